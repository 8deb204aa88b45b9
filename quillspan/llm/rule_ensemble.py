"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

Statistics of a text are plain Catalyst expressions. Boosted regression trees are fitted on a bounded sample of labelled
documents; every path from a root becomes a conjunctive rule; a logistic regression with an L1 penalty weighs the
rules, the penalty chosen on held-out rows; the rules that keep a weight become one Spark expression. So
scoring reads each text once, in the JVM, with no Python and no exchange.

Edges: a null text has null statistics, a null score and ``keep`` false; an empty text has statistics of 0 and is scored;
labels without a document or of null quality are no training rows, repeated labels count each; with no labelled row, or
labels of one kind only, every text gets that kind's share (1 with none) as its score; ties at a cut go left;
an empty table gives an empty result; columns but those named are passed on, except that ``quality_score`` and ``keep`` are
replaced; other columns may have any names. Rows of null id are scored; ids may be of any type.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, table

#: Labelled rows that are used at most: those of the lowest hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_ROWS, RATE = 24, 3, 32, 20, 0.3
#: A document is kept at this score or above.
KEEP_AT = 0.5


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text by name, all of them 0 for an empty one."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.when(text.isNotNull(), 0.0))
    chars, words = F.length(text).cast("double"), F.size(F.split(F.trim(text), r"\s+")).cast("double")
    bare = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")).cast("double")
    lines = F.split(text, "\n")
    pieces = F.split(F.trim(text), r"\s+")
    return {
        "length": F.log1p(chars),
        "word_length": over(chars, words),
        "upper": over(count(r"\p{Lu}"), chars),
        "digits": over(count(r"[0-9]"), chars),
        "signs": over(bare, chars),
        "odd_signs": over(count(r"[#$%&*|<>{}\[\]\\^~=+@_]"), chars),
        "shouts": over(count(r"[!?]"), chars),
        "stops": over(count(r"[.]"), words),
        "commas": over(count(r"[,;:]"), words),
        "line_length": over(chars, F.size(lines).cast("double")),
        "line_repeats": over(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines).cast("double")),
        "word_repeats": over(words - F.size(F.array_distinct(pieces)), words),
        "short_words": over(count(r"(?<!\S)\S{1,3}(?!\S)"), words),
        "long_words": over(count(r"\S{15,}"), words),
    }


NAMES = ("length", "word_length", "upper", "digits", "signs", "odd_signs", "shouts", "stops", "commas", "line_length", "line_repeats", "word_repeats", "short_words", "long_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, cut)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, cut in self.terms:
            out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{NAMES[k]} {'>' if above else '<='} {cut:.4g}" for k, above, cut in self.terms)


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as an expression over the statistics."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            condition = None
            for k, above, cut in rule.terms:
                c = stats[NAMES[k]] > F.lit(float(cut)) if above else stats[NAMES[k]] <= F.lit(float(cut))
                condition = c if condition is None else condition & c
            z = z + F.when(condition, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def tree_rules(binned: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, hessian: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Every path of one regression tree on gradients, and the tree's prediction of each row."""
    rules: list[Rule] = []
    out = np.zeros(len(target))

    def grow(rows: np.ndarray, terms: tuple, left: int) -> None:
        g, h = target[rows].sum(), hessian[rows].sum()
        best = (1e-9, -1, -1)
        if left and len(rows) >= 2 * least:
            for k in range(binned.shape[1]):
                if not len(cuts[k]):
                    continue
                b = binned[rows, k]
                n = len(cuts[k]) + 1
                gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (target[rows], hessian[rows], np.ones(len(rows))))
                gain = np.where((ns >= least) & (len(rows) - ns >= least), gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], k, at)
        if terms:
            rules.append(Rule(terms))
        if best[1] < 0:
            out[rows] = g / (h + 1)
            return
        _, k, at = best
        low = binned[rows, k] <= at
        grow(rows[low], (*terms, (k, False, float(cuts[k][at]))), left - 1)
        grow(rows[~low], (*terms, (k, True, float(cuts[k][at]))), left - 1)

    grow(np.arange(len(target)), (), depth)
    return rules, out


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, least: int = LEAST_ROWS, rate: float = RATE) -> list[Rule]:
    """The distinct paths of gradient-boosted trees for the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    base = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    f, found = np.full(len(y), np.log(base / (1 - base))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rules, step = tree_rules(binned, cuts, y - p, np.maximum(p * (1 - p), 1e-6), depth, least)
        f += rate * step
        found |= dict.fromkeys(rules)
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray] | None = None, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on the weights (mean loss), by accelerated proximal gradients."""
    n, m = z.shape
    b, w = start or (0.0, np.zeros(m))
    size = 4.0 / max(1e-9, np.linalg.norm(np.hstack([z, np.ones((n, 1))]), 2) ** 2 / n)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ vw + vb)))
        nb = vb - size * float((p - y).mean())
        nw = vw - size * (z.T @ (p - y)) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        moved = abs(nb - b) + np.abs(nw - w).max(initial=0)
        b, w, t = nb, nw, nt
        if moved < 1e-6:
            break
    return b, w


def _loss(z: np.ndarray, y: np.ndarray, b: float, w: np.ndarray) -> float:
    s = z @ w + b
    return float((np.logaddexp(0, s) - y * s).mean())


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules and weights from statistics [row, statistic] and labels 0/1."""
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0, constant=float(y[0]) if len(y) else 1.0)
    held = np.arange(len(y)) % 4 == 3
    if held.sum() < 10 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    train = ~held
    rules = boosted_rules(x[train], y[train])
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    if not rules:
        share = float(y.mean())
        return RuleModel(float(np.log(share / (1 - share))))
    largest = np.abs(z[train].T @ (y[train] - y[train].mean())).max() / train.sum()
    base = float(np.log(y.mean() / (1 - y.mean())))
    state, best = (base, np.zeros(len(rules))), (np.inf, base, np.zeros(len(rules)))
    check = held if held.any() else train
    for share in np.geomspace(0.5, 0.002, 9):
        state = lasso(z[train], y[train], share * largest, state)
        loss = _loss(z[check], y[check], *state)
        if loss < best[0] * 0.99:  # a smaller penalty must earn its further rules
            best = (loss, *state)
    _, b, w = best
    kept = [i for i in np.argsort(-np.abs(w)) if abs(w[i]) > 1e-3]
    return RuleModel(float(b), [rules[i] for i in kept], [float(w[i]) for i in kept])


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample_rows`` labelled documents, in order of their id's hash."""
    sample = labels.where(col(id_col).isNotNull() & col(label_col).isNotNull()).select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    # the sample is bounded by its parameter, so it may be broadcast whatever the size of the corpus
    texts = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("doc"), col(text_col).alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("doc") == F.col("id"))
    got = joined.select(F.xxhash64("id").alias("h"), "y", *[c.alias(n) for n, c in statistics(F.col("text")).items()]).toPandas()
    got = got.sort_values(["h", "y", *NAMES], kind="stable")
    return got[list(NAMES)].to_numpy(dtype=float), (got["y"].to_numpy() > 0).astype(float)


def with_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """docs with ``quality_score`` and ``keep``; one projection of built-in expressions."""
    stats = statistics(col(text_col))
    (held,) = fresh(docs, "stats")
    rows = docs.withColumn(held, F.struct(*[c.alias(n) for n, c in stats.items()]))
    score = F.when(col(text_col).isNotNull(), model.column({n: F.col(held)[n] for n in NAMES}))
    rows = rows.withColumn("quality_score", score)
    return rows.withColumn("keep", F.coalesce(F.col("quality_score") >= keep_at, F.lit(False))).drop(held)


def train(docs: DataFrame, labels: DataFrame, **options) -> RuleModel:
    return fit_rules(*labelled_statistics(docs, labels, **options))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_quality(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "quality_score", "keep")
