"""Language identification by interpolated Kneser-Ney character models held in sorted hash arrays.

One model of order ``ORDER`` a language is fitted on a bounded sample of labelled documents (half of
``SAMPLE_DOCS`` a language); the other half and as many more as ``SAMPLE_DOCS`` set the rejection thresholds, but for
those that another language's model fits better than their label's. Every document is scored whole
under every model; the language of the lowest cross-entropy per character wins (first in name on ties), and the
document is rejected when that cross-entropy is above what ``1 - FALSE_REJECTION`` of held-out documents of that
language and of such a length stay under.

Edges: null, empty and letterless texts have no language (null), a null cross-entropy and are rejected; a row with
null ``lang`` is no training row but is scored; repeated rows are scored alike; with no labelled row at all every row
is rejected; rows of null id are like others; only the named columns are read, and others pass untouched, whatever their names,
where rows are returned whole. A tie in cross-entropy goes to the first language by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GOLD, U64, claim, col, folded, fresh, mix, saved, slices, table, text_batches

ORDER, SAMPLE_DOCS, FALSE_REJECTION = 5, 800, 0.002
#: Languages of which a worker holds models at once; of more, texts are scored in passes.
MOST_LANGUAGES = 200
_CACHE_BITS = 18
SCHEMA = "language string, cross_entropy double, margin double, accepted boolean"


def _prepared(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with order - 1 start signs (code 1) before each text, and where each text begins."""
    codes, starts = folded(texts)
    n, pad = len(starts) - 1, order - 1
    at = starts + np.arange(n + 1) * pad
    out = np.ones(at[-1], dtype=np.uint32)
    inner = np.ones(at[-1], dtype=bool)
    for k in range(pad):
        inner[at[:-1] + k] = False
    out[inner] = codes
    return out, at


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """By position: the hash of the ``length`` code points that end there (shorter at the very start)."""
    h = np.zeros(len(codes), dtype=U64)
    for k in range(length - 1, -1, -1):
        h *= GOLD
        if k:
            h[k:] += codes[:-k].astype(U64)
        else:
            h += codes
    return mix(h + U64(length))


@dataclass
class Model:
    """Sorted hashes of n-grams with their interpolated log probabilities, and of contexts with their back-off weights."""

    languages: list[str]
    order: int
    grams: list[list[tuple[np.ndarray, np.ndarray]]]  # [language][order - 1]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]  # [language][order - 2]: of contexts of order - 1 signs
    floor: list[float]
    limits: np.ndarray | None = None  # by language: mean, spread, spread by length, threshold
    key: str = ""
    more: list[Model] = field(default_factory=list)  # of further languages, later in name

    def log_probabilities(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[position, language]: of the sign at each of ``ends`` after the order - 1 signs before it."""
        windows = [codes[ends - k].astype(U64) for k in range(self.order)]

        def hashed(first: int, length: int) -> np.ndarray:
            h = np.zeros(len(ends), dtype=U64)
            for k in range(first + length - 1, first - 1, -1):
                h *= GOLD
                h += windows[k]
            return mix(h + U64(length))

        of_gram = [hashed(0, n) for n in range(1, self.order + 1)]
        of_context = [hashed(1, n) for n in range(1, self.order)]
        out = np.empty((len(ends), len(self.languages)))
        for i in range(len(self.languages)):
            p = np.full(len(ends), self.floor[i])
            for n in range(1, self.order + 1):
                if n > 1:
                    at, hit = _found(self.contexts[i][n - 2][0], of_context[n - 2])
                    p += np.where(hit, self.contexts[i][n - 2][1][at], 0.0)
                at, hit = _found(self.grams[i][n - 1][0], of_gram[n - 1])
                p = np.where(hit, self.grams[i][n - 1][1][at], p)
            out[:, i] = p
        return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _row_hashes(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of code points, as ``Model`` looks it up."""
    h = np.zeros(len(grams), dtype=U64)
    for k in range(grams.shape[1]):
        h *= GOLD
        h += grams[:, k]
    return mix(h + U64(grams.shape[1]))


def fit_language(grams: np.ndarray, counts: np.ndarray, order: int) -> tuple[list, list, float]:
    """Kneser-Ney of one language from its distinct n-grams of the highest order [gram, sign] and their counts."""
    levels = [(grams, counts.astype(float))]
    for _ in range(order - 1):  # below the highest, a gram counts once for each sign that it was seen after
        shorter = levels[-1][0][:, 1:]
        _, first, n = np.unique(_row_hashes(shorter), return_index=True, return_counts=True)
        levels.append((shorter[first], n.astype(float)))
    levels.reverse()
    out, contexts, base = [], [], 1.0 / (len(levels[0][0]) + 1)
    floor = np.log(base)
    below_keys = below = np.zeros(0)
    for n, (level, c) in enumerate(levels, 1):
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = _row_hashes(level[:, :-1]) if n > 1 else np.zeros(len(level), dtype=U64)
        distinct, which = np.unique(context, return_inverse=True)
        total = np.bincount(which, weights=c)
        weight = discount * np.bincount(which) / total
        lower = base if n == 1 else below[np.searchsorted(below_keys, _row_hashes(level[:, 1:]))]
        p = (c - discount) / total[which] + weight[which] * lower
        if n == 1:
            floor = float(np.log(weight[0] * base)) if len(weight) else floor
        else:
            contexts.append((distinct, np.log(weight)))
        key = _row_hashes(level)
        order_of = np.argsort(key)
        below_keys, below = key[order_of], p[order_of]
        out.append((below_keys, np.log(below)))
    return out, contexts, floor


class Scorer:
    """Scores whole texts; the vectors of recently met n-grams are kept in a direct-mapped table."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.zeros(1 << _CACHE_BITS, dtype=U64)
        self.rows = np.zeros((1 << _CACHE_BITS, len(model.languages)))

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] in nats a sign, NaN for texts without a letter or digit; and each text's number of signs."""
        model, (codes, at) = self.model, _prepared(texts, self.model.order)
        sizes = np.diff(at) - (model.order - 1)
        h = _hashes(codes, model.order)
        slot = (h >> U64(64 - _CACHE_BITS)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != h)
        values = self.rows[slot]
        if len(missing):
            missing = missing[missing >= model.order - 1]
            new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            got = model.log_probabilities(codes, missing[first])
            values[missing] = got[which]
            self.keys[slot[missing[first]]], self.rows[slot[missing[first]]] = new, got
            # two new n-grams of one slot: the last stays, in both tables
        pads = (at[:-1, None] + np.arange(model.order - 1)).ravel()
        values[pads] = 0
        sums = np.add.reduceat(values, at[:-1], axis=0) if len(texts) else np.zeros((0, len(model.languages)))
        letters = np.add.reduceat((codes > 32).astype(np.int64), at[:-1]) if len(texts) else np.zeros(0)
        return np.where((letters > 0)[:, None], -sums / np.maximum(sizes, 1)[:, None], np.nan), sizes


def sample_of_labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, n: int) -> DataFrame:
    """(language, rank, text): of each language the n labelled documents of the lowest hash of id and text."""
    rows = docs.where(col(lang_col).isNotNull() & col(text_col).isNotNull()).select(col(lang_col).cast("string").alias("language"), F.xxhash64(col(id_col), col(text_col), F.lit(17)).alias("h"), col(text_col).alias("t"))
    of_each = Window.partitionBy("language").orderBy("h")
    lowest = rows.select("language", "h").withColumn("rank", F.row_number().over(of_each)).where(F.col("rank") <= n)
    last = lowest.groupBy("language").agg(F.max("h").alias("last"))  # a row a language, so it can be broadcast
    few = rows.join(F.broadcast(last), "language").where(F.col("h") <= F.col("last"))
    return few.withColumn("rank", F.row_number().over(of_each)).where(F.col("rank") <= n).drop("last")


def _gram_counts(order: int):
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, part in batch.groupby("language"):
                codes, at = _prepared(part["t"].tolist(), order)
                if len(codes) < order:
                    continue
                ends = np.setdiff1d(np.arange(order - 1, len(codes)), (at[:-1, None] + np.arange(order - 1)).ravel())
                grams = np.lib.stride_tricks.sliding_window_view(codes, order)[ends - order + 1]
                distinct, n = np.unique(grams, axis=0, return_counts=True)
                yield pd.DataFrame({"language": language, "gram": [bytes(g).decode("utf-32-le", "surrogatepass") for g in distinct], "n": n})

    return counts


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Model:
    sample = sample_of_labelled(docs, id_col, text_col, lang_col, 2 * sample_docs).persist()
    odd = (F.col("rank") % 2 == 1) & (F.col("rank") <= sample_docs)  # these train, others calibrate, so that a language of few documents has both
    counted = sample.where(odd).select("language", "t").mapInPandas(_gram_counts(order), "language string, gram string, n long")
    counts = counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).persist()
    names = sorted(r.language for r in sample.select("language").distinct().collect())
    parts = [_fit_part(sample, counts, odd, names[i : i + MOST_LANGUAGES], order) for i in range(0, max(1, len(names)), MOST_LANGUAGES)]
    model = parts[0]
    model.more = parts[1:]
    sample.unpersist()
    counts.unpersist()
    return model


def _fit_part(sample: DataFrame, counts: DataFrame, odd: Column, names: list[str], order: int) -> Model:
    fitted = {}
    for name in names:
        mine = counts.where(F.col("language") == name).select("gram", "n").toArrow()
        if not mine.num_rows:
            continue
        signs = np.frombuffer("".join(mine.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        fitted[name] = fit_language(signs.reshape(-1, order), np.asarray(mine.column("n")), order)
    model = Model(list(fitted), order, [x[0] for x in fitted.values()], [x[1] for x in fitted.values()], [x[2] for x in fitted.values()], key=uuid.uuid4().hex)
    model.limits = np.full((len(fitted), 4), np.inf)
    held = sample.where(~odd & F.col("language").isin(list(fitted)))
    shared = sample.sparkSession.sparkContext.broadcast(model)
    scored = held.select("language", F.pandas_udf(_held_out(shared), "own double, best boolean, size long")("language", "t").alias("s")).select("language", "s.*").toPandas()  # three numbers a text; none comes to the driver
    for i, name in enumerate(fitted):
        mine = scored[(scored["language"] == name) & scored["own"].notna()]
        model.limits[i] = limits_of(mine["own"].to_numpy()[mine["best"].to_numpy(dtype=bool)], mine["size"].to_numpy()[mine["best"].to_numpy(dtype=bool)])
    return model


def _held_out(broadcast):
    """Of each text its label's cross-entropy, whether that is the lowest, and the text's signs."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        claim("language_id", _scorers.clear)
        scorer = _scorer_of(broadcast.value)
        place = {name: i for i, name in enumerate(broadcast.value.languages)}
        for languages, texts in batches:
            own, best, size = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=np.int64)
            for at, to in slices(pa.array(texts, pa.string(), from_pandas=True), 1_000_000 // max(1, len(place))):
                ce, n = scorer.cross_entropies(texts.iloc[at:to].tolist())
                label = languages.iloc[at:to].map(place).to_numpy(dtype=np.int64)
                own[at:to], size[at:to] = ce[np.arange(to - at), label], n
                best[at:to] = np.where(np.isnan(ce), np.inf, ce).argmin(axis=1) == label
            yield pd.DataFrame({"own": own, "best": best, "size": size})

    def typed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return score(batches)

    return typed


def limits_of(x: np.ndarray, n: np.ndarray, false_rejection: float = FALSE_REJECTION) -> tuple[float, float, float, float]:
    """Centre, spread s0 and s1 with variance s0² + s1² / length, and the accepted number of spreads, of cross-entropies x of texts of n signs."""
    n = np.maximum(n, 1)
    if len(x) < 5:
        return 0.0, 1.0, 0.0, np.inf
    centre = np.median(x)
    off = np.minimum((x - centre) ** 2, np.quantile((x - centre) ** 2, 0.95))
    s = np.linalg.lstsq(np.stack([np.ones(len(x)), 1 / n], 1), off, rcond=None)[0].clip(0)
    s[0] = max(s[0], 1e-6)
    z = (x - centre) / np.sqrt(s[0] + s[1] / n)
    return centre, s[0], s[1], max(4.0, np.quantile(z, 1 - false_rejection))


def calibrate(model: Model, languages: list[str], texts: list[str], false_rejection: float = FALSE_REJECTION) -> np.ndarray:
    """By language the limits of held-out texts, but for those that another language's model fits better: they are mislabelled, or not of this language alone."""
    parts = [Scorer(model).cross_entropies(texts[i : i + 50]) for i in range(0, len(texts), 50)]
    ce, sizes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, len(model.languages))), np.zeros(0))
    out = np.full((len(model.languages), 4), np.inf)
    for i, name in enumerate(model.languages):
        mine = np.array([x == name for x in languages], dtype=bool) & ~np.isnan(ce[:, i])
        mine[mine] = ce[mine].argmin(axis=1) == i
        out[i] = limits_of(ce[mine, i], sizes[mine], false_rejection)
    return out


_scorers: dict[str, Scorer] = {}


def _scorer_of(model: Model) -> Scorer:
    """This worker's scorer of the model; it keeps one at a time."""
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = Scorer(model)
    return _scorers[model.key]


def _scored(broadcast):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("language_id", _scorers.clear)
        model: Model = broadcast.value
        scorer = _scorer_of(model)
        for batch in batches:
            texts = pa.array(batch, pa.string(), from_pandas=True)
            parts = [_decided(model, *scorer.cross_entropies(batch.iloc[at:to].where(batch.iloc[at:to].notna(), None).tolist())) for at, to in slices(texts, max(20_000, 1_000_000 // max(1, len(model.languages))))]
            yield pd.concat(parts, ignore_index=True) if parts else _decided(model, np.zeros((0, len(model.languages))), np.zeros(0))

    return score


def _decided(model: Model, ce: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    n = len(ce)
    if not model.languages:
        return pd.DataFrame({"language": [None] * n, "cross_entropy": [None] * n, "margin": [None] * n, "accepted": [False] * n})
    some = ~np.isnan(ce).all(axis=1)
    known = np.where(some[:, None], ce, 0.0)
    best = known.argmin(axis=1)
    low = np.sort(known, axis=1)
    centre, s0, s1, most = model.limits[best].T
    accepted = some & (low[:, 0] - centre <= most * np.sqrt(s0 + s1 / np.maximum(sizes, 1)))
    return pd.DataFrame({
        "language": np.where(some, np.array(model.languages, dtype=object)[best], None),
        "cross_entropy": np.where(some, low[:, 0], np.nan),
        "margin": np.where(some, low[:, 1] - low[:, 0] if low.shape[1] > 1 else 0.0, np.nan),
        "accepted": accepted,
    })


def identified(docs: DataFrame, model: Model, text_col: str = "text", result: str = "language_id") -> DataFrame:
    """docs with one more column ``result`` (struct of SCHEMA). Map-only for at most ``MOST_LANGUAGES``; of more, each pass over them saves docs with the best so far."""
    if result.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {result}")
    (more,) = fresh(docs, "next_result")

    def scored(part: Model) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(replace(part, more=[]))
        return F.pandas_udf(_typed(_scored(shared)), SCHEMA).asNondeterministic()(col(text_col))  # else a filter on it scores every text twice

    done = docs.withColumn(result, scored(model))
    for part in model.more:
        if part.languages:
            both = saved(done.withColumn(more, scored(part)), "languages")
            done = both.withColumn(result, _lower(result, more, len(model.languages) == 1 and part is model.more[0], len(part.languages) == 1)).drop(more)
    return done


def _lower(one: str, other: str, lone: bool, other_lone: bool) -> Column:
    """Of two results the one of the lower cross-entropy, the first on ties, with the margin to the second of all; a lone model has no margin of its own."""
    a, b = col(one), col(other)
    gap = F.abs(a["cross_entropy"] - b["cross_entropy"])
    margin = lambda x, alone: gap if alone else F.least(gap, x["margin"])
    first = a.withField("margin", margin(a, lone))
    return F.when(a["language"].isNull(), b).when(b["language"].isNull(), a).when(b["cross_entropy"] < a["cross_entropy"], b.withField("margin", margin(b, other_lone))).otherwise(first)


def _typed(function):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return function(batches)

    return score


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs)).select("doc_id", "language_id.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; ``lang`` of the others becomes the language found."""
    text_batches(spark)
    (result,) = fresh(docs, "language_id")
    found = identified(docs, fit(docs), result=result).where(F.col(result)["accepted"])
    return found.withColumn("lang", F.col(result)["language"]).select([col(c) for c in docs.columns])
