"""The fitted models against plain versions of their definitions, and the pipeline stage by stage."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import language_id as L
from quillspan.llm import rule_ensemble as R
from quillspan.llm.decontamination import Q, budget
from quillspan.llm.vocabulary import PATTERN, encoder_of, read_vocabulary

SF = "/root/testdata/sf0.001"


class PlainKneserNey:
    """Interpolated Kneser-Ney over strings and dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        counts = Counter()
        for t in texts:
            padded = "\x01" * (order - 1) + t
            counts.update(padded[i : i + order] for i in range(len(padded) - order + 1))
        self.levels = [counts]
        for _ in range(order - 1):
            shorter = Counter()
            for gram in self.levels[0]:
                shorter[gram[1:]] += 1
            self.levels.insert(0, shorter)
        self.base = 1 / (len(self.levels[0]) + 1)
        self.totals, self.kinds, self.discounts = [], [], []
        for level in self.levels:
            total, kinds = Counter(), Counter()
            for gram, c in level.items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            ones, twos = (sum(c == k for c in level.values()) for k in (1, 2))
            self.totals.append(total)
            self.kinds.append(kinds)
            self.discounts.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(self, gram):
        if not gram:
            return self.base
        n = len(gram)
        lower, total, d = self.p(gram[1:]), self.totals[n - 1][gram[:-1]], self.discounts[n - 1]
        if not total:
            return lower
        c = self.levels[n - 1][gram]
        return (max(c - d, 0) if c else 0) / total + d * self.kinds[n - 1][gram[:-1]] / total * lower

    def cross_entropy(self, text):
        padded = "\x01" * (self.order - 1) + text
        return -sum(math.log(self.p(padded[i : i + self.order])) for i in range(len(text))) / len(text)


def folded(text):
    return " " + " ".join(re.findall(r"[^\W_]+", text.lower()))


def test_kneser_ney_is_the_plain_one():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcde", weights=(9, 5, 3, 2, 1), k=rng.randint(1, 5))) for _ in range(30)) for _ in range(6)]
    for order in (1, 2, 3, 5):
        plain = PlainKneserNey([folded(t) for t in texts[:4]], order)
        codes, at = L._prepared(texts[:4], order)
        ends = np.setdiff1d(np.arange(order - 1, len(codes)), (at[:-1, None] + np.arange(order - 1)).ravel())
        grams = np.lib.stride_tricks.sliding_window_view(codes, order)[ends - order + 1]
        fitted = L.fit_language(*np.unique(grams, axis=0, return_counts=True), order)
        model = L.Model(["x"], order, [fitted[0]], [fitted[1]], [fitted[2]])
        tried = [*texts, "new words of other letters"]
        got = L.Scorer(model).cross_entropies(tried)[0][:, 0]
        assert got == pytest.approx([plain.cross_entropy(folded(t)) for t in tried], rel=1e-9)


def test_language_ties_go_to_the_first_name():
    limits = np.tile([0.0, 1.0, 0.0, np.inf], (2, 1))
    model = L.Model(["a", "b"], 1, [], [], [], limits)
    got = L._decided(model, np.array([[1.0, 1.0], [2.0, 1.0], [np.nan, np.nan]]), np.array([5, 5, 1]))
    assert got["language"].tolist() == ["a", "b", None] and got["margin"].tolist()[:2] == [0.0, 1.0] and got["accepted"].tolist() == [True, True, False]


def test_a_stump_is_the_best_by_trying_all():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float)
    y[x[:, 1] > 3] = 1
    (low, high) = R.boosted_rules(x, y, trees=1, depth=1, bins=200, least=5)
    p = y.mean()
    g, h = y - p, np.full(80, p * (1 - p))

    def gain(k, cut):
        left = x[:, k] <= cut
        if min(left.sum(), (~left).sum()) < 5:
            return -1
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - part(np.ones(80, bool))

    best = max((gain(k, c), k, c) for k in range(3) for c in np.unique(x[:, k]))
    (k, above, cut) = low.terms[0]
    assert not above and high.terms[0] == (k, True, cut) and gain(k, cut) == pytest.approx(best[0])


def test_tree_paths_partition_the_rows():
    rng = np.random.default_rng(4)
    x, y = rng.random((300, 4)), rng.integers(0, 2, 300).astype(float)
    rules = R.boosted_rules(x, y, trees=1, depth=3)
    ends = [r for r in rules if not any(set(r.terms) < set(o.terms) for o in rules)]
    assert (sum(r.holds(x).astype(int) for r in ends) == 1).all()


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(5)
    z = rng.integers(0, 2, (200, 12)).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 3])))).astype(float)
    for penalty in (0.02, 0.005):
        b, w = R.lasso(z, y, penalty, steps=20_000)
        p = 1 / (1 + np.exp(-(z @ w + b)))
        gradient = z.T @ (p - y) / 200
        assert abs((p - y).mean()) < 1e-4 and (np.abs(gradient[w == 0]) <= penalty + 1e-4).all()
        assert np.allclose(gradient[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-4) and w[0] > 0 > w[3]


def semi_global(item, text):
    """Fewest edits that turn item into a piece of text, a row of the table at a time."""
    t = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    row, steps = np.zeros(len(t) + 1, dtype=np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(np.frombuffer(item.encode("utf-32-le"), dtype=np.uint32), 1):
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (t != c)))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    names, stages = docs.columns, dict(pipe.STAGES)
    # languages: what stays is what the label's language is found for
    first = stages["language_id"](spark, docs, SF).persist()
    before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in first.collect()}
    assert first.columns == names and len(after) >= 0.98 * len(before) and all(before[i].text == r.text for i, r in after.items())
    assert sum(before[i].lang == r.lang for i, r in after.items()) >= 0.98 * len(after)
    # near copies: the least id of each class of documents joined by similar gram sets
    second = stages["jaccard_join"](spark, first, SF).persist()
    sets = {i: {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if (w := re.findall(r"[^\W_]+", (r.text or "").lower())) else set() for i, r in after.items()}
    holders = defaultdict(set)
    for i, grams in sets.items():
        for g in grams:
            holders[g].add(i)
    least = {i: i for i in sets}
    links = {(i, j) for i in sets for j in set().union(*(holders[g] for g in sets[i])) if i < j and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            changed = changed or least[i] != low or least[j] != low
            least[i] = least[j] = low
    kept = {r.doc_id for r in second.collect()}
    assert second.columns == names and kept == {i for i in sets if least[i] == i} and len(links) > 3
    # benchmark passages
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = stages["decontamination"](spark, second, SF).persist()
    plain = {i: " ".join(re.findall(r"[^\W_]+", (after[i].text or "").lower())) for i in kept}
    near = {i for i in kept for item in items if len(item) >= Q and len(plain[i]) <= 20_000 and semi_global(item, plain[i]) <= budget(len(item))}
    left = {r.doc_id for r in third.collect()}
    assert third.columns == names and not near & left and {i for i in kept - left if len(plain[i]) <= 20_000} == near
    # mixing: copies are rates rounded by each row's own coin
    encode = encoder_of(read_vocabulary(), PATTERN).encode_ordinary
    fourth = stages["source_mixing"](spark, third, SF).persist()
    copies = Counter(r.doc_id for r in fourth.collect())
    tokens = {i: len(encode(after[i].text or "")) for i in left}
    whole = sum(tokens.values())
    by = Counter()
    for i, n in copies.items():
        by[after[i].source] += n * tokens[i]
    assert fourth.columns == names and set(copies) <= left and 0.7 * whole < sum(by.values()) < 1.3 * whole
    # records
    rows = stages["token_binary"](spark, fourth, SF).collect()
    assert Counter(r.doc_id for r in rows if r.shard >= 0) == copies and all(r.n_tokens == tokens[r.doc_id] for r in rows if r.shard >= 0 and r.n_tokens is not None)
    none = docs.where("false")
    for _, stage in pipe.STAGES[:-1]:
        none = stage(spark, none, SF)
        assert none.columns == names and none.count() == 0
