"""Benchmark decontamination by q-gram counts in overlapping diagonal bands and banded alignment.

Texts and items are compared as lower-case letters and digits with single spaces. A passage of a document within
``k`` edits of an item of ``m`` signs shares at least ``m - q + 1 - k q`` of its q-grams on diagonals that differ by
at most ``k``, so it is found in one of the bands of width ``2 (k + 1)`` laid every ``k + 1`` diagonals. Bands that
reach this count are verified by a banded alignment of the whole item. ``k`` is ``EDIT_RATE`` of ``m``, less where
that would leave no q-gram to count on.

An item matches as a whole: a document that holds only a part of one isn't found.

Edges: null, empty and letterless texts match nothing; items of fewer than ``q`` signs have no q-gram to count and match
exactly, between word boundaries; null ids are kept as nulls and ids may be of any type; repeated documents give the same rows
again and repeated items each their own; an empty table on either side gives no row; only the named columns are read, whatever
others are called. Of several passages the one of fewest edits is reported.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructType

from .common import GOLD, U64, claim, col, folded, mix, slices, table, text_batches, type_of

Q, EDIT_RATE = 10, 0.08
#: Signs of benchmark text in one broadcast index; a larger benchmark is searched in several passes, each of this size.
INDEX_CHARS = 8_000_000
#: Pairs of places of equal grams that are laid out at once; a text of more is counted by diagonals.
MOST_PAIRS = 20_000_000


def budget(m: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits allowed for an item of m signs: the rate's, as far as the count bound stays at least 1."""
    return max(0, min(int(rate * m), (m - q) // q))


def _rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q signs that begin at each position (meaningless for the last q - 1), by doubling."""
    powers, part = {1: codes.astype(U64)}, 1
    multiplier = {1: GOLD}
    while part * 2 <= q:
        h = powers[part] * multiplier[part]
        h[:-part] += powers[part][part:]
        powers[part * 2], multiplier[part * 2] = h, U64(int(multiplier[part]) ** 2 & 0xFFFFFFFFFFFFFFFF)
        part *= 2
    out, at = powers[part].copy(), part
    for size in sorted((s for s in powers if s < part), reverse=True):
        while at + size <= q:
            out *= multiplier[size]
            out[:-at] += powers[size][at:]
            at += size
    return mix(out)


@dataclass
class Index:
    ids: pa.Array
    texts: list[np.ndarray]
    keys: np.ndarray  # sorted distinct q-gram hashes
    first: np.ndarray  # postings of key i: first[i] .. first[i + 1]
    item: np.ndarray
    place: np.ndarray
    bloom: np.ndarray
    shift: np.uint64  # of a hash to its place in the filter
    short: list[tuple[int, np.ndarray, np.ndarray]]  # (signs, sorted hashes of short items between spaces, their items)
    budgets: np.ndarray
    needed: np.ndarray
    q: int
    key: str


def build_index(ids: pa.Array, texts: list[str | None], q: int = Q, rate: float = EDIT_RATE) -> Index:
    codes, starts = folded(texts)
    parts, hashes, item, place, small = [], [], [], [], {}
    for i in range(len(texts)):
        text = codes[starts[i] + 1 : starts[i + 1]]
        text = text[:-1] if len(text) and text[-1] == 32 else text
        parts.append(text)
        if 0 < len(text) < q:
            between = np.concatenate([[32], text, [32]]).astype(np.uint32)
            small.setdefault(len(text), []).append((_rolling(between, len(between))[0], i))
        if len(text) >= q:
            h = _rolling(text, q)[: len(text) - q + 1]
            hashes.append(h)
            item.append(np.full(len(h), i, dtype=np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    bits = min(26, max(16, int(len(keys) * 8).bit_length()))  # an eighth full at most, up to 8 million grams
    shift = U64(64 - bits)
    bloom = np.zeros(1 << bits, dtype=bool)
    bloom[keys >> shift] = True
    short = []
    for m, found in sorted(small.items()):
        h_short, which = np.array([x for x, _ in found], dtype=U64), np.array([i for _, i in found], dtype=np.int64)
        by_hash = np.argsort(h_short, kind="stable")
        short.append((m, h_short[by_hash], which[by_hash]))
    sizes = np.array([len(t) for t in parts], dtype=np.int64)
    budgets = np.array([budget(m, rate, q) for m in sizes], dtype=np.int64)
    cat = lambda xs: np.concatenate(xs)[order] if xs else np.zeros(0, dtype=np.int32)
    return Index(ids, parts, keys, np.append(first, len(h)), cat(item), cat(place), bloom, shift, short, budgets, np.maximum(1, sizes - q + 1 - budgets * q), q, uuid.uuid4().hex)


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> int:
    """Fewest edits that turn item into a piece of region beginning at ``low`` to ``high``; over ``most``: most + 1.

    Cell (i, d) aligns item[:i] with what ends at region[low + d - most + i]; paths stay within ``most`` diagonals.
    """
    width = high - low + 2 * most + 1
    base = low - most
    big = most + 1
    steps = np.arange(width)
    starts = steps + base
    row = np.where((starts >= low) & (starts <= high) & (starts >= 0) & (starts <= len(region)), 0, big)
    padded = np.zeros(len(item) + width + 2, dtype=np.int64) - 1
    source = np.arange(base, base + len(padded))
    inside = (source >= 0) & (source < len(region))
    padded[inside] = region[source[inside]]
    for i, sign in enumerate(item.astype(np.int64)):
        there = padded[i : i + width]
        new = row + (there != sign)
        new[there < 0] = big
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum(np.minimum.accumulate(new - steps) + steps, big)
        if new.min() > most:
            return big
        row = new
    return int(row.min())


class Searcher:
    def __init__(self, index: Index):
        self.index = index

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text, item, fewest edits) of every text that holds a passage within the item's budget."""
        codes, starts = folded(texts)
        return self._short(codes, starts) + self._long(codes, starts, len(texts))

    def _short(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """Items of fewer signs than a gram, as whole words. The space before the next text, or one more, ends the last word."""
        found: set[tuple[int, int]] = set()
        if self.index.short and len(codes):
            codes = np.append(codes, np.uint32(32))
        for m, hashes, items in self.index.short:
            if len(codes) < m + 2:
                continue
            h = _rolling(codes, m + 2)[: len(codes) - m - 1]
            low = np.searchsorted(hashes, h)
            at = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h)
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + m + 1 <= starts[doc + 1]
            for d, i in zip(doc[inside], low[at[inside]]):
                to = np.searchsorted(hashes, hashes[i], side="right")
                found |= {(int(d), int(k)) for k in items[i:to]}
        return [(d, i, 0) for d, i in sorted(found)]

    def _long(self, codes: np.ndarray, starts: np.ndarray, n_texts: int) -> list[tuple[int, int, int]]:
        x = self.index
        if len(codes) < x.q or not len(x.keys):
            return []
        h = _rolling(codes, x.q)
        at = np.flatnonzero(x.bloom[h >> x.shift])
        key = np.minimum(np.searchsorted(x.keys, h[at]), len(x.keys) - 1)
        hit = x.keys[key] == h[at]
        at, key = at[hit], key[hit]
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = at + x.q <= starts[doc + 1]
        at, key, doc = at[inside], key[inside], doc[inside]
        # a text with fewer hits than any item needs holds none
        enough = np.bincount(doc, minlength=n_texts)[doc] >= x.needed.min()
        at, key, doc = at[enough], key[enough], doc[enough]
        if not len(at):
            return []
        n = x.first[key + 1] - x.first[key]
        work = np.bincount(doc, weights=n, minlength=n_texts)
        heavy = work > MOST_PAIRS  # a text and items that repeat few grams over and over
        bands = [self._banded(at[some], key[some], doc[some]) for some in self._shares(heavy[doc], doc, n)]
        for d in np.flatnonzero(heavy):
            bands += list(self._counted(at[doc == d], key[doc == d], int(d), int(starts[d]), int(starts[d + 1])))
        best: dict[int, int] = {}
        for p, low, high in ((int(p), int(a), int(b)) for band in bands for p, a, b in zip(*band)):
            d, i = divmod(p, len(x.texts))
            k = int(x.budgets[i])
            if best.get(p, k + 1) == 0:
                continue
            # a start may lie k diagonals before or after any diagonal that has hits
            first, last = low - starts[d] - k, high - starts[d] + k
            base = max(0, first - k)
            region = codes[starts[d] + base : min(starts[d + 1], starts[d] + last + len(x.texts[i]) + 2 * k + 1)]
            edits = banded_distance(x.texts[i], region, first - base, last - base, k)
            if edits <= k:
                best[p] = min(edits, best.get(p, edits))
        return [(*divmod(p, len(x.texts)), e) for p, e in best.items()]

    @staticmethod
    def _shares(heavy: np.ndarray, doc: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        """The hits of texts that aren't heavy, in runs of whole texts of about ``MOST_PAIRS`` pairs of places."""
        rest = np.flatnonzero(~heavy)
        if len(rest):
            done = np.cumsum(n[rest])
            share = (done - n[rest]) // MOST_PAIRS
            share = np.maximum.accumulate(np.where(np.append(True, doc[rest][1:] != doc[rest][:-1]), share, 0))
            yield from np.split(rest, np.flatnonzero(np.diff(share)) + 1)

    def _banded(self, at: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text and item, lowest, highest diagonal) of bands with enough hits, from every pair of places."""
        x = self.index
        n = x.first[key + 1] - x.first[key]
        which = np.repeat(np.arange(len(at)), n)
        post = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x.first[key], n)
        item, diagonal, doc = x.item[post].astype(np.int64), at[which] - x.place[post], doc[which]
        pair = doc * len(x.texts) + item
        # per text and item first, which needs no bands
        distinct, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        some = (count >= x.needed[distinct % len(x.texts)])[back]
        pair, diagonal = pair[some], diagonal[some]
        if not len(pair):
            return pair, pair, pair
        stride = x.budgets[pair % len(x.texts)] + 1
        band = diagonal // stride
        pair, diagonal, band = np.concatenate([pair, pair]), np.concatenate([diagonal, diagonal]), np.concatenate([band, band - 1])
        order = np.lexsort((band, pair))
        pair, diagonal, band = pair[order], diagonal[order], band[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])
        begin = np.flatnonzero(new)
        full = np.diff(np.append(begin, len(pair))) >= x.needed[pair[begin] % len(x.texts)]
        return pair[begin][full], np.minimum.reduceat(diagonal, begin)[full], np.maximum.reduceat(diagonal, begin)[full]

    def _counted(self, at: np.ndarray, key: np.ndarray, d: int, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for one text by counting hits on each diagonal: of a gram with many places on both sides by a product of transforms, without its pairs."""
        x = self.index
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        keys, begin = np.unique(key, return_index=True)
        ends = np.append(begin[1:], len(key))
        post = np.concatenate([np.arange(x.first[k], x.first[k + 1]) for k in keys])
        gram = np.repeat(np.arange(len(keys)), [x.first[k + 1] - x.first[k] for k in keys])
        by_item = np.argsort(x.item[post], kind="stable")
        items, first = np.unique(x.item[post][by_item], return_index=True)
        for i, mine in zip(items.astype(int), np.split(by_item, first[1:])):
            m, k = len(x.texts[i]), int(x.budgets[i])
            size = end - start + m + 1
            hits = np.zeros(size)
            for g in np.unique(gram[mine]):
                of_text, of_item = at[begin[g] : ends[g]] - start, x.place[post[mine[gram[mine] == g]]]
                if len(of_text) * len(of_item) <= 200_000:
                    np.add.at(hits, (of_text[:, None] - of_item[None, :] + m).ravel(), 1)
                else:
                    one, two = np.zeros(2 * size), np.zeros(2 * size)
                    one[of_text], two[m - of_item] = 1, 1
                    hits += np.rint(np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(two), 2 * size))[:size]
            upto = np.concatenate([[0.0], np.cumsum(hits)])
            low = np.arange(0, size, k + 1)
            high = np.minimum(low + 2 * (k + 1), size)
            full = upto[high] - upto[low] >= x.needed[i]
            yield np.full(full.sum(), d * len(x.texts) + i), low[full] - m + start, high[full] - 1 - m + start


_searchers: dict[str, Searcher] = {}


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """(id_col, item_id, edits, budget): every document that holds a passage of an item. Map-only over the documents.

    The items' index is broadcast in parts of at most ``INDEX_CHARS`` signs, one pass over the documents each.
    """
    spark = docs.sparkSession
    schema = StructType().add(id_col, type_of(docs, id_col)).add("item_id", type_of(benchmark, item_id)).add("edits", IntegerType()).add("budget", IntegerType())
    item_type = to_arrow_type(type_of(benchmark, item_id))
    out, ids, texts, size = None, [], [], 0

    def searched() -> DataFrame:
        shared = spark.sparkContext.broadcast(build_index(pa.array(ids, item_type), texts, q, rate))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("decontamination", _searchers.clear)
            index: Index = shared.value
            if index.key not in _searchers:
                _searchers.clear()
                _searchers[index.key] = Searcher(index)
            for batch in batches:
                for at, to in slices(batch.column(1)):
                    part = batch.slice(at, to - at)
                    if hits := _searchers[index.key].matches(part.column(1).to_pylist()):
                        rows, items, edits = map(np.array, zip(*hits))
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(rows)), index.ids.take(pa.array(items)), pa.array(edits.astype(np.int32)), pa.array(index.budgets[items].astype(np.int32))],
                            names=[id_col, "item_id", "edits", "budget"],
                        )

        return docs.select(col(id_col), col(text_col)).mapInArrow(found, schema)

    for row in benchmark.select(col(item_id).alias("i"), col(item_text).alias("t")).toLocalIterator():
        if size + len(row.t or "") > INDEX_CHARS and ids:
            out = searched() if out is None else out.unionAll(searched())
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t or "")
    return (searched() if out is None else out.unionAll(searched())) if ids else spark.createDataFrame([], schema)


def flagged(texts: pd.Series, index: Index) -> pd.Series:
    """Whether each text holds a passage of an item."""
    if index.key not in _searchers:
        _searchers.clear()
        _searchers[index.key] = Searcher(index)
    out = np.zeros(len(texts), dtype=bool)
    for at, to in slices(pa.array(texts, pa.string(), from_pandas=True)):
        part = texts.iloc[at:to]
        for d, _, _ in _searchers[index.key].matches(part.where(part.notna(), None).tolist()):
            out[at + d] = True
    return pd.Series(out)


def without_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, all columns kept; a filter, with no shuffle."""
    spark, texts, size, conditions = docs.sparkSession, [], 0, []

    def clean():
        shared = spark.sparkContext.broadcast(build_index(pa.nulls(len(texts)), texts, q, rate))

        @F.pandas_udf("boolean")
        def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            claim("decontamination", _searchers.clear)
            for batch in batches:
                yield flagged(batch, shared.value)

        return ~holds(col(text_col))

    for row in benchmark.select(col(item_text).alias("t")).toLocalIterator():
        if size + len(row.t or "") > INDEX_CHARS and texts:
            conditions.append(clean())
            texts, size = [], 0
        texts.append(row.t)
        size += len(row.t or "")
    if texts:
        conditions.append(clean())
    for condition in conditions:
        docs = docs.where(condition)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go."""
    text_batches(spark)
    return without_contamination(docs, table(spark, sf_dir, "benchmark"))
