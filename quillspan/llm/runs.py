"""Runs of equal keys: the pairs within each, however long a run is.

Keys and nodes travel as packed arrays of 64 bits by hash bucket and are sorted there, so no row is made for each. A run of
more than ``RUN`` nodes, and every run of a bucket that is far too large, goes on as rows: its nodes are dealt into groups, and
every two groups meet in a task of their own, so no task holds such a run as a whole and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, dropped, saved

#: Nodes of a run that one task pairs; keys that a bucket may hold before it is divided.
RUN, BUCKET_MOST = 4000, 6_000_000
#: Buckets that a task takes, about.
BUCKETS_A_TASK = 5
PACKED = "bucket int, a binary, b binary, c binary"
_ROWS = "x long, y long, sure boolean"

#: (nodes, payloads, nodes or None, payloads or None) -> blocks of (x, y, sure): the pairs within the first, or between both.
Pairs = Callable[[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def packed_rows(key: np.ndarray, node: np.ndarray, buckets: int, payload: np.ndarray | None = None) -> tuple[list[int], list[bytes], list[bytes], list[bytes | None]]:
    """(bucket, keys, nodes, payloads) with one entry for each bucket that occurs; a payload is a row of bytes."""
    bucket = ((key.view(U64) >> U64(32)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    distinct, first = np.unique(bucket, return_index=True)
    last = np.append(first[1:], len(bucket))
    parts = [order[i:j] for i, j in zip(first, last)]
    return distinct.tolist(), [key[p].tobytes() for p in parts], [node[p].tobytes() for p in parts], [None if payload is None else payload[p].tobytes() for p in parts]


def _sorted_runs(key: np.ndarray, node: np.ndarray, payload: np.ndarray | None):
    """(nodes, payloads, starts, sizes, keys of runs) of distinct (key, node), by key."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    payload = None if payload is None else payload[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])) if len(key) else np.zeros(0, dtype=bool)
    key, node = key[fresh], node[fresh]
    payload = None if payload is None else payload[fresh]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    return node, payload, begin, np.diff(np.append(begin, len(key))), key


class _Held:
    """Distinct pairs on their way out, a sure pair before an unsure one."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.parts, self.n = most, [], 0

    def add(self, x: np.ndarray, y: np.ndarray, sure: np.ndarray) -> Iterator[pa.RecordBatch]:
        low, high = np.minimum(x, y), np.maximum(x, y)
        self.parts.append(np.stack([low, high, (~sure).astype(np.int64)], axis=1))
        self.n += len(low)
        if self.n > self.most:
            self.parts = [self.distinct()]
            self.n = len(self.parts[0])
            if self.n > self.most // 2:
                yield from self.out()

    def distinct(self) -> np.ndarray:
        pairs = np.concatenate(self.parts)
        pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
        return pairs[np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1))] if len(pairs) else pairs

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            pairs = self.distinct()
            self.parts, self.n = [], 0
            for i in range(0, len(pairs), 500_000):
                p = pairs[i : i + 500_000]
                yield _batch(p[:, 0], p[:, 1], p[:, 2] == 0)


def _batch(x: np.ndarray, y: np.ndarray, sure: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.nulls(len(x), pa.bool_()) if sure is None else pa.array(sure)], names=["x", "y", "sure"])


def all_pairs(node: np.ndarray, _, other: np.ndarray | None, __) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every pair, none of them sure."""
    if other is None:
        for i in range(len(node) - 1):
            yield np.full(len(node) - 1 - i, node[i]), node[i + 1 :], np.zeros(len(node) - 1 - i, dtype=bool)
    else:
        for v in node:
            yield np.full(len(other), v), other, np.zeros(len(other), dtype=bool)


def _in_buckets(pairs: Pairs, small: bool, run: int):
    """Batches come in order of bucket. Runs of more than ``run`` nodes come out as rows (key, node, null)."""

    def joined(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.frombuffer(a, dtype=np.int64) for a, _, _ in parts])
        node = np.concatenate([np.frombuffer(b, dtype=np.int64) for _, b, _ in parts])
        payload = None if parts[0][2] is None else np.concatenate([np.frombuffer(c, dtype=np.uint8) for _, _, c in parts]).reshape(len(key), -1)
        node, payload, begin, size, key = _sorted_runs(key, node, payload)
        held = _Held()
        for m in np.unique(size[size > 1]):
            starts = begin[size == m]
            if m > run:
                for r in starts:
                    for i in range(r, r + m, 100_000):
                        to = min(i + 100_000, r + m)
                        yield _batch(key[i:to], node[i:to], None)
            elif small and m <= 1000:  # many runs of one size at a time
                i, j = np.triu_indices(int(m), 1)
                step = max(1, 2_000_000 // len(i))
                for r in range(0, len(starts), step):
                    x, y = node[starts[r : r + step, None] + i].ravel(), node[starts[r : r + step, None] + j].ravel()
                    yield from held.add(x, y, np.zeros(len(x), dtype=bool))
            else:
                for r in starts:
                    for x, y, sure in pairs(node[r : r + m], None if payload is None else payload[r : r + m], None, None):
                        yield from held.add(x, y, sure)
        yield from held.out()

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in (whole.slice(i, 16) for whole in batches for i in range(0, whole.num_rows, 16)):  # rows are long, and a batch's bytes aren't held twice
            for bucket, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now:
                    yield from every(parts)
                    parts = []
                now = bucket
                parts.append((a, b, c))
        yield from every(parts)

    def every(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        widths = [len(c or b"") // max(1, len(a) // 8) for a, _, c in parts]  # keys of different widths are never equal
        for width in sorted(set(widths)):
            yield from joined([p for p, w in zip(parts, widths) if w == width])

    return run_


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key, node = np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64)
            for i in range(0, len(key), 100_000):
                yield _batch(key[i : i + 100_000], node[i : i + 100_000], None)


def _in_tiles(pairs: Pairs):
    """Batches come in order of (key, lo, hi); a tile holds the nodes of one group or of two."""

    def met(rows: list[tuple], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        node, group = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows])
        payload = None if rows[0][2] is None else np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        held, one, two = _Held(), group == lo, group == hi
        of = lambda which: None if payload is None else payload[which]
        for x, y, sure in pairs(node[one], of(one), *((None, None) if lo == hi else (node[two], of(two)))):
            yield from held.add(x, y, sure)
        yield from held.out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for key, lo, hi, node, group, c in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (key, lo, hi) != now and rows:
                    yield from met(rows, *now[1:])
                    rows = []
                now = key, lo, hi
                rows.append((node, group, c))
        if rows:
            yield from met(rows, *now[1:])

    return run


def paired(packed: DataFrame, buckets: int, pairs: Pairs = all_pairs, payloads: DataFrame | None = None, run: int = RUN, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """(x, y, sure), x < y, distinct and saved: what ``pairs`` gives within every run of a key.

    ``packed`` is a saved table of ``PACKED``; ``payloads`` (node, c) has what long runs need beside their nodes.
    """
    sizes = packed.groupBy("bucket").agg(F.sum(F.length("a") / 8).alias("n"))
    large = saved(sizes.where(F.col("n") > bucket_most).select("bucket"), "large")
    some = not large.isEmpty()
    usual = packed.join(large, "bucket", "left_anti") if some else packed
    # several small buckets a task, so that chance doesn't heap a few large ones on one
    by_bucket = usual.select("bucket", "a", "b", "c").repartition(max(8, buckets // BUCKETS_A_TASK), "bucket").sortWithinPartitions("bucket")
    once = lambda rows: saved(rows.groupBy("x", "y").agg(F.max("sure").alias("sure")), "pairs")
    found = once(by_bucket.mapInArrow(_in_buckets(pairs, pairs is all_pairs, run), _ROWS))
    rest = found.where("sure IS NULL").select("x", "y")
    if some or not rest.isEmpty():
        if some:
            rest = rest.unionAll(packed.join(large, "bucket", "left_semi").select("a", "b").mapInArrow(_as_rows, _ROWS).select("x", "y").distinct())
        rows = saved(rest.toDF("key", "node"), "long")
        groups = saved(rows.groupBy("key").agg(F.ceil(F.count("*") / run).cast("int").alias("t")), "groups")
        dealt = rows.join(groups, "key").withColumn("g", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
        dealt = dealt.withColumn("c", F.lit(None).cast("binary")) if payloads is None else dealt.join(payloads, "node")
        tiles = dealt.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).select("key", F.least("g", "h").alias("lo"), F.greatest("g", "h").alias("hi"), "node", "g", "c")
        met = tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_in_tiles(pairs), _ROWS)
        was, found = found, once(found.where("sure IS NOT NULL").unionAll(met))
        dropped(was, rows, groups)
    dropped(large)
    return found


def bucket_number(entries: float, each: int) -> int:
    return max(8, math.ceil(entries / each))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (x, y) with the least node that it is joined to.

    Labels take the least of their neighbours', then that label's own label, until none changes; each round is
    written, so its plan stays short.
    """
    both = saved(edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    labels = saved(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("component")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("near"))
        nearer = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "component", F.least("component", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = saved(nearer.join(jump, "near").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("changed")), "labels")
        dropped(labels)
        labels = new
        if new.where("changed").isEmpty():
            dropped(both)
            return new.select("node", "component")


def classes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, class_id, n_links) for every row of members (id, node); edges (x, y) join nodes.

    ``class_id`` is the least id of all that are joined, directly or through others. ``n_links`` counts the members
    that share the node or have a node that an edge joins to it. Numbers are added up by node before ids are met.
    """
    sizes = saved(members.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least")), "sizes")
    both = edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    beside = both.join(sizes.select(F.col("node").alias("y"), "n"), "y").groupBy(F.col("x").alias("node")).agg(F.sum("n").alias("beside"))
    grouped = sizes.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = grouped.groupBy("component").agg(F.min("least").alias("class_id"))
    of_node = saved(grouped.join(first, "component").join(beside, "node", "left").select("node", "class_id", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links")), "classes")
    return members.join(of_node, "node").select("id", "class_id", "n_links")
