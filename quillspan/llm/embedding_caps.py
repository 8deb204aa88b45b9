"""Near copies among embeddings by spherical-cap filters.

Filter directions are the sums of one code word of each block: after a random rotation the space is cut into
blocks, each with a code of random unit vectors, and a direction takes one code word of every block. There are ``CODES``
such product codes, each with a rotation of its own, so that no vector lies badly in all of them.
A vector falls into the cap of every direction with which its product exceeds ``alpha``; these are list-decoded block
by block, and a prefix is dropped as soon as even the best remaining code words could not lift it over ``alpha``. Vectors
that share a cap are compared exactly. Caps shrink smoothly as the table grows, so that a cap holds about ``CAP_LOAD``
unrelated vectors, and their number is what gives a pair at the threshold about ``SHARED`` common caps a code.

Only caps, names and vectors of 8 bits a part travel, packed by hash bucket. Their known rounding error decides most pairs of a
cap for certain; the others are compared exactly. The result has a row for each vector: the class of vectors that
likeness joins it to, directly or through others, and the number of its links.

Edges: null, empty and zero vectors and those with a null, NaN or infinite part link to nothing, nor do vectors of
different dimension; rows without an id can't be named and have no row in the result; rows that repeat id and vector
are one, rows of one id and different vectors one for each vector; ids may be of any type that can be ordered; an empty table gives
an empty result; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, FloatType, LongType, StructType

from .common import GOLD, U64, col, dropped, mix, saved, table, type_of
from .runs import PACKED, bucket_number, classes, packed_rows, paired

THRESHOLD, CAP_LOAD, SHARED, CODES, MOST_WORDS, SEED = 0.9, 256, 2.0, 8, 2000, 11
#: Vectors in a bucket, about, and vectors of a cap that one task compares.
BUCKET_ENTRIES, RUN = 60_000, 8000
#: Scores that a task decodes at a time, and bytes of vectors that it holds before it packs them.
STEP, HELD = 2_000_000, 16_000_000


def _tail(dimension: int, grid: int = 20_001) -> tuple[np.ndarray, np.ndarray]:
    """(x, chance that a random unit vector's product with a fixed one exceeds x)."""
    x = np.linspace(-1, 1, grid)
    density = np.maximum(1 - x * x, 0) ** max((dimension - 3) / 2, 0)
    above = np.cumsum(density[::-1])[::-1]
    return x, above / above[0]


@lru_cache(maxsize=64)
def sizing(n: int, dimension: int, threshold: float = THRESHOLD) -> tuple[float, float]:
    """(height of a cap, number of caps of one code) for a table of n vectors of this dimension.

    A cap's height leaves it about ``CAP_LOAD`` of n random vectors (but is at most 0.8 of the threshold); so many caps give a pair at the threshold ``SHARED``
    common ones in each of the ``CODES`` codes.
    """
    x, above = _tail(dimension)
    rho = min(threshold, 0.9999)
    height = min(float(x[min(int((above > min(0.06, CAP_LOAD / max(n, 1))).sum()), len(x) - 2)]), 0.8 * rho)
    inside = np.linspace(height, 1, 2001)[:-1]
    weight = np.interp(inside, x, above) - np.interp(np.append(inside[1:], 1.0), x, above)
    need = (height - rho * inside) / np.sqrt((1 - rho * rho) * (1 - inside * inside))
    beside, rest = _tail(max(2, dimension - 1))
    both = float((weight * np.interp(need, beside, rest, left=1.0, right=0.0)).sum())
    return height, SHARED / max(both, 1e-18)


@lru_cache(maxsize=32)
def code(dimension: int, caps: float, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation, and the code words of each block, each scaled so that a direction has length 1."""
    rng = np.random.default_rng([seed, dimension])
    rotation = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
    blocks = min(max(2, math.ceil(math.log(caps) / math.log(MOST_WORDS))), dimension)
    each = max(2, math.ceil(caps ** (1 / blocks)))
    out = []
    for part in np.array_split(np.arange(dimension), blocks):
        words = rng.standard_normal((each, len(part)))
        out.append(words / np.linalg.norm(words, axis=1, keepdims=True) * math.sqrt(len(part) / dimension))
    return rotation, out


def list_decode(vectors: np.ndarray, height: float, caps: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(vector, direction) for all directions whose product with the unit vector exceeds ``height``.

    A vector of which no direction exceeds it goes to its single best direction.
    """
    n, dimension = vectors.shape
    rotation, words = code(dimension, caps, seed)
    turned = vectors @ rotation
    at, scores = 0, []
    for w in words:
        scores.append(turned[:, at : at + w.shape[1]] @ w.T)
        at += w.shape[1]
    best = [s.max(axis=1) for s in scores]
    rest = np.zeros((len(words) + 1, n))
    for k in range(len(words) - 1, -1, -1):
        rest[k] = rest[k + 1] + best[k]
    who, total, path = np.arange(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    goal = np.minimum(height, rest[0] - 1e-12)  # the best direction is always taken
    for k, s in enumerate(scores):
        parts, step = [], max(1, STEP // s.shape[1])
        for i in range(0, len(who), step):
            w, t, p = who[i : i + step], total[i : i + step], path[i : i + step]
            lifted = t[:, None] + s[w]
            row, word = np.nonzero(lifted + rest[k + 1][w][:, None] >= goal[w][:, None])
            parts.append((lifted[row, word], p[row] * s.shape[1] + word, w[row]))
        if parts:
            total, path, who = map(np.concatenate, zip(*parts))
    return who, path


def units(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, u): the vector of length 1 and its 64-bit name; both null where the vector has no direction."""
    schema = StructType().add("id", type_of(rows, id_col)).add("node", LongType()).add("u", ArrayType(FloatType()))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0), dtype=np.int64)
            flat = np.asarray(pc.fill_null(lists.flatten(), np.nan), dtype=np.float64)
            ends = np.cumsum(sizes)
            node, good, out = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=bool), [None] * len(sizes)
            for dimension in map(int, np.unique(sizes[sizes > 0])):
                at = np.flatnonzero(sizes == dimension)
                x = flat[(ends[at] - dimension)[:, None] + np.arange(dimension)]
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.sqrt((x * x).sum(axis=1))
                some = np.isfinite(norm) & (norm > 0)
                at, u = at[some], (x[some] / norm[some, None]).astype(np.float32) + np.float32(0)
                steps = np.arange(1, dimension + 1, dtype=U64) * GOLD
                names = mix(mix(u.view(np.uint32).astype(U64) + steps).sum(axis=1, dtype=U64) + np.full(len(u), dimension, dtype=U64))
                node[at], good[at] = names.view(np.int64), True
                for i, v in zip(at, u):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, mask=~good), pa.array(out, pa.list_(pa.float32()))], names=schema.names)

    return rows.where(col(id_col).isNotNull()).select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v")).mapInArrow(named, schema)


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of every dimension of a column of lists."""
    lists = batch.column(column)
    sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten(), dtype=np.float32)
    ends = np.cumsum(sizes)
    for dimension in map(int, np.unique(sizes)):
        at = np.flatnonzero(sizes == dimension)
        yield at, flat[(ends[at] - dimension)[:, None] + np.arange(dimension)]


def rounded(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: each part as 8 bits, then the scale and the length of what rounding took, as 32-bit floats."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((x - q * scale[:, None]).astype(float) ** 2).sum(axis=1)).astype(np.float32) + np.float32(1e-6)
    return np.hstack([q.view(np.uint8), scale.astype(np.float32)[:, None].view(np.uint8), lost[:, None].view(np.uint8)])


def close_pairs(threshold: float):
    """Pairs whose cosine may reach the threshold, sure where rounding can't have made the difference."""

    def read(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tail = np.ascontiguousarray(payload[:, -8:]).view(np.float32)
        return np.ascontiguousarray(payload[:, :-8]).view(np.int8).astype(np.float32) * tail[:, :1], tail[:, 1]

    def pairs(node, payload, other, other_payload):
        x, lost = read(payload)
        y, lost_y = (x, lost) if other is None else read(other_payload)
        to = node if other is None else other
        for i in range(0, len(x), 1000):
            for j in range(i if other is None else 0, len(y), 1000):
                like = x[i : i + 1000] @ y[j : j + 1000].T
                doubt = lost[i : i + 1000, None] + (1 + lost[i : i + 1000, None]) * lost_y[None, j : j + 1000] + 1e-5
                a, b = np.nonzero(like + doubt >= threshold)
                if other is None:
                    keep = a + i < b + j
                    a, b = a[keep], b[keep]
                if len(a):
                    yield node[a + i], to[b + j], like[a, b] - doubt[a, b] >= threshold

    return pairs


def _filtered(n: int, threshold: float, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            for width in {p.shape[1] for _, _, p in held}:
                cap, node, payload = (np.concatenate(x) for x in zip(*(h for h in held if h[2].shape[1] == width)))
                bucket, a, b, c = packed_rows(cap, node, buckets, payload)
                for i in range(0, len(bucket), 200):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[i : i + 200], pa.int32()), *(pa.array(x[i : i + 200], pa.binary()) for x in (a, b, c))], names=["bucket", "a", "b", "c"])
            held.clear()

        for batch in batches:
            node = np.asarray(batch.column(0))
            for rows, vectors in _matrices(batch, 1):
                dimension = vectors.shape[1]
                height, caps = sizing(n, dimension, threshold)
                for at, k in product(range(0, len(rows), 2000), range(CODES)):
                    x = vectors[at : at + 2000]
                    payload = rounded(x) if not k else payload
                    who, path = list_decode(x.astype(float), height, caps, seed + k)
                    cap = mix(mix(path.astype(U64) + np.full(1, k, dtype=U64) * GOLD) + U64(dimension)).view(np.int64)
                    held.append((cap, node[rows[at : at + 2000]][who], payload[who]))
                    if sum(h[2].size for h in held) > HELD:
                        yield from flushed()
        yield from flushed()

    return run


def _cosines(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for (rows, u), (_, v) in zip(_matrices(batch, 2), _matrices(batch, 3)):
                keep[rows] = np.einsum("ij,ij->i", u.astype(float), v.astype(float)) >= threshold - 1e-7
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["x", "y"])

    return run


def similar_nodes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(id, node), of null node without direction; (x, y): pairs of distinct vectors of at least this cosine, x < y.

    Equal vectors are one node. Exchanges: distinct vectors, packed caps, distinct pairs, and vectors for the pairs in doubt.
    """
    stored = saved(units(rows, id_col, vector_col), "units")
    members = stored.select("id", "node").distinct()
    nodes = saved(stored.where("node IS NOT NULL").select("node", "u").dropDuplicates(["node"]), "nodes")
    n = nodes.count()
    usual = nodes.groupBy(F.size("u").alias("d")).count().orderBy(F.desc("count"), "d").first()
    each = 0.0
    if usual:
        height, caps = sizing(n, usual.d, threshold)
        each = CODES * caps * float(np.interp(height, *_tail(usual.d)))
    buckets = bucket_number(n * each, BUCKET_ENTRIES)
    packed = saved(nodes.mapInArrow(_filtered(n, threshold, seed, buckets), PACKED), "caps")

    @F.pandas_udf("binary")
    def bytes_of(vectors: pd.Series) -> pd.Series:
        return pd.Series([rounded(np.asarray(v, dtype=np.float32)[None])[0].tobytes() for v in vectors])

    pairs = paired(packed, buckets, close_pairs(threshold), nodes.select("node", bytes_of("u").alias("c")), RUN)
    doubtful = pairs.where("NOT sure")
    u, v = nodes.toDF("x", "u"), nodes.toDF("y", "v")
    exact = doubtful.join(u, "x").join(v, "y").select("x", "y", "u", "v").mapInArrow(_cosines(threshold), "x long, y long")
    close = saved(pairs.where("sure").select("x", "y").unionAll(exact), "close")
    dropped(packed, pairs, nodes)
    return members, close


def similar_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """(id_col, class_id, n_links) of every vector: the least id of its class, and how many vectors have at least this cosine with it."""
    members, close = similar_nodes(rows, id_col, vector_col, threshold, seed)
    some = classes(members.where("node IS NOT NULL"), close)
    return some.unionAll(members.where("node IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))).withColumnRenamed("id", id_col)


def op6_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def with_near_copies(vectors: DataFrame) -> DataFrame:
    """The vectors, and of every third two more: one longer by half, one with its first eight parts pushed by its id."""
    copied = vectors.where("vec_id % 3 = 0")
    longer = copied.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.transform("embedding", lambda x: (x * F.lit(1.5)).cast("double")).alias("embedding"))
    pushed = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i < 8, (F.col("vec_id") % 7 - 3) * 0.01).otherwise(0.0))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).unionAll(longer).unionAll(copied.select((F.col("vec_id") + 2_000_000_000).alias("vec_id"), pushed.alias("embedding")))


def near_vectors_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over the whole table and copies derived from it, since the given table's vectors are all far apart."""
    return similar_vectors(with_near_copies(table(spark, sf_dir, "embeddings")))


_CLASSES = """
    p AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reached AS (SELECT p, q FROM p UNION SELECT r.p, l.q FROM reached r JOIN p l ON r.q = l.p),
    least AS (SELECT p, min(q) AS q FROM reached GROUP BY 1), number AS (SELECT p, count(*) AS n FROM p GROUP BY 1)
    SELECT vec_id, least(vec_id, coalesce(q, vec_id)) AS class_id, coalesce(n, 0)::BIGINT AS n_links
    FROM v LEFT JOIN least ON least.p = vec_id LEFT JOIN number ON number.p = vec_id
"""
ORACLES = {
    "op6_embedding_caps": f"WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL), {_CLASSES}",
    "near_vectors_derived": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x: x::DOUBLE * 1.5) FROM embeddings WHERE vec_id % 3 = 0
            UNION ALL SELECT vec_id + 2000000000, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i <= 8 THEN (vec_id % 7 - 3) * 0.01 ELSE 0 END) FROM embeddings WHERE vec_id % 3 = 0
        ), {_CLASSES}""",
}
