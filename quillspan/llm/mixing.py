"""Mixing sources to target token weights by entropy balancing.

Every document i gets a rate w_i > 0 so that the token-weighted Kullback-Leibler distance of the rates from 1,
``sum t_i (w_i log w_i - w_i + 1)``, is least while each source's tokens ``sum w_i t_i`` equal its target and the
corpus' token-weighted mean of z, the standardised log length, stays what it was. The convex dual has one number a
source and one for z; its solution tilts exponentially, ``w_i = exp(a[source_i] + b z_i)``. For a given b the sources' numbers
are known in closed form, so they are eliminated and Newton iterations solve for b alone. Each aggregates moments of (source,
tokens) cells by source and then over all sources, in one distributed job that gives the driver three numbers however many
sources there are. Rates become copies: the whole part, and one more with the chance of the rest, by a hash of id
and text, so that a retry copies alike.

Tokens are those of the vocabulary. Targets are shares of all tokens by source (``targets``), or, where none are given, the shares
of ``tokens ** TEMPERATURE``; a source that isn't named in ``targets`` gets 0 and its documents rate 0. Where no b meets the
constraint on lengths (targets alone may fix all rates), it is left out: targets are met with b = 0, ``lengths_met`` is
false in every row and a warning is given.

Edges: a null source is a source of its own; null and empty texts have no tokens, constrain nothing and get rate 1
(one copy), whatever their source; rows of one id and text get equal copies, rows of null id too; an empty table gives an empty result; in
``mixed`` all columns of docs are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, col, dropped, fresh, saved, table, text_batches
from .vocabulary import DEFAULT_VOCABULARY, PATTERN, encoded_length, forget_lengths, read_vocabulary

TEMPERATURE, TOLERANCE, MOST_STEPS, MOST_TILT = 0.7, 1e-10, 60, 60.0
#: Tilts of so many sources are broadcast (a number each); of more, they are joined by exchange.
BROADCAST_SOURCES = 20_000


def token_number(spark: SparkSession, text: Column, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> Column:
    """The tokens of a text, 0 for a null one."""
    raw = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("long")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("mixing", forget_lengths)
        for texts in batches:
            yield pd.Series([encoded_length(t, raw.value, pattern) if t else 0 for t in texts], dtype="int64")

    return number.asNondeterministic()(text)  # else a filter on it counts twice


@dataclass
class Balance:
    """w = exp(a + b z) with z = (log tokens - mean) / deviation; ``tilts`` has (source, a), saved, a null where the target is 0."""

    tilts: DataFrame
    sources: int
    b: float
    mean: float
    deviation: float
    lengths_met: bool


def balance(cells: DataFrame, targets: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> Balance:
    """The tilts from cells (source, tokens, n), n documents of a source that have so many tokens."""
    spark = cells.sparkSession
    log, weight = F.log(F.col("tokens").cast("double")), F.col("tokens") * F.col("n").cast("double")
    first = cells.groupBy("source").agg(F.sum(weight).alias("t"), F.sum(weight * log).alias("z"), F.sum(weight * log * log).alias("zz"), F.min(log).alias("low"), F.max(log).alias("high"))
    if targets is None:
        first = first.withColumn("raw", F.pow("t", F.lit(temperature)))
    else:
        asked = spark.createDataFrame([(s, float(x)) for s, x in targets.items()], "key string, raw double")
        first = first.join(asked, F.col("source").eqNullSafe(F.col("key")), "left").drop("key").fillna(0.0, ["raw"])
    first = saved(first, "sources")
    whole = first.agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("z").alias("z"), F.sum("zz").alias("zz"), F.sum("raw").alias("raw")).first()
    if not whole.t or not whole.raw:
        return Balance(first.select("source", F.lit(None).cast("double").alias("a")), whole.n, 0.0, 0.0, 1.0, True)
    mean = whole.z / whole.t
    deviation = math.sqrt(max(whole.zz / whole.t - mean * mean, 0.0))
    deviation = deviation if deviation > 1e-9 else 1.0
    goals = first.where("raw > 0").select("source", (F.col("raw") * (whole.t / whole.raw)).alias("goal"), ((F.col("low") - mean) / deviation).alias("low"), ((F.col("high") - mean) / deviation).alias("high"))
    goals = saved(goals, "goals")
    z = (log - F.lit(mean)) / F.lit(deviation)

    def by_source(b: float) -> DataFrame:
        """Of each source the sums of e, e z and e z z with e = weight exp(b z - top), top the largest b z of the source."""
        top = F.greatest(F.col("low") * b, F.col("high") * b)
        near = goals.select(F.col("source").alias("key"), "goal", top.alias("top"))
        joined = cells.join(F.broadcast(near) if whole.n <= BROADCAST_SOURCES else near, F.col("source").eqNullSafe(F.col("key")))
        e = weight * F.exp(F.lit(b) * z - F.col("top"))
        return joined.groupBy("source").agg(F.first("goal").alias("goal"), F.first("top").alias("top"), F.sum(e).alias("m"), F.sum(e * z).alias("mz"), F.sum(e * z * z).alias("mzz"))

    def dual(b: float) -> tuple[float, float, float]:
        """The dual at b with the sources' numbers at their best, its slope and its curvature; the target of z is 0."""
        share = F.col("mz") / F.col("m")
        got = by_source(b).agg(F.sum(F.col("goal") * (F.log("m") + F.col("top"))), F.sum(F.col("goal") * share), F.sum(F.col("goal") * (F.col("mzz") / F.col("m") - share * share))).first()
        return got[0], got[1], max(got[2], 0.0)

    b, met = 0.0, False
    value, slope, curve = dual(b)
    for _ in range(MOST_STEPS):
        if abs(slope) <= TOLERANCE * whole.t:
            met = True
            break
        if curve <= 1e-12 * whole.t or abs(b) > MOST_TILT:
            break
        step = -slope / curve
        step = math.copysign(min(abs(step), 5.0), step)
        scale = 1.0
        while True:
            tried = dual(b + scale * step)
            if tried[0] <= value + 1e-4 * scale * slope * step + 1e-13 * abs(value) or scale < 1e-6:
                break
            scale /= 2
        b += scale * step
        value, slope, curve = tried
    if not met:
        warnings.warn("no tilt keeps the mean length with these targets; lengths are left free", stacklevel=2)
        b = 0.0
    tilts = first.select("source").join(by_source(b).select(F.col("source").alias("key"), (F.log("goal") - F.log("m") - F.col("top")).alias("a")), F.col("source").eqNullSafe(F.col("key")), "left").drop("key")
    tilts = saved(tilts, "tilts")
    dropped(first, goals)
    return Balance(tilts, whole.n, b, mean, deviation, met)


def mixed_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", targets: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, seed: int = 5, keep: list[str] | None = None, names: tuple[str, str, str, str] = ("n_tokens", "rate", "copies", "lengths_met"), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and four more, named by ``names``: tokens, rate, copies and whether lengths are met.

    Texts are read and counted once; what is kept is saved with its counts and, up to ``BROADCAST_SOURCES`` sources, never shuffled.
    """
    keep = docs.columns if keep is None else keep
    taken = docs.select([col(c) for c in keep])
    tokens, coin, source, key, a = fresh(taken, "tokens", "coin", "source_name", "source_key", "tilt")
    hashed = F.pmod(F.xxhash64(col(id_col), col(text_col), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counted = docs.select(*[col(c) for c in keep], token_number(docs.sparkSession, col(text_col), vocabulary).alias(tokens), hashed.alias(coin), col(source_col).cast("string").alias(source))
    counted = saved(counted, "counted")
    cells = saved(counted.where(F.col(tokens) > 0).groupBy(F.col(source).alias("source"), F.col(tokens).alias("tokens")).agg(F.count("*").alias("n")), "cells")
    found = balance(cells, targets, temperature)
    dropped(cells)
    tilts = found.tilts.select(F.col("source").alias(key), F.col("a").alias(a))
    joined = counted.join(F.broadcast(tilts) if found.sources <= BROADCAST_SOURCES else tilts, F.col(source).eqNullSafe(F.col(key)), "left")
    z = (F.log(F.col(tokens).cast("double")) - F.lit(found.mean)) / F.lit(found.deviation)
    rate = F.when(F.col(tokens) == 0, F.lit(1.0)).otherwise(F.coalesce(F.exp(F.col(a) + F.lit(found.b) * z), F.lit(0.0)))
    whole = F.floor(rate)
    copies = (whole + F.when(F.col(coin) < rate - whole, 1).otherwise(0)).cast("int")
    return joined.select(*[col(c) for c in keep], F.col(tokens).alias(names[0]), rate.alias(names[1]), copies.alias(names[2]), F.lit(found.lengths_met).alias(names[3]))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as many times as its copies."""
    names = fresh(docs, "n_tokens", "rate", "copies", "lengths_met", "copy")
    rated = mixed_rates(docs, names=tuple(names[:4]), **options).where(F.col(names[2]) > 0)
    return rated.withColumn(names[4], F.explode(F.array_repeat(F.lit(0), F.col(names[2])))).select([col(c) for c in docs.columns])


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_rates(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as many times as its rate rounds to."""
    text_batches(spark)
    return mixed(docs)
