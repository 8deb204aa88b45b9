"""Likeness of words: edits, letter trigrams and a phonetic key, as expressions; and the same for plain strings."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, LEAST_LETTERS = 0.82, 4
#: Letters and the sounds that they are folded to.
_LETTERS, _SOUNDS = "оыэёеюябвгджз", "аииииуапфктшс"


def edit_likeness(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def trigrams(word: Column) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    n = F.length(padded)
    return F.when(n <= 3, F.array(padded)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(padded, i, 3))))


def set_likeness(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def sound_key(word: Column) -> Column:
    """Vowels and voiced consonants folded, runs of one sound collapsed, soft and hard signs dropped after they broke runs."""
    mapped = F.translate(F.translate(F.lower(word), _LETTERS, _SOUNDS), "ьъ", "##")
    return F.translate(F.regexp_replace(mapped, r"([^#])\1+", "$1"), "#", "")


def likeness(a: Column, b: Column) -> Column:
    sound = F.when(sound_key(a) == sound_key(b), 1.0).otherwise(0.0)
    return 0.58 * edit_likeness(a, b) + 0.30 * set_likeness(trigrams(a), trigrams(b)) + 0.12 * sound


def best_matches(words: DataFrame, vocabulary: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_LETTERS) -> DataFrame:
    """(word, match, score) of every distinct word that is like one of the vocabulary; the first in order on ties.

    Words meet by equal keys. Without a common trigram a score is 0.70 at most, so above that words meet by trigrams; below, by
    the lengths that the threshold allows.
    """
    a, b = words.select("word").where(F.length("word") >= least).distinct(), vocabulary.select(F.col("word").alias("match")).distinct()
    n, share = F.length("word"), max((threshold - 0.42) / 0.58, 0.0)
    if threshold > 0.7:
        pairs = a.select("word", F.explode(trigrams(F.col("word"))).alias("key")).join(b.select("match", F.explode(trigrams(F.col("match"))).alias("key")), "key").select("word", "match").distinct()
    else:
        longest = b.agg(F.coalesce(F.max(F.length("match")), F.lit(0))).first()[0]
        high = F.least(F.floor(n / share + 1e-9), F.lit(longest)) if share else F.lit(longest)
        keys = F.sequence(F.least(F.ceil(n * share - 1e-9), F.lit(longest)).cast("int"), high.cast("int"))
        pairs = a.select("word", F.explode(F.filter(keys, lambda k: (k >= n * share - 1e-9) & (k * share <= n + 1e-9))).alias("key")).join(b.select("match", F.length("match").alias("key")), "key").drop("key")
    scored = pairs.withColumn("score", likeness(F.col("word"), F.col("match"))).where(F.col("score") >= threshold)
    best = scored.groupBy("word").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("b"))
    return best.select("word", "b.match", (-F.col("b.s")).alias("score"))


# ---------------------------------------------------------------- plain strings, for the number grammar


def plain_edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@lru_cache(maxsize=50_000)
def plain_key(word: str) -> str:
    out, last = [], ""
    for c in word.lower().translate(str.maketrans(_LETTERS, _SOUNDS)):
        if c in "ьъ":
            last = ""
        elif c != last:
            out.append(c)
            last = c
    return "".join(out)


def plain_trigrams(word: str) -> frozenset[str]:
    p = f"^{word}$"
    return frozenset(p[i : i + 3] for i in range(max(1, len(p) - 2)))


def plain_likeness(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    edit = 1 - plain_edits(a, b) / longest if longest else 1.0
    x, y = plain_trigrams(a), plain_trigrams(b)
    return 0.58 * edit + 0.30 * (len(x & y) / len(x | y)) + 0.12 * (plain_key(a) == plain_key(b))
