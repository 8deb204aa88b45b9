"""Token counts by heap-and-linked-list byte-pair merging: symbols minus merges, no identifiers made.

Per document; nulls and edges: a null text has a null count, an empty one 0; rows are independent, so ties,
repeated rows, empty tables and further columns change nothing (only ``id_col`` and ``text_col`` are read,
and other columns, whatever their names, are not returned).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, col, table
from .vocabulary import DEFAULT_VOCABULARY, PATTERN, PieceCache, pattern_of, ranks_of, read_vocabulary


def merged_length(symbols: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols left when the lowest-ranked adjacent pair is merged again and again (leftmost on ties)."""
    n = len(symbols)
    if n < 2 or symbols in ranks:
        return min(n, 1)
    follows = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = follows[:]  # symbol i spans symbols[i:end[i]]; an absorbed one has end 0
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(symbols[i : i + 2])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, to = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != to:
            continue  # one side of this pair has merged since
        merges += 1
        end[i], end[j] = to, 0
        k = follows[i] = follows[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(symbols[i : end[k]])) is not None:
                heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(symbols[h:to])) is not None:
            heappush(heap, (r, h, to))
    return n - merges


@lru_cache(maxsize=2)
def _counter(raw: bytes, pattern: str) -> PieceCache:
    ranks, units = ranks_of(raw), pattern_of(pattern).findall
    known: dict[str, int] = {}

    def unit_length(unit: str) -> int:
        got = known.get(unit)
        if got is None:
            got = merged_length(unit.encode("utf-8", "surrogatepass"), ranks)
            if len(known) >= 400_000:
                known.clear()
            if len(unit) <= 64:
                known[unit] = got
        return got

    return PieceCache(lambda piece: sum(map(unit_length, units(piece))))


def count_tokens(text: str, raw: bytes, pattern: str = PATTERN) -> int:
    return sum(_counter(raw, pattern).values_of(text))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id_col, n_tokens) for every row. The vocabulary file is read on the driver and broadcast (0.5 MB, of fixed size)."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("token_counts", _counter.cache_clear)
        for texts in batches:
            yield pd.Series([None if t is None else count_tokens(t, raw.value, pattern) for t in texts], dtype="Int64")

    return docs.select(col(id_col), n_tokens(col(text_col)).alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
