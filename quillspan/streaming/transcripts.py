"""The transforms of one text at a time, unchanged over streams, and sessions of timestamped turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import with_pii
from ..functions.spoken import normalize_transcripts
from ..sources.io import RECORDS


def read_transcripts(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """A stream of JSON lines files of a folder."""
    return spark.readStream.schema(schema).json(path)


def anonymized(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Cleaned, found and masked; no state, so it needs no watermark."""
    return with_pii(normalize_transcripts(stream, text_col), "normalized_text")


def finds_by_session(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session, turns, finds) of a stream of ts, user_id, text. State is bounded by the watermark."""
    found = anonymized(stream).withWatermark("ts", late)
    return found.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("turns"), F.sum(F.size("pii")).alias("finds"))
