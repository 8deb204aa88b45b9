"""Reading and writing of the formats that transcripts come in."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
import warnings
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Annotated transcripts, one JSON object a line.
RECORDS = "id bigint, domain string, split string, value string, annotations array<struct<start:int,end:int,type:string,text:string>>, hard_negatives array<struct<text:string,category:string>>"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share. A local session where none is set (tests) gets a temporary one; a cluster's must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at


def spread(df: DataFrame, key: str, rows: int = 5_000) -> DataFrame:
    """df in parts of about ``rows`` rows by the hash of ``key``, counted from the files' footers: as many parts as the table asks for.

    Files are read by row groups, so a narrow table of a million rows is one task, however long its rows take.
    """
    total = df.count()
    parts = max(-(-total // rows), min(df.sparkSession.sparkContext.defaultParallelism, 10 * total // rows), 1)
    return df.repartition(parts, key)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text as one file of any file system, replacing what was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORDS, tolerant: bool = False) -> DataFrame:
    """Strict: a malformed line fails the read. Tolerant: such lines come with ``_corrupt_record`` set and null fields."""
    if tolerant:
        return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def corrupt_lines(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("skipped"), F.count_if(F.col("_corrupt_record").isNull()).alias("read"))


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines in UTF-8. An existing target is replaced only where asked."""
    df.write.mode(_mode(overwrite)).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the header."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode(_mode(overwrite)).option("header", True).option("escape", '"').csv(path)


def with_line_numbers(df: DataFrame, name: str) -> DataFrame:
    """The place of every row in its input, file by file: what ``positional_merge`` orders by. Numbers grow within a partition, and partitions follow the files."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_column_to_csv(spark: SparkSession, source: str, target: str, name: str, strict: bool = False, overwrite: bool = False) -> int:
    """The field ``text`` of JSON lines as a CSV of one column; returns how many lines lacked it. Those go with a warning or, if strict, raise KeyError."""
    rows = read_jsonl(spark, source, "text string", tolerant=True)
    lacking = rows.where(F.col("text").isNull()).count()
    if lacking and strict:
        raise KeyError("text")
    if lacking:
        warnings.warn(f"{lacking} lines have no text and are left out", stacklevel=2)
    write_csv(rows.where(F.col("text").isNotNull()).select(F.col("text").alias(name)), target, overwrite)
    return lacking


def read_lines(spark: SparkSession, path: str, default: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Stripped lines that aren't empty, or the ``first`` ones of them; the default where there are none or no file."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''") if exists(spark, path) else None
    if lines is None or lines.isEmpty():
        lines = spark.createDataFrame([(x,) for x in default or []], "line string")
    return lines if first is None else lines.limit(first)


def write_dialogs(df: DataFrame, path: str, text_col: str = "text", overwrite: bool = False) -> None:
    """Texts, each followed by a line of =====."""
    df.select(F.concat(F.col(text_col), F.lit("\n=====")).alias("value")).write.mode(_mode(overwrite)).text(path)


def write_snapshot(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A flat snapshot as Parquet."""
    df.write.mode(_mode(overwrite)).parquet(path)


def write_snapshot_json(lines: DataFrame, spans: DataFrame, path: str) -> None:
    """A folder with ``cases``, a JSON object a line, and ``summary.json`` with their number: cases of a large data set don't fit one file."""
    cases = snapshot_json(lines, spans)
    cases.select(F.col("case_json").alias("value")).write.mode("overwrite").text(f"{path}/cases")
    write_text(lines.sparkSession, f"{path}/summary.json", json.dumps({"samples_count": lines.select("case_id").distinct().count(), "cases": "cases"}))


def snapshot_json(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(case_id, case_json): one JSON object a case with its lines and spans; a line of output each, not one file on the driver."""
    a = lines.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("line", "role", "text"))).alias("lines"))
    b = spans.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("line", "begin", "end", "label"))).alias("spans"))
    return a.join(b, "case_id", "left").select("case_id", F.to_json(F.struct("case_id", "lines", "spans")).alias("case_json"))


def run_folder(root: str, now: datetime | None = None) -> str:
    """A folder of this moment under root, which may be a path of any file system."""
    return f"{root.rstrip('/')}/{now or datetime.now():%Y-%m-%d/%H-%M-%S}"


def artifact_tables(records: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a run leaves of its records: the texts before and after cleaning, and the masked texts with their matches."""
    about = ["id", "domain", "split"]
    done = records.select(*about, F.col("value").alias("original_text")).join(found.select("id", F.col("normalized_text").alias("preprocessed_text"), "masked_text", "pii"), "id")
    matches = F.transform("pii", lambda m: F.struct(m["type"].alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("raw_value"), m["normalized"].alias("canonical_value")))
    return done.select(*about, "original_text", "preprocessed_text"), done.select(*about, "preprocessed_text", "masked_text", matches.alias("matches"))


def write_artifacts(folder: str, preprocessed: DataFrame, found: DataFrame, report: DataFrame, metadata: dict) -> None:
    """The four artifacts of an evaluation run: two folders of JSON lines, and two small files."""
    spark = report.sparkSession
    write_jsonl(preprocessed, f"{folder}/dataset_after_preprocessing.jsonl")
    write_jsonl(found, f"{folder}/dataset_after_model.jsonl")
    metrics = json.loads(report.first().report)
    write_text(spark, f"{folder}/metrics.json", json.dumps(metrics, ensure_ascii=False, indent=2))
    files = {name: f"{folder}/{name}" for name in ("dataset_after_preprocessing.jsonl", "dataset_after_model.jsonl", "metrics.json")}
    about = metadata | {"records": metrics["records"], "generated_at": f"{datetime.now():%Y-%m-%dT%H:%M:%S}", "files": files}
    write_text(spark, f"{folder}/run_metadata.json", json.dumps(about, ensure_ascii=False, indent=2))


def read_sample(df: DataFrame, language: str | None, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows of a language, drawn by hash: a sampling operator."""
    rows = df if language is None else df.where(F.col("language") == language)
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
