"""What the training-data operators share: tables, the shared folder, text as numpy arrays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
#: Characters that a Python worker turns into arrays at a time; one document is never divided.
SLICE_CHARS = 1_000_000
#: Rows of whole texts in one Arrow batch.
TEXT_ROWS = 1000


_held: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None]) -> None:
    """Called where a Python worker begins an operator's task: what other operators keep in this worker is let go."""
    for other in [x for x in _held if x != name]:
        _held.pop(other)()
    _held[name] = release


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lets fewer rows than Spark's default travel to Python at a time, since these are whole texts.

    A setting of the session, so the registered queries and the pipeline make it; operators leave the session as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as a reference, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> DataType:
    """Of a column by its name, which Spark compares without case."""
    return next(f.dataType for f in df.schema.fields if f.name.lower() == name.lower())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session (tests) gets a temporary one; on a cluster that raises,
    since its machines don't see each other's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once in the shared folder: short lineage that outlives any executor.

    ``dropped`` removes them; tables that a returned plan still reads stay until the folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_quillspan_path"] = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Removes saved tables that nothing reads any more."""
    for df in tables:
        if df is not None and (path := df.__dict__.get("_quillspan_path")):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes spread over all bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text, each of one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and each text's length (a null counts as empty)."""
    parts = [t or "" for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """By code point: its lower case if it is a letter or digit, else a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            out[c] = ord(ch.lower()[0])
    return out


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case with every run of other signs as one space, each led by a space.

    Returns the code points of all and the start of each text in them (and the end of the last).
    """
    codes, sizes = code_points(texts)
    n = len(sizes)
    starts = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=starts[1:])
    out = np.full(starts[-1], 32, dtype=np.uint32)
    inner = np.ones(starts[-1], dtype=bool)
    inner[starts[:-1]] = False
    out[inner] = folding()[codes]
    keep = np.ones(len(out), dtype=bool)
    if len(out):
        keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
        keep[starts[:-1]] = True
    kept_before = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept_before[1:])
    return out[keep], kept_before[starts]
