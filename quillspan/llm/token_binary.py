"""Token ids as binary records: each document compressed alone under one shared zstandard dictionary.

A record is the document's ids as little-endian uint16 (uint32 for vocabularies over 65,536), compressed with a
dictionary trained on serialized id arrays. Every record carries the dictionary's hash, its shard and its offset among the
shard's bytes. ``write_shards`` lays the payloads of each task end to end in one file and keeps an index of offsets beside
them, so that ``read_document`` reads a short document with one seek and one small decompression. In a table of records the dictionary is
the row with ``shard`` -1 and a null id.

Edges: a null text gives a record with null ``n_tokens`` and a null payload of 0 bytes, an empty one a record of
0 tokens; repeated rows give repeated records, null ids null ids; ids may be of any type; an empty table gives just the
dictionary's row (of no bytes, when there was nothing to train on: zstandard then compresses without one, and the hash is that
of no bytes). Columns but the two named are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

from .common import claim, col, slices, table, type_of
from .vocabulary import DEFAULT_VOCABULARY, PATTERN, PieceCache, digest, encoder_of, ranks_of, read_vocabulary

#: Distinct texts of which the dictionary is trained at most, and its size: a bounded sample, drawn by hash from all rows.
SAMPLE_DOCS, DICTIONARY_BYTES, LEVEL = 2000, 65_536, 3


def record_schema(docs: DataFrame, id_col: str, payload: bool = True) -> StructType:
    out = StructType().add(id_col, type_of(docs, id_col)).add("shard", IntegerType()).add("offset", LongType()).add("n_bytes", IntegerType()).add("n_tokens", LongType()).add("dict_hash", StringType())
    return out.add("payload", BinaryType()) if payload else out.add("file", StringType())


def id_type(raw: bytes) -> np.dtype:
    return np.dtype("<u2") if max(ranks_of(raw).values(), default=0) < 65_536 else np.dtype("<u4")


@lru_cache(maxsize=2)
def _serializer(raw: bytes, pattern: str) -> PieceCache:
    encode, kind = encoder_of(raw, pattern).encode_ordinary, id_type(raw)
    return PieceCache(lambda piece: np.array(encode(piece), dtype=kind).tobytes(), most=300_000)


def serialized(text: str, raw: bytes, pattern: str = PATTERN) -> bytes:
    return b"".join(_serializer(raw, pattern).values_of(text))


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary, or no bytes when the samples are too few to train one."""
    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(max(256, min(size, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_sample(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """The n distinct whole texts of the lowest hashes. Hashes alone are ranked first, so that only about n texts move at all."""
    rows = docs.where(col(text_col).isNotNull()).select(F.xxhash64(col(text_col)).alias("h"), col(text_col).alias("t"))
    bound = rows.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.where(F.col("h") <= F.lit(bound)).dropDuplicates(["h"]).orderBy("h").limit(n)


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False)


def read_record(payload: bytes, dictionary: bytes, dict_hash: str, kind: str = "<u2") -> np.ndarray:
    """Ids of one record; refuses a dictionary of another hash."""
    if digest(dictionary) != dict_hash:
        raise ValueError("the record was written under another dictionary")
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=data).decompress(payload), dtype=kind)


def token_binary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One record a row, and one row with the dictionary. Map-only: a shard is what one task writes."""
    spark = docs.sparkSession
    raw_bytes = read_vocabulary(vocabulary)
    sample = [r.t for r in dictionary_sample(docs, text_col, sample_docs).toLocalIterator()]
    dictionary = train_dictionary([serialized(t, raw_bytes, pattern) for t in sample])
    name = digest(dictionary)
    shared = spark.sparkContext.broadcast((raw_bytes, dictionary))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_binary", _serializer.cache_clear)
        raw, data = shared.value
        compress, width, shard, offset = _compressor(data).compress, id_type(raw).itemsize, TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, to in slices(batch.column(1), 4_000_000):
                part = batch.slice(at, to - at)
                plain = [None if t is None else serialized(t, raw, pattern) for t in part.column(1).to_pylist()]
                packed = [None if p is None else compress(p) for p in plain]
                sizes = np.array([len(p or b"") for p in packed], dtype=np.int64)
                offsets = offset + np.cumsum(sizes) - sizes
                offset += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(offsets), pa.array(sizes.astype(np.int32)),
                     pa.array([None if p is None else len(p) // width for p in plain], pa.int64()), pa.array([name] * len(sizes)), pa.array(packed, pa.binary())],
                    names=[id_col, "shard", "offset", "n_bytes", "n_tokens", "dict_hash", "payload"],
                )

    schema = record_schema(docs, id_col)
    head = spark.createDataFrame([(None, -1, 0, len(dictionary), None, name, bytearray(dictionary))], schema)
    return docs.select(col(id_col), col(text_col)).mapInArrow(records, schema).unionAll(head)


def _filesystem(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    return FileSystem.from_uri(path)


def write_shards(records: DataFrame, path: str) -> DataFrame:
    """Writes the records as files of bytes under ``path`` and their index as Parquet under ``path/index``, in one job; returns the index.

    A task writes one file of its own name for each attempt, and the index names the files of the attempts that counted; files of
    others are removed. The dictionary's row stands in the index like a record. ``path`` must be shared by all machines.
    """
    id_col = records.columns[0]
    schema = record_schema(records, id_col, payload=False)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(path)
        file, offset, out = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.bin", 0, None
        try:
            for batch in batches:
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{file}")
                payloads = batch.column(6)
                sizes = np.asarray(pc.fill_null(pc.binary_length(payloads), 0), dtype=np.int64)
                for p in payloads:
                    if p.is_valid:
                        out.write(p.as_buffer())
                offsets = offset + np.cumsum(sizes) - sizes
                offset += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(offsets), *batch.columns[3:6], pa.array([file] * len(sizes))], names=schema.names)
        finally:
            if out is not None:
                out.close()

    records.mapInArrow(write, schema).write.parquet(f"{path}/index")
    index = records.sparkSession.read.schema(schema).parquet(f"{path}/index")
    counted = {r.file for r in index.select("file").distinct().toLocalIterator()}  # one name a task
    fs, root = _filesystem(path)
    for f in fs.get_file_info(FileSelector(root)):
        if f.base_name.startswith("shard-") and f.base_name not in counted:
            fs.delete_file(f.path)
    return index


def read_bytes(path: str, file: str, offset: int, n_bytes: int) -> bytes:
    """One record's bytes: a seek and a read."""
    fs, root = _filesystem(path)
    with fs.open_input_file(f"{root}/{file}") as f:
        f.seek(offset)
        return f.read(n_bytes)


def read_document(index: DataFrame, path: str, document, kind: str = "<u2") -> np.ndarray | None:
    """Token ids of the first record of this id; null for a null text or an unknown id."""
    row = index.where(col(index.columns[0]) == F.lit(document)).orderBy("file", "offset").first()
    if row is None or row.n_tokens is None:
        return None
    head = index.where((F.col("shard") == -1) & (F.col("dict_hash") == row.dict_hash)).first()
    return read_record(read_bytes(path, row.file, row.offset, row.n_bytes), read_bytes(path, head.file, head.offset, head.n_bytes), row.dict_hash, kind)


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"))
