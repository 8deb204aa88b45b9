"""Queries over small tables made to show one fault each, against their SQL."""

import tracemalloc
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspan.functions import scan, spoken
from quillspan.llm import embedding_caps
from quillspan.operators import spans
from quillspan.plans import catalogue


def table(folder, name, **columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


def same(spark, folder, name):
    """The query's rows, which must be those of its SQL."""
    got = catalogue.queries()[name](spark, str(folder))
    with duckdb.connect() as c:
        for path in folder.glob("*.parquet"):
            c.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
        told = c.sql(catalogue.oracle_sql()[name])
        want = told.select(*[f'"{x}"' for x in got.columns]).fetchall()
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(want, key=repr)
    return rows


def test_seconds_are_rounded(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = [timedelta(seconds=x) for x in (0.6, 3631, 10_000.5, 13_631.5, 20_001.5, 23_632)]  # gaps of an hour by rounded seconds, more by whole ones
    table(tmp_path, "events", event_id=range(6), ts=[start + x for x in at], user_id=[1, 1, 2, 2, 3, 3], event_type=["a"] * 6)
    assert [r[2] for r in same(spark, tmp_path, "proximity_clusters")] == [1, 2, 1]


def customers(folder, n):
    table(folder, "customer", c_custkey=range(n), c_mktsegment=["AUTO", "HOUSE"] * (n // 2))


@pytest.mark.parametrize("name", [
    "pii_type_rollup",
    "run_audit",
    "filler_removal",
    "anonymize_transcripts",
    "digit_sequence_parse",
])
def test_a_row_group_is_many_tasks(spark, tmp_path, name):
    customers(tmp_path, 30_000)
    plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert ", 6), REPARTITION_BY_NUM" in plan.split("== Physical Plan ==")[1]
    customers(tmp_path, 600)
    same(spark, tmp_path, name)


def orders(folder, n):
    """Orders of up to seven lines; every tenth has none."""
    lines = [(k, i) for k in range(n) if k % 10 for i in range(1, 2 + k % 7)]
    table(folder, "orders", o_orderkey=range(n))
    table(folder, "lineitem", l_orderkey=[k for k, _ in lines], l_linenumber=pa.array([i for _, i in lines], pa.int32()), l_partkey=[k * 31 + i * i * 7 for k, i in lines], l_suppkey=[k + i * 5 for k, i in lines], l_returnflag=["ANR"[(k + i) % 3] for k, i in lines])


@pytest.mark.parametrize("name", ["bio_exact", "sixteen_metrics", "entity_soft", "interval_overlap", "char_hard", "char_overlap", "hard_cases", "char_confusion", "misaligned_cases"])
def test_cases_lie_in_bounded_parts(spark, tmp_path, name, monkeypatch):
    orders(tmp_path, 300)
    monkeypatch.setattr(catalogue, "CASES", 80)  # rows of a part
    plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "REPARTITION_BY_NUM" in plan
    if name != "misaligned_cases":
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x]  # nothing moves again
    same(spark, tmp_path, name)


def test_spans_without_characters_and_tokens_without_spans(spark):
    columns = "case_id int, line int, begin int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 0, 5, "A"), (1, 0, 3, 8, "A"), (2, 0, 4, 4, "A"), (4, 0, 0, 3, "B"), (4, 0, 2, 5, "B")], columns)
    pred = spark.createDataFrame([(1, 0, 7, 10, "A"), (1, 0, 4, 6, "A"), (3, 0, 1, 2, "A"), (4, 0, 1, 9, "B")], columns)
    assert sorted(map(tuple, spans.char_overlap_scores(gold, pred).collect())) == [(1, 3, 2, 5), (2, 0, 0, 0), (3, 0, 1, 0), (4, 4, 4, 1)]
    assert sorted(map(tuple, spans.overlap_lengths(gold, pred).collect())) == [(1, 0, 3), (4, 0, 4)]
    assert tuple(spans.entity_soft(gold, pred).first()) == (3, 1, 2)
    tokens = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 5, 9), (1, 3, 20, 24), (5, 1, 0, 4)], "case_id int, token int, t_begin int, t_end int")
    assert [r.tag for r in spans.bio_tags(tokens, gold).orderBy("case_id", "token").collect()] == ["B-A", "B-A", "O", "O"]


def test_stages_share_a_worker(spark, tmp_path):
    table(tmp_path, "events", event_id=range(4), ts=[datetime(2024, 1, 1, 0, 0, x) for x in range(4)], user_id=[1, 1, 2, 3], event_type=["a"] * 4)
    plan = catalogue.queries()["session_finds"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 2 and "REPARTITION_BY_NUM" in plan
    assert sorted(r[1:] for r in same(spark, tmp_path, "session_finds")) == [(300_000_000, 1, 0), (300_000_000, 1, 1), (301_000_000, 2, 1)]


def test_stages_by_turns_and_nulls(spark):
    df = spark.createDataFrame([("ну один, два",), (None,), ("",)], "t string")
    off = spoken.normalize_transcripts(df, "t", fillers=None, punctuation=None, numbers=None)
    assert [tuple(r)[1:] for r in off.collect()] == [("ну один, два",) * 3, (None,) * 3, ("",) * 3]
    words = spoken.normalize_transcripts(df, "t", punctuation=None)
    assert [tuple(r)[1:] for r in words.collect()] == [("один, два", "один, два", "1, 2"), (None,) * 3, ("",) * 3]
    assert [tuple(r)[1:] for r in spoken.normalize_transcripts(df, "t").collect()][0] == ("один, два", "один два", "12")


def test_long_texts_travel_in_small_batches(spark, tmp_path):
    table(tmp_path, "documents", doc_id=range(700), text=[None if i % 7 == 0 else f"а, {i}.5!" for i in range(700)])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    rows = {r.doc_id: r.clean for r in catalogue.queries()["punctuation_protected"](spark, str(tmp_path)).collect()}
    assert int(spark.conf.get(name)) <= 1000
    assert rows == {i: None if i % 7 == 0 else f"а {i}.5" for i in range(700)}
    assert [len(x) for x in scan.slices(pa.array(range(600)))] == [256, 256, 88] and list(scan.slices(pa.array([], pa.string()))) == [[]]


def test_batches_of_long_texts_are_bounded_by_bytes(spark, tmp_path):
    texts = [None if i % 9 == 4 else f"{i}.5, " + "да! " * (500_000 if i == 7 else 30_000) for i in range(120)]
    parts = list(scan.slices(pa.array(texts)))
    assert [t for part in parts for t in part] == texts
    assert all(len(part) == 1 or sum(len(t.encode()) for t in part if t) <= 1 << 20 for part in parts) and 10 < len(parts) < 60

    @F.arrow_udf("long")
    def sizes(batch: pa.Array) -> pa.Array:
        return pa.array([batch.nbytes] * len(batch))

    table(tmp_path, "documents", doc_id=range(120), text=texts)
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    rows = {r.doc_id: r.clean for r in catalogue.queries()["punctuation_protected"](spark, str(tmp_path)).collect()}
    assert rows == {i: t and " ".join(t.replace(",", "").replace("!", "").split()) for i, t in enumerate(texts)}
    assert max(r[0] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1).select(sizes("text")).collect()) < 10_000_000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    catalogue.queries()["punctuation_protected"](spark, str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"  # a lower limit stays


def test_caps_are_packed_in_bounded_memory():
    vectors = np.random.default_rng(3).standard_normal((30_000, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 1000)), pa.array(list(vectors[i : i + 1000]), pa.list_(pa.float32()))], names=["node", "u"]) for i in range(0, 30_000, 1000)]
    tracemalloc.start()
    packed = sum(len(c) for b in embedding_caps._filtered(30_000, 0.9, 11, 40)(iter(batches)) for c in b.column(3).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert packed > 50_000_000 and peak < 130_000_000, (packed, peak)


def test_islands_do_not_depend_on_ties(spark):
    rows = [(17, 24, "A"), (19, 27, "R"), (30, 34, "N"), (36, 39, "A"), (36, 39, "R"), (36, 46, "A"), (39, 43, "N")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(1, 0, *r) for r in order], "case_id int, line int, begin int, end int, label string")
        assert sorted(r[2:] for r in map(tuple, spans.merged_spans(df).collect())) == [(17, 27), (30, 34), (36, 46)]
        assert sorted(r[2:] for r in map(tuple, spans.merged_spans(df, gap=2).collect())) == [(17, 27), (30, 46)]
