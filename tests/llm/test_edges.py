"""Every operator and stage on one odd table: nulls, repeated rows and ids, empty and very long texts, clashing names, ids as strings, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import chat_template as C
from quillspan.llm import decontamination as D
from quillspan.llm import embedding_caps as E
from quillspan.llm import jaccard_join as J
from quillspan.llm import language_id as L
from quillspan.llm import mixing as M
from quillspan.llm import pii_surrogates as P
from quillspan.llm import rule_ensemble as R
from quillspan.llm import token_binary as B
from quillspan.llm import token_counts as T
from quillspan.llm.vocabulary import PATTERN, encoder_of, read_vocabulary

LONG_WORD, LONG_TEXT = "a" * 1_000_000, "lorem ipsum dolor sit amet " * 40_000
TEXTS = [(1, None), (2, ""), (3, "  \n"), (4, "!?"), (5, "word"), (6, "word"), (7, LONG_WORD), (8, LONG_TEXT), (9, "same row twice"), (9, "same row twice"), (10, "one id"), (10, "two different texts"), (None, "a text of no id"), (None, None), (11, "😀 ünï 数字 123 Ж")]
ITEM = "a benchmark passage of some length that nobody else has"
#: Names that the operators use within, and names with signs that mean something in SQL.
CLASH = ["node", "goes", "own", "stats", "tokens", "coin", "source_name", "source_key", "tilt", "copy", "n_tokens", "copies", "drawn", "done", "t1", "t2", "language_id", "id", "text2", "a.b", "x`y", "h", "part", "__n", "__key"]


def odd(spark, extra=True):
    rows = [(i, t, "en", None if i == 5 else f"s{(i or 0) % 2}", None, *["kept"] * (len(CLASH) * extra)) for i, t in TEXTS + [(12, f"before {ITEM} after")]]
    names = ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASH) if extra else ""
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + (f", {names}" if names else ""))


def kept(rows):
    return all(r[c] == "kept" for r in rows for c in CLASH)


def ids(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1 for r in rows))


ALL = sorted([i if i is not None else -1 for i, _ in TEXTS] + [12])


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return L.fit(docs, sample_docs=100)


def test_surrogates(spark):
    rows = P.with_surrogates(odd(spark), b"k").collect()
    assert kept(rows) and ids(rows) == ALL and [r.n_entities for r in rows] == [0] * len(rows)
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in odd(spark, False).collect())


def test_language(spark, model):
    plain = odd(spark).drop("language_id")
    rows = L.identified(plain, model).collect()
    assert ids(rows) == ALL and all(r[c] == "kept" for r in rows for c in CLASH if c != "language_id")
    by = {r.doc_id: r.language_id for r in rows}
    assert all(by[i].language is None and not by[i].accepted and by[i].cross_entropy is None or np.isnan(by[i].cross_entropy or np.nan) for i in (1, 2, 3, 4)) and by[5] == by[6] and by[7].language is not None
    with pytest.raises(ValueError):
        L.identified(odd(spark), model)
    stage = L.keep_identified(spark, odd(spark), "")
    assert stage.columns == odd(spark).columns and kept(stage.collect())


def test_templates(spark):
    rows = [(1, 1, "user", None, "x"), (1, 1, "user", None, "x"), (None, 1, "user", "lost", "x"), (2, None, None, LONG_TEXT, "x"), (2, 1, "assistant", LONG_WORD, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").withColumn("m", F.lit("kept")).withColumn("conv_id", F.col("conv_id").cast("string"))
    got = {r.conv_id: r for r in C.formatted(turns).collect()}
    assert set(got) == {"1", "2"} and got["1"].rendered == "<|im_start|>user\n<|im_end|>\n" * 2 and got["2"].error is None
    (a, b) = got["2"].generation[0]
    assert got["2"].rendered[a:b] == LONG_WORD + "<|im_end|>" and got["2"].rendered.startswith("<|im_start|>\nlorem")
    assert C.formatted(turns.where("false")).count() == 0


def test_token_records(spark):
    rows = B.token_binary(odd(spark).withColumn("doc_id", F.col("doc_id").cast("string"))).collect()
    head = next(r for r in rows if r.shard == -1)
    encode = encoder_of(read_vocabulary(), PATTERN).encode_ordinary
    want = sorted(((str(i) if i is not None else "", -1 if t is None else len(encode(t))) for i, t in TEXTS + [(12, f"before {ITEM} after")] if t != LONG_WORD))
    got = sorted((r.doc_id or "", -1 if r.n_tokens is None else r.n_tokens) for r in rows if r.shard >= 0 and r.doc_id != "7")
    assert got == want
    long = next(r for r in rows if r.doc_id == "7")
    assert len(B.read_record(bytes(long.payload), bytes(head.payload), long.dict_hash)) == long.n_tokens == T.count_tokens(LONG_WORD, read_vocabulary())
    counted = {(r.doc_id, r.n_tokens) for r in T.token_counts(odd(spark)).collect()}
    assert (7, long.n_tokens) in counted and (1, None) in counted and (2, 0) in counted and len(T.token_counts(odd(spark)).collect()) == len(ALL)


def test_jaccard(spark):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.jaccard_join(odd(spark)).collect())
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 5, 1), (7, 7, 0), (8, 8, 0), (9, 9, 0), (10, 10, 0), (10, 10, 0), (11, 11, 0), (12, 12, 0)]
    rows = J.without_near_copies(odd(spark)).collect()
    assert kept(rows) and ids(rows) == [-1, -1, 1, 2, 3, 4, 5, 7, 8, 9, 10, 10, 11, 12]
    named = J.jaccard_join(odd(spark).withColumn("doc_id", F.format_string("d%02d", "doc_id"))).where("doc_id <> 'dnull'").collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in named} == {(f"d{a:02d}", f"d{b:02d}", n) for a, b, n in got}
    assert J.without_near_copies(odd(spark).where("false")).count() == 0


def test_vectors(spark):
    rows = [("a", [1.0, 0.0], "x"), ("b", [2.0, 0.0], "x"), ("b", [2.0, 0.0], "x"), ("c", [0.0, 1.0], "x"), ("c", [1.0, 0.1], "x"), ("d", [1e308, 1e308], "x"), ("e", [float("inf"), 0.0], "x"), (None, [1.0, 0.0], "x"), ("f", [3.0], "x"), ("g", [-1.0], "x"), ("h", [0.5], "x")]
    got = sorted((r.vec_id, r.class_id, r.n_links) for r in E.similar_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>, node string")).collect())
    assert got == [("a", "a", 2), ("b", "a", 2), ("c", "a", 2), ("c", "c", 0), ("d", "d", 0), ("e", "e", 0), ("f", "f", 1), ("g", "g", 0), ("h", "f", 1)]


def test_contamination(spark):
    bench = spark.createDataFrame([("i", ITEM, "x"), ("i", ITEM, "x"), (None, ITEM, "x"), ("j", None, "x"), ("k", "", "x"), ("l", "word", "x"), ("m", "a" * 3000, "x")], "item_id string, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id or "") for r in D.contaminated(odd(spark), bench).collect())
    assert got == [(5, "l"), (6, "l"), (7, "m"), (12, ""), (12, "i"), (12, "i")]
    rows = D.without_contamination(odd(spark), bench).collect()
    assert kept(rows) and ids(rows) == [x for x in ALL if x not in (5, 6, 7, 12)]
    assert D.contaminated(odd(spark).where("false"), bench).count() == D.contaminated(odd(spark), bench.where("false")).count() == 0


def test_mixing(spark):
    docs = odd(spark)
    with pytest.raises(Exception):  # noqa: B017  a column n_tokens is there, so names must be given
        M.mixed_rates(docs).select("n_tokens").collect()
    rows = M.mixed_rates(docs, names=("t", "w", "c", "met")).collect()
    assert kept(rows) and ids(rows) == ALL and all(r.w == 1.0 and r.c == 1 for r in rows if not r.text)
    by = {}
    for r in rows:
        by[r.source] = by.get(r.source, 0) + r.w * r.t
    plain = {}
    for r in rows:
        plain[r.source] = plain.get(r.source, 0) + r.t
    norm = sum(t**M.TEMPERATURE for t in plain.values())
    assert all(by[s] == pytest.approx(sum(plain.values()) * plain[s] ** M.TEMPERATURE / norm, rel=1e-6) for s in plain) and None in by
    out = M.mixed(docs).collect()
    assert kept(out) and sum(r.doc_id == 1 for r in out) == 1 and M.mixed(docs.where("false")).count() == 0
    one = M.mixed_rates(docs.where("doc_id = 5"), names=("t", "w", "c", "met")).collect()
    assert [(r.w, r.c, r.met) for r in one] == [(pytest.approx(1.0), 1, True)] * len(one)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = R.train(docs, labels)
    rows = R.with_quality(odd(spark), fitted).collect()
    by = {r.doc_id: r for r in rows}
    assert kept(rows) and ids(rows) == ALL and by[1].quality_score is None and by[1].keep is False and by[2].quality_score is not None and by[5].quality_score == by[6].quality_score
    strange = spark.createDataFrame([(None, 1), (5, None), (999_999_999, 1), (1, 0), (1, 0)], "doc_id long, quality int")
    assert R.train(docs, strange).constant == 0.0
