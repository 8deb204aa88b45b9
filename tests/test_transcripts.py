"""Text, numbers, rules and spans on small cases."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspan.functions import fuzzy, pii, punctuation, spoken, text
from quillspan.operators import evaluation, generate, shaping, spans
from quillspan.plans.api import anonymize, evaluate
from quillspan.sources import io
from quillspan.streaming.transcripts import anonymized

NUMBERS = [
    ("двадцать ноль пять", "205"), ("сто 5 5", "110"), ("код сорока", "код 40"), ("сорока сидит", "сорока сидит"), ("минус два с половиной", "-2"), ("педесят пять", "55"), ("ноль тысяч", "1000"),
    ("сто двадцать три тысячи четыреста пять", "123405"), ("ноль ноль семь", "007"), ("двадцать пять ноль один", "2501"), ("без чисел", "без чисел"), ("", ""), ("двадцать пол женский", "20 женский"),
]
FILLERS = [("ну вот, э-э, мне как бы это самое сорок лет", "мне сорок лет"), ("ах, да", "да"), ("он ах сказал", "он ах сказал"), ("а, значит, пошли", "пошли"), ("э - м", ""), ("типа", ""), ("", "")]


@pytest.mark.parametrize("said,written", NUMBERS)
def test_numbers(said, written):
    assert spoken.with_digits_text(said) == written


@pytest.mark.parametrize("said,left", FILLERS)
def test_fillers(said, left):
    assert spoken.without_fillers_text(said) == left


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string").select("i", f.alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


def test_spans_and_offsets(spark):
    got = column(spark, ["😀 a1 b22", "", None, " 5"], text.find_spans("text", r"\d+"))
    assert [[(s.start, s.end, s.raw) for s in g] if g is not None else None for g in got] == [[(3, 4, "1"), (6, 8, "22")], [], None, [(2, 3, "5")]]


def test_rules(spark):
    cases = {
        "телефон 8-913-123-45-67.": [("PHONE", "+79131234567")], "домашний телефон 89131234567": [], "паспорт 4510 номер 123456": [("PASSPORT", "4510123456")], "дата рождения 31.02.1990": [], "родился 12 03 1985": [("DATE_BIRTH", "12.03.1985")],
        "мне 45 лет": [("AGE", "45")], "давление 120": [], "снилс 112-233-445 95": [("SNILS", "11223344595")], "инн 500100732259": [("INN", "500100732259")], "": [], "12345678901": [],
    }
    got = column(spark, [*cases, None], pii.find_pii("text", as_of=date(2026, 1, 1)))
    assert [[(m.type, m.normalized) for m in g] for g in got] == [*cases.values(), []]


def test_punctuation(spark):
    got = column(spark, ["Почта ivan@mail.ru, сайт https://a.b/c?x=1, версия 1.2.3 — да!", "a...b", None, "№5"], punctuation.without_punctuation("text"))
    assert got == ["Почта ivan@mail.ru сайт https://a.b/c?x=1 версия 1.2.3 да", "a b", None, "5"]
    assert [(s.start, s.end) for s in column(spark, ["a...b, c"], punctuation.removed_punctuation("text"))[0]] == [(1, 4), (5, 6)]


def test_whole_run_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("справка мсэ номер ноль восемь семь четыре два три дробь две тысячи двадцать один",)], "text string")
    row = anonymize(df).first()
    assert row.normalized_text == "справка мсэ номер 087423 дробь 2021" and row.masked_text == "справка мсэ номер [MSE]"
    df.write.json(str(tmp_path / "in"))
    stream = anonymized(spark.readStream.schema("text string").json(str(tmp_path / "in"))).select("masked_text").writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.sql("select * from masked").first()[0] == row.masked_text


def test_evaluation(spark):
    rows = [(1, "d", "s", "телефон 8 913 123 45 67", [(8, 23, "ТЕЛЕФОН", "восемь девять один три один два три четыре пять шесть семь"), (0, 1, "ДРУГОЕ", "x")], [("пульс 80", "vitals")])]
    got = evaluate(spark.createDataFrame(rows, io.RECORDS))
    assert {(r.type, r.tp, r.fp, r.fn) for r in got["hard"].collect()} == {("PHONE", 1, 0, 0), (None, 1, 0, 0)} == {(r.type, r.tp, r.fp, r.fn) for r in got["soft"].collect()}
    assert got["hard_negatives"].first().false_positives == 0 and '"tp":1' in evaluation.report(got["hard"]).first().report


def test_evaluation_of_spoken_dates_and_whole_report(spark):
    said = ["двенадцатое мая тысяча девятьсот восемьдесят второго", "тридцать первое апреля тысяча девятьсот восемьдесят второго", "двадцать девятое февраля две тысячи четвёртого года", "двенадцать ноль пять"]
    assert [spoken.spoken_date(t) for t in said] == ["12.05.1982", "31.04.1982", "29.02.2004", None]
    assert [spoken.spoken_date(f"{d} мая две тысячи один")[:2] for d in ("двадцать второе", "двадцатое", "два", "тринадцатое", "тридцать один", "третьего")] == ["22", "20", "02", "13", "31", "03"]
    assert spoken.digit_segments("плюс семь, девятьсот тринадцать дробь ноль пять") == ["7", "913", "05"]
    rows = [(i, "d", "s", "дата рождения 12.05.1982", [(14, 24, "ДАТА_РОЖДЕНИЯ", t)], [("телефон 89131234567" if i else "пульс 80", "c")]) for i, t in enumerate(said[:2])]
    got = evaluate(spark.createDataFrame(rows, io.RECORDS))
    assert {(r.type, r.tp, r.fp, r.fn) for r in got["hard"].collect()} == {("DATE_BIRTH", 1, 1, 1), (None, 1, 1, 1)}
    report = json.loads(evaluation.whole_report(got["hard"], got["soft"], got["hard_negatives"], got["found"]).first().report)
    assert report["records"] == 2 and report["hard_negatives"] == {"total": 2, "false_positives": 1, "specificity": 0.5, "false_positives_by_category": {"c": 1}}
    assert report["hard"]["metrics"] == pytest.approx({"precision": 0.5, "recall": 0.5, "f1": 0.5, "accuracy": 0.5, "specificity": 0.5})
    assert report["soft"]["counts"] == {"tp": 1, "fp": 1, "fn": 0, "tn": 1} and report["soft"]["per_type"] == {"DATE_BIRTH": {"tp": 1, "fp": 1, "fn": 0}}


def test_matching_and_metrics(spark):
    schema = "case_id int, line int, begin int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 0, 4, "A"), (1, 0, 3, 8, "A"), (2, 0, 0, 2, "B")], schema)
    pred = spark.createDataFrame([(1, 0, 3, 4, "A"), (1, 0, 1, 2, "A"), (3, 0, 0, 1, "B")], schema)
    assert tuple(spans.entity_soft(gold, pred).first()) == (2, 1, 1) and tuple(spans.entity_hard(gold, pred).first()) == (0, 3, 3) and tuple(spans.char_soft(gold, pred).first()) == (2, 1, 8)
    assert spans.sixteen_metrics(gold, pred).count() == 4 and tuple(spans.entity_hard(gold, gold).first()) == (3, 0, 0)
    assert spans._matched([[0, 1], [0], [1, 2], [2, 3]]) == 4


def test_generators_and_speech(spark):
    docs = generate.documents(spark, 200)
    again = generate.documents(spark, 200).repartition(7)
    assert docs.exceptAll(again).isEmpty()
    said = docs.select(spoken.with_digits(generate.spoken("snils", F.col("snils_raw"))).alias("a"), F.col("snils_raw").alias("b"), spoken.with_digits(F.col("age")).alias("c"), F.col("age_raw").alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in said)
    assert [r.x for r in spark.range(3).select(generate.number_words(F.element_at(F.array(F.lit(0), F.lit(2001), F.lit(11_000_012)), F.col("id").cast("int") + 1)).alias("x")).collect()] == ["ноль", "две тысячи один", "одиннадцать миллионов двенадцать"]


def test_shaping(spark):
    got = column(spark, ["a [S]b[/S] c[/S] [S]d", "[S][/S]x", ""], shaping.untagged(F.col("text")))
    assert [(g.text, [tuple(s) for s in g.spans]) for g in got] == [("a b c d", [("b", 2, 3), ("d", 6, 7)]), ("x", [("", 0, 0)]), ("", [])]
    assert column(spark, ["Ab07@x.ru"], shaping.address_words(F.col("text"))) == ["Аб ноль семь собака кс точка ру"]
    with pytest.raises(ValueError):
        shaping.positional_merge(spark.range(3), spark.range(2), "id", 5).count()


def test_fuzzy_forms_agree(spark):
    words = ["педесят", "тыщща", "восемь", "объезд", "сссемь"]
    got = column(spark, words, fuzzy.likeness(F.col("text"), F.lit("семь")))
    assert got == pytest.approx([fuzzy.plain_likeness(w, "семь") for w in words])


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "Ева"}\n\n{bad\n', encoding="utf-8")
    df = io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "text string", tolerant=True)
    assert df.where("text = 'Ева'").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "text string").collect()
    io.write_csv(spark.createDataFrame([("x,\"y\"", "1")], "a string, b string"), str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c")).first().a == 'x,"y"'
    assert io.read_lines(spark, str(tmp_path / "none"), ["z"]).first().line == "z"
