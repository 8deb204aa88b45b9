"""Command lines, evaluation from parts, sources and sinks, scans of long texts, and metrics against brute force."""

import json
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.functions import fuzzy, pii, punctuation, scan, spoken, text
from quillspan.functions.punctuation import PunctuationConfig, plain_text
from quillspan.operators import evaluation, generate, shaping, spans
from quillspan.plans import api, cli, framework
from quillspan.plans.catalogue import _plain_words
from quillspan.sources import io
from quillspan.streaming.transcripts import finds_by_session

ROOT = Path(__file__).resolve().parents[1]


# ---------------------------------------------------------------- scans


def test_scans_are_linear_in_the_text(spark):
    long = "слово 12.5, ivan@mail.ru — да! " * 32_000
    began = time.time()
    assert len(list(scan.compiled(text.TOKEN).finditer(long))) > 300_000
    assert len(punctuation.removed_places(long)) == 3 * 32_000 and plain_text(long).startswith("слово 12.5 ivan@mail.ru да слово")
    assert pii.Scanner().matches("телефон 89131234567, " * 3000)[-1][6].startswith("8913")
    assert time.time() - began < 20
    rows = spark.createDataFrame([(long,)], "text string")
    assert rows.select(F.size(text.tokens("text"))).first()[0] == len(list(scan.compiled(text.TOKEN).finditer(long)))


@pytest.mark.parametrize("given_text, by, out", [("a...b", "_", "a___b"), ("a .b", "_", "a b"), ("a!", "$1", "a$1"), ("1.5, x", "", "1.5 x"), ("№5", "\\", "\\5"), ("да? нет.", " ", "да нет")])
def test_a_replacement_for_every_sign(given_text, by, out):
    assert plain_text(given_text, PunctuationConfig(replacement=by)) == out


def test_final_signs_stay_where_asked():
    assert plain_text("да , вот !  Нет; ну .", PunctuationConfig(keep_sentence_final=True)) == "да вот! Нет ну."


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), max_size=25))
def test_greedy_choice_of_spans(given_spans):
    pairs = [(a, a + n) for a, n in given_spans]
    kept: list[int] = []
    for i, (a, b) in enumerate(pairs):
        if not any(pairs[k][0] < b and a < pairs[k][1] for k in kept):
            kept.append(i)
    got = scan.disjoint([a for a, _ in pairs], [b for _, b in pairs])
    assert sorted(got) == kept and got == sorted(kept, key=lambda i: (*pairs[i], i))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 999), st.integers(0, 999))
def test_numbers_come_back_from_words(thousands, rest):
    words, ones = _plain_words(), {1: "одна", 2: "две"}
    n = thousands * 1000 + rest
    if thousands:
        said = words[thousands].split()
        said[-1] = {"один": ones[1], "два": ones[2]}.get(said[-1], said[-1])
        form = "тысяч" if 11 <= thousands % 100 <= 14 else {1: "тысяча", 2: "тысячи", 3: "тысячи", 4: "тысячи"}.get(thousands % 10, "тысяч")
        spoken_text = " ".join([*said, form, *([words[rest]] if rest else [])])
    else:
        spoken_text = words[rest]
    assert spoken.with_digits_text(f"номер {spoken_text} да") == f"номер {n} да"


def test_own_rules_and_likeness(spark):
    words = ["тысяча", "тысеча", "восем", "совсем", "миллион", "стол", "сорак"]
    vocabulary = [*"тысяча восемь миллион сорок сто семь".split(), *_plain_words()[:20]]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    for threshold in (0.3, 0.55, 0.75, 0.82):
        got = {(r.word, r.match, round(r.score, 9)) for r in fuzzy.best_matches(df(words), df(vocabulary), threshold).collect()}
        want = set()
        for w in words:
            best = min((-round(fuzzy.plain_likeness(w, v), 12), v) for v in vocabulary)
            if -best[0] >= threshold:
                want.add((w, best[1], round(-best[0], 9)))
        assert got == want
    own = pii.Rule("ORDER", "order", pii._n(7), pii._stems("заказ"), pii._stems("возврат"), 20, 0, 50, 0.7, lengths=(7, 7))
    rows = spark.createDataFrame([("заказ 123-45-67",), ("возврат заказ 1234567",), (None,)], "text string")
    assert [[m.normalized for m in r[0]] for r in rows.select(pii.find_pii("text", [own])).collect()] == [["1234567"], [], []]


# ---------------------------------------------------------------- metrics


def test_char_metrics_by_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.randrange(4), rng.randrange(2), b := rng.randrange(30), b + rng.randrange(0, 9), rng.choice("AB")) for _ in range(n)]
    gold, pred = make(40), make(40)
    schema = "case_id int, line int, begin int, end int, label string"
    g, p = spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)
    hard = lambda rows: {(c, k, i, x) for c, k, b, e, x in rows for i in range(b, e)}
    soft = lambda rows: {(c, k, i) for c, k, b, e, _ in rows for i in range(b, e)}
    for count, of in ((spans.char_hard, hard), (spans.char_soft, soft)):
        a, b = of(gold), of(pred)
        assert tuple(count(g, p).first()) == (len(a & b), len(b - a), len(a - b))
    by = {r.case_id: (r.tp, r.fp, r.fn) for r in spans.char_soft(g, p, ("case_id",)).collect()}
    assert by == {c: (len({x for x in soft(gold) & soft(pred) if x[0] == c}), len({x for x in soft(pred) - soft(gold) if x[0] == c}), len({x for x in soft(gold) - soft(pred) if x[0] == c})) for c in by}
    lines = spark.createDataFrame([(c, k, "x" * 50) for c in range(4) for k in range(2)] + [(9, 0, None)], "case_id int, line int, text string")
    assert spans.char_confusion(g, p, lines).first().tn == 400 - len(soft(gold) | soft(pred))
    with pytest.raises(ValueError):
        spans.sixteen_metrics(g, p, ("entity_hard", "other"))


def test_soft_matching_over_records(spark):
    rows = [(i, "d", "s", "телефон 8 913 123 45 67", [(8, 9, "ТЕЛЕФОН", "8"), (10, 13, "ТЕЛЕФОН", "913"), (14, 23, "ТЕЛЕФОН", "1234567")], []) for i in range(2)]
    got = api.evaluate(spark.createDataFrame(rows, io.RECORDS))
    assert {(r.type, r.tp, r.fp, r.fn) for r in got["soft"].collect()} == {("PHONE", 2, 0, 0), (None, 2, 0, 0)}
    assert {(r.type, r.tp, r.fp, r.fn) for r in got["hard"].collect()} == {("PHONE", 0, 2, 6), (None, 0, 2, 6)}
    table = [r.line for r in evaluation.table_lines("hard per type", got["hard"]).collect()]
    assert len(table) == 12 and table[0] == "hard per type" and any(x.split()[:4] == ["PHONE", "0", "2", "6"] for x in table)


# ---------------------------------------------------------------- command lines


def test_text_commands(capsys, monkeypatch):
    def said(*argv):
        cli.main(["transcripts", *argv])
        return capsys.readouterr().out.strip()

    assert said("--replace", "мне сорок пять лет") == "мне 45 лет"
    assert said("--clean", "ну вот, мне как бы сорок") == "мне сорок"
    assert said("--punctuation-clean", "да, 1.5 и a@b.ru!") == "да 1.5 и a@b.ru"
    assert said("--run", "ну, мне сорок, да!") == "мне 40 да" and said("--run", "--keep-punctuation", "ну, мне сорок, да!") == "мне 40, да!"
    layers = json.loads(said("--run-json", "ну, мне сорок, да!"))
    assert layers["disfluency_cleaned_text"] == "мне сорок, да!" and [s["reason"] for s in layers["punctuation_removed_spans"]] == ["punctuation"] * 2 and layers["integer_spans"][0]["value"] == "40" and layers["removed_spans"][0]["raw"] == "ну"
    assert json.loads(said("сорок два"))[0]["candidates"] and "\\u0441" in said("--ascii", "сорок два")
    monkeypatch.setattr(sys, "stdin", __import__("io").StringIO("пять"))
    assert said("--replace") == "5"
    with pytest.raises(SystemExit):
        cli.main(["transcripts", "--run", "--clean", "x"])


def test_table_commands(spark, tmp_path, capsys):
    cli.main(["generate", "--type", "snils", "--count", "3", "--raw"])
    assert all(len(x) == 11 and x.isdigit() for x in capsys.readouterr().out.split())
    cli.main(["generate", "--type", "phone_mobile", "--count", "2"])
    assert len(capsys.readouterr().out.strip().split("\n")) == 2
    cli.main(["table", "--count", "5", "--output", str(tmp_path / "all"), "--include-raw"])
    made = io.read_csv(spark, str(tmp_path / "all"))
    assert made.count() == 5 and len(made.columns) == 22
    for name, rows in (("l", [("1", "a"), ("2", "b")]), ("r", [("3", "c"), ("4", "d")])):
        io.write_csv(spark.createDataFrame(rows, "index string, v string").coalesce(1), str(tmp_path / name))
    cli.main(["merge", str(tmp_path / "l"), str(tmp_path / "r"), str(tmp_path / "both"), "--count", "2"])
    assert sorted((r.v, r.v_2) for r in io.read_csv(spark, str(tmp_path / "both")).collect()) == [("a", "c"), ("b", "d")]
    io.write_csv(spark.createDataFrame([("ab@x.ru", "keep")], "mail string, v string"), str(tmp_path / "m"))
    cli.main(["transliterate", str(tmp_path / "m"), str(tmp_path / "said"), "--columns", "mail", "--mode", "spell"])
    assert io.read_csv(spark, str(tmp_path / "said")).first().asDict() == {"mail": "эй би собака экс точка эр ю", "v": "keep"}
    with pytest.raises(ValueError):
        shaping.addresses_spoken(io.read_csv(spark, str(tmp_path / "m")), ["none"])


def test_evaluation_command(spark, tmp_path, capsys):
    record = {"id": 1, "domain": "d", "split": "s", "value": "телефон восемь девять один три один два три четыре пять шесть семь", "annotations": [{"start": 8, "end": 66, "type": "ТЕЛЕФОН", "text": "8 913 123 45 67"}], "hard_negatives": [{"text": "пульс 80", "category": "vitals"}]}
    (tmp_path / "gold.jsonl").write_text(json.dumps(record, ensure_ascii=False) + "\n\n", encoding="utf-8")
    cli.main(["evaluate", str(tmp_path / "gold.jsonl"), "--json", "--artifacts-root", str(tmp_path / "runs")])
    report = json.loads(capsys.readouterr().out)
    assert report["hard"]["counts"] == {"tp": 1, "fp": 0, "fn": 0, "tn": 1} == report["soft"]["counts"]
    (day,) = (tmp_path / "runs").iterdir()
    (moment,) = day.iterdir()
    assert json.loads((moment / "metrics.json").read_text()) == report and json.loads((moment / "run_metadata.json").read_text())["records"] == 1
    matched = spark.read.json(str(moment / "dataset_after_model.jsonl")).first()
    assert matched.masked_text == "телефон [PHONE]" and matched.matches[0].canonical_value == "+79131234567" and matched.domain == "d"
    time.sleep(1)
    cli.main(["evaluate", str(tmp_path / "gold.jsonl"), "--artifacts-root", str(tmp_path / "runs")])
    assert "hard negatives: 1 total, 0 false positives, specificity=1.0000" in capsys.readouterr().out


# ---------------------------------------------------------------- evaluation from parts

YAML = """
run:
  name: example   # a remark
dataset: example
model: example
metrics: [example_count, entity_hard]
training:
  enabled: false
outputs:
  artifacts_dir: {at}
  write_dataset_snapshot_json: true
  write_dataset_snapshot_parquet: true
"""


def test_run_from_a_file(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(YAML.format(at=tmp_path / "out"))
    cli.main(["pipeline", "--config", str(tmp_path / "c.yaml"), "--json"])
    done = json.loads(capsys.readouterr().out)
    assert done["samples_count"] == 1 and done["metric_results"]["example_count"]["cases_count"] == 1 and done["metric_results"]["entity_hard"]["f1"] == 1.0
    assert json.loads((tmp_path / "out/report.json").read_text()) == done and json.loads((tmp_path / "out/dataset_snapshot.json/summary.json").read_text())["samples_count"] == 1
    assert spark.read.parquet(str(tmp_path / "out/dataset_snapshot.parquet")).first().label == "PHONE"


def test_parts_and_their_faults(spark):
    config = lambda **x: framework.config_of({"dataset": "example", "model": "example", "metrics": ["example_count"]} | x)
    with pytest.raises(framework.RegistryError, match="Unknown dataset id: missing"):
        framework.run(spark, config(dataset="missing"))
    with pytest.raises(framework.RegistryError):
        framework.run(spark, config(model={"id": "rules", "params": {"x": 1}}))
    with pytest.raises(TypeError):
        framework.run(spark, config(training={"enabled": True}))
    with pytest.raises(ValueError):
        framework.config_of({"model": "rules"})
    with pytest.raises(ValueError):
        framework.simple_yaml("a:\n  b:\n    c: 1")
    assert framework.simple_yaml("a: 1\nb:\n  c: [x, 2]\n  d: null\n  e: true") == {"a": 1, "b": {"c": ["x", 2], "d": None, "e": True}}
    data = framework.DATASETS["example"](spark)
    assert framework.evaluate(data, framework.Nothing(), {"h": framework.METRICS["entity_hard"]})["metrics"]["h"]["fn"] == 1
    taught = framework.Remembered().fit(data)
    assert framework.evaluate(data, taught, {"h": framework.METRICS["entity_hard"]})["metrics"]["h"]["tp"] == 1
    with pytest.raises(ValueError):
        framework.evaluate(framework.Dataset(data.lines.where("false"), data.gold), taught, {})
    mapped = framework.Mapped(lambda frames: (f.assign(begin=8, end=23, label="PHONE")[["case_id", "line", "begin", "end", "label"]] for f in frames))
    framework.register("model", "mine", lambda: mapped)
    assert framework.evaluate(data, mapped, {"s": framework.METRICS["char_soft"]})["metrics"]["s"]["tp"] == 15


# ---------------------------------------------------------------- sources, SQL names, streams


def test_sinks_ask_before_they_replace(spark, tmp_path):
    df, at = spark.createDataFrame([("x",)], "text string"), str(tmp_path / "o")
    io.write_jsonl(df, at)
    with pytest.raises(Exception):  # noqa: B017
        io.write_jsonl(df, at)
    io.write_jsonl(df, at, overwrite=True)
    (tmp_path / "n.jsonl").write_text('{"text": "Ева"}\n{"other": 1}\n', encoding="utf-8")
    with pytest.warns(UserWarning):
        assert io.text_column_to_csv(spark, str(tmp_path / "n.jsonl"), str(tmp_path / "csv"), "names") == 1
    with pytest.raises(KeyError):
        io.text_column_to_csv(spark, str(tmp_path / "n.jsonl"), str(tmp_path / "csv2"), "names", strict=True)
    io.write_dialogs(df, str(tmp_path / "d"))
    assert "x\n=====" in "".join(p.read_text() for p in (tmp_path / "d").glob("part*"))
    (tmp_path / "lines").write_text(" a \n\nb\nc\n")
    assert [r.line for r in io.read_lines(spark, f"file://{tmp_path}/lines", first=2).collect()] == ["a", "b"] and io.read_lines(spark, f"file://{tmp_path}/no", ["z"]).first().line == "z"
    assert io.run_folder("s3://bucket/x/").startswith("s3://bucket/x/2")
    sample = io.read_sample(spark.range(50).withColumn("language", F.when(F.col("id") < 25, "ru").otherwise("en")), "ru", 5, 7)
    assert sample.count() == 5 and sample.where("language = 'ru'").count() == 5


def test_functions_for_frames_and_sql(spark):
    df = spark.createDataFrame([(1, "ну мне сорок лет!"), (2, None)], "id int, text string")
    first = api.parse(df, replace=True, include_candidates=False).orderBy("id").first()
    assert first.replaced_text == "ну мне 40 лет!" and "candidates" not in first["items"][0].asDict() and first["items"][0].value == "40"
    cleaned = api.punctuation_clean(df).orderBy("id").collect()
    assert cleaned[0].cleaned_text == "ну мне сорок лет" and cleaned[0].removed_spans[0].raw == "!" and cleaned[1].cleaned_text is None and "removed_spans" not in api.punctuation_clean(df, include_spans=False).columns
    done = api.run(df).orderBy("id").collect()
    assert done[0].normalized_text == "мне 40 лет" and done[0].integer_spans[0].value == "40" and done[1].normalized_text is None and api.run(df, include_spans=False).columns == ["id", "text", "original_text", "disfluency_cleaned_text", "punctuation_cleaned_text", "cleaned_text", "normalized_text"]
    api.register(spark)
    df.createOrReplaceTempView("said")
    assert spark.sql("SELECT with_digits(without_fillers(text)) FROM said WHERE id = 1").first()[0] == "мне 40 лет!"
    assert spark.sql("SELECT n.value, n.start FROM said, LATERAL number_spans(text) n").collect() == [("40", 7)]


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", 1, "телефон 89131234567"), ("2024-01-01 10:03:00", 1, "пульс"), ("2024-01-01 10:30:00", 1, "да"), ("2024-01-01 10:01:00", 2, "нет")]
    spark.createDataFrame(rows, "ts string, user_id int, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("2024-01-02 10:00:00", 9, "конец")], "ts string, user_id int, text string").withColumn("ts", F.to_timestamp("ts"))
    stream = spark.readStream.schema("ts timestamp, user_id int, text string").parquet(str(tmp_path / "in"))
    query = finds_by_session(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        late.write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        query.processAllAvailable()
        got = {(r.user_id, r.turns, r.finds) for r in spark.sql("select * from sessions").collect()}
    finally:
        query.stop()
    assert got == {(1, 2, 1), (1, 1, 0), (2, 1, 0)}


# ---------------------------------------------------------------- generators


def test_grouping_modes_and_forms(spark):
    assert sum(map(len, generate.GROUPINGS.values())) == 37 and generate.GROUPINGS["snils"]["6-3-2"] == (6, 3, 2) and all(sum(v["groups"]) == sum(v["digits"]) for v in generate.GROUPINGS.values())
    row = spark.range(1).select(
        generate.spoken("snils", F.lit("00000001205"), "groups").alias("a"), generate.spoken("snils", F.lit("12345678901"), "6-3-2").alias("b"), generate.spoken_mobile(F.lit("79130000007"), F.lit("3-2-3-2"), F.lit("plus")).alias("c"),
        generate.spoken_certificate(F.lit("XII-ЙЯ000123"), F.lit("3-3")).alias("d"), generate.spoken_birthdate(F.lit("02.03.2001")).alias("e"), generate.spoken("oms", F.lit("1" * 18), "digits").alias("f"),
    ).first()
    assert tuple(row) == (
        "ноль ноль ноль ноль ноль ноль ноль двенадцать ноль пять", "сто двадцать три тысячи четыреста пятьдесят шесть семьсот восемьдесят девять ноль один", "плюс семь девятьсот тринадцать ноль ноль ноль ноль ноль ноль семь",
        "двенадцать тире и краткое я ноль ноль ноль сто двадцать три", "два марта две тысячи один года", " ".join(["один"] * 16),
    )


def test_names_drawn_until_enough(spark):
    of = lambda words: spark.createDataFrame([(w, p, g) for w, p, g in words], "text string, probability double, gender string")
    names, fathers, families = of([("Анна", 0.9, "f"), ("Ия", 1e-9, "f"), ("Иван", 0.1, "m"), ("Нет", 0.0, "m")]), of([("Ивановна", 1.0, "f"), ("Иванович", 1.0, "m")]), of([("Орлова", 3.0, "f"), ("Ким", 1.0, "f"), ("Орлов", 1.0, "m")])
    every = {r.full_name for r in generate.full_names(names, fathers, families, 99).collect()}
    assert every == {"Орлова Анна Ивановна", "Ким Анна Ивановна", "Орлова Ия Ивановна", "Ким Ия Ивановна", "Орлов Иван Иванович"}
    two = [r.full_name for r in generate.full_names(names, fathers, families, 2).collect()]
    assert len(set(two)) == 2 and set(two) <= every


def test_core_runs_without_the_other_folder():
    code = "import sys, quillspan.plans.catalogue, quillspan.plans.cli; assert not [m for m in sys.modules if m.startswith('quillspan.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
