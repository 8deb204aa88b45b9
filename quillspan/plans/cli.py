"""Command lines: python -m quillspan.plans.cli COMMAND.

``transcripts`` cleans and parses texts given as arguments, on standard input or, with ``--path``, lines of files;
``evaluate`` scores annotated JSON lines; ``generate`` and ``table`` make synthetic numbers and documents; ``merge`` lays two CSV
files side by side; ``transliterate`` says addresses; ``pipeline`` runs an evaluation from a YAML file.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import spoken
from ..functions.punctuation import plain_text, without_punctuation
from ..operators import evaluation, generate, shaping
from ..sources import io
from . import api, framework


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _spans_json(text: str, ascii_only: bool) -> str:
    return json.dumps([api.span_dict(s) for s in spoken.number_spans(text)], ensure_ascii=ascii_only, indent=2)


def transcripts(a: argparse.Namespace) -> None:
    mode = next((m for m in ("replace", "clean", "punctuation_clean", "run", "run_json") if getattr(a, m)), "spans")
    punctuation = not a.keep_punctuation
    if a.path:
        df = _spark().read.text(a.path).withColumnRenamed("value", "text")
        text = F.col("text")
        made = {
            "spans": lambda: df.withColumn("spans", spoken.extract_numbers(text)), "replace": lambda: df.withColumn("text", spoken.with_digits(text)), "clean": lambda: df.withColumn("text", spoken.without_fillers(text)),
            "punctuation_clean": lambda: df.withColumn("text", without_punctuation(text)), "run": lambda: api.anonymize(df, keep_punctuation=a.keep_punctuation), "run_json": lambda: api.run(df, remove_punctuation=punctuation),
        }
        made[mode]().write.json(a.out)
        return
    text = " ".join(a.text).strip() or sys.stdin.read()
    print({
        "spans": lambda: _spans_json(text, a.ascii), "replace": lambda: spoken.with_digits_text(text), "clean": lambda: spoken.without_fillers_text(text), "punctuation_clean": lambda: plain_text(text),
        "run": lambda: api.run_text(text, punctuation=punctuation)["normalized_text"], "run_json": lambda: json.dumps(api.run_text(text, punctuation=punctuation), ensure_ascii=a.ascii, indent=2),
    }[mode]())


def evaluate(a: argparse.Namespace) -> None:
    spark = _spark()
    records = io.read_jsonl(spark, a.path)
    got = api.evaluate(records, a.soft_gap)
    report = evaluation.whole_report(got["hard"], got["soft"], got["hard_negatives"], got["found"])
    folder = io.run_folder(a.artifacts_root)
    io.write_artifacts(folder, *io.artifact_tables(records, got["found"]), report, {"dataset_path": a.path})
    found = json.loads(report.first().report)
    print(json.dumps(found, ensure_ascii=False, indent=2) if a.json else "\n".join(evaluation.report_lines(found, a.path, folder)))


def generated(a: argparse.Namespace) -> None:
    rows = generate.documents(_spark(), a.count, a.seed, kinds=[a.type])
    for r in rows.orderBy("id").select(f"{a.type}_raw" if a.raw else a.type).toLocalIterator():
        print(r[0])


def table(a: argparse.Namespace) -> None:
    io.write_csv(generate.documents(_spark(), a.count, a.seed, a.include_raw).drop("id"), a.output)


def merge(a: argparse.Namespace) -> None:
    spark = _spark()
    left, right = (io.with_line_numbers(io.read_csv(spark, p), "line_number") for p in (a.left, a.right))
    io.write_csv(shaping.positional_merge(left, right, "line_number", a.count, a.keep_index).drop("line_number", "line_number_2"), a.output)


def transliterate(a: argparse.Namespace) -> None:
    rows = io.read_csv(_spark(), a.path)
    io.write_csv(shaping.addresses_spoken(rows, a.columns or rows.columns, a.mode, a.seed), a.output)


def pipeline(a: argparse.Namespace) -> None:
    done = framework.run(_spark(), framework.config_of(framework.read_yaml(a.config)))
    print(json.dumps(done, ensure_ascii=False, indent=2) if a.json else f"report: {done['artifacts']['report']}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, **options) -> argparse.ArgumentParser:
        made = sub.add_parser(name, **options)
        made.set_defaults(run_command=run)
        return made

    c = command("transcripts", transcripts, help="clean texts and write their numbers; spans as JSON by default")
    c.add_argument("text", nargs="*")
    c.add_argument("--path", help="text files, one transcript a line, instead of a text")
    c.add_argument("--out", help="folder of the results of --path, as JSON lines")
    modes = c.add_mutually_exclusive_group()
    for name in ("replace", "clean", "punctuation-clean", "run", "run-json"):
        modes.add_argument(f"--{name}", action="store_true")
    c.add_argument("--keep-punctuation", action="store_true")
    c.add_argument("--ascii", action="store_true", help="JSON in ASCII alone")
    c = command("evaluate", evaluate, help="score annotated transcripts")
    c.add_argument("path", nargs="?", default="gt_asr.jsonl")
    c.add_argument("--soft-gap", type=int, default=evaluation.SOFT_GAP)
    c.add_argument("--json", action="store_true")
    c.add_argument("--artifacts-root", default="artifacts")
    c = command("generate", generated, help="values of one type, said or written")
    c.add_argument("--type", required=True, choices=list(generate.GENERATORS))
    c.add_argument("--count", type=int, default=1)
    c.add_argument("--raw", action="store_true")
    c.add_argument("--seed", type=int, default=0)
    c = command("table", table, help="documents with every type, as CSV")
    c.add_argument("--count", type=int, default=1)
    c.add_argument("--output", default="all_types.csv")
    c.add_argument("--include-raw", action="store_true")
    c.add_argument("--seed", type=int, default=0)
    c = command("merge", merge, help="the first rows of two CSV files side by side")
    c.add_argument("left")
    c.add_argument("right")
    c.add_argument("output")
    c.add_argument("--count", type=int, default=10_000)
    c.add_argument("--keep-index", action="store_true")
    c = command("transliterate", transliterate, help="addresses of a CSV file as they are said")
    c.add_argument("path")
    c.add_argument("output")
    c.add_argument("--columns", nargs="*")
    c.add_argument("--mode", choices=["words", "spell", "random"], default="words")
    c.add_argument("--seed", type=int, default=0)
    c = command("pipeline", pipeline, help="an evaluation from a YAML file")
    c.add_argument("--config", required=True)
    c.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run_command(a)


if __name__ == "__main__":
    main()
