"""Evaluations put together from named parts: data sets, models and metrics by name, a run from a configuration, its report.

A data set is two DataFrames, lines (case_id, line, role, text) and gold spans (case_id, line, begin, end, label); a model turns lines into
predicted spans; a metric turns both into one row of numbers. All that a run collects is that row of each metric.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import find_pii
from ..operators import spans as S
from ..sources import io

LINES, SPANS = "case_id bigint, line int, role string, text string", "case_id bigint, line int, begin int, end int, label string"


class RegistryError(ValueError):
    """An unknown name, or parameters that a part doesn't take."""


# ---------------------------------------------------------------- parts


@dataclass(frozen=True)
class Dataset:
    lines: DataFrame
    gold: DataFrame

    def checked(self) -> Dataset:
        """Raises where there are no cases, columns are missing or a span can't be."""
        for df, schema in ((self.lines, LINES), (self.gold, SPANS)):
            lacking = {c.split()[0] for c in schema.split(", ")} - set(df.columns)
            if lacking:
                raise ValueError(f"columns are missing: {sorted(lacking)}")
        if self.lines.isEmpty():
            raise ValueError("a data set must have cases")
        if not S.invalid_spans(self.gold).isEmpty():
            raise ValueError("a gold span is empty, negative or without label")
        return self

    def cases(self) -> int:
        return self.lines.select("case_id").distinct().count()


class Model:
    """``predict`` gives spans of lines. A model that can learn has a ``fit`` too, which may return the fitted one."""

    def predict(self, lines: DataFrame) -> DataFrame:
        raise NotImplementedError


class Rules(Model):
    """The rules for numeric personal data."""

    def predict(self, lines: DataFrame) -> DataFrame:
        found = lines.select("case_id", "line", F.explode(find_pii("text")).alias("m"))
        return found.select("case_id", "line", F.col("m.start").alias("begin"), F.col("m.end").alias("end"), F.col("m.type").alias("label"))


class Nothing(Model):
    """Predicts no span."""

    def predict(self, lines: DataFrame) -> DataFrame:
        return lines.sparkSession.createDataFrame([], SPANS)


class Remembered(Model):
    """Learns the texts of gold spans, and predicts their labels for lines that are equal to one."""

    def __init__(self, known: DataFrame | None = None):
        self.known = known

    def fit(self, data: Dataset) -> Remembered:
        texts = data.gold.join(data.lines, ["case_id", "line"]).select("text", "begin", "end", "label").distinct()
        return Remembered(io.stored(texts, "remembered"))

    def predict(self, lines: DataFrame) -> DataFrame:
        if self.known is None:
            raise ValueError("fit the model first")
        return lines.join(self.known, "text").select("case_id", "line", "begin", "end", "label")


class Mapped(Model):
    """A function from an iterator of pandas frames to such an iterator, for models of other libraries."""

    def __init__(self, function: Callable):
        self.function = function

    def predict(self, lines: DataFrame) -> DataFrame:
        return S.predicted(lines, self.function, SPANS)


def _example(spark: SparkSession) -> Dataset:
    lines = spark.createDataFrame([(1, 0, "patient", "телефон 8 913 123 45 67")], LINES)
    return Dataset(lines, spark.createDataFrame([(1, 0, 8, 23, "PHONE")], SPANS))


def _from_files(spark: SparkSession, lines: str, spans: str) -> Dataset:
    return Dataset(io.read_jsonl(spark, lines, LINES), io.read_jsonl(spark, spans, SPANS))


def _from_records(spark: SparkSession, path: str) -> Dataset:
    """Annotated transcripts, a line each."""
    from ..operators.evaluation import gold_rows

    records = io.read_jsonl(spark, path)
    lines = records.select(F.col("id").alias("case_id"), F.lit(0).alias("line"), F.lit("speaker").alias("role"), F.col("value").alias("text"))
    gold = gold_rows(records).select(F.col("id").alias("case_id"), F.lit(0).alias("line"), F.col("start").alias("begin"), "end", F.col("type").alias("label"))
    return Dataset(lines, gold)


def _counts(data: Dataset, predicted: DataFrame) -> DataFrame:
    """How many cases there are, and how many of them have predictions."""
    return data.lines.agg(F.count_distinct("case_id").alias("cases_count")).crossJoin(predicted.agg(F.count_distinct("case_id").alias("predicted_cases_count"), F.count("*").alias("spans_count")))


def _mode(name: str) -> Callable:
    return lambda data, predicted: S.with_scores(S.MODES[name](data.gold, predicted))


DATASETS: dict[str, Callable[..., Dataset]] = {"example": _example, "spans": _from_files, "records": _from_records}
MODELS: dict[str, Callable[..., Model]] = {"rules": Rules, "nothing": Nothing, "remembered": Remembered, "example": Rules}
METRICS: dict[str, Callable[[Dataset, DataFrame], DataFrame]] = {
    "example_count": _counts, **{name: _mode(name) for name in S.MODES}, "coverage": lambda data, predicted: S.coverage(data.gold, predicted),
    "char_confusion": lambda data, predicted: S.char_confusion(data.gold, predicted, data.lines), "total_chars": lambda data, predicted: S.document_characters(data.lines).agg(F.sum("total_chars").alias("total_chars")),
}


def register(kind: str, name: str, part: Callable) -> None:
    """Makes a part of one's own known: kind is dataset, model or metric."""
    {"dataset": DATASETS, "model": MODELS, "metric": METRICS}[kind][name] = part


def _part(kind: str, known: dict, name: str) -> Callable:
    if name not in known:
        raise RegistryError(f"Unknown {kind} id: {name}")
    return known[name]


def _made(kind: str, known: dict, component: Component, *first):
    try:
        return _part(kind, known, component.id)(*first, **component.params)
    except TypeError as e:
        raise RegistryError(f"{kind} {component.id!r} doesn't take these parameters: {e}") from e


def evaluate(data: Dataset, model: Model, metrics: dict[str, Callable]) -> dict:
    """{samples_count, metrics: {name: numbers}} of one model on one data set. Predictions are made once."""
    data.checked()
    predicted = io.stored(model.predict(data.lines).select(*[c.split()[0] for c in SPANS.split(", ")]), "predicted")
    strange = S.misaligned(data.lines.select("case_id"), predicted.select("case_id")).where("missing = 'document'")
    if not strange.isEmpty():
        raise ValueError("there are predictions for cases that the data set lacks")
    if not S.invalid_spans(predicted).isEmpty():
        raise ValueError("a predicted span is empty, negative or without label")
    return {"samples_count": data.cases(), "metrics": {name: compute(data, predicted).first().asDict() for name, compute in metrics.items()}}


# ---------------------------------------------------------------- configuration


@dataclass(frozen=True)
class Component:
    id: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Outputs:
    artifacts_dir: str = "artifacts/ml"
    report_filename: str = "report.json"
    write_dataset_snapshot_json: bool = False
    write_dataset_snapshot_parquet: bool = False


@dataclass(frozen=True)
class Config:
    run: dict
    dataset: Component
    model: Component
    metrics: tuple[Component, ...]
    training: bool
    evaluation: bool
    outputs: Outputs


def _component(value, what: str) -> Component:
    if isinstance(value, str) and value:
        return Component(value)
    if isinstance(value, dict) and isinstance(value.get("id"), str):
        return Component(value["id"], dict(value.get("params") or {}))
    raise ValueError(f"{what} must be a name, or an id with params")


def config_of(given: dict) -> Config:
    """A configuration from a mapping as YAML files hold it."""
    switch = lambda name, default: bool((given.get(name) or {}).get("enabled", default))
    outputs = given.get("outputs") or {}
    unknown = set(outputs) - set(Outputs.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    metrics = tuple(_component(m, "a metric") for m in given.get("metrics") or ())
    return Config(dict(given.get("run") or {}), _component(given.get("dataset"), "dataset"), _component(given.get("model"), "model"), metrics, switch("training", False), switch("evaluation", True), Outputs(**outputs))


def _scalar(text: str):
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none", "~"):
        return None
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def simple_yaml(text: str) -> dict:
    """Mappings of two levels with plain values and flat lists: what is read where no YAML library is installed."""
    out: dict = {}
    section = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        depth, (key, colon, value) = len(line) - len(line.lstrip(" ")), line.strip().partition(":")
        if not colon or not key.strip() or depth not in (0, 2) or (depth == 2 and not isinstance(out.get(section), dict)):
            raise ValueError(f"only two levels of keys and values can be read here: {raw!r}")
        into = out if depth == 0 else out[section]
        into[key.strip()] = _scalar(value.strip()) if value.strip() else {}
        section = key.strip() if depth == 0 else section
    return out


def read_yaml(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        found = simple_yaml(text)
    else:
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found


def run(spark: SparkSession, config: Config) -> dict:
    """Fits where asked, evaluates, and writes the report and snapshots; returns the report with the places of what was written."""
    data = _made("dataset", DATASETS, config.dataset, spark).checked()
    model = _made("model", MODELS, config.model)
    metrics = {m.id: _part("metric", METRICS, m.id) for m in config.metrics}
    if any(m.params for m in config.metrics):
        raise RegistryError("metrics take no parameters")
    if config.training:
        if not callable(getattr(model, "fit", None)):
            raise TypeError(f"model {config.model.id!r} can't be trained; switch training off or name one that can")
        model = model.fit(data) or model
    found = evaluate(data, model, metrics) if config.evaluation else {"samples_count": 0, "metrics": {}}
    report = {"run": config.run, "dataset": asdict(config.dataset), "model": asdict(config.model), "metrics": [asdict(m) for m in config.metrics], "training": {"enabled": config.training}, "evaluation": {"enabled": config.evaluation}, "samples_count": found["samples_count"], "metric_results": found["metrics"]}
    at = config.outputs.artifacts_dir
    places = {"report": f"{at}/{config.outputs.report_filename}"}
    if config.outputs.write_dataset_snapshot_json:
        places["dataset_snapshot_json"] = f"{at}/dataset_snapshot.json"
        io.write_snapshot_json(data.lines, data.gold, places["dataset_snapshot_json"])
    if config.outputs.write_dataset_snapshot_parquet:
        places["dataset_snapshot_parquet"] = f"{at}/dataset_snapshot.parquet"
        io.write_snapshot(S.snapshot(data.lines, data.gold), places["dataset_snapshot_parquet"], overwrite=True)
    report["artifacts"] = places
    io.write_text(spark, places["report"], json.dumps(report, ensure_ascii=False, indent=2))
    return report
