"""The whole anonymisation of a transcript table, its layers for audit, and names for SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spoken
from ..functions.pii import Rule, with_pii
from ..functions.punctuation import PunctuationConfig, plain_text, protected_places, removed_places
from ..operators import evaluation
from ..sources.io import stored


def anonymize(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, as_of: date | None = None, keep_punctuation: bool = False) -> DataFrame:
    """df with fluent_text, clean_text, normalized_text, pii and masked_text. Map-only: scans of each text in Arrow batches."""
    cleaned = spoken.normalize_transcripts(df, text_col, punctuation=None if keep_punctuation else PunctuationConfig())
    return with_pii(cleaned, "normalized_text", rules, as_of)


_CANDIDATE = "candidates array<struct<value:string,kind:string,confidence:double>>"
RESULT_TYPE = (
    "original_text string, disfluency_cleaned_text string, punctuation_cleaned_text string, cleaned_text string, normalized_text string, removed_spans array<struct<start:int,end:int,raw:string,reason:string>>, "
    "punctuation_removed_spans array<struct<start:int,end:int,raw:string,reason:string>>, punctuation_protected_spans array<struct<start:int,end:int,raw:string,reason:string>>, "
    f"integer_spans array<struct<value:string,start:int,end:int,raw:string,normalized:string,kind:string,status:string,confidence:double,{_CANDIDATE.replace(' ', ':', 1)}>>"
)


def _named(names: str, rows) -> list[dict]:
    return [dict(zip(names.split(), r)) for r in rows]


def run_text(text: str, fillers: bool = True, punctuation: bool = True, spans: bool = True, candidates: bool = True) -> dict:
    """Every layer of the run of one text. Filler spans are places in the text, punctuation spans in the text without fillers, numbers in the cleaned one."""
    fluent = spoken.without_fillers_text(text) if fillers else text
    plain = plain_text(fluent) if punctuation else fluent
    out = {"original_text": text, "disfluency_cleaned_text": fluent, "punctuation_cleaned_text": plain, "cleaned_text": plain, "normalized_text": spoken.with_digits_text(plain)}
    if not spans:
        return out
    config = PunctuationConfig()
    out["removed_spans"] = _named("start end raw reason", spoken.removed_fillers(text)) if fillers else []
    out["punctuation_removed_spans"] = _named("start end raw reason", [(a, b, fluent[a:b], "punctuation") for a, b in removed_places(fluent, config)]) if punctuation else []
    out["punctuation_protected_spans"] = _named("start end raw reason", [(a, b, fluent[a:b], r) for a, b, r in protected_places(fluent, config)]) if punctuation else []
    out["integer_spans"] = [span_dict(s, candidates) for s in spoken.number_spans(plain)]
    return out


def span_dict(s: spoken.NumberSpan, candidates: bool = True) -> dict:
    out = {k: getattr(s, k) for k in ("value", "start", "end", "raw", "normalized", "kind", "status", "confidence")}
    return out | {"candidates": _named("value kind confidence", s.candidates)} if candidates else out


def run_result(text: Column, fillers: bool = True, punctuation: bool = True) -> Column:
    """struct of all layers of the run; null for a null text."""

    @F.pandas_udf(RESULT_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in RESULT_TYPE.split(", ")]
        for texts in batches:
            yield pd.DataFrame([dict.fromkeys(names) if t is None else run_text(t, fillers, punctuation) for t in texts], columns=names)

    return F.when(text.isNotNull(), run(text))


def parse(df: DataFrame, text_col: str = "text", replace: bool = False, include_candidates: bool = True) -> DataFrame:
    """df with ``items``, the number spans, and ``replaced_text``, null unless asked for."""
    found = spoken.extract_numbers(F.col(text_col))
    items = found if include_candidates else F.transform(found, lambda s: s.dropFields("candidates"))
    return df.withColumns({"items": items, "replaced_text": spoken.with_digits(F.col(text_col)) if replace else F.lit(None).cast("string")})


def punctuation_clean(df: DataFrame, text_col: str = "text", include_spans: bool = True) -> DataFrame:
    """df with ``cleaned_text`` and, if asked for, ``removed_spans`` and ``protected_spans``."""
    from ..functions.punctuation import protected_spans, removed_punctuation, without_punctuation

    spans = {"removed_spans": removed_punctuation(text_col), "protected_spans": protected_spans(text_col)} if include_spans else {}
    return df.withColumns({"cleaned_text": without_punctuation(text_col), **spans})


def run(df: DataFrame, text_col: str = "text", include_spans: bool = True, remove_punctuation: bool = True) -> DataFrame:
    """df with the texts of every layer and, if asked for, their spans."""
    names = [c.split(" ")[0] for c in RESULT_TYPE.split(", ")][: None if include_spans else 5]
    done = run_result(F.col(text_col), punctuation=remove_punctuation)
    out = df.withColumn("run_layers", done)
    return out.select(*df.columns, *[F.col("run_layers")[n].alias(n) for n in names])


def register(spark: SparkSession) -> None:
    """SQL functions over texts: without_fillers, with_digits, without_punctuation, run_json; and the table function number_spans(text)."""
    plain = {"without_fillers": spoken.without_fillers_text, "with_digits": spoken.with_digits_text, "without_punctuation": plain_text, "run_json": lambda t: json.dumps(run_text(t), ensure_ascii=False)}

    def over(function):
        @F.arrow_udf("string")
        def each(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

        return each

    for name, function in plain.items():
        spark.udf.register(name, over(function))

    @F.udtf(returnType="value string, start int, end int, kind string, confidence double")
    class NumberSpans:
        def eval(self, text: str):
            for s in spoken.number_spans(text) if text else ():
                yield s.value, s.start, s.end, s.kind, s.confidence

    spark.udtf.register("number_spans", NumberSpans)


def evaluate(records: DataFrame, gap: int = evaluation.SOFT_GAP) -> dict[str, DataFrame]:
    """hard and soft counts by type, and false positives on hard negatives, of annotated records."""
    gold = stored(evaluation.spoken_key(evaluation.gold_rows(records)), "gold")
    found = stored(anonymize(records.select("id", "domain", "split", F.col("value").alias("text")) if "domain" in records.columns else records.select("id", F.col("value").alias("text"))), "found")
    pred = found.select("id", F.explode("pii").alias("m")).select("id", "m.type", F.col("m.normalized").alias("key"))
    known = gold.withColumn("normalized", F.when(~F.col("key").rlike("^(digits|text):"), F.col("key")))
    soft = evaluation.soft_counts(evaluation.soft_keys(known, gap), pred)
    return {"hard": evaluation.multiset_counts(gold, pred), "soft": soft, "hard_negatives": evaluation.hard_negatives(records), "found": found}
