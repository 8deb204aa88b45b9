"""Corpus evaluation of found personal data against annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pii import find_pii, normal_birth_date, normalize_pii
from ..functions.spoken import digit_segments, spoken_date
from ..functions.text import single_spaced
from .spans import ratio, with_scores

#: Labels of annotated transcripts and the types that they stand for.
GOLD_TYPES = dict(zip("ТЕЛЕФОН СНИЛС ПАСПОРТ ДАТА_РОЖДЕНИЯ ОМС ИНН ВОЗРАСТ МСЭ СВИДЕТЕЛЬСТВО ВУ".split(), "PHONE SNILS PASSPORT DATE_BIRTH OMS INN AGE MSE BIRTH_CERTIFICATE DRIVER_LICENSE".split()))
SOFT_GAP = 12


def gold_rows(records: DataFrame) -> DataFrame:
    """(id, type, start, end, text) of annotations whose label is known."""
    known = F.create_map(*[F.lit(x) for pair in GOLD_TYPES.items() for x in pair])
    rows = records.select("id", F.explode("annotations").alias("a"))
    return rows.select("id", known[F.col("a.type")].alias("type"), F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.col("a.text").alias("text")).where("type IS NOT NULL")


def evaluation_key(kind: Column, text: Column, digits: Column, date: Column) -> Column:
    """The normal form of the value; else its digits; else the text in lower case. A date with a month's name counts only as ``date``."""
    canon = F.coalesce(normalize_pii(kind, digits), normalize_pii(kind, text))
    canon = F.when((kind == "DATE_BIRTH") & date.isNotNull(), normal_birth_date(date)).otherwise(canon)
    return F.coalesce(canon, F.when(digits != "", F.concat(F.lit("digits:"), digits)), F.concat(F.lit("text:"), F.lower(single_spaced(text))))


def spoken_key(gold: DataFrame) -> DataFrame:
    """gold with ``digits`` and ``key``. Number words are parsed once for each distinct text."""
    parse = F.udf(lambda t: None if t is None else ("".join(digit_segments(t)), spoken_date(t)), "digits string, date string", useArrow=True)
    distinct = gold.select("text").distinct().withColumn("said", parse("text")).select("text", "said.*")
    return gold.join(distinct, "text").withColumn("key", evaluation_key(F.col("type"), F.col("text"), F.col("digits"), F.col("date"))).drop("date")


def multiset_counts(gold: DataFrame, pred: DataFrame, rollup: bool = True) -> DataFrame:
    """tp, fp, fn by type and, as type null, in all; (type, key) matched as multisets over the whole corpus."""
    side = lambda df, name: df.groupBy("type", "key").agg(F.count("*").alias(name))
    zero = F.lit(0)
    both = side(gold, "g").join(side(pred, "p"), ["type", "key"], "full").select("type", "key", F.coalesce("g", zero).alias("g"), F.coalesce("p", zero).alias("p"))
    tally = [F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), zero)).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), zero)).alias("fn")]
    return both.rollup("type").agg(*tally) if rollup else both.groupBy("type").agg(*tally)


def with_specificity(counts: DataFrame) -> DataFrame:
    """Scores of columns tp, fp, fn, tn, neg_fp; 0 where a denominator is."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + tn + fp + fn), "specificity": ratio(tn, tn + F.col("neg_fp"))})


def proximity_clusters(spans: DataFrame, gap: int = SOFT_GAP, keys: tuple[str, ...] = ("id", "type")) -> DataFrame:
    """spans with ``cluster``, from 1: a new one begins where a span starts over ``gap`` after the end of the one before."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    fresh = F.when(F.col("start") - F.lag("end").over(w) <= gap, 0).otherwise(1)
    return spans.withColumn("__fresh", fresh).withColumn("cluster", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def soft_keys(spans: DataFrame, gap: int = SOFT_GAP) -> DataFrame:
    """Distinct (id, type, key): normal forms of single values and, but for dates and ages, of every run of neighbours in a cluster.

    spans: id, type, start, end, digits, normalized. Runs are built inside each cluster's array; one exchange.
    """
    clustered = proximity_clusters(spans, gap)
    whole = clustered.groupBy("id", "type", "cluster").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("digits", F.lit("")).alias("d"), "normalized"))).alias("m"))
    n = F.size("m")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.when(F.exists(F.slice(F.col("m"), i, j - i + 1), lambda x: x["d"] == ""), F.lit(None).cast("string")).otherwise(F.array_join(F.transform(F.slice(F.col("m"), i, j - i + 1), lambda x: x["d"]), "")))))
    joined = F.when(F.col("type").isin("DATE_BIRTH", "AGE"), F.array().cast("array<string>")).otherwise(runs)
    single = F.transform("m", lambda x: x["normalized"])
    one = whole.select("id", "type", F.explode(single).alias("key"))
    many = whole.select("id", "type", F.explode(joined).alias("run")).select("id", "type", normalize_pii(F.col("type"), F.col("run")).alias("key"))
    return one.unionByName(many).where("key IS NOT NULL").distinct()


def soft_counts(gold_keys: DataFrame, pred_keys: DataFrame) -> DataFrame:
    """tp, fp, fn by type and in all: keys are distinct within a record, then matched as multisets over the whole corpus."""
    once = lambda df: df.select("id", "type", "key").distinct()
    return multiset_counts(once(gold_keys), once(pred_keys))


def hard_negatives(records: DataFrame) -> DataFrame:
    """(category, n, false_positives): how many of the given harmless texts are found to hold personal data."""
    rows = records.select(F.explode("hard_negatives").alias("h")).select("h.category", F.size(find_pii(F.col("h.text"))).alias("hits"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("hits") > 0).alias("false_positives"))


def report(counts: DataFrame) -> DataFrame:
    """One row with the scores by type as JSON, types in order, null as ``all``."""
    rows = counts.select(F.struct(F.coalesce("type", F.lit("all")).alias("type"), "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall")).alias("r"))
    return rows.agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("report"))


def whole_report(hard: DataFrame, soft: DataFrame, negatives: DataFrame, found: DataFrame) -> DataFrame:
    """One row with counts, scores and counts by type of both matchings, and the harmless texts, as JSON."""
    zero = F.lit(0).cast("long")
    total, wrong = F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("false_positives"), zero)
    by_category = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("false_positives") > 0, F.struct("category", "false_positives")))))
    clean = negatives.agg(total.alias("total"), wrong.alias("neg_fp"), by_category.alias("by_category")).withColumn("tn", F.col("total") - F.col("neg_fp"))

    def side(counts: DataFrame, name: str) -> DataFrame:
        in_all = [F.coalesce(F.max(F.when(F.col("type").isNull(), F.col(c))), zero).alias(c) for c in ("tp", "fp", "fn")]
        per_type = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", F.struct("tp", "fp", "fn"))))))
        scored = with_specificity(counts.agg(*in_all, per_type.alias("per_type")).crossJoin(clean))
        return scored.select(F.struct(
            F.struct("tp", "fp", "fn", "tn").alias("counts"), F.struct("precision", "recall", "f1", "accuracy", "specificity").alias("metrics"),
            (F.col("tp") + F.col("fn")).alias("references"), (F.col("tp") + F.col("fp")).alias("predictions"), "per_type",
        ).alias(name))

    harmless = F.struct("total", F.col("neg_fp").alias("false_positives"), ratio(F.col("tn"), F.col("total")).alias("specificity"), F.col("by_category").alias("false_positives_by_category"))
    rows = found.agg(F.count("*").alias("records")).crossJoin(clean.select(harmless.alias("hard_negatives"))).crossJoin(side(hard, "hard")).crossJoin(side(soft, "soft"))
    return rows.select(F.to_json(F.struct("records", "hard_negatives", "hard", "soft")).alias("report"))


def scores_by_type(counts: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) of every known type, in order of their names, 0 where a type doesn't occur."""
    kinds = counts.sparkSession.createDataFrame([(t,) for t in sorted(GOLD_TYPES.values())], "type string")
    zero = F.lit(0).cast("long")
    whole = kinds.join(counts, "type", "left").select("type", *[F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn")])
    return with_scores(whole).drop("accuracy").orderBy("type")


def table_lines(title: str, counts: DataFrame) -> DataFrame:
    """(n, line): the scores by type as lines of text, a title and a header before them."""
    head = f"{'type':<18} {'tp':>5} {'fp':>5} {'fn':>5} {'precision':>10} {'recall':>10} {'f1':>10}"
    number = [F.format_string("%.4f", c) for c in ("precision", "recall", "f1")]
    line = F.concat_ws(" ", F.rpad("type", 18, " "), *[F.lpad(F.col(c).cast("string"), 5, " ") for c in ("tp", "fp", "fn")], *[F.lpad(x, 10, " ") for x in number])
    rows = scores_by_type(counts).select(F.array_position(F.array(*map(F.lit, sorted(GOLD_TYPES.values()))), F.col("type")).cast("int").alias("n"), line.alias("line"))
    return counts.sparkSession.createDataFrame([(-1, title), (0, head)], "n int, line string").unionAll(rows).orderBy("n")


def report_lines(report: dict, dataset: str, folder: str | None) -> list[str]:
    """The report as text: a few dozen lines, whatever the corpus."""
    negatives = report["hard_negatives"]
    out = [f"dataset: {dataset}"] + ([f"artifacts: {folder}"] if folder else [])
    out += [f"records: {report['records']}", f"hard negatives: {negatives['total']} total, {negatives['false_positives']} false positives, specificity={negatives['specificity']:.4f}", ""]
    for side in ("hard", "soft"):
        out += [side, *(f"  {k + ':':<12}{v:.4f}" for k, v in report[side]["metrics"].items()), ""]
    for side in ("hard", "soft"):
        out += [f"{side} per type", f"{'type':<18} {'tp':>5} {'fp':>5} {'fn':>5} {'precision':>10} {'recall':>10} {'f1':>10}"]
        for kind in sorted(GOLD_TYPES.values()):
            tp, fp, fn = (report[side]["per_type"].get(kind, {}).get(c, 0) for c in ("tp", "fp", "fn"))
            share = lambda a, b: a / b if b else 0.0
            out.append(f"{kind:<18} {tp:>5} {fp:>5} {fn:>5} {share(tp, tp + fp):>10.4f} {share(tp, tp + fn):>10.4f} {share(2 * tp, 2 * tp + fp + fn):>10.4f}")
        out.append("")
    return [*out, "hard negative false positives by category", *(f"  {k}: {v}" for k, v in negatives["false_positives_by_category"].items())]
