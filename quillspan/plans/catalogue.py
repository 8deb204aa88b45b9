"""Every query of the transcript operators over the given tables, with the SQL that checks it.

Carrier texts are projected from keys by expressions that Spark and the checking engine read alike, so that the right answer
is known by construction.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, fuzzy, lexicon, pii, punctuation, spoken, text
from ..operators import evaluation, generate, shaping, spans
from ..sources.io import snapshot_json, spread
from ..streaming.transcripts import finds_by_session
from .api import anonymize, evaluate, run_result

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
AS_OF = date(2026, 1, 1)
CASES = 100_000  # rows of a part where rows are grouped by case


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(spark: SparkSession, sf: str, name: str, key: str, rows: int = 5_000) -> DataFrame:
    """A table in parts of about ``rows`` rows by the hash of its key, for work that takes long or holds much a row."""
    return spread(_t(spark, sf, name), key, rows)


def _documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """Documents, or another table of whole texts, of which fewer rows and bytes than Spark's defaults travel to Python at a time."""
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for limit, read, most in (("maxRecordsPerBatch", int, 1000), ("maxBytesPerBatch", in_bytes, 4 << 20)):
        if not 0 < read(spark.conf.get(f"spark.sql.execution.arrow.{limit}")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{limit}", str(most))
    return _t(spark, sf, name)


def _key(column: str, factor: int, digits: int) -> str:
    return f"lpad(cast({column} * {factor} % {10**digits} as string), {digits}, '0')"


_NINE, _SEVEN = _key("c_custkey", 7919, 9), _key("c_custkey", 7919, 7)

# ---------------------------------------------------------------- the whole run


def spoken_customers(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence a customer with a telephone number in words and fillers around it."""
    number = F.concat(F.lit("89"), F.expr(_NINE))
    said = F.concat(F.lit("ну мой телефон эээ "), generate.digits_words(number), F.lit(", вот."))
    return _spread(spark, sf, "customer", "c_custkey").select("c_custkey", number.alias("number"), said.alias("text"))


@query(f"SELECT c_custkey, 'мой телефон 89' || {_NINE} AS normalized_text, 'мой телефон [PHONE]' AS masked_text, '+79' || {_NINE} AS phone FROM customer")
def anonymize_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    done = anonymize(spoken_customers(spark, sf), as_of=AS_OF)
    return done.select("c_custkey", "normalized_text", "masked_text", F.get("pii", F.lit(0))["normalized"].alias("phone"))


@query("SELECT c_custkey, 'номер ' || c_custkey || ' да' AS normalized_text, 3 AS n_removed, 'hesitation' AS second_reason, 0 AS n_protected, 2 AS n_signs, c_custkey::VARCHAR AS number FROM customer")
def run_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The layers of a whole run, read from its JSON."""
    rows = _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", "'ну номер эээ, ' || c_custkey || '! как бы да' AS text").select("c_custkey", F.to_json(run_result(F.col("text"))).alias("j"))
    at = lambda path: F.get_json_object("j", f"$.{path}")
    n = lambda name, kind: F.size(F.from_json(at(name), f"array<struct<{kind}>>"))
    return rows.select("c_custkey", at("normalized_text").alias("normalized_text"), n("removed_spans", "raw:string").alias("n_removed"), at("removed_spans[1].reason").alias("second_reason"), n("punctuation_protected_spans", "raw:string").alias("n_protected"), n("punctuation_removed_spans", "raw:string").alias("n_signs"), at("integer_spans[0].value").alias("number"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize_transcripts(spark, sf_dir)


@query("SELECT 'PHONE' AS type, count(*)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn FROM customer UNION ALL SELECT NULL, count(*)::BIGINT, 0::BIGINT, 0::BIGINT FROM customer")
def evaluation_hard(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate(_records(spark, sf))["hard"].select("type", "tp", "fp", "fn")


@query("SELECT 'PHONE' AS type, count(*)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn FROM customer UNION ALL SELECT NULL, count(*)::BIGINT, 0::BIGINT, 0::BIGINT FROM customer")
def evaluation_soft(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate(_records(spark, sf))["soft"].select("type", "tp", "fp", "fn")


@query("SELECT c_mktsegment AS category, count(*)::BIGINT AS n, count(*) FILTER (WHERE c_custkey % 5 = 0)::BIGINT AS false_positives FROM customer GROUP BY 1")
def evaluation_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.hard_negatives(_records(spark, sf))


_KINDS = ", ".join(f"'{k}'" for k in ("PHONE", "SNILS", "PASSPORT", "INN", "OMS", "DATE_BIRTH", "DRIVER_LICENSE", "MSE", "BIRTH_CERTIFICATE", "AGE"))
#: Every spoken value is found but for birth dates with the month's name, which no rule knows.
_BY_TYPE = f"SELECT list_element([{_KINDS}], (c_custkey % 10 + 1)::INT) AS type, count(*) FILTER (WHERE c_custkey % 10 <> 5 OR c_custkey // 10 % 2 = 1)::BIGINT AS tp, count(*) FILTER (WHERE c_custkey % 10 = 5 AND c_custkey // 10 % 2 = 0)::BIGINT AS fn FROM customer GROUP BY 1"


@query(f"""
    WITH t AS ({_BY_TYPE}), a AS (SELECT sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn FROM t), p AS (SELECT '{{' || string_agg('"' || type || '":{{"tp":' || tp || ',"fp":0,"fn":' || fn || '}}', ',' ORDER BY type) || '}}' AS per_type FROM t),
    h AS (SELECT c_mktsegment AS c, count(*) AS n, count(*) FILTER (WHERE c_custkey % 5 = 0) AS f FROM customer GROUP BY 1), n AS (SELECT sum(n)::BIGINT AS n, sum(f)::BIGINT AS f, '{{' || string_agg('"' || c || '":' || f, ',' ORDER BY c) FILTER (WHERE f > 0) || '}}' AS by_c FROM h),
    s AS (SELECT '{{"counts":{{"tp":' || tp || ',"fp":0,"fn":' || fn || ',"tn":' || (n - f) || '}},"metrics":{{"precision":1.0,"recall":' || (tp / (tp + fn))::VARCHAR || ',"f1":' || (2 * tp / (2 * tp + fn))::VARCHAR || ',"accuracy":' || ((tp + n - f) / (tp + n - f + fn))::VARCHAR || ',"specificity":' || ((n - f) / n)::VARCHAR || '}},"references":' || (tp + fn) || ',"predictions":' || tp || ',"per_type":' || per_type || '}}' AS side, n.* FROM a, p, n)
    SELECT '{{"records":' || n || ',"hard_negatives":{{"total":' || n || ',"false_positives":' || f || ',"specificity":' || ((n - f) / n)::VARCHAR || ',"false_positives_by_category":' || by_c || '}},"hard":' || side || ',"soft":' || side || '}}' AS report FROM s
""")
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.whole_report(*map(evaluate(_typed_records(spark, sf)).get, ("hard", "soft", "hard_negatives", "found")))


@query(f"""
    WITH t AS ({_BY_TYPE}), r AS (SELECT *, row_number() OVER (ORDER BY type) AS n FROM t)
    SELECT n::INTEGER AS n, printf('%-18s %5d %5d %5d %10.4f %10.4f %10.4f', type, tp, 0, fn, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, tp / (tp + fn), 2 * tp / (2 * tp + fn)) AS line FROM r
    UNION ALL SELECT -1, 'hard per type' UNION ALL SELECT 0, printf('%-18s %5s %5s %5s %10s %10s %10s', 'type', 'tp', 'fp', 'fn', 'precision', 'recall', 'f1')
""")
def evaluation_table(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.table_lines("hard per type", evaluate(_typed_records(spark, sf))["hard"])


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated records: the spoken sentence, its number as gold, and a harmless text that every fifth time looks like a number."""
    rows = spoken_customers(spark, sf).join(_spread(spark, sf, "customer", "c_custkey").select("c_custkey", "c_mktsegment"), "c_custkey")
    words = generate.digits_words(F.col("number"))
    negative = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("телефон "), F.col("number"))).otherwise(F.concat(F.lit("доза "), F.col("c_custkey") % 9, F.lit(" мг")))
    note = F.struct(F.lit(19).alias("start"), (F.lit(19) + F.length(words)).alias("end"), F.lit("ТЕЛЕФОН").alias("type"), words.alias("text"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("text").alias("value"), F.array(note).alias("annotations"), F.array(F.struct(negative.alias("text"), F.col("c_mktsegment").alias("category"))).alias("hard_negatives"))


_ORDINALS = "первое второе третье четвёртое пятое шестое седьмое восьмое девятое десятое одиннадцатое двенадцатое тринадцатое четырнадцатое пятнадцатое шестнадцатое семнадцатое восемнадцатое девятнадцатое двадцатое".split()
_ORDINALS += [f"двадцать {w}" for w in _ORDINALS[:9]]


def _typed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated records of all ten types, by key: the number in words after the words of its carrier; of birth dates every other one with the month's name."""
    said = _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", "c_mktsegment", f"element_at(array({', '.join(_CARRIERS.values())}), cast(c_custkey % {len(_CARRIERS)} as int) + 1) AS t")
    kind = F.element_at(F.array(*map(F.lit, _CARRIERS)), (F.col("c_custkey") % len(_CARRIERS)).cast("int") + 1)
    number = F.regexp_replace(F.regexp_extract("t", r"\d[\d. а-я]*$", 0), r"\D", "")
    lead = F.regexp_extract("t", r"^\D+", 0)
    day, month, year = (F.substring(number, a, n).try_cast("int") for a, n in ((1, 2), (3, 2), (5, 4)))
    named = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _ORDINALS)), day), F.element_at(F.array(*map(F.lit, generate.MONTHS)), month), generate.number_words(year))
    words = F.when((kind == "DATE_BIRTH") & (F.floor(F.col("c_custkey") / len(_CARRIERS)) % 2 == 0), named).when(kind == "AGE", generate.number_words(number)).otherwise(generate.digits_words(number))
    label = F.create_map(*[F.lit(x) for k, v in evaluation.GOLD_TYPES.items() for x in (v, k)])[kind]
    note = F.struct(F.length(lead).alias("start"), (F.length(lead) + F.length(words)).alias("end"), label.alias("type"), words.alias("text"))
    records = _records(spark, sf).select("id", "hard_negatives")
    return said.select(F.col("c_custkey").alias("id"), F.concat(lead, words).alias("value"), F.array(note).alias("annotations")).join(records, "id")


# ---------------------------------------------------------------- rules and normal forms

_CARRIERS = {
    "PHONE": f"'телефон 89' || {_NINE}",
    "SNILS": f"'снилс ' || {_key('c_custkey', 104729, 11)}",
    "PASSPORT": f"'паспорт серия 4510 номер ' || {_key('c_custkey', 7919, 6)}",
    "INN": f"'инн ' || {_key('c_custkey', 1299709, 12)}",
    "OMS": f"'полис омс 77' || {_key('c_custkey', 1299709, 14)}",
    "DATE_BIRTH": "'дата рождения ' || lpad(cast(c_custkey % 28 + 1 as string), 2, '0') || '.' || lpad(cast(c_custkey % 12 + 1 as string), 2, '0') || '.' || cast(1930 + c_custkey % 80 as string)",
    "DRIVER_LICENSE": f"'водительские права номер 77' || {_key('c_custkey', 7919, 8)}",
    "MSE": f"'справка мсэ ' || {_SEVEN}",
    "BIRTH_CERTIFICATE": f"'свидетельство о рождении ' || {_key('c_custkey', 7919, 6)}",
    "AGE": "'возраст ' || cast(c_custkey % 90 + 1 as string)",
}


def carriers(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, wanted, text): a sentence of every type a customer."""
    pairs = ", ".join(f"named_struct('wanted', '{k}', 'text', {v})" for k, v in _CARRIERS.items())
    return _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", f"inline(array({pairs}))")


@query("SELECT t AS type, count(*)::BIGINT AS n FROM customer, (SELECT unnest([" + ", ".join(f"'{k}'" for k in _CARRIERS) + "]) AS t) GROUP BY ROLLUP (t)")
def pii_type_rollup(spark: SparkSession, sf: str) -> DataFrame:
    found = carriers(spark, sf).select(F.explode(pii.find_pii("text", as_of=AS_OF)).alias("m"))
    return found.select("m.type").rollup("type").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, 'телефон [PHONE]' AS masked_text FROM customer")
def phone_mask(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", f"{_CARRIERS['PHONE']} AS text")
    return pii.with_pii(rows, as_of=AS_OF).select("c_custkey", "masked_text")


@query(f"SELECT c_custkey, 'телефон <тел>' AS masked_text FROM customer")
def mask_replacements(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", f"{_CARRIERS['PHONE']} AS text")
    return rows.select("c_custkey", pii.mask("text", pii.find_pii("text"), {"PHONE": "<тел>"}).alias("masked_text"))


_PII_SNILS, _PII_SUM = _key("c_custkey", 104729, 11), " + ".join(f"cast(substr(v, {i}, 1) as int) * {10 - i}" for i in range(1, 10))


@query(f"""
    WITH n AS (SELECT c_custkey, {_PII_SNILS} AS v FROM customer), s AS (SELECT *, {_PII_SUM} AS t FROM n), c AS (SELECT *, (CASE WHEN t < 100 THEN t ELSE t % 101 % 100 END) = cast(substr(v, 10, 2) as int) AS ok FROM s)
    SELECT c_custkey, 'SNILS' AS type, v AS normalized, CASE WHEN ok THEN 0.99 ELSE 0.89 END::DOUBLE AS confidence, 11 AS length, ok AS checksum_valid, true AS positive_context_hit, 95 AS priority, 'снилс ' || v AS context FROM c
""")
def pii_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = carriers(spark, sf).where("wanted = 'SNILS'").select("c_custkey", F.explode(pii.find_pii("text", as_of=AS_OF)).alias("m"))
    return rows.select("c_custkey", "m.type", "m.normalized", F.round("m.confidence", 6).alias("confidence"), "m.metadata.length", "m.metadata.checksum_valid", "m.metadata.positive_context_hit", "m.metadata.priority", "m.context")


@query(f"SELECT c_custkey, 'ORDER' AS type, {_SEVEN} AS normalized, 'заказ № [ORDER]' AS masked_text FROM customer")
def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule of one's own in place of the ten."""
    own = pii.Rule("ORDER", "order", pii._n(7), pii._stems("заказ"), pii._stems("возврат"), 20, 0, 50, 0.7, lengths=(7, 7))
    rows = _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", f"'заказ № ' || {_SEVEN} AS text")
    done = pii.with_pii(rows, rules=[own])
    return done.select("c_custkey", F.get("pii", F.lit(0))["type"].alias("type"), F.get("pii", F.lit(0))["normalized"].alias("normalized"), "masked_text")


@query(f"SELECT c_custkey, '+79' || {_NINE} AS phone FROM customer")
def phone_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").selectExpr("c_custkey", f"(CASE c_custkey % 3 WHEN 0 THEN '8 (9' WHEN 1 THEN '+7-9' ELSE '9' END) || {_NINE} AS v")
    return rows.select("c_custkey", pii.normal_phone(F.col("v")).alias("phone"))


_SNILS = _key("o_orderkey", 104729, 11)
_SUM9 = " + ".join(f"cast(substr(v, {i}, 1) as int) * {10 - i}" for i in range(1, 10))


@query(f"WITH n AS (SELECT o_orderkey, {_SNILS} AS v FROM orders), s AS (SELECT *, {_SUM9} AS t FROM n) SELECT o_orderkey, (CASE WHEN t < 100 THEN t WHEN t % 101 = 100 THEN 0 ELSE t % 101 END) = cast(substr(v, 10, 2) as int) AS valid FROM s")
def snils_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").selectExpr("o_orderkey", f"{_SNILS} AS v").select("o_orderkey", checksums.snils_valid(F.col("v")).alias("valid"))


_INN = _key("o_orderkey", 1299709, 12)


def _weights(ws: tuple[int, ...]) -> str:
    return " + ".join(f"cast(substr(v, {i}, 1) as int) * {w}" for i, w in enumerate(ws, 1))


@query(f"WITH n AS (SELECT o_orderkey, {_INN} AS v FROM orders) SELECT o_orderkey, ({_weights((7, 2, 4, 10, 3, 5, 9, 4, 6, 8))}) % 11 % 10 = cast(substr(v, 11, 1) as int) AND ({_weights((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))}) % 11 % 10 = cast(substr(v, 12, 1) as int) AS valid FROM n")
def inn_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").selectExpr("o_orderkey", f"{_INN} AS v").select("o_orderkey", checksums.inn_valid(F.col("v")).alias("valid"))


@query("WITH n AS (SELECT o_orderkey, " + _key("o_orderkey", 1299709, 17) + " AS v FROM orders) SELECT o_orderkey, cast((10 - list_sum(list_transform(range(1, 18), lambda i: CASE WHEN (17 - i) % 2 = 0 THEN (CASE WHEN cast(substr(v, i::INT, 1) as int) * 2 > 9 THEN cast(substr(v, i::INT, 1) as int) * 2 - 9 ELSE cast(substr(v, i::INT, 1) as int) * 2 END) ELSE cast(substr(v, i::INT, 1) as int) END)) % 10) % 10 AS INTEGER) AS control FROM n")
def oms_checksum(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").selectExpr("o_orderkey", _key("o_orderkey", 1299709, 17) + " AS v")
    return rows.select("o_orderkey", checksums.luhn_control(F.col("v"), 17).cast("int").alias("control"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%d.%m.%Y') END AS born FROM orders")
def birth_date_normalize(spark: SparkSession, sf: str) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 7 == 0, F.lit("31.02.1990")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "ddMMyyyy")).otherwise(F.date_format("o_orderdate", "d - M - yyyy"))
    return _t(spark, sf, "orders").select("o_orderkey", pii.normal_birth_date(written, AS_OF).alias("born"))


@query("WITH RECURSIVE c AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey % 50, l_suppkey % 20) AS n, (l_partkey % 50)::INT AS s, (l_partkey % 50 + 1 + l_suppkey % 20)::INT AS e FROM lineitem), g(k, n, kept) AS (SELECT k, n, [{'s': s, 'e': e}] FROM c WHERE n = 1 UNION ALL SELECT g.k, c.n, CASE WHEN len(list_filter(g.kept, lambda x: x.s < c.e AND c.s < x.e)) > 0 THEN g.kept ELSE list_append(g.kept, {'s': c.s, 'e': c.e}) END FROM g JOIN c ON c.k = g.k AND c.n = g.n + 1) SELECT k AS l_orderkey, len(kept)::INTEGER AS n_kept, list_sum(list_transform(kept, lambda x: x.s))::INTEGER AS starts, list_sum(list_transform(kept, lambda x: x.e))::INTEGER AS ends FROM g QUALIFY n = max(n) OVER (PARTITION BY k)")
def overlap_resolution(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select("l_orderkey", F.struct((-F.col("l_quantity")).alias("rank"), "l_linenumber", (F.col("l_partkey") % 50).cast("int").alias("start"), (F.col("l_partkey") % 50 + 1 + F.col("l_suppkey") % 20).cast("int").alias("end")).alias("c"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("c")).alias("c")).select("l_orderkey", text.resolve(F.col("c")).alias("k")).select("l_orderkey", F.size("k").alias("n_kept"), *[F.aggregate(f"k.{x}", F.lit(0), lambda a, b: a + b).alias(f"{x}s") for x in ("start", "end")])


# ---------------------------------------------------------------- text

_PUNCT = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\p{Z}]"


@query(rf"WITH t AS (SELECT unnest(regexp_extract_all(text, '[0-9]+|[A-Za-zА-Яа-яЁё]+|{_PUNCT}')) AS t FROM documents) SELECT CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'digits' WHEN regexp_matches(t, '^\p{{L}}+$') THEN 'word' ELSE 'punct' END AS kind, count(*)::BIGINT AS n FROM t GROUP BY 1")
def token_kinds(spark: SparkSession, sf: str) -> DataFrame:
    raw = _t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({text.TOKEN})"), 1)).alias("t"))
    return raw.groupBy(text.kind_of(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query(rf"SELECT conv_id, turn, length(regexp_replace(text, '[^A-Za-zА-Яа-яЁё]+', '', 'g'))::BIGINT AS letters, array_to_string(regexp_extract_all(text, '[0-9A-Za-zА-Яа-яЁё]|{_PUNCT}'), '') AS cut_out FROM conversations")
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(text.tokens("text"), lambda t: t["kind"] == "word")
    width = F.aggregate(words, F.lit(0).cast("long"), lambda n, t: n + t["end"] - t["start"])
    cut = F.array_join(F.transform(text.tokens("text"), lambda t: text.cut(F.col("text"), t["start"], t["end"])), "")
    return _documents(spark, sf, "conversations").select("conv_id", "turn", width.alias("letters"), cut.alias("cut_out"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INTEGER AS n_words FROM documents")
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", text.word_count("text").alias("n_words"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\pP№]+', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def punctuation_plain(spark: SparkSession, sf: str) -> DataFrame:
    off = punctuation.PunctuationConfig(keep_numeric=False, keep_domains=False, keep_urls=False, keep_emails=False)
    return _documents(spark, sf).select("doc_id", punctuation.without_punctuation("text", off).alias("clean"))


@query()
def punctuation_protected(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", punctuation.without_punctuation("text").alias("clean"))


def _mixed_text(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with an address, a link, a version and a domain, all by key."""
    return _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", "'Почта c' || c_custkey || '@mail.ru, сайт https://a.b/c?x=' || c_custkey || ', версия 1.' || c_custkey || '.3 — на яндекс.рф! (да); №' || c_custkey AS text")


@query("SELECT c_custkey, 'Почта c' || c_custkey || '@mail.ru сайт https://a.b/c?x=' || c_custkey || ' версия 1.' || c_custkey || '.3 на яндекс.рф да ' || c_custkey AS plain, 'Почта c' || c_custkey || '@mail.ru_ сайт https://a.b/c?x=' || c_custkey || '_ версия 1.' || c_custkey || '.3 на яндекс.рф_ да__ ' || c_custkey AS marked FROM customer")
def punctuation_kept_spans(spark: SparkSession, sf: str) -> DataFrame:
    marks = punctuation.PunctuationConfig(replacement="_")
    return _mixed_text(spark, sf).select("c_custkey", punctuation.without_punctuation("text").alias("plain"), punctuation.without_punctuation("text", marks).alias("marked"))


@query("""
    WITH t AS (SELECT c_custkey, length(c_custkey::VARCHAR) AS n FROM customer)
    SELECT c_custkey, 'email' AS reason, 6 AS start, (15 + n)::INTEGER AS "end" FROM t UNION ALL SELECT c_custkey, 'url', (22 + n)::INTEGER, (38 + 2 * n)::INTEGER FROM t
    UNION ALL SELECT c_custkey, 'numeric_separator', (47 + 2 * n)::INTEGER, (51 + 3 * n)::INTEGER FROM t UNION ALL SELECT c_custkey, 'domain', (57 + 3 * n)::INTEGER, (66 + 3 * n)::INTEGER FROM t
""")
def protected_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_text(spark, sf).select("c_custkey", F.explode(punctuation.protected_spans("text")).alias("s")).select("c_custkey", "s.reason", "s.start", "s.end")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}'))::INTEGER AS n FROM documents")
def protected_emails(spark: SparkSession, sf: str) -> DataFrame:
    only = punctuation.PunctuationConfig(keep_numeric=False, keep_domains=False, keep_urls=False)
    return _documents(spark, sf).select("doc_id", F.size(punctuation.protected_spans("text", only)).alias("n"))


@query("SELECT c_custkey, 'номер ' || cast(c_custkey as string) || ' да' AS fluent_text FROM customer")
def filler_removal(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", "'ну, как бы номер э-э ' || cast(c_custkey as string) || ' эээ, ой, да вот' AS text")
    return rows.select("c_custkey", spoken.without_fillers(F.col("text")).alias("fluent_text"))


@query("SELECT c_custkey, 3::INTEGER AS n, ['discourse_marker', 'hesitation', 'phrase_filler']::VARCHAR AS reasons FROM customer")
def filler_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", "'ну номер эээ ' || cast(c_custkey as string) || ' как бы' AS text")
    found = rows.select("c_custkey", spoken.filler_spans(F.col("text")).alias("s"))
    return found.select("c_custkey", F.size("s").alias("n"), F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct("s.reason")), ", "), F.lit("]")).alias("reasons"))


_FILLED = ["ах, да", "он ах сказал", "а, значит, пошли", "типа", "э - м номер", "ну как бы это самое вот"]
_LEFT = ["да", "он ах сказал", "пошли", "", "номер", ""]


def _cases(spark: SparkSession, sf: str, texts: list[str]) -> DataFrame:
    """A text of the list a customer, by turns."""
    return _spread(spark, sf, "customer", "c_custkey").select("c_custkey", F.element_at(F.array(*map(F.lit, texts)), (F.col("c_custkey") % len(texts) + 1).cast("int")).alias("text"))


def _answers(name: str, *columns: tuple[str, list]) -> str:
    """SQL that gives each customer the answers of the text that ``_cases`` gives it."""
    shown = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return "SELECT c_custkey, " + ", ".join(f"list_element([{', '.join(map(shown, values))}], (c_custkey % {len(values)} + 1)::INT) AS {column}" for column, values in columns) + f" FROM {name}"


@query(_answers("customer", ("fluent_text", _LEFT)))
def filler_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf, _FILLED).select("c_custkey", spoken.without_fillers(F.col("text")).alias("fluent_text"))


# ---------------------------------------------------------------- numbers

_SPOKEN = ["код сорока", "сорока сидит", "минус два с половиной", "педесят пять", "ноль ноль семь", "сто двадцать три тысячи", "двадцать пять ноль один", "42"]


@query(_answers("customer", ("value", ["40", None, "-2", "55", "007", "123000", "2501", "42"]), ("kind", ["cardinal", None, "digit_sequence", "cardinal", "digit_sequence", "cardinal", "mixed", "digits"])))
def number_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The first number of texts with a misheard word, a magpie, a fraction, leading zeros and pieces."""
    first = F.get(spoken.extract_numbers(F.col("text")), F.lit(0))
    return _cases(spark, sf, _SPOKEN).select("c_custkey", first["value"].alias("value"), first["kind"].alias("kind"))


@query(_answers("customer", ("normalized_text", ["код 40", "сорока сидит", "-2", "55", "007", "123000", "2501", "42"])))
def number_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf, _SPOKEN).select("c_custkey", spoken.with_digits(F.col("text")).alias("normalized_text"))


# the model: (0.98 - 0.22 misheard share - 0.05 if a fraction), at most the way of parsing's own
@query(_answers("customer", ("confidence", [0.98, 0.96, 0.94, 0.76, 0.87, 0.98])))
def number_confidence(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get(spoken.extract_numbers(F.col("text")), F.lit(0))
    texts = ["один два три", "двадцать пять", "двадцать пять ноль один", "педесят", "педесят пять", "42"]
    return _cases(spark, sf, texts).select("c_custkey", F.round(first["confidence"], 6).alias("confidence"))



@query(f"SELECT c_custkey, {_NINE} AS value, 'digit_sequence' AS kind FROM customer")
def digit_sequence_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(spark, sf, "customer", "c_custkey").select("c_custkey", generate.digits_words(F.expr(_NINE)).alias("text"))
    return rows.select("c_custkey", F.get(spoken.extract_numbers(F.col("text")), F.lit(0)).alias("s")).select("c_custkey", "s.value", "s.kind")


@query("SELECT o_orderkey, cast(o_orderkey * 7919 as string) AS value FROM orders")
def cardinal_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(spark, sf, "orders", "o_orderkey", 25_000).select("o_orderkey", generate.number_words(F.col("o_orderkey") * 7919).alias("text"))
    return rows.select("o_orderkey", spoken.with_digits(F.col("text")).alias("value"))


@query("SELECT c_custkey, 'код ' || cast(c_custkey % 90 + 10 as string) || lpad(cast(c_custkey % 100 as string), 2, '0') AS normalized_text FROM customer")
def concatenated_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
     # a ten before its digit would be one number, so it is written out
    rows = _spread(spark, sf, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("код "), (k % 90 + 10).cast("string"), F.lit(" "), generate.digits_words(F.lpad((k % 100).cast("string"), 2, "0"))).alias("text"))
    return rows.select("c_custkey", spoken.with_digits(F.col("text")).alias("normalized_text"))


_COLLAPSED = "list_aggregate(list_transform(list_filter(range(1, length({w}) + 1), lambda i: i = 1 OR substr({w}, i::INT, 1) <> substr({w}, i::INT - 1, 1)), lambda i: substr({w}, i::INT, 1)), 'string_agg', '')"
_GRAMS = "list_distinct(list_transform(range(1, length({w}) + 1), lambda i: substr('^' || {w} || '$', i::INT, 3)))"


@query(f"""
    WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), v AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS match FROM part),
    g AS (SELECT word, match, {_GRAMS.format(w='word')} AS a, {_GRAMS.format(w='match')} AS b FROM w, v WHERE length(word) >= 4),
    s AS (SELECT word, match, 0.58 * (1 - levenshtein(word, match) / greatest(length(word), length(match))) + 0.3 * (len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))) + CASE WHEN {_COLLAPSED.format(w='word')} = {_COLLAPSED.format(w='match')} THEN 0.12 ELSE 0 END AS score FROM g)
    SELECT word, match, round(score, 6) AS score FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, match) = 1
""")
def fuzzy_best_match(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part")
    words, vocabulary = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")), part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("word"))
    return fuzzy.best_matches(words, vocabulary, 0.4).select("word", "match", F.round("score", 6).alias("score"))


#: Numbers' own names.
_CANON = {"digit": "ноль один два три четыре пять шесть семь восемь девять", "teen": "десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать", "ten": "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто", "hundred": "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот", "scale": "тысяча миллион миллиард триллион"}
_OF_CANON = {"digit": "i - 1", "teen": "i + 9", "ten": "i * 10 + 10", "hundred": "i * 100", "scale": "power(1000, i)"}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS class, list_element(string_split('{words}', ' '), i::INT) AS word, ({_OF_CANON[kind]})::BIGINT AS value FROM range(1, {len(words.split()) + 1}) AS r(i)" for kind, words in _CANON.items()))
def lexicon_values(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers that the lexicon has forms of, with the form that is a number's own name."""
    known = lexicon.lexicon(spark)
    own = F.element_at(F.array(*[F.lit(w) for k in _CANON for w in _CANON[k].split()]), F.array_position(F.array(*[F.lit(w) for k in _CANON for w in _CANON[k].split()]), F.col("form")).cast("int"))
    return known.where(F.col("form").isin([w for k in _CANON for w in _CANON[k].split()])).select("class", own.alias("word"), "value").distinct()


@query()
def lexicon_forms(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.lexicon(spark)


# ---------------------------------------------------------------- evaluation

_GOLD = "SELECT l_returnflag AS type, l_partkey AS key FROM lineitem"
_PRED = "SELECT l_returnflag AS type, l_partkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS key FROM lineitem WHERE l_suppkey % 7 <> 0"


@query(f"""
    WITH g AS (SELECT type, key, count(*) AS g FROM ({_GOLD}) GROUP BY 1, 2), p AS (SELECT type, key, count(*) AS p FROM ({_PRED}) GROUP BY 1, 2),
    b AS (SELECT coalesce(g.type, p.type) AS type, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p ON g.type = p.type AND g.key = p.key),
    c AS (SELECT type, sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM b GROUP BY ROLLUP (type))
    SELECT type, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""")
def multiset_prf(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "lineitem")
    gold = lines.select(F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("key"))
    pred = lines.where("l_suppkey % 7 <> 0").select(F.col("l_returnflag").alias("type"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("key"))
    scored = spans.with_scores(evaluation.multiset_counts(gold, pred))
    return scored.select("type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
    WITH e AS (SELECT user_id, event_type, event_id, epoch(ts)::BIGINT AS s FROM events), f AS (SELECT *, CASE WHEN s - lag(s + 30) OVER w <= 3600 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY s, s + 30)),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY s ROWS UNBOUNDED PRECEDING) AS cluster FROM f)
    SELECT user_id AS id, event_type AS type, max(cluster)::BIGINT AS clusters FROM c GROUP BY 1, 2
""")
def proximity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")  # to the nearest second, as the SQL's cast
    rows = _t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("type"), at.alias("start"), (at + 30).alias("end"))
    return evaluation.proximity_clusters(rows, 3600).groupBy("id", "type").agg(F.max("cluster").alias("clusters"))


@query("SELECT s_suppkey AS id, 'PHONE' AS type, '+7913' || lpad(cast(s_suppkey as string), 7, '0') AS key FROM supplier")
def soft_keys(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.array(F.lit("8"), F.lit("913"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))
    rows = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("PHONE").alias("type"), F.posexplode(pieces).alias("i", "digits"))
    rows = rows.select("id", "type", (F.col("i") * 10).alias("start"), (F.col("i") * 10 + F.length("digits")).alias("end"), "digits", F.lit(None).cast("string").alias("normalized"))
    return evaluation.soft_keys(rows)


@query("""
    WITH e AS (SELECT user_id, epoch_us(ts) AS s, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS f FROM events), c AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 300000000 THEN 0 ELSE 1 END AS fresh FROM e),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM c)
    SELECT user_id, (max(s) + 300000000 - min(s))::BIGINT AS micros, count(*)::BIGINT AS turns, sum(f)::BIGINT AS finds FROM i GROUP BY user_id, k
""")
def session_finds(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator over a table: turns and found data in sessions."""
    said = F.when(F.col("event_id") % 2 == 0, "телефон восемь девять один три один два три четыре пять шесть семь").otherwise("пульс восемьдесят")
    rows = _spread(spark, sf, "events", "user_id", 20_000).select("user_id", F.col("ts").cast("timestamp").alias("ts"), said.alias("text"))
    done = finds_by_session(rows)
    return done.select("user_id", (F.unix_micros("session.end") - F.unix_micros("session.start")).alias("micros"), "turns", "finds")


# ---------------------------------------------------------------- spans

_G = "SELECT DISTINCT l_orderkey AS case_id, 0 AS line, (l_partkey % 60)::INT AS begin, (l_partkey % 60 + 1 + l_suppkey % 12)::INT AS \"end\", l_returnflag AS label FROM lineitem"
_P = "SELECT DISTINCT l_orderkey AS case_id, 0 AS line, (l_partkey % 60 + (CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END))::INT AS begin, (l_partkey % 60 + 1 + l_suppkey % 12 + (CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END))::INT AS \"end\", CASE WHEN l_linenumber = 5 THEN 'N' ELSE l_returnflag END AS label FROM lineitem WHERE l_suppkey % 5 <> 0"


def span_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Gold spans of orders, and predictions that shift, relabel and miss some. Both lie by their case, in parts of bounded size, so what is done a case moves nothing more."""
    rows = _spread(spark, sf, "lineitem", "l_orderkey", CASES)
    begin, width = (F.col("l_partkey") % 60).cast("int"), (1 + F.col("l_suppkey") % 12).cast("int")
    shift = F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)
    shape = lambda df, b, label: df.select(F.col("l_orderkey").alias("case_id"), F.lit(0).alias("line"), b.alias("begin"), (b + width).alias("end"), label.alias("label")).distinct()
    return shape(rows, begin, F.col("l_returnflag")), shape(rows.where("l_suppkey % 5 <> 0"), begin + shift, F.when(F.col("l_linenumber") == 5, "N").otherwise(F.col("l_returnflag")))


def _chars(side: str, label: bool) -> str:
    return f"SELECT DISTINCT case_id, unnest(range(begin, \"end\")) AS at{', label' if label else ''} FROM ({side})"


def _counts(g: str, p: str) -> str:
    return f"SELECT (SELECT count(*) FROM ({g} INTERSECT {p}))::BIGINT AS tp, (SELECT count(*) FROM ({p} EXCEPT {g}))::BIGINT AS fp, (SELECT count(*) FROM ({g} EXCEPT {p}))::BIGINT AS fn"


@query(_counts(f"({_G})", f"({_P})"))
def entity_hard(spark: SparkSession, sf: str) -> DataFrame:
    return spans.entity_hard(*span_sides(spark, sf))


#: A largest matching by trying, span after span, every overlapping prediction that is still free: its set of used ones is a number's bits.
_SOFT = f"""
    gold AS (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY begin, "end") AS i FROM ({_G})), pred AS (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY begin, "end") AS j FROM ({_P})),
    tried(case_id, label, i, used) AS (SELECT DISTINCT case_id, label, 0::BIGINT, 0::BIGINT FROM gold UNION SELECT t.case_id, t.label, g.i, CASE WHEN p.j IS NULL OR skip THEN t.used ELSE t.used | (1::BIGINT << (p.j - 1)::INT) END
        FROM tried t JOIN gold g ON g.case_id = t.case_id AND g.label = t.label AND g.i = t.i + 1 CROSS JOIN (SELECT unnest([true, false]) AS skip) LEFT JOIN pred p ON NOT skip AND p.case_id = g.case_id AND p.label = g.label AND p.begin < g."end" AND g.begin < p."end" AND (t.used & (1::BIGINT << (p.j - 1)::INT)) = 0),
    best AS (SELECT sum(m)::BIGINT AS tp FROM (SELECT max(bit_count(used)) AS m FROM tried GROUP BY case_id, label)),
    soft AS (SELECT tp, (SELECT count(*) FROM pred) - tp AS fp, (SELECT count(*) FROM gold) - tp AS fn FROM best)"""


@query(f"WITH RECURSIVE {_SOFT} SELECT * FROM soft")
def entity_soft(spark: SparkSession, sf: str) -> DataFrame:
    return spans.entity_soft(*span_sides(spark, sf))


@query(f"""
    WITH RECURSIVE {_SOFT}, c AS (SELECT 'entity_soft' AS mode, * FROM soft UNION ALL SELECT 'entity_hard', * FROM ({_counts(f"({_G})", f"({_P})")})
        UNION ALL SELECT 'char_hard', * FROM ({_counts(f"({_chars(_G, True)})", f"({_chars(_P, True)})")}) UNION ALL SELECT 'char_soft', * FROM ({_counts(f"({_chars(_G, False)})", f"({_chars(_P, False)})")}))
    SELECT mode, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp + fn) AS accuracy FROM c
""")
def sixteen_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return spans.sixteen_metrics(*span_sides(spark, sf))


@query(_counts(f"({_chars(_G, True)})", f"({_chars(_P, True)})"))
def char_hard(spark: SparkSession, sf: str) -> DataFrame:
    return spans.char_hard(*span_sides(spark, sf))


@query(_counts(f"({_chars(_G, False)})", f"({_chars(_P, False)})"))
def char_soft(spark: SparkSession, sf: str) -> DataFrame:
    return spans.char_soft(*span_sides(spark, sf))


@query(f"WITH c AS ({_counts(f'({_chars(_G, False)})', f'({_chars(_P, False)})')}) SELECT round(100 * tp / (tp + fn), 6) AS coverage, round(100 * fp / (tp + fn), 6) AS over_coverage FROM c")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return spans.coverage(*span_sides(spark, sf)).select(F.round("coverage", 6).alias("coverage"), F.round("over_coverage", 6).alias("over_coverage"))


@query("SELECT conv_id AS case_id, sum(length(text))::BIGINT AS total_chars FROM conversations GROUP BY 1")
def document_characters(spark: SparkSession, sf: str) -> DataFrame:
    return spans.document_characters(_t(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), "text"))


@query(f"WITH c AS ({_counts(f'({_chars(_G, False)})', f'({_chars(_P, False)})')}) SELECT tp, fp, fn, (SELECT count(*) * 100 FROM orders)::BIGINT - tp - fp - fn AS tn FROM c")
def char_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Characters in and out of spans, of lines of 100 signs an order."""
    lines = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(0).alias("line"), F.repeat(F.lit("x"), 100).alias("text"))
    return spans.char_confusion(*span_sides(spark, sf), lines)


_ISLANDS = "WITH s AS ({g}), f AS (SELECT *, CASE WHEN begin <= max(\"end\") OVER (PARTITION BY case_id ORDER BY begin, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM s), i AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY begin, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT case_id, 0 AS line, min(begin)::INTEGER AS begin, max(\"end\")::INTEGER AS \"end\" FROM i GROUP BY case_id, island"


@query(_ISLANDS.format(g=_G, gap=0))
def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.merged_spans(span_sides(spark, sf)[0])


@query(_ISLANDS.format(g=_G, gap=2))
def merge_name_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.merged_spans(span_sides(spark, sf)[0], gap=2)


@query(f"SELECT case_id, count(*)::BIGINT AS overlap FROM (({_chars(_G, False)}) INTERSECT ({_chars(_P, False)})) GROUP BY 1")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return spans.overlap_lengths(*span_sides(spark, sf)).select("case_id", "overlap")


@query(f"WITH g AS ({_chars(_G, False)}), p AS ({_chars(_P, False)}) SELECT coalesce(g.case_id, p.case_id) AS case_id, count(g.at + p.at)::BIGINT AS tp, count(*) FILTER (WHERE g.at IS NULL)::BIGINT AS fp, count(*) FILTER (WHERE p.at IS NULL)::BIGINT AS fn FROM g FULL JOIN p ON g.case_id = p.case_id AND g.at = p.at GROUP BY 1")
def char_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return spans.char_overlap_scores(*span_sides(spark, sf))


@query(f"WITH g AS ({_chars(_G, False)}), p AS ({_chars(_P, False)}), c AS (SELECT coalesce(g.case_id, p.case_id) AS case_id, count(*) FILTER (WHERE g.at IS NULL)::BIGINT AS fp, count(*) FILTER (WHERE p.at IS NULL)::BIGINT AS fn FROM g FULL JOIN p ON g.case_id = p.case_id AND g.at = p.at GROUP BY 1) SELECT case_id, fp, fn FROM c ORDER BY fn DESC, fp DESC, case_id LIMIT 10")
def hard_cases(spark: SparkSession, sf: str) -> DataFrame:
    return spans.hardest_cases(spans.char_overlap_scores(*span_sides(spark, sf)).select("case_id", "fp", "fn"))


@query(f"SELECT case_id, greatest(0, begin - 10)::INTEGER AS begin, least(40, \"end\" - 10)::INTEGER AS \"end\", label FROM ({_G}) WHERE least(40, \"end\" - 10) > greatest(0, begin - 10)")
def clip_spans(spark: SparkSession, sf: str) -> DataFrame:
    moved = span_sides(spark, sf)[0].withColumns({"begin": F.col("begin") - 10, "end": F.col("end") - 10})
    return spans.clipped(moved, F.lit(40)).select("case_id", "begin", "end", "label")


@query(f"SELECT CASE label WHEN 'A' THEN 'NAME' ELSE 'PLACE' END AS label, count(*)::BIGINT AS n FROM ({_G}) WHERE label IN ('A', 'R') GROUP BY 1")
def label_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return spans.label_frequencies(spans.relabelled(span_sides(spark, sf)[0], {"A": "NAME", "R": "PLACE"}))


_TOKENS = "SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS token, l_linenumber * 10 AS t_begin, l_linenumber * 10 + 8 AS t_end FROM lineitem"


def _bio(side: str, order: str) -> str:
    return f"""SELECT t.case_id, t.token, coalesce(b.tag, 'O') AS tag FROM ({_TOKENS}) t LEFT JOIN (
        SELECT case_id, token, CASE WHEN row_number() OVER (PARTITION BY case_id, begin, "end", label ORDER BY token) = 1 THEN 'B-' ELSE 'I-' END || label AS tag FROM (
            SELECT t.case_id, t.token, s.begin, s."end", s.label FROM ({_TOKENS}) t JOIN ({side}) s ON s.case_id = t.case_id AND t_begin < s."end" AND s.begin < t_end
            QUALIFY row_number() OVER (PARTITION BY t.case_id, t.token ORDER BY {order}) = 1)) b ON b.case_id = t.case_id AND b.token = t.token"""


_LAST = 's.begin DESC, s."end" DESC, s.label DESC'
_FIRST, _LONGEST = 's.begin, s."end", s.label', 's.begin, s."end" DESC, s.label'


def token_grid(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    return _spread(spark, sf, "lineitem", "l_orderkey", CASES).select(F.col("l_orderkey").alias("case_id"), n.alias("token"), (n * 10).alias("t_begin"), (n * 10 + 8).alias("t_end")).distinct()


@query(_bio(_G, _FIRST))
def bio_tags(spark: SparkSession, sf: str) -> DataFrame:
    return spans.bio_tags(token_grid(spark, sf), span_sides(spark, sf)[0]).select("case_id", "token", "tag")


@query(_bio(_G, _LONGEST))
def bio_tags_longest(spark: SparkSession, sf: str) -> DataFrame:
    return spans.bio_tags(token_grid(spark, sf), span_sides(spark, sf)[0], "longest").select("case_id", "token", "tag")


@query(_bio(_G, _LAST))
def bio_tags_last(spark: SparkSession, sf: str) -> DataFrame:
    return spans.bio_tags(token_grid(spark, sf), span_sides(spark, sf)[0], "last").select("case_id", "token", "tag")


def _flagged(flag: str) -> str:
    return f"SELECT DISTINCT * FROM ({_G}) WHERE label = '{flag}'"


@query(f"SELECT r.case_id, r.token, CASE WHEN r.tag <> 'O' THEN r.tag WHEN a.tag <> 'O' THEN a.tag ELSE n.tag END AS tag FROM ({_bio(_flagged('R'), _FIRST)}) r JOIN ({_bio(_flagged('A'), _FIRST)}) a USING (case_id, token) JOIN ({_bio(_flagged('N'), _FIRST)}) n USING (case_id, token)")
def bio_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of each label alone, merged with R before A before N."""
    grid, gold = token_grid(spark, sf), span_sides(spark, sf)[0]
    out = None
    for label in "RAN":
        mine = spans.bio_tags(grid, gold.where(F.col("label") == label)).select("case_id", "token", F.col("tag").alias(label))
        out = mine if out is None else out.join(mine, ["case_id", "token"])
    return out.select("case_id", "token", spans.merged_tags(*map(F.col, "RAN")).alias("tag"))


def _bio_runs(tags: str) -> str:
    return f"""SELECT case_id, min(token) AS first, max(token) AS last, min(kind) AS label FROM (
        SELECT *, sum(cut) OVER (PARTITION BY case_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN tag LIKE 'B-%' OR kind IS NULL OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY case_id ORDER BY token) THEN 1 ELSE 0 END AS cut FROM (SELECT *, CASE WHEN tag = 'O' THEN NULL ELSE substr(tag, 3) END AS kind FROM ({tags}))))
        WHERE kind IS NOT NULL GROUP BY case_id, run HAVING bool_or(tag LIKE 'B-%')"""


@query(_counts(f"({_bio_runs(_bio(_G, _FIRST))})", f"({_bio_runs(_bio(_P, _LONGEST))})"))
def bio_exact(spark: SparkSession, sf: str) -> DataFrame:
    grid, (gold, pred) = token_grid(spark, sf), span_sides(spark, sf)
    return spans.bio_exact(spans.bio_tags(grid, gold), spans.bio_tags(grid, pred, "longest"))


@query(f"""
    WITH t AS (SELECT *, CASE WHEN tag = 'O' THEN NULL ELSE substr(tag, 3) END AS kind FROM ({_bio(_G, _FIRST)})),
    c AS (SELECT *, CASE WHEN tag LIKE 'B-%' OR kind IS NULL OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY case_id ORDER BY token) THEN 1 ELSE 0 END AS cut FROM t),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY case_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT case_id, min(token) AS first, max(token) AS last, min(kind) AS label FROM r WHERE kind IS NOT NULL GROUP BY case_id, run HAVING bool_or(tag LIKE 'B-%')
""")
def bio_to_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.bio_spans(bio_tags(spark, sf))


_BOTH = f"SELECT g.case_id, g.token, CASE WHEN g.tag = 'O' THEN NULL ELSE substr(g.tag, 3) END AS g, CASE WHEN p.tag = 'O' THEN NULL ELSE substr(p.tag, 3) END AS p FROM ({_bio(_G, _FIRST)}) g JOIN ({_bio(_P, _LONGEST)}) p ON g.case_id = p.case_id AND g.token = p.token"


def both_tags(spark: SparkSession, sf: str) -> DataFrame:
    grid, (gold, pred) = token_grid(spark, sf), span_sides(spark, sf)
    g = spans.bio_tags(grid, gold).select("case_id", "token", F.col("tag").alias("gold"))
    return g.join(spans.bio_tags(grid, pred, "longest").select("case_id", "token", F.col("tag").alias("pred")), ["case_id", "token"])


@query(f"WITH t AS ({_BOTH}), l AS (SELECT unnest(['A', 'N', 'R']) AS label) SELECT label, count(*) FILTER (WHERE g IS NOT DISTINCT FROM label AND p IS NOT DISTINCT FROM label)::BIGINT AS tp, count(*) FILTER (WHERE g IS DISTINCT FROM label AND p IS NOT DISTINCT FROM label)::BIGINT AS fp, count(*) FILTER (WHERE g IS NOT DISTINCT FROM label AND p IS DISTINCT FROM label)::BIGINT AS fn, count(*) FILTER (WHERE g IS DISTINCT FROM label AND p IS DISTINCT FROM label)::BIGINT AS tn FROM t, l GROUP BY 1")
def bio_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return spans.token_confusion(both_tags(spark, sf), ["A", "N", "R"])


@query(f"WITH t AS ({_BOTH}) SELECT CASE WHEN p IS NULL THEN 'FN' WHEN g IS NULL THEN 'FP' ELSE 'LABEL_SWAP' END AS error, count(*)::BIGINT AS n FROM t WHERE g IS DISTINCT FROM p GROUP BY 1")
def bio_errors(spark: SparkSession, sf: str) -> DataFrame:
    return spans.tag_errors(both_tags(spark, sf)).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS case_id, turn AS line, role, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN 'X' END AS label FROM conversations WHERE conv_id % 3 <> 0 OR turn % 2 = 0 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn % 2 = 0)")
def snapshot_flat(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("line"), "role", "text")
    marks = lines.where("case_id % 3 = 0 AND line % 2 = 0").select("case_id", "line", F.lit(0).alias("begin"), F.lit(1).alias("end"), F.lit("X").alias("label"))
    return spans.snapshot(lines, marks).select("case_id", "line", "role", "label")


@query("""
    WITH l AS (SELECT conv_id, list({'line': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS lines, list({'line': turn, 'begin': 0, 'end': 1, 'label': 'X'} ORDER BY turn) FILTER (WHERE conv_id % 3 = 0 AND turn % 2 = 0) AS spans FROM conversations GROUP BY 1)
    SELECT conv_id AS case_id, CASE WHEN spans IS NULL THEN to_json({'case_id': conv_id, 'lines': lines})::VARCHAR ELSE to_json({'case_id': conv_id, 'lines': lines, 'spans': spans})::VARCHAR END AS case_json FROM l
""")
def snapshot_cases(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("line"), "role", "text")
    marks = lines.where("case_id % 3 = 0 AND line % 2 = 0").select("case_id", "line", F.lit(0).alias("begin"), F.lit(1).alias("end"), F.lit("X").alias("label"))
    return snapshot_json(lines, marks)


@query("SELECT o_orderkey AS case_id, 'prediction' AS missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 2 = 0)")
def misaligned_cases(spark: SparkSession, sf: str) -> DataFrame:
    docs = _spread(spark, sf, "orders", "o_orderkey", CASES // 4).select(F.col("o_orderkey").alias("case_id"))
    return spans.misaligned(docs, _spread(spark, sf, "lineitem", "l_orderkey", CASES).where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("case_id")).join(docs, "case_id", "left_semi"))


@query(f"SELECT CASE WHEN begin - 5 < 0 THEN 'begin' ELSE 'end' END AS reason, count(*)::BIGINT AS n FROM ({_G}) WHERE begin - 5 < 0 OR \"end\" - 10 <= begin - 5 GROUP BY 1")
def invalid_spans(spark: SparkSession, sf: str) -> DataFrame:
    moved = span_sides(spark, sf)[0].withColumns({"begin": F.col("begin") - 5, "end": F.col("end") - 10})
    return spans.invalid_spans(moved).groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- generation and shaping


@query()
def generated_documents(spark: SparkSession, sf: str) -> DataFrame:
    return generate.documents(spark, _t(spark, sf, "customer").count())


@query("SELECT c_custkey, true AS snils_ok, true AS inn_ok, true AS oms_ok FROM customer")
def generated_checksums(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = _spread(spark, sf, "customer", "c_custkey").select("c_custkey", generate.snils(key).alias("s"), generate.inn(key).alias("i"), generate.oms(key).alias("o"))
    return rows.select("c_custkey", checksums.snils_valid(F.col("s")).alias("snils_ok"), checksums.inn_valid(F.col("i")).alias("inn_ok"), ((F.length("o") == 18) & (checksums.luhn_control(F.col("o"), 17).cast("string") == F.substring("o", 18, 1))).alias("oms_ok"))


_FORMATS = {
    "phone_mobile": r"^79\d{9}$", "phone_landline": r"^[1-9]\d{5}$", "snils": r"^\d{11}$", "passport": r"^\d{10}$", "birthdate": r"^(0[1-9]|[12]\d|3[01])\.(0[1-9]|1[0-2])\.(19|20)\d\d$", "inn": r"^\d{12}$", "oms": r"^(0[1-9]|[1-8]\d)[012](19|20)\d\d(0[1-9]|1[0-2])\d{9}$",
    "age": r"^([1-9]\d?|100)$", "mse": r"^(0[1-9]|[1-9]\d)([01]\d|2[0-6])\d{7}$", "birth_certificate": r"^(I{1,3}|I?V|VI{1,3}|IX|XI{0,2})-[А-ЯЁ]{2}\d{6}$", "driver_license": r"^(0[1-9]|[1-9]\d)\d{8}$",
}


@query("SELECT k AS type, count(*)::BIGINT AS n, count(*)::BIGINT AS well_formed, count(*)::BIGINT AS spoken_in_words FROM customer, (SELECT unnest([" + ", ".join(f"'{k}'" for k in _FORMATS) + "]) AS k) GROUP BY 1")
def generated_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all generated values have their type's form, and are said in words alone."""
    rows = generated_documents(spark, sf).select(F.inline(F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"{k}_raw").rlike(f).alias("ok"), F.col(k).rlike("^[а-яё]+( [а-яё]+)*$").alias("words")) for k, f in _FORMATS.items()])))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if("ok").alias("well_formed"), F.count_if("words").alias("spoken_in_words"))


def _plain_words() -> list[str]:
    """0 to 999 in words, by tables of their own."""
    ones = _CANON["digit"].split() + _CANON["teen"].split()
    under = [ones[n] if n < 20 else " ".join([_CANON["ten"].split()[n // 10 - 2], *([ones[n % 10]] if n % 10 else [])]) for n in range(100)]
    return [under[n] if n < 100 else " ".join([_CANON["hundred"].split()[n // 100 - 1], *([under[n % 100]] if n % 100 else [])]) for n in range(1000)]


def _group_words(g: str) -> str:
    return f"CASE WHEN {g}::INT = 0 THEN rtrim(repeat('ноль ', length({g}))) WHEN {g} LIKE '0%' THEN 'ноль ' || list_element(w, {g}::INT + 1) ELSE list_element(w, {g}::INT + 1) END"


@query(f"WITH n AS (SELECT c_custkey, {_key('c_custkey', 104729, 11)} AS v, {_SEVEN} AS p, [{', '.join(repr(w) for w in _plain_words())}] AS w FROM customer) SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN {' || chr(32) || '.join(_group_words(f'substr(v, {a}, {b})') for a, b in ((1, 3), (4, 3), (7, 3), (10, 2)))} ELSE {' || chr(32) || '.join(_group_words(f'substr(v, {a}, 1)') for a in range(1, 12))} END AS snils, list_element(['плюс семь', 'восемь', 'семь', 'плюс семь'], (c_custkey % 4 + 1)::INT) || ' ' || {' || chr(32) || '.join(_group_words(f'substr(913 || p, {a}, {b})') for a, b in ((1, 3), (4, 3), (7, 2), (9, 2)))} AS phone FROM n")
def spoken_groups(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _spread(spark, sf, "customer", "c_custkey").select("c_custkey", F.expr(_key("c_custkey", 104729, 11)).alias("v"), F.concat(F.lit("7913"), F.expr(_SEVEN)).alias("p"))
    mode = F.when(k % 2 == 0, "3-3-3-2").otherwise("digits")
    prefix = F.element_at(F.array(*map(F.lit, ("+7", "8", "7", "plus"))), (k % 4 + 1).cast("int"))
    return rows.select("c_custkey", generate.spoken_by_mode("snils", F.col("v"), mode).alias("snils"), generate.spoken_mobile(F.col("p"), F.lit("groups"), prefix).alias("phone"))


_MONTH_NAMES = ", ".join(f"'{m}'" for m in generate.MONTHS)


@query(f"WITH n AS (SELECT o_orderkey, o_orderdate AS d, [{', '.join(repr(w) for w in _plain_words())}] AS w FROM orders) SELECT o_orderkey, list_element(w, day(d)::INT + 1) || ' ' || list_element([{_MONTH_NAMES}], month(d)::INT) || CASE WHEN year(d) < 2000 THEN ' одна тысяча' ELSE ' две тысячи' END || CASE WHEN year(d) % 1000 > 0 THEN ' ' || list_element(w, year(d)::INT % 1000 + 1) ELSE '' END || ' года' AS said, list_element(['один', 'два', 'три'], (o_orderkey % 3 + 1)::INT) || ' тире а бэ ' || {' || chr(32) || '.join(_group_words(f"substr(lpad((o_orderkey % 1000000)::VARCHAR, 6, chr(48)), {a}, 2)") for a in (1, 3, 5))} AS certificate FROM n")
def spoken_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Dates with the month's name and certificates of birth, said."""
    k = F.col("o_orderkey")
    series = F.concat(F.element_at(F.array(*map(F.lit, ("I", "II", "III"))), (k % 3 + 1).cast("int")), F.lit("-АБ"), F.lpad((k % 1_000_000).cast("string"), 6, "0"))
    return _t(spark, sf, "orders").select("o_orderkey", generate.spoken_birthdate(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("said"), generate.spoken_certificate(series, F.lit("groups")).alias("certificate"))


@query("SELECT c_mktsegment, 5::BIGINT AS n FROM customer GROUP BY 1")
def weighted_draw(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").select("c_mktsegment", "c_custkey", (F.abs("c_acctbal") + 1).alias("w"))
    return generate.weighted_without_replacement(rows, "c_mktsegment", "w", 5).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


_FULL = [(g, f"{s} {n} {p}") for g, ns, ss, ps in (("f", "Анна Мария Ольга", "Иванова Смирнова Орлова", "Ивановна Петровна"), ("m", "Иван Пётр Олег", "Иванов Смирнов Орлов", "Иванович Петрович")) for n in ns.split() for s in ss.split() for p in ps.split()]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{name}')" for g, name in _FULL) + ") AS v(gender, full_name)")
def generated_names(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda words: spark.createDataFrame([(w, 1.0 / (i + 1), "m" if i % 2 else "f") for i, w in enumerate(words.split())], "text string, probability double, gender string")
    return generate.full_names(of("Анна Иван Мария Пётр Ольга Олег"), of("Ивановна Иванович Петровна Петрович"), of("Иванова Иванов Смирнова Смирнов Орлова Орлов"), 1000)


_SPELL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in (shaping._NAMES | dict(zip("0123456789", shaping._ONES)) | shaping._SIGNS).items()) + "}"


@query(f"SELECT c_custkey, array_to_string(list_transform(string_split(lower(replace(c_name, '#', '_')), ''), lambda c: {_SPELL}[c]), ' ') || ' собака ' || 'эм эй ай эл точка эр ю' AS said FROM customer")
def address_spelled(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(spark, sf, "customer", "c_custkey").select("c_custkey", F.concat(F.lower(F.translate("c_name", "#", "_")), F.lit("@mail.ru")).alias("a"))
    return rows.select("c_custkey", shaping.address_spoken(F.col("a"), "spell").alias("said"))


@query("SELECT c_custkey, 'цустомер подчеркивание ' || (CASE WHEN c_custkey < 10 THEN 'ноль' ELSE 'десять' END) || ' собака маил точка ру' AS said FROM customer")
def address_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(spark, sf, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("customer_"), F.when(F.col("c_custkey") < 10, "0").otherwise("10"), F.lit("@mail.ru")).alias("a"))
    return rows.select("c_custkey", shaping.address_spoken(F.col("a")).alias("said"))


@query("WITH c AS (SELECT c_name, c_acctbal AS v, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), s AS (SELECT s_name, s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) SELECT c_name, c.v AS v, s_name, s.v AS v_2 FROM c JOIN s ON c.n = s.n WHERE c.n <= 10")
def positional_merge(spark: SparkSession, sf: str) -> DataFrame:
    a = _t(spark, sf, "customer").select(F.col("c_custkey").alias("index"), "c_name", F.col("c_acctbal").alias("v"))
    b = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("index"), "s_name", F.col("s_acctbal").alias("v"))
    return shaping.positional_merge(a, b, "index", 10)


@query("SELECT n_nationkey, n_name AS description, 'ФИО' AS first, (n_nationkey % 4 + 2)::INTEGER AS times, 2::INTEGER AS n FROM nation")
def scenario_parse(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat("n_name", F.lit(" Детальное анкетирование: ФИО ×"), (F.col("n_nationkey") % 4 + 2).cast("string"), F.lit(", адрес."))
    rows = _t(spark, sf, "nation").select("n_nationkey", shaping.scenario_parts(line).alias("s"))
    return rows.select("n_nationkey", "s.description", F.get("s.requirements", F.lit(0))["name"].alias("first"), F.get("s.requirements", F.lit(0))["times"].alias("times"), F.size("s.requirements").alias("n"))


@query("SELECT n_nationkey, 'Страна: ' || n_name || chr(10) || 'Регион: ' || cast(n_regionkey as string) AS prompt FROM nation")
def prompt_lines(spark: SparkSession, sf: str) -> DataFrame:
    values = {"n_name": F.col("n_name"), "n_regionkey": F.col("n_regionkey"), "n_comment": F.lit(None)}
    return _t(spark, sf, "nation").select("n_nationkey", shaping.prompt({"n_name": "Страна", "n_regionkey": "Регион", "n_comment": "Прочее"}, values).alias("prompt"))


@query("SELECT conv_id, turn, role || ' ' || text AS text, role AS span, 0::INTEGER AS begin, length(role)::INTEGER AS \"end\" FROM conversations")
def tag_strip_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", shaping.untagged(F.concat(F.lit("[S]"), "role", F.lit("[/S] "), "text")).alias("u"))
    return rows.select("conv_id", "turn", "u.text", F.explode("u.spans").alias("s")).select("conv_id", "turn", "text", "s.span", "s.begin", "s.end")


def _dialogs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "conversations").select(F.col("conv_id").alias("dialog"), "turn", "text")


@query(r"""
    WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n FROM conversations),
    w AS (SELECT a.conv_id, a.turn AS first, b.turn AS last, (SELECT sum(n) FROM t c WHERE c.conv_id = a.conv_id AND c.turn BETWEEN a.turn AND b.turn) AS n FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <= b.turn)
    SELECT conv_id AS dialog, min(CASE WHEN n < 30 THEN 30 - n WHEN n > 60 THEN n - 60 ELSE 0 END)::INTEGER AS deviation FROM w GROUP BY 1
""")
def dialog_windows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_words")
    return shaping.dialog_windows(_dialogs(spark, sf)).select("dialog", F.when(n < 30, 30 - n).when(n > 60, n - 60).otherwise(0).cast("int").alias("deviation"))


@query("SELECT conv_id AS dialog, 0::INTEGER AS begin, least(3, length(text))::INTEGER AS \"end\" FROM conversations WHERE length(text) > 0 QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)")
def rebased_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans at the head of every turn, in the window of each dialog's last turn."""
    turns = _dialogs(spark, sf)
    last = turns.groupBy("dialog").agg(F.max("turn").alias("first"), F.max("turn").alias("last"))
    return shaping.rebased_spans(turns, _heads(turns), last, strict=True)


def _heads(turns: DataFrame) -> DataFrame:
    ordered = turns.groupBy("dialog").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("m"))
    placed = ordered.select("dialog", F.posexplode("m").alias("i", "x"), "m")
    at = F.aggregate(F.slice("m", 1, F.col("i")), F.lit(0), lambda a, x: a + x["n"] + 1)
    return placed.where("x.n > 0").select("dialog", at.alias("begin"), (at + F.least(F.lit(3), F.col("x.n"))).alias("end"))
