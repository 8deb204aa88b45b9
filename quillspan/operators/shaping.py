"""Shaping of data sets: positional merge, addresses in speech, scenario lines, tagged dialogs, dialog windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut
from .generate import below, number_words

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_LETTERS = dict(zip(_LATIN, "а б ц д е ф г х и дж к л м н о п к р с т у в в кс й з".split()))
_NAMES = dict(zip(_LATIN, "эй би си ди и эф гэ эйч ай джей ка эл эм эн оу пи кью эр эс ти ю ви дабл-ю экс уай зед".split()))
_SIGNS = {".": "точка", "-": "дефис", "_": "подчеркивание"}
_ONES = "ноль один два три четыре пять шесть семь восемь девять".split()
_AT = " собака "


def _capital(letter: str, said: str) -> str:
    return {"x": "Кс"}.get(letter, said.upper())


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def digit_pairs_words(run: Column) -> Column:
    """Digits in pairs from the left, each 0 at the head of what is left said alone."""
    marked = F.regexp_extract_all(run, F.lit("(0|[1-9][0-9]|[1-9])"), 1)
    return F.array_join(F.transform(marked, lambda g: number_words(g.cast("long"))), " ")


def address_words(text: Column) -> Column:
    """Latin letters by their sounds, digit runs in words, signs by name, @ as собака."""
    letters = _map({a: b for c, s in _LETTERS.items() for a, b in ((c, s), (c.upper(), _capital(c, s)))})
    signs = _map(_SIGNS)

    def one(piece: Column) -> Column:
        sounds = F.array_join(F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.coalesce(letters[c], c)), "")
        return F.when(piece.rlike("^[0-9]"), digit_pairs_words(piece)).when(piece.rlike(r"^\p{L}"), sounds).otherwise(F.coalesce(signs[piece], piece))

    def part(p: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"([0-9]+|\p{L}+|[^0-9\p{L}])"), 1), one), " ")

    return F.array_join(F.transform(F.split(text, "@", -1), part), _AT)


def address_spelled(text: Column) -> Column:
    """Every sign by its name."""
    names = _map({a: n for c, n in _NAMES.items() for a in (c, c.upper())} | dict(zip("0123456789", _ONES)) | _SIGNS)
    return F.array_join(F.transform(F.split(text, "@", -1), lambda p: F.array_join(F.transform(F.filter(F.split(p, ""), lambda c: c != ""), lambda c: F.coalesce(names[c], c)), " ")), _AT)


def address_spoken(text: Column, mode: str = "words", seed: int = 0) -> Column:
    if mode == "random":
        return F.when(below(text, 2, "mode", seed) == 0, address_words(text)).otherwise(address_spelled(text))
    return {"words": address_words, "spell": address_spelled}[mode](text)


def addresses_spoken(rows: DataFrame, columns: list[str], mode: str = "words", seed: int = 0) -> DataFrame:
    """rows with the named columns as they are said; the others pass. Raises where a column isn't there."""
    lacking = [c for c in columns if c not in rows.columns]
    if lacking:
        raise ValueError(f"no columns {lacking}")
    return rows.withColumns({c: address_spoken(F.col(c), mode, seed) for c in columns})


def positional_merge(left: DataFrame, right: DataFrame, order: str, n: int, keep_index: bool = False) -> DataFrame:
    """The first n rows by ``order`` of both sides, side by side. Columns of the right that clash get ``_2``; ``index`` columns go.

    Raises when a side has fewer rows than the other among those n.
    """
    def numbered(df: DataFrame) -> DataFrame:
        first = df.orderBy(order).limit(n)
        return first.withColumn("__row", F.row_number().over(Window.orderBy(order)))  # n rows: a report, not a corpus

    drop = [] if keep_index else ["index"]
    a, b = numbered(left), numbered(right)
    a = a.select("__row", *[c for c in left.columns if c.lower() not in drop])
    b = b.select("__row", *[F.col(c).alias(f"{c}_2" if c in a.columns else c) for c in right.columns if c.lower() not in drop])
    both = a.join(b, "__row", "full")
    lengths = both.select(F.count_if(F.lit(True)).alias("n")).first().n, a.count(), b.count()
    if len(set(lengths)) > 1:
        raise ValueError(f"sides of {lengths[1]} and {lengths[2]} rows can't be merged")
    return both.drop("__row")


def scenario_parts(line: Column) -> Column:
    """struct<description, requirements array<struct<name, times>>> of a scenario line."""
    mark = "Детальное анкетирование:"
    at = F.instr(line, mark)
    tail = F.regexp_replace(F.trim(F.substring(line, at + len(mark), F.length(line))), r"\.$", "")
    named = F.filter(F.transform(F.split(tail, ","), F.trim), lambda r: r != "")

    def one(r: Column) -> Column:
        times = F.regexp_extract(r, r"[×x]\s*([0-9]+)", 1).try_cast("int")
        return F.struct(F.trim(F.when(times.isNotNull(), F.regexp_replace(r, r"\s*[×x]\s*[0-9]+\s*$", "")).otherwise(r)).alias("name"), F.coalesce(times, F.lit(1)).alias("times"))

    wanted = F.transform(named, one)
    return F.when(at > 0, F.struct(F.trim(F.substring(line, F.lit(1), at - 1)).alias("description"), wanted.alias("requirements"))).otherwise(F.struct(line.alias("description"), F.filter(wanted, lambda _: F.lit(False)).alias("requirements")))


def prompt(fields: dict[str, str], values: dict[str, Column], scenario: Column | None = None, share: float = 0.7, key: Column | None = None, seed: int = 0) -> Column:
    """Lines "name: value" of the fields that have a value, and before them the scenario in about ``share`` of the rows."""
    lines = [F.when(values[f].isNotNull(), F.concat(F.lit(f"{name}: "), values[f].cast("string"))) for f, name in fields.items() if f in values]
    if scenario is None:
        return F.concat_ws("\n", *lines)
    shown = below(key, 1000, "scenario", seed) < int(share * 1000) if key is not None else F.lit(True)
    return F.concat_ws("\n", F.when(shown, scenario), *lines)


def untagged(text: Column) -> Column:
    """struct<text, spans array<struct<span, begin, end>>> of a text with [S]…[/S].

    A tag that closes nothing goes; one that opens again starts anew; an open span with text runs to the end.
    """
    parts = F.split(F.regexp_replace(text, r"(\[/?S\])", "\ue000$1\ue000"), "\ue000", -1)
    none = F.from_json(F.lit("[]"), "array<struct<begin:int,end:int>>")
    state = F.struct(F.lit("").alias("out"), F.lit(-1).alias("open"), none.alias("spans"))

    def step(s: Column, p: Column) -> Column:
        at = F.length(s["out"])
        opens, closes = p == "[S]", p == "[/S]"
        closed = F.concat(s["spans"], F.array(F.struct(s["open"].alias("begin"), at.alias("end"))))
        return F.struct(
            F.when(opens | closes, s["out"]).otherwise(F.concat(s["out"], p)).alias("out"),
            F.when(opens, at).when(closes, F.lit(-1)).otherwise(s["open"]).alias("open"),
            F.when(closes & (s["open"] >= 0), closed).otherwise(s["spans"]).alias("spans"),
        )

    def finish(s: Column) -> Column:
        n = F.length(s["out"])
        spans = F.when((s["open"] >= 0) & (n > s["open"]), F.concat(s["spans"], F.array(F.struct(s["open"].alias("begin"), n.alias("end"))))).otherwise(s["spans"])
        return F.struct(s["out"].alias("text"), F.transform(spans, lambda x: F.struct(cut(s["out"], x["begin"], x["end"]).alias("span"), x["begin"].alias("begin"), x["end"].alias("end"))).alias("spans"))

    return F.aggregate(parts, state, step, finish)


def dialog_windows(turns: DataFrame, low: int = 30, high: int = 60, seed: int = 0) -> DataFrame:
    """(dialog, first, last, n_words): of each dialog one run of turns of low to high words, drawn by hash; else a nearest.

    turns: dialog, turn, text. Word counts are added up inside each dialog's array; texts don't join themselves.
    """
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    whole = turns.groupBy("dialog").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), words.alias("n")))).alias("m"))
    sums = F.transform(F.sequence(F.lit(0), F.size("m")), lambda i: F.aggregate(F.slice("m", 1, i), F.lit(0), lambda a, x: a + x["n"]))
    runs = whole.withColumn("s", sums).select("dialog", "m", "s", F.posexplode("m").alias("i", "x"))
    runs = runs.select("dialog", F.col("x.turn").alias("first"), F.explode(F.transform(F.sequence(F.col("i") + 1, F.size("m")), lambda j: F.struct(F.element_at("m", j)["turn"].alias("last"), (F.element_at("s", j + 1) - F.element_at("s", F.col("i") + 1)).alias("n_words")))).alias("r")).select("dialog", "first", "r.*")
    off = F.when(F.col("n_words") < low, low - F.col("n_words")).when(F.col("n_words") > high, F.col("n_words") - high).otherwise(0)
    order = Window.partitionBy("dialog").orderBy(off, F.xxhash64("dialog", "first", "last", F.lit(seed)), "first", "last")
    return runs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def rebased_spans(turns: DataFrame, spans: DataFrame, windows: DataFrame, strict: bool = False) -> DataFrame:
    """Spans (dialog, begin, end of the dialog's text with a newline between turns) in offsets of the chosen window.

    A span stays if it begins in a chosen turn and doesn't run over its end. Without ``strict`` offsets in windows that don't begin
    at the first turn are 1 too large, as the widespread data sets of this form have them.
    """
    w = Window.partitionBy("dialog").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("b", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))).withColumn("e", F.col("b") + F.length("text"))
    start = windows.join(placed.select("dialog", F.col("turn").alias("first"), F.col("b").alias("base"), (F.row_number().over(Window.partitionBy("dialog").orderBy("turn")) > 1).alias("later")), ["dialog", "first"])
    base = F.col("base") - (F.lit(0) if strict else F.col("later").cast("int"))
    inside = spans.join(placed.select("dialog", "turn", "b", "e"), "dialog").where("b <= begin AND begin < e AND end <= e")
    kept = inside.join(start.withColumn("__base", base), "dialog").where("first <= turn AND turn <= last")
    return kept.select("dialog", (F.col("begin") - F.col("__base")).cast("int").alias("begin"), (F.col("end") - F.col("__base")).cast("int").alias("end"))
