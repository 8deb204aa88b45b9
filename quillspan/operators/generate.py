"""Synthetic Russian documents, deterministic in (id, seed): the same row on every retry and every partitioning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checksums import inn_controls, luhn_control, snils_control

_MODES = """
phone_mobile 3322 groups 3232
phone_landline 222 groups 33
snils 3332 groups 3332 335 632
passport 22222 groups 2233 433
birthdate 224 groups 2222 44
inn 3333 groups 222222 444
oms 4444 groups 333322 43333
mse 22322 groups 47
birth_certificate 222 groups 33
driver_license 22222 groups 2233 433
"""


def _groupings() -> dict[str, dict[str, tuple[int, ...]]]:
    """By type and mode the sizes of groups that are said as numbers. A mode's name is its sizes; ``groups`` is the usual one, ``digits`` one by one."""
    out = {}
    for line in _MODES.split("\n")[1:-1]:
        kind, usual, _, *others = line.split()
        sizes = tuple(map(int, usual))
        out[kind] = {"groups": sizes} | {"-".join(o): tuple(map(int, o)) for o in others} | {"digits": (1,) * sum(sizes)}
    return out


GROUPINGS = _groupings()
#: What may be said for the country code of a mobile number.
PHONE_PREFIXES = {"+7": "плюс семь", "8": "восемь", "7": "семь", "plus": "плюс семь"}
#: Region numbers of insurance policies.
REGIONS = [f"{n:02d}" for n in range(1, 90)]
OKATO = "01 03 04 05 07 08 10 11 12 14 15 17 18 19 20 22 24 25 27 28 29 32 33 34 36 37 38 40 41 42 44 45 46 47 49 50 52 53 54 56 57 58 60 61 63 64 65 66 68 69 70 71 73 75 76 78 79 80 81 82 83 84 85 86 87 88 89 90 91 92 93 94 95 96 97 98 99".split()
MOBILE = [str(n) for n in range(900, 1000)]
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
ROMAN = "I II III IV V VI VII VIII IX X XI XII".split()
#: Letters of a certificate's series and their names, by turns.
LETTER_NAMES = dict(zip(*[iter("А а Б бэ В вэ Г гэ Д дэ Е е Ж жэ З зэ И и Й и_краткое К ка Л эль М эм Н эн О о П пэ Р эр С эс Т тэ У у Ф эф Х ха Ц цэ Ч че Ш ша Щ ща Ы ы Э э Ю ю Я я".replace("_", "\xa0").split(" "))] * 2))
_LETTERS = "".join(LETTER_NAMES)


def below(key: Column, n: int | Column, tag: str, seed: int = 0) -> Column:
    """A number from 0 below n, drawn by hash of key, seed and tag."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(tag)), F.lit(n) if isinstance(n, int) else n).cast("int")


def digits(key: Column, n: int, tag: str, seed: int = 0) -> Column:
    return F.lpad(F.pmod(F.xxhash64(key, F.lit(seed), F.lit(tag)), F.lit(10**n)).cast("string"), n, "0")


def one_of(key: Column, items: list[str], tag: str, seed: int = 0) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), below(key, len(items), tag, seed) + 1)


def phone_mobile(key: Column, seed: int = 0) -> Column:
    return F.concat(F.lit("7"), one_of(key, MOBILE, "mobile", seed), digits(key, 7, "phone", seed))


def phone_landline(key: Column, seed: int = 0) -> Column:
    return F.concat((1 + below(key, 9, "first", seed)).cast("string"), digits(key, 5, "landline", seed))


def snils(key: Column, seed: int = 0) -> Column:
    base = digits(key, 9, "snils", seed)
    return F.concat(base, F.lpad(snils_control(base).cast("string"), 2, "0"))


def inn(key: Column, seed: int = 0) -> Column:
    base = digits(key, 10, "inn", seed)
    first, second = inn_controls(base)
    return F.concat(base, first.cast("string"), second.cast("string"))


def oms(key: Column, seed: int = 0, as_of: date = date(2026, 1, 1)) -> Column:
    """18 digits: region, duplicate mark, year and month, day (50 more for men), number, check digit."""
    d = below(key, 100, "duplicate", seed)
    copy = F.when(d < 90, "0").when(d < 97, "1").otherwise("2")
    born = F.date_sub(F.lit(as_of), 365 + below(key, 365 * 89, "born", seed))
    day = F.dayofmonth(born) + F.when(below(key, 2, "sex", seed) == 1, 50).otherwise(0)
    base = F.concat(one_of(key, REGIONS, "region", seed), copy, F.date_format(born, "yyyyMM"), F.lpad(day.cast("string"), 2, "0"), digits(key, 6, "number", seed))
    return F.concat(base, luhn_control(base, 17).cast("string"))


def passport(key: Column, seed: int = 0, year: int = 2026) -> Column:
    issued = F.pmod(1997 + below(key, year - 1996, "issued", seed), F.lit(100))
    return F.concat(one_of(key, OKATO, "okato", seed), F.lpad(issued.cast("string"), 2, "0"), digits(key, 6, "passport", seed))


def driver_license(key: Column, seed: int = 0) -> Column:
    return F.concat(F.lpad((1 + below(key, 99, "licence", seed)).cast("string"), 2, "0"), digits(key, 2, "series", seed), digits(key, 6, "licence_number", seed))


def mse(key: Column, seed: int = 0, year: int = 2026) -> Column:
    number = 1 + F.pmod(F.xxhash64(key, F.lit(seed), F.lit("mse")), F.lit(9_999_999))
    return F.concat(F.lpad((1 + below(key, 99, "bureau", seed)).cast("string"), 2, "0"), F.lpad(below(key, year % 100 + 1, "mse_year", seed).cast("string"), 2, "0"), F.lpad(number.cast("string"), 7, "0"))


def birth_certificate(key: Column, seed: int = 0) -> Column:
    letter = lambda tag: F.substring(F.lit(_LETTERS), below(key, len(_LETTERS), tag, seed) + 1, F.lit(1))
    return F.concat(one_of(key, ROMAN, "roman", seed), F.lit("-"), letter("a"), letter("b"), digits(key, 6, "certificate", seed))


def birthdate(key: Column, seed: int = 0, as_of: date = date(2026, 1, 1)) -> Column:
    return F.date_format(F.date_sub(F.lit(as_of), 365 + below(key, 365 * 89, "birthdate", seed)), "dd.MM.yyyy")


def age(key: Column, seed: int = 0) -> Column:
    return (1 + below(key, 100, "age", seed)).cast("string")


GENERATORS = {"phone_mobile": phone_mobile, "phone_landline": phone_landline, "snils": snils, "passport": passport, "birthdate": birthdate, "inn": inn, "oms": oms, "age": age, "mse": mse, "birth_certificate": birth_certificate, "driver_license": driver_license}

# ---------------------------------------------------------------- speech

_ONES = " один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split(" ")
_TENS = "  двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split(" ")
_HUNDREDS = " сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split(" ")
_FORMS = {1: ("тысяча", "тысячи", "тысяч"), 2: ("миллион", "миллиона", "миллионов"), 3: ("миллиард", "миллиарда", "миллиардов")}


def _pick(words: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), at.cast("int") + 1)


def _hundreds_words(n: Column, feminine: bool) -> Column:
    rest = n % 100
    ones = [*_ONES]
    if feminine:
        ones[1:3] = "одна", "две"
    low = F.when(rest < 20, _pick(ones, rest)).otherwise(F.concat_ws(" ", _pick(_TENS, F.floor(rest / 10)), F.nullif(_pick(ones, rest % 10), F.lit(""))))
    return F.concat_ws(" ", F.nullif(_pick(_HUNDREDS, F.floor(n / 100)), F.lit("")), F.nullif(low, F.lit("")))


def number_words(n: Column) -> Column:
    """A whole number from 0 below 10^12 in words, in the nominative."""
    n = n.cast("long")
    parts = []
    for power in (3, 2, 1):
        group = F.floor(n / 1000**power) % 1000
        last, two = group % 10, group % 100
        form = F.when((two >= 11) & (two <= 14), _FORMS[power][2]).when(last == 1, _FORMS[power][0]).when((last >= 2) & (last <= 4), _FORMS[power][1]).otherwise(_FORMS[power][2])
        parts.append(F.when(group > 0, F.concat_ws(" ", _hundreds_words(group, power == 1), form)))
    small = n % 1000
    parts.append(F.when(small > 0, _hundreds_words(small, False)))
    return F.when(n == 0, "ноль").otherwise(F.concat_ws(" ", *parts))


def split_groups(number: Column, sizes: tuple[int, ...]) -> Column:
    """Digits cut into groups of the given sizes; what is left over goes."""
    out, at = [], 1
    for size in sizes:
        out.append(F.substring(number, at, size))
        at += size
    return F.filter(F.array(*out), lambda g: g != "")


def digits_words(number: Column) -> Column:
    """Every digit as a word."""
    words = F.array(*[F.lit(w) for w in ["ноль", *_ONES[1:10]]])
    return F.array_join(F.transform(F.filter(F.split(number, ""), lambda c: c != ""), lambda c: F.element_at(words, c.cast("int") + 1)), " ")


def groups_words(groups: Column) -> Column:
    """Every group as a number; of a group that begins with 0 one ноль and the rest, of zeros alone every one."""
    def one(g: Column) -> Column:
        value = F.coalesce(g.try_cast("long"), F.lit(0))
        zeros = F.array_join(F.array_repeat(F.lit("ноль"), F.length(g)), " ")
        return F.when(value == 0, zeros).otherwise(F.concat(F.when(g.startswith("0"), "ноль ").otherwise(""), number_words(value)))

    return F.array_join(F.transform(groups, one), " ")


def spoken(kind: str, number: Column, mode: str = "digits") -> Column:
    """A number's digits in the groups of a mode. Digits beyond the groups' stay unsaid, as of policies with 18 of them."""
    sizes = GROUPINGS[kind][mode]
    return groups_words(split_groups(number, sizes))


def spoken_by_mode(kind: str, number: Column, mode: Column) -> Column:
    """``spoken`` where the mode is a column."""
    out = None
    for name, sizes in GROUPINGS[kind].items():
        cut = split_groups(number, sizes)
        out = F.when(mode == name, cut) if out is None else out.when(mode == name, cut)
    return groups_words(out)


def spoken_mobile(phone: Column, mode: Column, prefix: Column) -> Column:
    """The country code's words and the other ten digits in groups."""
    words = F.create_map(*[F.lit(x) for pair in PHONE_PREFIXES.items() for x in pair])
    return F.concat_ws(" ", words[prefix], spoken_by_mode("phone_mobile", F.substring(phone, 2, 10), mode))


def spoken_certificate(value: Column, mode: Column) -> Column:
    """The Roman numeral as a number, "тире", the letters' names and the six digits in groups."""
    roman = F.create_map(*[F.lit(x) for i, r in enumerate(ROMAN, 1) for x in (r, (_ONES + ["десять"])[i] if i < 10 else _ONES[i])])
    names = F.create_map(*[F.lit(x.replace("\xa0", " ")) for pair in LETTER_NAMES.items() for x in pair])
    letters = F.regexp_extract(value, "-(.)(.)", 1), F.regexp_extract(value, "-(.)(.)", 2)
    return F.concat_ws(" ", roman[F.regexp_extract(value, "^[IVX]+", 0)], F.lit("тире"), names[letters[0]], names[letters[1]], spoken_by_mode("birth_certificate", F.regexp_extract(value, "[0-9]{6}$", 0), mode))


def spoken_birthdate(value: Column, mode: Column | str = "words") -> Column:
    """Day, month's name and year with "года", or in mode ``digits`` every digit."""
    day, month, year = F.substring(value, 1, 2).try_cast("int"), F.substring(value, 4, 2).try_cast("int"), F.substring(value, 7, 4).try_cast("int")
    words = F.concat_ws(" ", number_words(day), F.element_at(F.array(*map(F.lit, MONTHS)), month), number_words(year), F.lit("года"))
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "digits", digits_words(F.regexp_replace(value, r"\D", ""))).otherwise(words)


def said(name: str, value: Column, key: Column, seed: int = 0) -> Column:
    """A value of a type in a mode, and for mobile numbers a prefix, drawn by key."""
    mode = one_of(key, list(GROUPINGS.get(name, {"words": ()})), f"mode of {name}", seed)
    if name == "age":
        return number_words(value)
    if name == "birthdate":
        return spoken_birthdate(value, mode)
    if name == "birth_certificate":
        return spoken_certificate(value, mode)
    if name == "phone_mobile":
        return spoken_mobile(value, mode, one_of(key, list(PHONE_PREFIXES), "prefix", seed))
    return spoken_by_mode(name, value, mode)


def documents(spark: SparkSession, count: int, seed: int = 0, raw: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """One row an id with every type spoken, each in a mode of its own draw, and, with ``raw``, written."""
    rows, names = spark.range(count), list(GENERATORS) if kinds is None else kinds
    key = F.col("id")
    rows = rows.select("id", *[GENERATORS[name](key, seed).alias(f"{name}_raw") for name in names])
    shown = []
    for name in names:
        shown.append(said(name, F.col(f"{name}_raw"), key, seed).alias(name))
        if raw:
            shown.append(F.col(f"{name}_raw"))
    return rows.select("id", *shown)


def weighted_without_replacement(items: DataFrame, group: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """Of each group n rows, likelier by weight (exponential keys); a hash of the row takes the place of chance."""
    u = (F.pmod(F.xxhash64(*items.columns, F.lit(seed)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    order = Window.partitionBy(group).orderBy((-F.log(u) / F.col(weight)), *[c for c in items.columns if c != group])
    return items.where(F.col(weight) > 0).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def full_names(names: DataFrame, patronymics: DataFrame, surnames: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(gender, full_name): ``count`` distinct triples, or all that there are. Inputs: text, probability, gender.

    The given name is drawn from all, its gender decides the lists of the others. Each list becomes ranges of
    cumulated probability; a draw meets its range by a join on list and range. Draws go on, twice as many each round,
    until enough are distinct; a triple's first draw counts, so the result doesn't depend on partitions. Triples too unlikely to come up are listed
    at the end.
    """
    spark = names.sparkSession
    sizes = [{r.gender: r["count"] for r in df.where("probability > 0").select("gender", "text").distinct().groupBy("gender").count().collect()} for df in (names, patronymics, surnames)]
    there = sum(a * sizes[1].get(g, 0) * sizes[2].get(g, 0) for g, a in sizes[0].items())
    genders = [g for g in sizes[0] if sizes[1].get(g) and sizes[2].get(g)]
    count = min(count, there)

    def ranges(df: DataFrame, name: str, by: list[str]) -> DataFrame:
        rows = df.where(F.col("gender").isin(genders) & (F.col("probability") > 0)).groupBy("gender", "text").agg(F.sum("probability").alias("p"))
        share = F.col("p") / F.sum("p").over(Window.partitionBy(*by))
        up = rows.withColumn("share", share).withColumn("to", F.sum("share").over(Window.partitionBy(*by).orderBy("gender", "text").rowsBetween(Window.unboundedPreceding, 0)))
        last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gender"), F.desc("text"))) == 1
        return up.select(F.col("gender").alias(f"{name}_g"), F.col("text").alias(name), (F.col("to") - F.col("share")).alias("lo"), F.when(last, 2.0).otherwise(F.col("to")).alias("hi"))

    lists = [("name", ranges(names.withColumn("whole", F.lit(1)), "name", []), None)] + [(n, ranges(df, n, ["gender"]), "gender") for n, df in (("surname", surnames), ("patronymic", patronymics))]

    def drawn(first: int, last: int) -> DataFrame:
        rows = spark.range(first, last)
        for name, r, by in lists:
            u = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 40)) / F.lit(float(1 << 40))
            meets = (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
            rows = rows.withColumn("u", u).join(r, meets if by is None else (F.col("gender") == F.col(f"{name}_g")) & meets).drop("u", "lo", "hi")
            rows = rows.withColumnRenamed("name_g", "gender") if by is None else rows.drop(f"{name}_g")
        return rows.select("id", "gender", F.concat_ws(" ", "surname", "name", "patronymic").alias("full_name"))

    asked = max(16, 2 * count)
    while True:
        found = drawn(0, asked).groupBy("gender", "full_name").agg(F.min("id").alias("id"))
        missing = count - found.count()
        if missing <= 0:
            break
        if asked >= 64 * max(count, 16):  # the rest is too unlikely to be drawn, so it is listed
            every = lists[0][1].select(F.col("name_g").alias("gender"), "name").join(surnames.select("gender", F.col("text").alias("surname")), "gender").join(patronymics.select("gender", F.col("text").alias("patronymic")), "gender")
            rest = every.select("gender", F.concat_ws(" ", "surname", "name", "patronymic").alias("full_name")).distinct().join(found, ["gender", "full_name"], "left_anti")
            found = found.unionByName(rest.withColumn("id", F.lit(asked) + F.pmod(F.xxhash64("full_name", F.lit(seed)), F.lit(1 << 40))))
            break
        asked *= 2
    return found.orderBy("id", "full_name").limit(count).select("gender", "full_name")
