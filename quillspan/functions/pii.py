"""Numeric personal data in Russian transcripts: rules, normal forms, overlap, masks.

Normal forms are Catalyst expressions; the rules themselves run in one linear scan of each text in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .checksums import inn_holds, snils_holds
from .text import _col, digits_only, let, splice

_FLAGS = "(?iuU)"
_SEP, _REQ = r"[\s \-–—().]*", r"[\s \-–—()./]+"


def _stems(words: str, *fixed: str) -> str:
    """One alternation: every word of the list with any ending, a word that ends in ! as it is, _ for white space."""
    found = [(w[:-1] if w.endswith("!") else w + r"\w*").replace("_", r"\w*\s+") for w in words.split()]
    return r"\b(?:" + "|".join([*found, *fixed]) + r")\b"


_COMMON = _stems(
    "температур давлен пульс сатураци сахар глюкоз холестерин гемоглобин лейкоцит тромбоцит креатинин билирубин дозировк таблет капсул капл ампул миллиграм мг! мл! единиц "
    "дня! дней! недел месяц час минут секунд кабинет палат этаж корпус дом квартир рост вес мкб! диагноз анализ",
    r"код\s+мкб",
)


def _n(low: int, high: int | None = None) -> str:
    return rf"(?:\d{_SEP}){{{low}{'' if high is None else f',{high}'}}}"


@dataclass(frozen=True)
class Rule:
    type: str
    name: str
    value: str
    positive: str
    negative: str
    before: int
    after: int
    priority: int
    base: float
    required: bool = True
    lengths: tuple[int, int] | None = None  # of a type of one's own: fewest and most digits, which are its normal form

    @property
    def pattern(self) -> str:
        return rf"{_FLAGS}(?<!\d)(?:{self.value})(?!{_SEP}\d)"


def default_rules() -> list[Rule]:
    day, month = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])"
    born = rf"{day}{_REQ}{month}{_REQ}(?:19|20)\d{{2}}|(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d{{2}}"
    phone = rf"(?:\+{_SEP})?(?:[78]{_SEP})?9{_SEP}{_n(9)}"
    mse = rf"{_n(4, 8)}(?:/|\s*дробь\s*){_n(2, 4)}|{_n(4, 12)}"
    documents = _stems("паспорт серия снилс! полис омс! инн! мсэ! свидетельств водительск удостоверени")
    return [
        Rule("DATE_BIRTH", "date_birth", born, _stems("дат_рождени родил", r"год\w*\s+рождени\w*", r"рожд[её]н\w*"), _stems("прием приём запис операци анализ осмотр выписк сегодня! завтра! вчера! недел месяц"), 88, 0, 100, 0.82),
        Rule("PASSPORT", "passport", rf"{_n(4)}(?:номер[\s ]+)?{_n(6)}", _stems("паспорт серия"), _COMMON, 84, 0, 98, 0.82),
        Rule("DRIVER_LICENSE", "driver_license", _n(10), _stems("водительск_удостоверени водительск_прав права_номер номер_прав"), _COMMON, 84, 0, 97, 0.82),
        Rule("OMS", "oms", f"{_n(16)}|{_n(10)}", _stems("омс! полис обязательн_медицинск_страхован"), _COMMON, 84, 0, 96, 0.80),
        Rule("SNILS", "snils", _n(11), _stems("снилс! страхов_номер индивидуальн_лицев_счет"), _COMMON, 76, 0, 95, 0.80),
        Rule("INN", "inn", _n(12), _stems("инн! идентификацион_номер_налогоплательщик"), _COMMON, 76, 0, 95, 0.80),
        Rule("PHONE", "phone", phone, _stems("телефон мобильн сотов домашн позвон перезвон", r"номер\s+телефон\w*", r"для\s+связи"), f"{_COMMON}|{documents}", 68, 0, 72, 0.76, False),
        Rule("MSE", "mse", mse, _stems("мсэ! справк_мсэ акт_мсэ инвалидност", r"медико\s+социальн\w*\s+экспертиз\w*"), _COMMON, 84, 0, 86, 0.76),
        Rule("BIRTH_CERTIFICATE", "birth_certificate", _n(4, 12), _stems("номер_свидетельств", r"свидетельств\w*\s+о\s+рождени\w*"), _COMMON, 96, 0, 86, 0.76),
        Rule("AGE", "age", "(?:120|1[01][0-9]|[1-9][0-9]?)", _stems("возраст лет! год! года! исполнилось! исполнится!", r"сколько\s+лет", "полных", r"(?:вам|ему|ей|пациенту?)\s+сейчас"), f"{_COMMON}|{_stems('дата рождени родил паспорт снилс! полис омс! инн! дом квартир улиц строени корпус')}", 28, 28, 40, 0.67),
    ]


#: Fewest and most digits of types that are kept as digits.
_LENGTHS = {"PASSPORT": (10, 10), "DRIVER_LICENSE": (10, 10), "OMS": (10, 16), "SNILS": (11, 11), "INN": (12, 12), "MSE": (4, 12), "BIRTH_CERTIFICATE": (4, 12)}


def normal_phone(value: Column) -> Column:
    return let(digits_only(value), lambda d: F.when(d.rlike(r"^[78]?9\d{9}$"), F.concat(F.lit("+7"), F.right(d, F.lit(10)))))


def normal_birth_date(value: Column, as_of: date | None = None) -> Column:
    """dd.MM.yyyy of a calendar date from 1900 to the year of ``as_of`` (today where none is given), else null."""
    last = F.lit(as_of.year) if as_of else F.year(F.current_date())

    def parts(v: Column) -> Column:
        groups = F.regexp_extract_all(v, F.lit(r"(\d+)"), 1)
        return F.when(F.size(groups) >= 3, groups).when(F.length(digits_only(v)) == 8, F.regexp_extract_all(F.regexp_replace(digits_only(v), r"^(..)(..)(....)$", "$1 $2 $3"), F.lit(r"(\d+)"), 1))

    def written(p: Column) -> Column:
        day, month, year = (F.get(p, F.lit(i)) for i in range(3))
        good = (F.length(year) <= 4) & (F.length(month) <= 2) & (F.length(day) <= 2) & year.try_cast("int").between(F.lit(1900), last)
        text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return F.when(good, F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "dd.MM.yyyy"))

    return let(let(value, parts), written)


def normal_age(value: Column) -> Column:
    return let(digits_only(value).try_cast("int"), lambda n: F.when(n.between(0, 120), n.cast("string")))


def normal_value(kind: str, value: Column, as_of: date | None = None) -> Column:
    if kind == "PHONE":
        return normal_phone(value)
    if kind == "DATE_BIRTH":
        return normal_birth_date(value, as_of)
    if kind == "AGE":
        return normal_age(value)
    low, high = _LENGTHS[kind]
    return let(digits_only(value), lambda d: F.when(F.length(d).between(low, high), d))


def normalize_pii(kind: Column, value: Column, as_of: date | None = None) -> Column:
    """The normal form where the type is a column."""
    branches = [(kind == name, normal_value(name, value, as_of)) for name in ("PHONE", "DATE_BIRTH", "AGE", *_LENGTHS)]
    out = F.when(*branches[0])
    for branch in branches[1:]:
        out = out.when(*branch)
    return out


@lru_cache(maxsize=100_000)
def _date_of(value: str, last: int) -> str | None:
    groups = re.findall("[0-9]+", value)
    if len(groups) < 3:
        d = scan.compiled(r"(?U)\D").sub("", value)
        groups = [d[:2], d[2:4], d[4:]] if len(d) == 8 and d.isascii() else []
    if not groups:
        return None
    day, month, year = groups[:3]
    if len(year) > 4 or len(month) > 2 or len(day) > 2 or not 1900 <= int(year) <= last:
        return None
    try:
        return date(int(year), int(month), int(day)).strftime("%d.%m.%Y")
    except ValueError:
        return None


def plain_value(kind: str, value: str, last_year: int) -> str | None:
    """The normal form of a value, null where it has none; ``normal_value`` for plain strings."""
    if kind == "DATE_BIRTH":
        return _date_of(value, last_year)
    digits = scan.compiled(r"(?U)\D").sub("", value)
    if kind == "PHONE":
        return f"+7{digits[-10:]}" if re.fullmatch("[78]?9[0-9]{9}", digits) else None
    if kind == "AGE":
        return str(int(digits)) if digits.isascii() and digits and len(digits) < 10 and int(digits) <= 120 else None
    low, high = _LENGTHS[kind]
    return digits if low <= len(digits) <= high else None


def _digits_within(value: str, low: int, high: int) -> str | None:
    digits = scan.compiled(r"(?U)\D").sub("", value)
    return digits if low <= len(digits) <= high else None


class Scanner:
    """Finds the data of all rules in a text."""

    def __init__(self, rules: list[Rule] | None = None, as_of: date | None = None):
        self.rules = default_rules() if rules is None else rules
        self.last_year = (as_of or date.today()).year
        self.patterns = [(scan.compiled(r.pattern), scan.compiled(_FLAGS + r.positive), scan.compiled(_FLAGS + r.negative)) for r in self.rules]
        self.digit, self.tail = re.compile("[0-9]"), scan.compiled(r"(?U)\s+\Z")

    def candidates(self, text: str) -> list[tuple]:
        """All accepted candidates in order of preference: (-priority, -confidence, -length, start, rule, end, raw, normal form, context, checksum, context hit)."""
        out = []
        if not self.digit.search(text):
            return out
        for order, (rule, (value, positive, negative)) in enumerate(zip(self.rules, self.patterns)):
            if rule.required and not positive.search(text):
                continue
            for m in value.finditer(text):
                start, raw = m.start(), self.tail.sub("", m[0])
                normal = plain_value(rule.type, raw, self.last_year) if rule.lengths is None else _digits_within(raw, *rule.lengths)
                if normal is None:
                    continue
                end = start + len(raw)
                context = text[max(start - rule.before, 0) : end + rule.after]
                if negative.search(context):
                    continue
                hit = positive.search(context) is not None
                if rule.required and not hit:
                    continue
                checked = snils_holds(normal) if rule.type == "SNILS" else inn_holds(normal) if rule.type == "INN" else None
                score = rule.base + (0.12 if hit else 0.0) + (0.0 if checked is None else 0.08 if checked else -0.03)
                out.append((-rule.priority, -min(max(score, 0.01), 0.99), -len(raw), start, order, end, raw, normal, context, checked, hit))
        out.sort(key=lambda c: c[:6])
        return out

    def matches(self, text: str) -> list[tuple]:
        """Of the candidates those that no preferred one overlaps, in order of their places."""
        found = self.candidates(text)
        return [found[i] for i in scan.disjoint([c[3] for c in found], [c[5] for c in found])]


_MATCH = {
    "type": pa.string(), "start": pa.int32(), "end": pa.int32(), "value": pa.string(), "normalized": pa.string(), "confidence": pa.float64(), "rule": pa.string(), "context": pa.string(),
    "metadata": pa.struct([("length", pa.int32()), ("checksum_valid", pa.bool_()), ("positive_context_hit", pa.bool_()), ("priority", pa.int32())]),
}
MATCH_TYPE = "array<struct<type:string,start:int,end:int,value:string,normalized:string,confidence:double,rule:string,context:string,metadata:struct<length:int,checksum_valid:boolean,positive_context_hit:boolean,priority:int>>>"


def find_pii(text: Column | str, rules: list[Rule] | None = None, as_of: date | None = None) -> Column:
    """array<struct<type,start,end,value,normalized,confidence,rule,context,metadata>> without overlap, in order; empty for a null text.

    All rules run in one scan; a rule is tried only on texts that have digits and, where it needs context, that context anywhere.
    """
    given = default_rules() if rules is None else rules
    made: list[Scanner] = []  # patterns are compiled in the worker

    def read(t: str, out: scan.Lists) -> None:
        if not made:
            made.append(Scanner(given, as_of))
        for rank, doubt, _, start, order, end, raw, normal, context, checked, hit in made[0].matches(t):
            rule = given[order]
            digits = sum(map(str.isdecimal, normal))
            row = (rule.type, start, end, raw, normal, -doubt, rule.name, context, {"length": digits, "checksum_valid": checked, "positive_context_hit": hit, "priority": -rank})
            for name, x in zip(_MATCH, row):
                out.values[name].append(x)

    return scan.scanned(MATCH_TYPE, _MATCH, read, empty_for_null=True)(_col(text))


def mask(text: Column | str, matches: Column, replacements: dict[str, str] | None = None) -> Column:
    """The text with every match as [TYPE], or as the replacement given for its type."""
    given = F.create_map(*[F.lit(x) for pair in (replacements or {"": ""}).items() for x in pair])
    return splice(_col(text), matches, lambda m: F.coalesce(given[m["type"]], F.concat(F.lit("["), m["type"], F.lit("]"))))


def with_pii(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, as_of: date | None = None) -> DataFrame:
    """df with ``pii`` and ``masked_text``. Map-only."""
    found = df.withColumn("pii", find_pii(text_col, rules, as_of))
    return found.withColumn("masked_text", mask(text_col, F.col("pii")))


def without_context(rule: Rule) -> Rule:
    """The rule for values whose context is known to be given elsewhere."""
    return replace(rule, required=False)
