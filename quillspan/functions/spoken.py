"""Spoken transcripts: filler removal and numbers from words.

Both are sequential scans over tokens in which each decision depends on earlier ones, so they run as Arrow-batched
functions; everything before and after them is Catalyst expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from .fuzzy import LEAST_LETTERS, THRESHOLD, plain_likeness
from .punctuation import PunctuationConfig, plain_text
from .scan import slices

_TOKEN = re.compile(r"(\d+)|([A-Za-zА-Яа-яЁё]+)|([^\w\s])")
_KINDS = (None, "digits", "word", "punct")
_DASHES = str.maketrans("—–−", "---")


@dataclass(slots=True)
class Tok:
    text: str
    form: str  # normalised
    start: int
    end: int
    kind: str


def tokenize(text: str) -> list[Tok]:
    known = L.aliases()
    out = []
    for m in _TOKEN.finditer(text):
        form = m[0].lower().replace("ё", "е").translate(_DASHES)
        out.append(Tok(m[0], known.get(form, form), m.start(), m.end(), _KINDS[m.lastindex]))
    return out


# ---------------------------------------------------------------- fillers


@dataclass(frozen=True)
class FillerConfig:
    hesitations: bool = True
    interjections: bool = True
    phrases: bool = True
    discourse: bool = True
    aggressive: bool = False


_HESITATIONS = frozenset("э" * n for n in range(1, 5)) | {"эм", "эмм", "эммм", "хм", "м", "мм", "ммм"}
_AT_EDGES = frozenset("ах ох ух эх".split())
_ALWAYS = frozenset("здравствуйте прям понятно спасибо пожалуйста подождите давайте уже ну вот".split())
_SOMETIMES = frozenset("а типа значит".split())
_PHRASES = [tuple(p.split()) for p in ("как бы", "это самое", "так сказать", "в общем")]
_HYPHENS = frozenset("-–—−")
_SOFT = _HYPHENS | frozenset(",;:")
_EDGE = _SOFT | frozenset(".?!")
_TIDY = [(re.compile(a), b) for a, b in ((r"\s+", " "), (r"\s+(?=[?!,.;:])", ""), (r"(?:[;:,]\s*){2,}", " "), (r"[;:,]\s*(?=[?!.])", ""), (r"(?<=[?!.])\s*[;:,]+", ""), (r"\A[\s?!,.;:]+", ""), (r"[\s;:,]+\Z", ""), (r"\s+", " "))]


def tidy(text: str) -> str:
    text = text.strip()
    for pattern, by in _TIDY:
        text = pattern.sub(by, text)
    return text.strip()


def removed_fillers(text: str, config: FillerConfig = FillerConfig()) -> list[tuple[int, int, str, str]]:
    """(start, end, raw, reason) in order; each pass sees what the earlier ones took away."""
    toks = tokenize(text)
    words = [t.text.lower().replace("ё", "е") if t.kind == "word" else "" for t in toks]
    gone: set[int] = set()
    out: list[tuple[int, int, str, str]] = []

    def take(first: int, n: int, reason: str) -> None:
        if not gone.intersection(range(first, first + n)):
            gone.update(range(first, first + n))
            a, b = toks[first].start, toks[first + n - 1].end
            out.append((a, b, text[a:b], reason))

    def beside(i: int, step: int) -> str | None:
        i += step
        while 0 <= i < len(toks) and i in gone:
            i += step
        return toks[i].text if 0 <= i < len(toks) else None

    def singly(vocabulary: frozenset[str], reason: str, right: frozenset[str] | None = None) -> None:
        for i, w in enumerate(words):
            if w and w in vocabulary and i not in gone:
                left_of, right_of = beside(i, -1), beside(i, 1)
                if right is None or left_of is None or left_of in _EDGE or right_of is None or right_of in right:
                    take(i, 1, reason)

    if config.phrases:
        for i in range(len(toks)):
            for phrase in _PHRASES:
                if tuple(words[i : i + len(phrase)]) == phrase:
                    take(i, len(phrase), "phrase_filler")
    if config.hesitations:
        for i in range(len(toks) - 2):
            if words[i] in ("э", "м") and toks[i + 1].text in _HYPHENS and words[i + 2] in ("э", "м"):
                take(i, 3, "hyphenated_hesitation")
        singly(_HESITATIONS, "hesitation")
    if config.interjections:
        singly(frozenset({"ой"}), "interjection")
        singly(_AT_EDGES, "interjection", _EDGE)
    if config.discourse:
        singly(_ALWAYS, "discourse_marker")
        singly(_SOMETIMES, "discourse_marker", None if config.aggressive else _SOFT)
    return sorted(out)


def without_fillers_text(text: str, config: FillerConfig = FillerConfig()) -> str:
    at, parts = 0, []
    for start, end, _, _ in removed_fillers(text, config):
        parts.append(text[at:start])
        at = end
    return tidy("".join(parts) + text[at:])


# ---------------------------------------------------------------- numbers


@dataclass(frozen=True)
class NumberConfig:
    fuzzy: bool = True
    threshold: float = THRESHOLD
    least_letters: int = LEAST_LETTERS
    least_sequence: int = 2
    most_tokens: int = 24
    prefer_sequences: bool = True
    fraction_tail: bool = True


@dataclass(slots=True)
class Num:
    tok: Tok
    word: str  # canonical
    score: float
    fuzzy: bool


@dataclass(slots=True)
class NumberSpan:
    value: str
    start: int
    end: int
    raw: str
    normalized: str
    kind: str
    status: str
    confidence: float
    candidates: list[tuple[str, str, float]] = field(default_factory=list)


@lru_cache(maxsize=100_000)
def _closest(word: str, threshold: float, least: int) -> tuple[str, float] | None:
    if len(word) < least:
        return None
    best, score = "", 0.0
    for candidate in L.vocabulary():
        # no word of such a length can reach the threshold
        if 0.58 * min(len(word), len(candidate)) / max(len(word), len(candidate)) + 0.42 < max(threshold, score):
            continue
        s = plain_likeness(word, candidate)
        if s > score:
            best, score = candidate, s
    return (best, score) if best and score >= threshold else None


def _number_of(tok: Tok, config: NumberConfig) -> Num | None:
    if tok.kind == "digits":
        return Num(tok, tok.form, 1.0, False)
    if tok.form in L.VALUES or tok.form in L.MINUS or tok.form in L.FRACTIONS:
        return Num(tok, tok.form, 1.0, tok.text.lower().replace("ё", "е") in L.asr_aliases())
    if config.fuzzy and tok.kind == "word" and (got := _closest(tok.form, config.threshold, config.least_letters)):
        return Num(tok, got[0], got[1], True)
    return None


def _signed(nums: list[Num]) -> tuple[str, list[Num]]:
    return ("-", nums[1:]) if nums and nums[0].word in L.MINUS else ("", nums)


def _atom(n: Num) -> str | None:
    return n.tok.form if n.tok.kind == "digits" else str(L.DIGITS[n.word]) if n.word in L.DIGITS else None


def _structured(nums: list[Num]) -> bool:
    return any(n.word in L.TEENS or n.word in L.TENS or n.word in L.HUNDREDS or n.word in L.SCALES for n in nums)


def _written(nums: list[Num]) -> str | None:
    sign, body = _signed(nums)
    return sign + body[0].tok.form if len(body) == 1 and body[0].tok.kind == "digits" else None


def _sequence(nums: list[Num]) -> str | None:
    sign, body = _signed(nums)
    atoms = [_atom(n) for n in body]
    return sign + "".join(atoms) if atoms and None not in atoms else None


#: Where a word stands in a group of three digits: a later word must stand lower.
_PLACES = ((L.HUNDREDS, 100), (L.TENS, 10), (L.TEENS, 10))


def _cardinal(nums: list[Num]) -> str | None:
    sign, body = _signed(nums)
    structured = _structured(nums)
    if len(body) > 1 and not structured and all(_atom(n) is not None for n in body):
        return None
    total = group = 0
    place = 10_000
    for n in body:
        if n.tok.kind == "digits":
            value = int(n.tok.form)
            if value >= 1000:
                total, place = total + value, 10_000
            else:
                group, place = group + value, min(place, 1)
        elif found := next(((table, at) for table, at in _PLACES if n.word in table), None):
            table, at = found
            if place <= at:
                return None
            group, place = group + table[n.word], at
        elif n.word in L.DIGITS:
            if place <= 1 and structured:
                return None
            group, place = group + L.DIGITS[n.word], 1
        elif n.word in L.SCALES:
            total, group, place = total + max(group, 1) * L.SCALES[n.word], 0, 10_000
        else:
            return None
    return str((-1 if sign else 1) * (total + group)) if body else None


def _chunks(nums: list[Num], config: NumberConfig) -> str | None:
    """Greedy: always the longest prefix that is a number; null unless there are two or more."""
    out, at = [], 0
    while at < len(nums):
        for to in range(len(nums), at, -1):
            part = nums[at:to]
            value = _cardinal(part)
            if value is None and len(part) >= config.least_sequence:
                value = _sequence(part)
            if value is None:
                value = _written(part)
            if value is not None:
                break
        else:
            return None
        if value.startswith("-"):
            return None
        out.append(value)
        at = to
    return "".join(out) if len(out) > 1 else None


def _parsed(span: list[Num], config: NumberConfig) -> tuple[NumberSpan, int, bool] | None:
    body: list[Num] = []
    tail = False
    for k, n in enumerate(span):
        if n.word in L.FRACTIONS:
            tail = True
            break
        if n.word in L.FRACTION_LINKS:
            tail = k + 1 < len(span) and span[k + 1].word in L.FRACTIONS
            break
        body.append(n)
    if not body:
        return None
    found = [("digits", _written(body), 1.0)]
    if len(body) >= config.least_sequence:
        found.append(("digit_sequence", _sequence(body), 0.98))
    found += [("cardinal", _cardinal(body), 0.96)]
    if len(body) > 1:
        found.append(("mixed", _chunks(body, config), 0.94))
    found = [x for x in found if x[1] is not None]
    if not found:
        return None
    chosen = next((x for x in found if x[0] == "digit_sequence"), None) if config.prefer_sequences else None
    chosen = chosen or max(found, key=lambda x: x[2])
    misheard = sum(n.fuzzy for n in body)
    sure = (0.98 - 0.22 * misheard / len(body) - 0.05 * tail) * min(1.0, max(0.0, sum(n.score for n in body) / len(body)))
    kind, value, most = chosen
    made = NumberSpan(value, 0, 0, "", " ".join(n.word for n in body), kind, "fuzzy_ok" if misheard else "ok", min(most, max(0.0, min(1.0, sure))), [(v, k, c) for k, v, c in found])
    return made, len(body), tail


def number_spans(text: str, config: NumberConfig = NumberConfig()) -> list[NumberSpan]:
    toks = tokenize(text)
    nums = [_number_of(t, config) for t in toks]
    out, i = [], 0
    while i < len(toks):
        span: list[Num] = []
        j = i
        while nums[i] and j < len(toks) and len(span) < config.most_tokens:
            follows = nums[j + 1] if j + 1 < len(toks) else None
            if nums[j]:
                span.append(nums[j])
            elif toks[j].kind == "word" and toks[j].form in L.FRACTION_LINKS and follows and follows.word in L.FRACTIONS:
                span.append(Num(toks[j], toks[j].form, 1.0, False))
            else:
                break
            j += 1
        got = _parsed(span, config) if span else None
        if not got:
            i += 1
            continue
        made, used, tail = got
        if tail and config.fraction_tail:
            while used < len(span):
                used += 1
                if span[used - 1].word in L.FRACTIONS:
                    break
        lone_magpie = used == 1 and toks[i].text.lower().replace("ё", "е") in L.MAGPIE
        if lone_magpie and not (i and toks[i - 1].kind == "word" and toks[i - 1].form in L.BEFORE_MAGPIE):
            i += 1
            continue
        made.start, made.end = span[0].tok.start, span[used - 1].tok.end
        made.raw = text[made.start : made.end]
        out.append(made)
        i += used
    return out


def with_digits_text(text: str, config: NumberConfig = NumberConfig()) -> str:
    at, parts = 0, []
    for s in number_spans(text, config):
        if s.start >= at:
            parts += [text[at : s.start], s.value]
            at = s.end
    return "".join(parts) + text[at:]


def digit_segments(text: str, config: NumberConfig = NumberConfig(), most: int = 8) -> list[str]:
    """The digits of the numbers in a text: from each word on the longest run of at most ``most`` number words that is one number."""
    toks = [t for t in tokenize(text) if t.form not in ("плюс", "плюсом")]
    nums = [_number_of(t, config) for t in toks]
    out, i = [], 0
    while i < len(toks):
        to = i
        while to < len(toks) and to < i + most and toks[to].kind != "punct" and nums[to]:
            to += 1
        for end in range(to, i, -1):
            got = _parsed(nums[i:end], config)
            if got and got[1] == end - i:
                out.append(got[0].value)
                i = end
                break
        else:
            i += 1
    return [d for v in out if (d := "".join(c for c in v if c.isdigit()))]


_MONTHS = {w: n for n, pair in enumerate("января январь,февраля февраль,марта март,апреля апрель,мая май,июня июнь,июля июль,августа август,сентября сентябрь,октября октябрь,ноября ноябрь,декабря декабрь".split(","), 1) for w in pair.split()}
#: Beginnings of the words of a day, cardinal or ordinal; longer ones first.
_UNITS = [(w, n) for n, ws in enumerate("перв один,втор два,трет три,четверт четыре,пят,шест,седьм семь,восьм восемь,девят,десят".split(","), 1) for w in ws.split()]
_DAYS = [(f"двадцать {w}", 20 + n) for w, n in _UNITS if n < 10] + [("тридцать перв", 31), ("тридцать один", 31), ("тридцат", 30), ("двадцат", 20)]
_DAYS += [(f"{w}надцат", n) for n, w in enumerate("один две три четыр пят шест сем восем девят".split(), 11)] + _UNITS


def spoken_date(text: str) -> str | None:
    """dd.MM.yyyy of a date with the month's name, whether or not the calendar has it; empty if day or year can't be read, null without a month."""
    plain = [t.text.lower().replace("ё", "е") for t in tokenize(text) if t.kind == "word"]
    words = [t.form for t in tokenize(text) if t.kind == "word"]
    at = next((i for i, w in enumerate(words) if w in _MONTHS), None)
    if at is None:
        return None
    said = " ".join(plain[:at])  # not the canonical forms, in which ordinals are cardinals
    day = next((n for w, n in _DAYS if said.startswith(w)), None)
    year = digit_segments(" ".join(words[at + 1 :]))
    return f"{day:02d}.{_MONTHS[words[at]]:02d}.{int(year[0]):04d}" if day and len(year) == 1 else ""


# ---------------------------------------------------------------- columns

SPAN_TYPE = "array<struct<value:string,start:int,end:int,raw:string,normalized:string,kind:string,status:string,confidence:double,candidates:array<struct<value:string,kind:string,confidence:double>>>>"


def without_fillers(text: Column | str, config: FillerConfig = FillerConfig()) -> Column:
    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else without_fillers_text(t, config) for t in texts], dtype=object)

    return clean(text)


def filler_spans(text: Column | str, config: FillerConfig = FillerConfig()) -> Column:
    """array<struct<start,end,raw,reason>> in offsets of the original text."""

    @F.pandas_udf("array<struct<start:int,end:int,raw:string,reason:string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else [dict(zip(("start", "end", "raw", "reason"), s)) for s in removed_fillers(t, config)] for t in texts], dtype=object)

    return spans(text)


def extract_numbers(text: Column | str, config: NumberConfig = NumberConfig()) -> Column:
    @F.pandas_udf(SPAN_TYPE)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("value", "kind", "confidence")
        for texts in batches:
            yield pd.Series([None if t is None else [{k: getattr(s, k) for k in NumberSpan.__slots__ if k != "candidates"} | {"candidates": [dict(zip(names, c)) for c in s.candidates]} for s in number_spans(t, config)] for t in texts], dtype=object)

    return extract(text)


def with_digits(text: Column | str, config: NumberConfig = NumberConfig()) -> Column:
    """The text with every number span as its value. A null stays null."""

    @F.pandas_udf("string")
    def digits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else with_digits_text(t, config) for t in texts], dtype=object)

    return digits(text)


def normalize_transcripts(df: DataFrame, text_col: str = "text", fillers: FillerConfig | None = FillerConfig(), punctuation: PunctuationConfig | None = PunctuationConfig(), numbers: NumberConfig | None = NumberConfig()) -> DataFrame:
    """df with ``fluent_text``, ``clean_text`` and ``normalized_text``; a stage of None is skipped."""
    if not (fillers or punctuation or numbers):
        return df.withColumns(dict.fromkeys(("fluent_text", "clean_text", "normalized_text"), F.col(text_col)))

    @F.arrow_udf("fluent_text string, clean_text string, normalized_text string")
    def staged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # all stages in one Python worker
        for batch in batches:
            for texts in slices(batch):
                fluent = [t if t is None or not fillers else without_fillers_text(t, fillers) for t in texts]
                clean = [t if t is None or not punctuation else plain_text(t, punctuation) for t in fluent]
                normal = [t if t is None or not numbers else with_digits_text(t, numbers) for t in clean]
                yield pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (fluent, clean, normal)], names=["fluent_text", "clean_text", "normalized_text"])

    done = df.withColumn("__staged", staged(F.col(text_col)))
    return done.withColumns({name: F.col("__staged")[name] for name in ("fluent_text", "clean_text", "normalized_text")}).drop("__staged")


def to_json(spans: Column) -> Column:
    return F.to_json(spans, {"pretty": "true"})
