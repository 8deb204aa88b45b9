"""Spans of a text column: search, cut, splice, tokens. Offsets are code points, half-open.

What finds or joins many places in a text runs as a linear scan in Arrow batches: expressions over arrays would copy what they have found at
every step, and count code points from the text's begin for every cut. The rest stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scan

_FOLDED = str.maketrans("ё—–−", "е---")
TOKEN = r"(?U)\d+|[A-Za-zА-Яа-яЁё]+|[^\w\s]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_spans(text: Column | str, pattern: str) -> Column:
    """array<struct<start,end,raw>> of all matches that don't overlap, left to right. The pattern must not match nothing."""
    return scan.find(_col(text), pattern)


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))


def splice(text: Column | str, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each span replaced; spans come in order, one that begins before the end of the last is left out."""
    each = lambda name: F.transform(spans, lambda s: s[name].cast("int"))
    return scan.spliced(_col(text), each("start"), each("end"), F.transform(spans, replacement))


def kind_of(token: Column) -> Column:
    return F.when(token.rlike(r"^(?U)\d+$"), "digits").when(token.rlike(r"^\p{L}+$"), "word").otherwise("punct")


def fold_word(token: Column) -> Column:
    """Lower case, ё as е, every dash as a hyphen."""
    return F.translate(F.lower(token), "ё—–−", "е---")


def _read_tokens(t: str, out: scan.Lists) -> None:
    text, normalized, start, end, kind = out.values.values()
    for m in scan.compiled(TOKEN).finditer(t):
        raw = m[0]
        text.append(raw)
        normalized.append(raw.lower().translate(_FOLDED))
        start.append(m.start())
        end.append(m.end())
        kind.append("digits" if raw[0].isdecimal() else "word" if raw[0].isalpha() else "punct")


def tokens(text: Column | str) -> Column:
    """array<struct<text,normalized,start,end,kind>>: digit runs, letter runs and single signs; other word characters are skipped."""
    fields = {"text": pa.string(), "normalized": pa.string(), "start": pa.int32(), "end": pa.int32(), "kind": pa.string()}
    return scan.scanned("array<struct<text:string,normalized:string,start:int,end:int,kind:string>>", fields, _read_tokens)(_col(text))


def digits_only(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?U)\D", "")


def single_spaced(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != ""))


def resolve(candidates: Column) -> Column:
    """Of spans in order of preference, greedily those that overlap none before them; given back in order of their places."""
    each = lambda name: F.transform(candidates, lambda c: c[name].cast("int"))
    return F.transform(scan.kept_places(each("start"), each("end")), lambda i: F.get(candidates, i))


def merged(spans: Column, touching: bool = True, gap: int = 0) -> Column:
    """Spans (start, end) in order with those that overlap, touch, or lie at most ``gap`` apart joined."""
    return scan.joined(F.transform(spans, lambda s: s["start"].cast("int")), F.transform(spans, lambda s: s["end"].cast("int")), touching, gap)
