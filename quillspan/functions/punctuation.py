"""Punctuation removal that keeps numbers, addresses and domains whole: one linear scan of each text in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scan
from .text import _col

_ENDINGS = "com org net ru рф ком su io ai app dev gov edu info biz me co uk de fr cn jp kz by ua бел рус москва онлайн сайт".split()
_L = "A-Za-zА-Яа-яЁё"
NUMERIC = r"(?U)(?<!\d)\d+(?:[-.,:/]\d+)+(?!\d)"
URL = r"(?iuU)\b(?:ftp|https?)://\S*[^\s.,;:!?…]"
EMAIL = rf"(?iuU)(?<![\w.+-])[{_L}0-9._%+-]+@(?:[{_L}0-9-]+\.)+[{_L}]{{2,}}(?![\w.-])"
DOMAIN = rf"(?iuU)(?<![\w@])(?:[{_L}0-9](?:[{_L}0-9-]{{0,61}}[{_L}0-9])?\.)+(?:{'|'.join(sorted(_ENDINGS, key=len, reverse=True))})(?![{_L}0-9-])"


@dataclass(frozen=True)
class PunctuationConfig:
    enabled: bool = True
    keep_numeric: bool = True
    keep_domains: bool = True
    keep_urls: bool = True
    keep_emails: bool = True
    keep_sentence_final: bool = False
    replacement: str = " "


_KINDS = ((NUMERIC, "numeric_separator", "keep_numeric", ""), (URL, "url", "keep_urls", "://"), (EMAIL, "email", "keep_emails", "@"), (DOMAIN, "domain", "keep_domains", "."))


def protected_places(text: str, config: PunctuationConfig) -> list[tuple[int, int, str]]:
    """(start, end, reason), in order; spans that overlap or touch are one."""
    found = []
    for pattern, reason, on, hint in _KINDS:
        if getattr(config, on) and hint in text:
            found += [(m.start(), m.end(), reason) for m in scan.compiled(pattern).finditer(text)]
    out: list[tuple[int, int, str]] = []
    for a, b, reason in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b), reason if out[-1][2] == reason else "mixed_protected"
        else:
            out.append((a, b, reason))
    return out


def protected_spans(text: Column | str, config: PunctuationConfig = PunctuationConfig()) -> Column:
    """array<struct<start,end,raw,reason>>, in order; spans that overlap or touch are one, of mixed reasons ``mixed_protected``."""

    def read(t: str, out: scan.Lists) -> None:
        for a, b, reason in protected_places(t, config):
            for name, x in (("start", a), ("end", b), ("raw", t[a:b]), ("reason", reason)):
                out.values[name].append(x)

    return scan.scanned("array<struct<start:int,end:int,raw:string,reason:string>>", {"start": pa.int32(), "end": pa.int32(), "raw": pa.string(), "reason": pa.string()}, read, empty_for_null=True)(_col(text))


def _signs(config: PunctuationConfig) -> str:
    return r"(?U)(?![.?!])[\p{P}№]" if config.keep_sentence_final else r"(?U)[\p{P}№]"


def plain_text(text: str, config: PunctuationConfig = PunctuationConfig()) -> str:
    """The text with every sign of punctuation outside protected spans as one replacement, and white space tidied."""
    if not config.enabled:
        return text
    signs, by = scan.compiled(_signs(config)), config.replacement
    out, at = [], 0
    for a, b, _ in [*protected_places(text, config), (len(text), len(text), "")]:
        if not by or by.isspace():
            out += [signs.sub(by, text[at:a]), text[a:b]]
        else:
            for m in signs.finditer(text, at, a):
                if text[at : m.start()]:
                    out.append(text[at : m.start()])
                if not (out and out[-1][-1].isspace()):  # none right after white space
                    out.append(by)
                at = m.end()
            out += [x for x in (text[at:a], text[a:b]) if x]
        at = b
    tidy = scan.compiled(r"(?U)\s+").sub(" ", "".join(out))
    return re.sub(r" ([.?!])", r"\1", tidy).strip(" ")


def without_punctuation(text: Column | str, config: PunctuationConfig = PunctuationConfig()) -> Column:
    """The text with every sign of punctuation outside protected spans as one replacement. A null stays null."""
    if not config.enabled:
        return _col(text)

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in scan.slices(batch):
                yield pa.array([None if t is None else plain_text(t, config) for t in texts], pa.string())

    return clean(_col(text))


def removed_places(text: str, config: PunctuationConfig = PunctuationConfig()) -> list[tuple[int, int]]:
    """The runs of signs that go."""
    kept, runs, k = protected_places(text, config), [], 0
    for m in scan.compiled(_signs(config)).finditer(text):
        a = m.start()
        while k < len(kept) and kept[k][1] <= a:
            k += 1
        if k < len(kept) and kept[k][0] <= a:
            continue
        if runs and runs[-1][1] == a:
            runs[-1] = runs[-1][0], a + 1
        else:
            runs.append((a, a + 1))
    return runs


def removed_punctuation(text: Column | str, config: PunctuationConfig = PunctuationConfig()) -> Column:
    """array<struct<start,end,raw>>: the runs that go, for audit."""

    def read(t: str, out: scan.Lists) -> None:
        for a, b in removed_places(t, config):
            for name, x in (("start", a), ("end", b), ("raw", t[a:b])):
                out.values[name].append(x)

    return scan.scanned("array<struct<start:int,end:int,raw:string>>", {"start": pa.int32(), "end": pa.int32(), "raw": pa.string()}, read)(_col(text))
