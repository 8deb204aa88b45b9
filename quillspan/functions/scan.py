"""Linear scans of texts in Arrow batches: matches, splices, overlaps. A scan reads each text once, whatever it finds.

Patterns are written for Spark's own functions and mean the same here. Results are built as flat Arrow arrays, so no
object is made for a span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_FLAGS = re.compile(r"\(\?([iuU]+)\)")


@lru_cache(maxsize=512)
def compiled(pattern: str) -> regex.Pattern:
    """A pattern of java.util.regex with leading flags, for whole code points; letters, digits and spaces are ASCII ones without (?U)."""
    on = set("".join(_FLAGS.findall(pattern)))
    flags = (regex.IGNORECASE if "i" in on else 0) | (regex.UNICODE if on & {"U", "u"} else regex.ASCII)
    return regex.compile(_FLAGS.sub("", pattern), flags | regex.V0)


def slices(batch: pa.Array, rows: int = 256, size: int = 1 << 20) -> Iterator[list]:
    """The values of a batch, a few at a time, one slice of none for an empty batch: a batch of long texts isn't held twice.

    A slice has at most ``size`` bytes, or one longer value. What is made of a slice is given back before the next.
    """
    i = 0
    while i < max(len(batch), 1):
        n = rows
        while n > 1 and batch.slice(i, n).nbytes > size:
            n //= 2
        yield batch.slice(i, n).to_pylist()
        i += n


class Lists:
    """Builds one list of structs a text, field by field."""

    def __init__(self, **types: pa.DataType):
        self.types, self.values, self.ends, self.missing = types, {k: [] for k in types}, [0], []

    def close(self, missing: bool = False) -> None:
        """Ends the list of one text."""
        self.ends.append(len(next(iter(self.values.values()))))
        self.missing.append(missing)

    def array(self) -> pa.Array:
        structs = pa.StructArray.from_arrays([pa.array(self.values[k], t) for k, t in self.types.items()], names=list(self.types))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), structs, mask=pa.array(self.missing, pa.bool_()))


def scanned(schema: str, fields: dict[str, pa.DataType], read: Callable[[str, Lists], None], empty_for_null: bool = False) -> Callable[[Column], Column]:
    """A column function: ``read`` adds what it finds in a text to the lists. A null text gives a null, or an empty list."""

    @F.arrow_udf(schema)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (x for batch in batches for x in slices(batch)):
            out = Lists(**fields)
            for text in texts:
                if text is not None:
                    read(text, out)
                out.close(text is None and not empty_for_null)
            yield out.array()

    return scan


def spans_of(text: str, pattern: str) -> Iterator[tuple[int, int, str]]:
    for m in compiled(pattern).finditer(text):
        yield m.start(), m.end(), m[0]


def find(text: Column, pattern: str) -> Column:
    def read(t: str, out: Lists) -> None:
        start, end, raw = out.values["start"], out.values["end"], out.values["raw"]
        for m in compiled(pattern).finditer(t):
            start.append(m.start())
            end.append(m.end())
            raw.append(m[0])

    return scanned("array<struct<start:int,end:int,raw:string>>", {"start": pa.int32(), "end": pa.int32(), "raw": pa.string()}, read)(text)


def spliced_text(text: str, spans: Iterator[tuple[int, int, str | None]]) -> str:
    at, parts = 0, []
    for start, end, by in spans:
        if start >= at:
            parts += [text[at:start], by or ""]
            at = end
    return "".join(parts) + text[at:]


def spliced(text: Column, starts: Column, ends: Column, by: Column) -> Column:
    @F.arrow_udf("string")
    def splice(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None or a is None else spliced_text(t, zip(a, b, c)) for t, a, b, c in zip(*(x.to_pylist() for x in batch))], pa.string())

    return splice(text, starts, ends, by)


def disjoint(starts: list[int], ends: list[int]) -> list[int]:
    """Places of spans, greedily in the given order, that overlap none taken before; by their begin and end. Taken ones are kept sorted."""
    begins: list[tuple[int, int, int]] = []  # of spans that aren't empty
    points: list[tuple[int, int, int]] = []
    for i, (a, b) in enumerate(zip(starts, ends)):
        at = bisect_left(begins, (a, b, i))
        if (at and begins[at - 1][1] > a) or (at < len(begins) and begins[at][0] < b):
            continue
        if b > a:
            inside = bisect_left(points, (a + 1,))
            if inside < len(points) and points[inside][0] < b:
                continue
        into = begins if b > a else points
        into.insert(bisect_left(into, (a, b, i)), (a, b, i))
    return [i for _, _, i in sorted(begins + points)]


def kept_places(starts: Column, ends: Column) -> Column:
    @F.arrow_udf("array<int>")
    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([None if s is None else disjoint(s, e) for s, e in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.int32()))

    return keep(starts, ends)


def joined_spans(spans: list[tuple[int, int]], touching: bool = True, gap: int = 0) -> list[tuple[int, int]]:
    """Spans in order, those that overlap, touch or lie at most ``gap`` apart joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] + gap if touching else a < out[-1][1]):
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def joined(starts: Column, ends: Column, touching: bool, gap: int) -> Column:
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def join(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out = Lists(start=pa.int32(), end=pa.int32())
            for s, e in zip(a.to_pylist(), b.to_pylist()):
                for x, y in joined_spans(list(zip(s or (), e or ())), touching, gap):
                    out.values["start"].append(x)
                    out.values["end"].append(y)
                out.close(s is None)
            yield out.array()

    return join(starts, ends)
