"""Check digits of Russian identifiers, as expressions over strings of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(number: Column, place: int) -> Column:
    return F.substring(number, place, 1).try_cast("int")


def _weighted(number: Column, weights: tuple[int, ...]) -> Column:
    out = F.lit(0)
    for place, w in enumerate(weights, 1):
        out = out + _digit(number, place) * w
    return out


def snils_control(base: Column) -> Column:
    """The two check digits of nine, as a number."""
    total = _weighted(base, tuple(range(9, 0, -1)))
    rest = F.when(total < 100, total).otherwise(total % 101)
    return F.when(rest == 100, 0).otherwise(rest)


def snils_valid(number: Column) -> Column:
    return F.coalesce((F.length(number) == 11) & (snils_control(number) == F.substring(number, 10, 2).try_cast("int")), F.lit(False))


def inn_controls(base: Column) -> tuple[Column, Column]:
    """The last two digits of a personal tax number from its first ten (the second takes the first into account)."""
    first = _weighted(base, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10
    second = (_weighted(base, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6)) + first * 8) % 11 % 10
    return first, second


def inn_valid(number: Column) -> Column:
    first, second = inn_controls(number)
    return F.coalesce((F.length(number) == 12) & (first == _digit(number, 11)) & (second == _digit(number, 12)), F.lit(False))


def luhn_control(base: Column, length: int) -> Column:
    """The check digit that follows ``length`` digits: every second one from the right is doubled."""
    out = F.lit(0)
    for place in range(1, length + 1):
        d = _digit(base, place)
        if (length - place) % 2 == 0:
            d = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        out = out + d
    return (F.lit(10) - out % 10) % 10


# ---------------------------------------------------------------- plain strings, for the rules' scan


def snils_holds(number: str) -> bool:
    if len(number) != 11 or not number.isascii():
        return False
    total = sum(int(d) * w for d, w in zip(number, range(9, 0, -1)))
    return (total if total < 100 else total % 101) % 100 == int(number[9:])


def inn_holds(number: str) -> bool:
    if len(number) != 12 or not number.isascii():
        return False
    d = [int(c) for c in number]
    first = sum(x * w for x, w in zip(d, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    second = sum(x * w for x, w in zip(d, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    return (first, second) == (d[10], d[11])
