"""Exact numbers: money, guarded quotients, half-even rounding, figures in text, units and periods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"
#: Factors to millions of currency and to tonnes.
MILLIONS = {"元": "0.000001", "千元": "0.001", "万元": "0.01", "百万元": "1", "亿元": "100", "yuan": "0.000001", "thousand": "0.001", "million": "1", "billion": "1000"}
TONNES = {"吨": "1", "千吨": "1000", "万吨": "10000", "百万吨": "1000000", "亿吨": "100000000", "t": "1", "kt": "1000", "mt": "1000000"}


def money(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(MONEY)


def quantize(x: Column, places: int) -> Column:
    """Half-even, as exact decimal arithmetic rounds by default."""
    return F.bround(x, places)


def quotient(a: Column, b: Column, places: int = 4, scale: int = 1) -> Column:
    """a / b * scale, null where b is 0; both are money, so 18 digits stand before the rounding."""
    return quantize(F.try_divide(money(a), money(b)) * F.lit(scale), places)


def half_up(x: Column, places: int) -> Column:
    return F.round(x, places)


def year_of(period: Column) -> Column:
    """The year of an annual label; null for any other label."""
    return F.when(period.rlike(r"^[0-9]{4}$"), period.try_cast("int"))


def period_gap(prev: Column, curr: Column) -> Column:
    return year_of(curr) - year_of(prev)


def parse_figure(text: Column, let: Callable[[Column, Callable[[Column], Column]], Column] = lambda value, use: use(value)) -> Column:
    """``struct(value, is_dash)`` of a printed figure: thousands separators, full-width signs, brackets for
    negatives; a dash is no value but a stated nil, anything else unreadable is null. ``let`` may compute a step once
    where Spark doesn't, as in functions of an array's elements."""
    dash = lambda t: F.coalesce(t.rlike(r"^[-—–]+$"), F.lit(False))
    bare = lambda t: let(F.regexp_extract(t, r"^\((.*)\)$", 1), lambda inner: F.when(inner != "", F.concat(F.lit("-"), inner)).otherwise(t))
    value = lambda t, dash: F.when(~dash, let(bare(t), lambda b: F.when(b.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), b.try_cast(MONEY))))
    read = lambda t: let(dash(t), lambda d: F.struct(value(t, d).alias("value"), d.alias("is_dash")))
    return let(F.translate(F.regexp_replace(text, r"[\s　,，]", ""), "（）－−０１２３４５６７８９．", "()--0123456789."), read)


def _factor(unit: Column, factors: dict[str, str]) -> Column:
    pairs = [F.lit(x) for k, v in factors.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), unit).cast("decimal(20,6)")


def to_millions(value: Column, unit: Column) -> Column:
    """Millions of currency; null for a unit that isn't known, never a guess."""
    return (value * _factor(unit, MILLIONS)).cast(MONEY)


def to_tonnes(value: Column, unit: Column) -> Column:
    return (value * _factor(unit, TONNES)).cast(MONEY)


def snapped_factor(noisy: Column, factors: tuple[str, ...] = ("0.000001", "0.001", "0.01", "1", "100"), tolerance: float = 0.02) -> Column:
    """The exact unit factor within the relative tolerance of a noisy one, else null."""
    near = [F.when(F.abs(noisy - F.lit(float(f))) <= tolerance * float(f), F.lit(f).cast("decimal(20,6)")) for f in factors]
    return F.coalesce(*near)
