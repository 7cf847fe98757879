"""Column functions: text, angles, norms and the normalisers of graph features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.regexp_replace(c, f"{suffix}$", "")


def dashed(*cs: Column) -> Column:
    """Values joined by a dash; null if any is null."""
    return F.concat(*[x for c in cs for x in (F.lit("-"), c.cast("string"))][1:])


def clock_seconds(c: Column) -> Column:
    """Seconds of ``mm:ss``."""
    parts = F.split(c, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def to_tens(c: Column) -> Column:
    return F.round(c / 10) * 10


def height_cm(c: Column) -> Column:
    """Centimetres of ``feet-inches``, to the nearest ten; null where there are no such numbers."""
    feet = F.regexp_extract(c, r"(\d+)", 1).try_cast("double")
    inches = F.regexp_extract(c, r"\d+-(\d+)", 1).try_cast("double")
    return to_tens(feet * 30.48 + inches * 2.54)


def weight_kg(pounds: Column) -> Column:
    return to_tens(pounds * 0.453592)


def wrapped(degrees: Column) -> Column:
    """Degrees as radians in [-pi, pi)."""
    return F.pmod(F.radians(degrees) + math.pi, F.lit(2 * math.pi)) - math.pi


def between(v: Column, low: float, high: float) -> Column:
    return (v - low) / (high - low)


def part_of(v: Column, most: float) -> Column:
    return v / most


def angle_part(v: Column) -> Column:
    return (v + math.pi) / (2 * math.pi)


def sincos_part(v: Column) -> Column:
    return (v + 1) / 2


def clipped(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def speed_part(v: Column, is_ball: Column, player: float, ball: float) -> Column:
    return clipped(v / F.when(is_ball, ball).otherwise(player), 0.0, 1.0)


def acceleration_part(v: Column, is_ball: Column, player: float, ball: float) -> Column:
    return clipped(v / F.when(is_ball, ball).otherwise(player), -1.0, 1.0)


def speed_difference_part(v: Column, is_ball: Column, player: float, ball: float) -> Column:
    """One-sided: a negative difference is clipped to 0."""
    return speed_part(v, is_ball, player, ball) * F.signum(v)


def norm(*cs: Column) -> Column:
    total = cs[0] * cs[0]
    for c in cs[1:]:
        total = total + c * c
    return F.sqrt(total)


def unit(v: Column, size: Column) -> Column:
    return F.when(size == 0, 0.0).otherwise(v / F.when(size == 0, 1.0).otherwise(size))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Radians between two vectors; a zero vector is at a right angle to any."""
    na, nb = norm(ax, ay), norm(bx, by)
    return F.acos(clipped(unit(ax, na) * unit(bx, nb) + unit(ay, na) * unit(by, nb), -1.0, 1.0))


def zero_nan(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def finite(c: Column, nan: float = 1e-10, high: float = 1e3, low: float = -1e3) -> Column:
    """NaN and null become ``nan``; infinities the bounds."""
    return F.when(c.isNull() | F.isnan(c), nan).when(c == float("inf"), high).when(c == float("-inf"), low).otherwise(c)


def default_of(kind: T.DataType) -> Column:
    """The padding value of a type: false, 0, 0.0, empty text, else null."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    return F.lit(None).cast(kind)
