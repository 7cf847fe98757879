"""Rays against axis-parallel segments, and half turns about the points where they meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.scalar import norm

TINY = 1e-10


def ray_hits(x: Column, y: Column, vx: Column, vy: Column, start: tuple[float, float], end: tuple[float, float]) -> tuple[Column, Column, Column]:
    """(hit, x, y) where the ray from a position along its velocity meets the segment; (false, 0, 0) if it does not."""
    size = norm(vx, vy)
    ux, uy = F.try_divide(vx, size), F.try_divide(vy, size)
    if abs(end[0] - start[0]) < TINY:
        along, t = F.abs(ux) >= TINY, F.try_divide(F.lit(start[0]) - x, ux)
        low, high, other = min(start[1], end[1]), max(start[1], end[1]), y + t * uy
    elif abs(end[1] - start[1]) < TINY:
        along, t = F.abs(uy) >= TINY, F.try_divide(F.lit(start[1]) - y, uy)
        low, high, other = min(start[0], end[0]), max(start[0], end[0]), x + t * ux
    else:
        raise NotImplementedError("only lines along an axis")
    hit = F.coalesce(along & (t >= 0) & other.between(low, high), F.lit(False))
    return hit, F.when(hit, x + t * ux).otherwise(0.0), F.when(hit, y + t * uy).otherwise(0.0)


def half_turn(p: Column, v: Column, pivot: Column, hit: Column) -> tuple[Column, Column]:
    """A coordinate and its velocity turned by 180 degrees about ``pivot`` where ``hit``."""
    return F.when(hit, 2 * pivot - p).otherwise(p), F.when(hit, -v).otherwise(v)
