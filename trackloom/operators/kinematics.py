"""Velocity, smoothing, acceleration and clamps per object, as window expressions over one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.scalar import norm
from trackloom.schema import OBJECT, Settings

ORDER = ["t_ms", "frame_id"]


def object_window():
    return Window.partitionBy(*OBJECT).orderBy(*ORDER)


def derivative(columns: list[str], prefix: str, df: DataFrame) -> DataFrame:
    """Per second change of each column since the object's row before; 0 for the first, and where no time has passed."""
    w = object_window()
    dt = (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000.0
    return df.withColumns({prefix + c[-1]: F.coalesce(F.try_divide(F.col(c) - F.lag(c).over(w), dt), F.lit(0.0)) for c in columns})


def smooth(df: DataFrame, columns: dict[str, str], half: int, only: Column | None = None) -> DataFrame:
    """First-order Savitzky-Golay over 2 * half + 1 rows of an object: the mean inside, a fitted line at both ends.

    Writes ``columns`` (name: new name) of the objects where ``only`` holds, or of all. Objects with fewer rows are left
    as they are.
    """
    w, part, size = object_window(), Window.partitionBy(*OBJECT), 2 * half + 1
    squares = float(sum(t * t for t in range(-half, half + 1)))
    df = df.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(part)})
    head, tail = F.col("_rn") <= size, F.col("_rn") > F.col("_n") - size
    t_head, t_tail = F.col("_rn") - 1 - half, F.col("_rn") - F.col("_n") + half
    new = {}
    for c, name in columns.items():
        v = F.col(c)
        ends = {}
        for end, at, t in (("head", head, t_head), ("tail", tail, t_tail)):
            mean = F.sum(F.when(at, v)).over(part) / size
            slope = F.sum(F.when(at, v * t)).over(part) / squares
            ends[end] = mean + slope * t
        inside = F.avg(c).over(w.rowsBetween(-half, half))
        value = F.when(F.col("_n") < size, v).when(F.col("_rn") <= half, ends["head"]).when(F.col("_rn") > F.col("_n") - half, ends["tail"]).otherwise(inside)
        new[name] = value if only is None else F.when(only, value).otherwise(v)
    return df.withColumns(new).drop("_rn", "_n")


def clamped(df: DataFrame, settings: Settings) -> DataFrame:
    """Cap the sizes ``v`` and ``a`` by kind of object; their components stay."""
    ball = F.col("team_id") == settings.ball_id
    cap = lambda c, player, most: F.when(ball & (F.col(c) > most), most).when(~ball & (F.col(c) > player), player).otherwise(F.col(c))
    return df.withColumns({"v": cap("v", settings.max_player_speed, settings.max_ball_speed), "a": cap("a", settings.max_player_acceleration, settings.max_ball_acceleration)})


def kinematics(df: DataFrame, settings: Settings = Settings(), smoothing: bool = True, half_player: int = 3, half_ball: int = 1) -> DataFrame:
    """Add vx vy vz v ax ay az a. All windows share the partitioning by game, object and period: one shuffle."""
    d = derivative(["x", "y", "z"], "v", df)
    if smoothing:
        ball = F.col("team_id") == settings.ball_id
        names = {c: c for c in ("vx", "vy", "vz")}
        d = smooth(smooth(d, names, half_player, ~ball), names, half_ball, ball)
    d = d.withColumn("v", norm(F.col("vx"), F.col("vy"), F.col("vz")))
    d = derivative(["vx", "vy", "vz"], "a", d)
    d = d.withColumn("a", norm(F.col("ax"), F.col("ay"), F.col("az")))
    return clamped(d, settings).where(~(F.col("x").isNull() & F.col("y").isNull()))
