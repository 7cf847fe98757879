"""Sampling, completeness filters, padding, lookups, labels and ids of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.scalar import dashed, default_of
from trackloom.schema import FRAME, Settings


def sample_frames(df: DataFrame, rate: float, column: str = "frame_id") -> DataFrame:
    """Keep frames whose number is a multiple of 1 / rate; a rate of a half keeps every second one."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    return df.where(F.col(column) % F.lit(1.0 / rate) == 0)


def sample_graphs(df: DataFrame, rate: float, order: list[str] = FRAME) -> DataFrame:
    """Keep every (1 / rate)-th row of one row per graph, counted within its game in order."""
    k = F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])) - 1
    return df.withColumn("_k", k).where(F.col("_k") % F.lit(1.0 / rate) == 0).drop("_k")


def time_window(df: DataFrame, start_ms: int | None, end_ms: int | None, period_id: int | None) -> DataFrame:
    """Rows of one period between two times, both included; all three arguments or none."""
    given = [x is not None for x in (start_ms, end_ms, period_id)]
    if not any(given):
        return df
    if not all(given):
        raise ValueError("give start, end and period, or none of them")
    return df.where(F.col("t_ms").between(start_ms, end_ms) & (F.col("period_id") == period_id))


def filled_forward(df: DataFrame, column: str, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def first_frame_at(df: DataFrame) -> DataFrame:
    """Of the frames at one time of a game's period, the first."""
    w = Window.partitionBy("game_id", "period_id", "t_ms").orderBy("frame_id")
    return df.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def next_time(df: DataFrame, period_id: int, t_ms: int) -> DataFrame:
    """The earliest frame of a period at or after a time, one per game."""
    at = df.where((F.col("period_id") == period_id) & (F.col("t_ms") >= t_ms))
    return at.groupBy("game_id").agg(F.min_by("frame_id", F.struct("t_ms", "frame_id")).alias("frame_id"), F.min("t_ms").alias("t_ms"))


def whole_frames(df: DataFrame, teams: int = 3) -> DataFrame:
    """Frames in which exactly so many teams (the ball is one) have rows; one window, no join."""
    n = F.size(F.collect_set("team_id").over(Window.partitionBy(*FRAME)))
    return df.withColumn("_n", n).where(F.col("_n") == teams).drop("_n")


def football_frames(df: DataFrame, by: list[str], ball_id: str, least: int = 10) -> DataFrame:
    """Frames with at least ``least`` objects and the ball."""
    w = Window.partitionBy(*by)
    d = df.withColumns({"_n": F.count("*").over(w), "_b": F.sum(F.when(F.col("team_id") == ball_id, 1).otherwise(0)).over(w)})
    return d.where((F.col("_n") >= least) & (F.col("_b") > 0)).drop("_n", "_b")


def complete_frames(df: DataFrame, settings: Settings = Settings(), players: int = 11) -> DataFrame:
    """Frames of exactly one ball and ``players`` of the owning and of the other team."""
    w = Window.partitionBy(*FRAME)
    ball, own = F.col("team_id") == settings.ball_id, F.col("team_id") == F.col("ball_owning_team_id")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    d = df.withColumns({"_b": n(ball), "_o": n(own), "_x": n(~ball & ~own)})
    return d.where((F.col("_b") == 1) & (F.col("_o") == players) & (F.col("_x") == players)).drop("_b", "_o", "_x")


def padded(df: DataFrame, settings: Settings = Settings(), players: int = 11, copied: tuple[str, ...] = ("t_ms", "ball_state", "label", "graph_id")) -> DataFrame:
    """Fill teams up to ``players`` rows and add a missing ball, then keep complete frames.

    Added rows copy the frame's shared columns and have default values elsewhere: 0, false, empty text.
    """
    shared = [c for c in copied if c in df.columns]
    keys = [*FRAME, "ball_owning_team_id"]
    others = F.when((F.col("team_id") != settings.ball_id) & (F.col("team_id") != F.col("ball_owning_team_id")), F.col("team_id"))
    own = F.col("team_id") == F.col("ball_owning_team_id")
    per = df.groupBy(*keys).agg(
        *(F.min(c).alias(c) for c in shared),
        F.max(others).alias("_other"),
        F.count_if(own).alias("_own_n"),
        F.count_if(others.isNotNull()).alias("_other_n"),
        F.count_if(F.col("team_id") == settings.ball_id).alias("_ball_n"),
    )
    row = lambda team, n: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda _: team)).otherwise(F.array().cast("array<string>"))
    missing = F.concat(
        row(F.col("ball_owning_team_id"), players - F.col("_own_n")),
        row(F.col("_other"), F.when(F.col("_other").isNotNull(), players - F.col("_other_n")).otherwise(0)),
        row(F.lit(settings.ball_id), 1 - F.col("_ball_n")),
    )
    added = per.select(*keys, *shared, F.explode(missing).alias("team_id"))
    rest = [f for f in df.schema.fields if f.name not in {*keys, *shared, "team_id"}]
    added = added.select(*keys, *shared, "team_id", *(default_of(f.dataType).alias(f.name) for f in rest))
    return complete_frames(df.unionByName(added), settings, players)


def with_graph_ids(df: DataFrame, by: list[str] = FRAME) -> DataFrame:
    return df.withColumn("graph_id", dashed(*map(F.col, by)))


def with_dummy_labels(df: DataFrame, by: list[str] = FRAME, seed: int = 0) -> DataFrame:
    """A 0 or 1 per distinct ``by``, from the md5 of it and the seed."""
    digest = F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in by), F.lit(str(seed))))
    return df.withColumn("label", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 2).cast("int"))


def constant_in_frame(df: DataFrame, columns: list[str], by: list[str] = FRAME) -> DataFrame:
    """The rows as they are; an error when read if a column has two values in one frame."""
    w = Window.partitionBy(*by)
    for c in columns:
        same = F.min(c).over(w).eqNullSafe(F.max(c).over(w))
        df = df.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must have one value in a frame")).cast(df.schema[c].dataType)))
    return df


def graph_order(settings: Settings = Settings()) -> Column:
    """Attackers, defenders, ball; by id in each."""
    kind = F.when(F.col("team_id") == settings.ball_id, 2).when(F.col("team_id") == F.col("ball_owning_team_id"), -1).otherwise(0)
    return F.struct(kind.alias("kind"), F.col("id").alias("id"))
