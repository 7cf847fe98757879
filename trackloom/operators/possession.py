"""Ball owner and carrier, playing direction and goalkeepers, in windows over one partitioning by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.scalar import norm
from trackloom.schema import FRAME, Settings


def owners_missing(df: DataFrame) -> bool:
    """Whether no row names an owning team, so that all would be inferred."""
    return not df.where(F.col("ball_owning_team_id").isNotNull()).take(1)


def ball_distance(df: DataFrame, settings: Settings) -> DataFrame:
    """Add ``ball_distance``: to the ball of the row's frame, null without one."""
    w = Window.partitionBy(*FRAME)
    at = {c: F.max(F.when(F.col("team_id") == settings.ball_id, F.col(c))).over(w) for c in ("x", "y", "z")}
    d = df.withColumns({f"_b{c}": at[c] for c in at})
    return d.withColumn("ball_distance", norm(*(F.col(c) - F.col(f"_b{c}") for c in "xyz"))).drop("_bx", "_by", "_bz")


def with_owner(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Infer missing owners and the carrier, and drop frames without an owner.

    The owner is the given one, else the team of the nearest player closer than the threshold; the carrier the given
    one, else the nearest player of the owning team closer than it. Ties go to the smaller id.
    """
    w = Window.partitionBy(*FRAME)
    d = ball_distance(df, settings)
    player = (F.col("team_id") != settings.ball_id) & F.col("ball_distance").isNotNull() & (F.col("ball_distance") < settings.ball_carrier_threshold)
    near = F.struct("ball_distance", "id")
    given = F.min("ball_owning_team_id").over(w)
    d = d.withColumn("ball_owning_team_id", F.coalesce(given, F.min_by("team_id", F.when(player, near)).over(w)))
    own = player & (F.col("team_id") == F.col("ball_owning_team_id"))
    named = F.max(F.when(F.col("is_ball_carrier"), F.col("id"))).over(w) if "is_ball_carrier" in df.columns else F.lit(None).cast("string")
    d = d.withColumn("_carrier", F.coalesce(named, F.min_by("id", F.when(own, near)).over(w)))
    d = d.withColumn("is_ball_carrier", F.coalesce(F.col("id") == F.col("_carrier"), F.lit(False)))
    return d.drop("_carrier", "ball_distance").where(F.col("ball_owning_team_id").isNotNull())


def facing_right(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Turn frames so that the owning team plays to the right: x, y and their derivatives change sign, z does not."""
    turn = F.col("ball_owning_team_id") != settings.home_team_id
    return df.withColumns({c: F.when(turn, -F.col(c)).otherwise(F.col(c)) for c in ("x", "y", "vx", "vy", "ax", "ay") if c in df.columns})


def goalkeepers(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Name ``GK`` the player of each team nearest to its own goal; other players' position becomes null.

    With ball-owning orientation the owner defends the left goal, else the home team does. Ties go to the smaller id.
    """
    left_team = F.col("ball_owning_team_id") if settings.orientation == "ball_owning" else F.lit(settings.home_team_id)
    goal = F.when(F.col("team_id") == left_team, -settings.x_max).otherwise(settings.x_max)
    distance = norm(F.col("x") - goal, F.col("y"))
    w = Window.partitionBy(*FRAME, "team_id")
    keeper = F.min_by("id", F.struct(distance, F.col("id"))).over(w)
    position = F.when(F.col("team_id") == settings.ball_id, F.col("position_name")).when(F.col("id") == keeper, F.lit("GK"))
    return df.withColumn("position_name", position)


def one_row_per_object(df: DataFrame) -> DataFrame:
    """Of rows that repeat an object in a frame, the earliest one."""
    w = Window.partitionBy(*FRAME, "id").orderBy("t_ms", "x", "y")
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
