"""Soccer tracking feeds and rosters as tidy tables."""

from __future__ import annotations

import re
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.scalar import strip_suffix
from trackloom.operators import kinematics, possession
from trackloom.schema import Settings

COORDINATE = re.compile(r"(.+)_([xyz])$")


def object_ids(df: DataFrame) -> list[str]:
    """Objects that have an x column, in column order."""
    return [m[1] for c in df.columns if (m := COORDINATE.fullmatch(c)) and m[2] == "x"]


def unpivot(df: DataFrame, keep: list[str]) -> DataFrame:
    """Wide rows, with columns {id}_x, {id}_y and perhaps {id}_z, as a row per object: keep..., id, x, y, z.

    One pass without a shuffle. A missing or null z is 0.
    """
    has = set(df.columns)
    part = lambda i, c: F.col(f"`{i}_{c}`").cast("double") if f"{i}_{c}" in has else F.lit(None).cast("double")
    rows = [F.struct(strip_suffix(F.lit(f"{i}_x"), "_x").alias("id"), part(i, "x").alias("x"), part(i, "y").alias("y"), F.coalesce(part(i, "z"), F.lit(0.0)).alias("z")) for i in object_ids(df)]
    return df.select(*keep, F.inline(F.array(*rows)))


def centred(df: DataFrame, x0: float, y0: float, from_length: float, from_width: float, settings: Settings = Settings(), flip_periods: tuple[int, ...] = ()) -> DataFrame:
    """Provider coordinates as metres from the centre; periods in which sides are changed are turned."""
    sign = F.when(F.col("period_id").isin(list(flip_periods)), -1.0).otherwise(1.0) if flip_periods else F.lit(1.0)
    return df.withColumns({"x": sign * (F.col("x") - x0) * (settings.length / from_length), "y": sign * (F.col("y") - y0) * (settings.width / from_width)})


def with_roster(df: DataFrame, players: DataFrame) -> DataFrame:
    """Add team_id and position_name of ``players`` (game_id, id, team_id, position_name); the ball is its own team."""
    d = df.join(players.select("game_id", "id", "team_id", "position_name"), ["game_id", "id"], "left")
    ball = F.col("id") == "ball"
    return d.withColumns({"team_id": F.when(ball, F.lit("ball")).otherwise(F.col("team_id")), "position_name": F.when(ball, F.lit("ball")).otherwise(F.col("position_name"))})


def load(df: DataFrame, settings: Settings = Settings(), smoothing: bool = True) -> DataFrame:
    """The whole soccer pipeline on long rows: motion, clamps, owner and carrier, direction, goalkeepers, one row each.

    Two shuffles: by object, then by frame. Goalkeepers are inferred in games whose home team has no known position. If
    no row at all names an owner, there is a warning: all owners are then inferred from the distance to the ball.
    """
    if possession.owners_missing(df):
        warnings.warn("no row names the team that owns the ball; owners are inferred from the distance to the ball", UserWarning, stacklevel=2)
    d = possession.with_owner(kinematics.kinematics(df, settings, smoothing), settings)
    if settings.orientation == "ball_owning":
        d = possession.facing_right(d, settings)
    named = (F.col("team_id") == settings.home_team_id) & F.col("position_name").isNotNull()
    games = df.groupBy("game_id").agg(F.max(named).alias("_named"))
    kinds = {bool(r[0]) for r in games.select("_named").distinct().collect()}
    if kinds == {False}:
        d = possession.goalkeepers(d, settings)
    elif len(kinds) == 2:
        inferred = possession.goalkeepers(d.withColumn("_given", F.col("position_name")), settings).join(games, "game_id")
        d = inferred.withColumn("position_name", F.when(F.col("_named"), F.col("_given")).otherwise(F.col("position_name"))).drop("_given", "_named")
    return possession.one_row_per_object(d)


def load_feed(feed: tuple[DataFrame, DataFrame, str], settings: Settings = Settings(), smoothing: bool = True) -> DataFrame:
    """The whole pipeline on what a reader of ``providers`` gives; the feed's home team takes the place of the settings'."""
    rows, players, home = feed
    return load(with_roster(rows, players), replace(settings, home_team_id=home), smoothing)


def with_game_id(df: DataFrame, name: str) -> DataFrame:
    """Rows without a game's id get ``name``, the same in every run; a column is added if there is none."""
    given = F.col("game_id") if "game_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("game_id", F.coalesce(given, F.lit(name)))


def player_by_id(players: DataFrame, player_id: str) -> Row | None:
    """A player's row of a roster, or None."""
    return players.where(F.col("id") == player_id).first()


def team_id_of_player(players: DataFrame, player_id: str) -> str | None:
    found = player_by_id(players, player_id)
    return found["team_id"] if found else None


def from_wide(df: DataFrame, players: DataFrame, settings: Settings = Settings(), smoothing: bool = True) -> DataFrame:
    keep = [c for c in ("game_id", "period_id", "frame_id", "t_ms", "ball_state", "ball_owning_team_id") if c in df.columns]
    return load(with_roster(unpivot(df, keep), players), settings, smoothing)


def roster_xml(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, id, team_id, name, position_name, starting) of a match information XML."""
    m = spark.read.format("xml").option("rowTag", "MatchInformation").option("inferSchema", False).load(path)
    t = m.select(F.col("General._MatchId").alias("game_id"), F.explode("Teams.Team").alias("t"))
    p = t.select("game_id", F.col("t._TeamId").alias("team_id"), F.explode("t.Players.Player").alias("p"))
    return p.select("game_id", F.col("p._PersonId").cast("string").alias("id"), "team_id", F.col("p._Shortname").alias("name"), F.col("p._PlayingPosition").alias("position_name"), F.col("p._Starting").cast("boolean").alias("starting"))


def roster_json(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, id, team_id, name, position_name) of a match data JSON."""
    m = spark.read.option("multiLine", True).json(path)
    p = m.select(F.col("id").cast("string").alias("game_id"), F.explode("players").alias("p"))
    return p.select("game_id", F.col("p.id").cast("string").alias("id"), F.col("p.team_id").cast("string").alias("team_id"), F.concat_ws(" ", "p.first_name", "p.last_name").alias("name"), F.col("p.player_role.acronym").alias("position_name"))
