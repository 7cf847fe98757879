"""American football tracking from CSV: scans, dimensions and the play-direction transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.scalar import clock_seconds, height_cm, weight_kg, wrapped
from trackloom.operators.frames import filled_forward
from trackloom.schema import FOOTBALL, FootballSettings

#: Fixed tokens that stand for null in the feed, and the id of the ball.
NULLS = ["NA", "NULL", ""]
BALL_ID = -9999.9
#: Kinds of frames, events that end a play before or at the snap, and events of the huddle.
BEFORE_SNAP, SNAP = "BEFORE_SNAP", "SNAP"
ENDING = ["field_goal_play", "pass_forward", "timeout_away", "timeout_home", "snap_direct"]
HUDDLE = ["huddle_break_offense", "huddle_start_offense"]


def scan(spark: SparkSession, path: str, types: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """Lenient CSV scan: columns are read as text, null tokens become null, then cast; what can't be cast is null."""
    d = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"')
    clean = lambda c: F.when(~F.col(f"`{c}`").isin(NULLS), F.col(f"`{c}`"))
    return d.select(*(clean(c).try_cast(types[c]).alias(c) if types and c in types else clean(c).alias(c) for c in d.columns))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that are there: seasons differ (club or team, officialPosition or position)."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def oriented(df: DataFrame, settings: FootballSettings = FootballSettings()) -> DataFrame:
    """Centre the field, turn plays that go left by half a circle, and give angles in radians."""
    left = F.col("playDirection") == "left"
    angle = lambda c: wrapped(F.when(left, F.col(c) + 180).otherwise(F.col(c)))
    x, y = F.col("x") - settings.x_max, F.col("y") - settings.y_max
    return df.withColumns({"x": F.when(left, -x).otherwise(x), "y": F.when(left, -y).otherwise(y), "o": angle("o"), "dir": angle("dir"), "playDirection": F.lit("left")})


def players(df: DataFrame) -> DataFrame:
    d = renamed(df, {"officialPosition": "position_name", "position": "position_name"})
    return d.select(F.col("nflId").try_cast("double").alias("id"), "position_name", height_cm(F.col("height")).alias("height_cm"), weight_kg(F.col("weight").try_cast("double")).alias("weight_kg"))


def tracking(feed: DataFrame, players_: DataFrame, plays: DataFrame, settings: FootballSettings = FootballSettings(), sample_rate: float | None = None) -> DataFrame:
    """Tidy rows: game_id, play_id, frame_id (play * 100000 + frame), id, team_id, motion, position, size and owner.

    The dimension tables are small by nature, but joined without a hint: Spark broadcasts them below its own bound.
    """
    d = renamed(feed, {"club": "team_id", "team": "team_id"})
    d = d.withColumn("id", F.coalesce(F.col("nflId").try_cast("double"), F.lit(BALL_ID)))
    if sample_rate:
        d = d.where(F.col("frameId") % F.lit(1.0 / sample_rate) == 0)
    d = oriented(d, settings).join(players(players_), "id", "left")
    owner = plays.select("gameId", "playId", F.col("possessionTeam").alias("ball_owning_team_id"))
    d = d.join(owner, ["gameId", "playId"], "left")
    return d.select(
        F.col("gameId").alias("game_id"), F.col("playId").alias("play_id"), (F.col("playId").cast("long") * 100_000 + F.col("frameId").cast("long")).alias("frame_id"),
        "id", "team_id", "x", "y", F.col("s").alias("v"), "a", "o", "dir", F.when(F.col("team_id") == FOOTBALL, FOOTBALL).otherwise(F.col("position_name")).alias("position_name"), "height_cm", "weight_kg", "ball_owning_team_id",
    )


#: Types of the columns that the loader reads as numbers.
TRACKING_TYPES = {"gameId": "bigint", "playId": "bigint", "nflId": "double", "frameId": "bigint", "x": "double", "y": "double", "s": "double", "a": "double", "dis": "double", "o": "double", "dir": "double"}
PLAYER_TYPES = {"nflId": "double", "weight": "double"}
PLAY_TYPES = {"gameId": "bigint", "playId": "bigint"}


def load(spark: SparkSession, tracking_path: str, players_path: str, plays_path: str, settings: FootballSettings = FootballSettings(), sample_rate: float | None = None) -> DataFrame:
    """``tracking`` of three CSV files or folders; unknown sizes and positions are null."""
    feed, players_, plays = (scan(spark, p, t) for p, t in ((tracking_path, TRACKING_TYPES), (players_path, PLAYER_TYPES), (plays_path, PLAY_TYPES)))
    return tracking(feed, players_, plays, settings, sample_rate)


def before_snap(tracking_: DataFrame) -> DataFrame:
    """Rows before the snap of plays that don't end at once: plays with one of ENDING's events up to the snap go, events
    are carried forward per player, and rows of the huddle go."""
    early = F.col("frameType").isin(BEFORE_SNAP, SNAP)
    ended = tracking_.where(early & F.col("event").isin(ENDING)).select("gameId", "playId").distinct()
    d = tracking_.join(ended, ["gameId", "playId"], "left_anti").where(early)
    d = filled_forward(d, "event", ["gameId", "playId", "nflId"], ["frameId"])
    # a null event is no member of HUDDLE and no other either, so its row goes
    return d.where(~F.col("event").isin(HUDDLE) & (F.col("frameType") != SNAP))


def plays_features(plays: DataFrame, games: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """Model inputs and targets of each play, and the names of the ``x``, ``y`` and ``other`` columns.

    ``plays`` and ``games`` are joined by gameId. Shares: a quarter has 900 seconds, a game 3600, overtime 600.
    """
    c = F.col
    home, normal = c("possessionTeam") == c("homeTeamAbbr"), c("quarter") <= 4
    minute, second = (F.split("gameClock", ":")[k].cast("int") for k in (0, 1))
    lead = c("preSnapHomeScore") - c("preSnapVisitorScore")
    clock = minute * 60 + second
    game_left = F.when(normal, 3600 - ((F.greatest(c("quarter"), F.lit(1)) - 1) * 900 + clock)).otherwise(600 - clock)
    minute_part = F.when(normal, minute / 15.0).otherwise(minute / 10.0)
    d = plays.join(games.select("gameId", "homeTeamAbbr", "visitorTeamAbbr"), "gameId").select(
        "gameId", "playId", "quarter", "down",
        (c("yardsToGo") / 50.0).alias("yardsToGo"), (c("yardlineNumber") / 50).alias("yardlineNumber"), "prePenaltyYardsGained", "yardsGained", "visitorTeamAbbr",
        F.coalesce(home, F.lit(False)).alias("isHome"),
        (F.when(home, lead).otherwise(-lead) / 100.0).alias("preSnapScoreDiff"),
        F.when(home, c("preSnapHomeTeamWinProbability")).otherwise(1 - c("preSnapHomeTeamWinProbability")).alias("preSnapTeamWinProbability"),
        minute_part.alias("quarterMinute"), (second / 60.0).alias("quarterSecond"),
        (game_left / F.when(normal, 3600).otherwise(600)).alias("gameSecondsLeft"),
        (clock / F.when(normal, 900).otherwise(600)).alias("quarterSecondsLeft"),
        c("passResult").isNotNull().alias("isPass"), c("yardsToGo").alias("yardsToGoText"),
        F.concat(c("visitorTeamAbbr"), F.lit(" "), c("preSnapVisitorScore").cast("string"), F.lit(" - "), c("homeTeamAbbr"), F.lit(" "), c("preSnapHomeScore").cast("string")).alias("scoreBoard"),
        (c("prePenaltyYardsGained") / 100.0).alias("prePenaltyYardsGainedNorm"),
    )
    y = ["prePenaltyYardsGained", "yardsGained", "isPass", "prePenaltyYardsGainedNorm"]
    x = ["quarter", "down", "yardsToGo", "isHome", "preSnapScoreDiff", "preSnapTeamWinProbability", "quarterMinute", "quarterSecond", "gameSecondsLeft", "quarterSecondsLeft", "yardlineNumber"]
    return d, {"x": x, "y": y, "other": [n for n in d.columns if n not in x and n not in y]}


def without_plays(tracking_: DataFrame, plays: DataFrame, results: list[str]) -> DataFrame:
    """Drop the plays with one of these results."""
    gone = plays.where(F.col("passResult").isin(results)).select("gameId", "playId").distinct()
    return tracking_.join(gone, ["gameId", "playId"], "left_anti")


def play_context(plays: DataFrame) -> DataFrame:
    """Clock in seconds, whether in the own half, score ahead of the play, and the last event so far of each game."""
    d = plays.withColumns({
        "clock_s": clock_seconds(F.col("gameClock")),
        "own_half": F.col("yardlineSide") == F.col("possessionTeam"),
        "score": F.concat(F.col("preSnapHomeScore").cast("string"), F.lit("-"), F.col("preSnapVisitorScore").cast("string")),
    })
    return filled_forward(d, "event", ["gameId", "playId"], ["frameId"]) if "event" in d.columns else d
