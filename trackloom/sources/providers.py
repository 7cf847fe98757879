"""Tracking files of data providers as long rows: game, period, frame, time, ball state, owner, object and place.

All give ``(rows, players, home_team_id)`` for ``soccer.load_feed``: rows without motion, in metres from the centre, and a
roster with ``GK`` for goalkeepers. Element, field and code names are fixed values of the providers' published formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.schema import BALL
from trackloom.sources.files import scratch

ROWS = ["game_id", "period_id", "frame_id", "t_ms", "ball_state", "ball_owning_team_id", "id", "x", "y", "z"]
SECTIONS = {"firstHalf": 1, "secondHalf": 2, "firstHalfExtra": 3, "secondHalfExtra": 4}
#: Minutes on the clock at the start of each period.
KICK_OFF = {1: 0, 2: 45, 3: 90, 4: 105}
Feed = tuple[DataFrame, DataFrame, str]


def looked_up(c: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c)


def sportec(spark: SparkSession, tracking_path: str, meta_path: str, frame_rate: int = 25) -> Feed:
    """Positions XML (a FrameSet per object and half) and match information XML. Time counts from a period's first frame."""
    m = spark.read.format("xml").option("rowTag", "MatchInformation").option("inferSchema", False).load(meta_path)
    home, guest = m.select("General._HomeTeamId", "General._GuestTeamId").first()
    p = m.select(F.col("General._MatchId").alias("game_id"), F.explode("Teams.Team").alias("t")).select("game_id", F.col("t._TeamId").alias("team_id"), F.explode("t.Players.Player").alias("p"))
    position = F.when(F.col("p._PlayingPosition") == "TW", "GK").otherwise(F.col("p._PlayingPosition"))
    players = p.select("game_id", F.col("p._PersonId").cast("string").alias("id"), "team_id", position.alias("position_name"))
    kind = "_GameSection string, _MatchId string, _TeamId string, _PersonId string, Frame array<struct<_N:bigint,_X:double,_Y:double,_Z:double,_BallPossession:int,_BallStatus:int>>"
    sets = spark.read.format("xml").option("rowTag", "FrameSet").schema(kind).load(tracking_path)
    is_ball = F.col("_TeamId") == "BALL"
    rows = sets.where(is_ball | F.col("_TeamId").isin(home, guest)).select(
        F.col("_MatchId").alias("game_id"), looked_up(F.col("_GameSection"), SECTIONS).alias("period_id"), F.when(is_ball, BALL).otherwise(F.col("_PersonId")).alias("id"), F.explode("Frame").alias("f")
    )
    # parsed once: what follows reads the rows several times
    path = scratch(spark, "positions")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    first = rows.groupBy("game_id", "period_id").agg(F.min("f._N").alias("first"))
    ball = rows.where(F.col("id") == BALL).select(
        "game_id", "period_id", F.col("f._N").alias("frame_id"),
        F.when(F.col("f._BallStatus") == 1, "alive").otherwise("dead").alias("ball_state"),
        looked_up(F.col("f._BallPossession"), {1: home, 2: guest}).alias("ball_owning_team_id"),
    )
    rows = rows.select("game_id", "period_id", F.col("f._N").alias("frame_id"), "id", F.col("f._X").alias("x"), F.col("f._Y").alias("y"), F.coalesce("f._Z", F.lit(0.0)).alias("z"))
    rows = rows.join(F.broadcast(first), ["game_id", "period_id"]).join(ball, ["game_id", "period_id", "frame_id"], "left")
    t = ((F.col("frame_id") - F.col("first")) * 1000 / frame_rate).cast("long")
    return rows.withColumn("t_ms", t).select(*ROWS), players, home


def milliseconds(clock: Column) -> Column:
    """Of ``h:mm:ss.f`` or ``mm:ss.f``."""
    parts = F.transform(F.reverse(F.split(clock, ":")), lambda x, k: x.cast("double") * F.pow(F.lit(60.0), k))
    return F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) * 1000).cast("long")


def skillcorner(spark: SparkSession, tracking_path: str, meta_path: str, multi_line: bool = True) -> Feed:
    """Structured JSON, gzip or not, and match data JSON. A file that is one array of frames is read by one task; with
    ``multi_line`` off, files have a frame a line."""
    m = spark.read.option("multiLine", True).json(meta_path)
    match = m.select(F.col("id").cast("string").alias("game_id"), F.col("home_team.id").cast("string").alias("home"), F.col("away_team.id").cast("string").alias("away"), F.col("ball.trackable_object").alias("ball")).first()
    p = m.select(F.explode("players").alias("p")).select(F.col("p.trackable_object").alias("object"), F.col("p.id").cast("string").alias("id"), F.col("p.team_id").cast("string").alias("team_id"), F.col("p.player_role.acronym").alias("position_name"))
    kind = "frame long, period int, timestamp string, time string, possession struct<group:string,trackable_object:bigint>, data array<struct<trackable_object:bigint,x:double,y:double,z:double>>"
    f = spark.read.option("multiLine", multi_line).schema(kind).json(tracking_path).where(F.col("period").isNotNull())
    t = milliseconds(F.coalesce("timestamp", "time")) - looked_up(F.col("period"), KICK_OFF) * 60_000
    owner = looked_up(F.col("possession.group"), {"home team": match["home"], "away team": match["away"]})
    rows = f.select(F.lit(match["game_id"]).alias("game_id"), F.col("period").alias("period_id"), F.col("frame").alias("frame_id"), t.alias("t_ms"), F.lit("alive").alias("ball_state"), owner.alias("ball_owning_team_id"), F.inline("data"))
    ball = F.col("object") == F.lit(match["ball"])
    rows = rows.withColumnRenamed("trackable_object", "object").join(F.broadcast(p.select("object", "id")), "object", "left").withColumn("id", F.when(ball, BALL).otherwise(F.col("id")))
    rows = rows.where(F.col("id").isNotNull()).withColumn("z", F.coalesce("z", F.lit(0.0)))  # others are referees
    return rows.select(*ROWS), p.select(F.lit(match["game_id"]).alias("game_id"), "id", "team_id", "position_name"), match["home"]


def second_spectrum(spark: SparkSession, tracking_path: str, game_id: str) -> Feed:
    """JSON lines, a frame each. The file names no positions, so goalkeepers are inferred."""
    side = "array<struct<playerId:string,xyz:array<double>>>"
    kind = f"period int, frameIdx long, gameClock double, live boolean, lastTouch string, ball struct<xyz:array<double>>, homePlayers {side}, awayPlayers {side}"
    f = spark.read.schema(kind).json(tracking_path)
    one = lambda team: F.transform(f"{team}Players", lambda p: F.struct(p["playerId"].alias("id"), F.lit(team).alias("team_id"), p["xyz"].alias("xyz")))
    ball = F.when(F.col("ball.xyz").isNotNull(), F.array(F.struct(F.lit(BALL).alias("id"), F.lit(BALL).alias("team_id"), F.col("ball.xyz").alias("xyz")))).otherwise(F.array())
    at = lambda k: F.get(F.col("o.xyz"), F.lit(k))
    rows = f.select(
        F.lit(game_id).alias("game_id"), F.col("period").alias("period_id"), F.col("frameIdx").alias("frame_id"), F.round(F.col("gameClock") * 1000).cast("long").alias("t_ms"), F.when(F.col("live"), "alive").otherwise("dead").alias("ball_state"),
        F.when(F.col("lastTouch").isin("home", "away"), F.col("lastTouch")).alias("ball_owning_team_id"), F.explode(F.concat(F.coalesce(one("home"), F.array()), F.coalesce(one("away"), F.array()), ball)).alias("o"),
    )
    rows = rows.select(*ROWS[:6], "o.id", "o.team_id", at(0).alias("x"), at(1).alias("y"), F.coalesce(at(2), F.lit(0.0)).alias("z"))
    players = rows.where(F.col("id") != BALL).select("game_id", "id", "team_id", F.lit(None).cast("string").alias("position_name")).distinct()
    return rows.select(*ROWS), players, "home"


def tracab(spark: SparkSession, tracking_path: str, game_id: str, periods: dict[int, tuple[int, int]], frame_rate: int = 25) -> Feed:
    """DAT lines ``frame:team,target,number,x,y,speed;...:x,y,z,speed,owner,state;:`` in centimetres. ``periods`` gives the
    first and last frame of each. The file names no positions, so goalkeepers are inferred."""
    part = F.split("value", ":")
    d = spark.read.text(tracking_path).where(F.col("value") != "").select(part[0].cast("long").alias("frame_id"), F.split(part[1], ";").alias("o"), F.split(F.split(part[2], ";")[0], ",").alias("b"))
    d = d.withColumns({"period_id": F.coalesce(*(F.when(F.col("frame_id").between(*ends), k) for k, ends in periods.items())), "first": F.coalesce(*(F.when(F.col("frame_id").between(*ends), ends[0]) for ends in periods.values()))})
    metres = lambda c: c.try_cast("double") / 100
    objects = F.transform(F.filter("o", lambda o: F.split(o, ",")[0].isin("0", "1")), lambda o: F.struct(
        F.concat(F.when(F.split(o, ",")[0] == "1", "home").otherwise("away"), F.lit("-"), F.split(o, ",")[2]).alias("id"),
        F.when(F.split(o, ",")[0] == "1", "home").otherwise("away").alias("team_id"), metres(F.split(o, ",")[3]).alias("x"), metres(F.split(o, ",")[4]).alias("y"), F.lit(0.0).alias("z"),
    ))
    ball = F.array(F.struct(F.lit(BALL).alias("id"), F.lit(BALL).alias("team_id"), metres(F.col("b")[0]).alias("x"), metres(F.col("b")[1]).alias("y"), metres(F.col("b")[2]).alias("z")))
    rows = d.where(F.col("period_id").isNotNull()).select(
        F.lit(game_id).alias("game_id"), "period_id", "frame_id", ((F.col("frame_id") - F.col("first")) * 1000 / frame_rate).cast("long").alias("t_ms"), F.lower(F.col("b")[5]).alias("ball_state"),
        looked_up(F.col("b")[4], {"H": "home", "A": "away"}).alias("ball_owning_team_id"), F.inline(F.concat(objects, ball)),
    )
    players = rows.where(F.col("id") != BALL).select("game_id", "id", "team_id", F.lit(None).cast("string").alias("position_name")).distinct()
    return rows.select(*ROWS), players, "home"

