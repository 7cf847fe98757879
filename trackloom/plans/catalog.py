"""Registered queries of the tracking operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geometry, scalar
from trackloom.operators import datasets, features, formations, frames, graphs, kinematics, pairs, possession, pressing, splits
from trackloom.plans.views import FEED, TRACKING, feed, table, tracking
from trackloom.schema import BALL, FRAME, FootballSettings, Settings
from trackloom.sources import football, graph_files, providers, soccer
from trackloom.sources.files import scratch
from trackloom.streaming import feed as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SOCCER, GRID = Settings(), FootballSettings(ball_id=BALL)
KEYS = ", ".join(FRAME)
PI = repr(math.pi)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r4(c: Column | str) -> Column:
    """To four places by the same arithmetic as ``q4``: round() breaks ties differently from engine to engine."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10_000 + 0.5).cast("double") / 10_000


def q4(e: str) -> str:
    return f"(floor(CAST({e} AS DOUBLE) * 10000 + 0.5::DOUBLE) / 10000::DOUBLE)"


# --- motion -----------------------------------------------------------------------------------------------------------

W = "OVER (PARTITION BY id ORDER BY t_ms, frame_id)"
MOVED = f"""{FEED}, v1 AS (SELECT *, coalesce((x - lag(x) {W}) / nullif((t_ms - lag(t_ms) {W}) / 1000.0::DOUBLE, 0), 0) AS vx,
  coalesce((y - lag(y) {W}) / nullif((t_ms - lag(t_ms) {W}) / 1000.0::DOUBLE, 0), 0) AS vy FROM feed)"""


def accelerated(source: str) -> str:
    return f"""v2 AS (SELECT *, sqrt(vx * vx + vy * vy) AS v,
  coalesce((vx - lag(vx) {W}) / nullif((t_ms - lag(t_ms) {W}) / 1000.0::DOUBLE, 0), 0) AS ax,
  coalesce((vy - lag(vy) {W}) / nullif((t_ms - lag(t_ms) {W}) / 1000.0::DOUBLE, 0), 0) AS ay FROM {source})
SELECT id, frame_id, {q4("vx")} AS vx, {q4("vy")} AS vy, {q4("least(v, CASE WHEN ball THEN 28.0 ELSE 12.0 END::DOUBLE)")} AS v,
  {q4("ax")} AS ax, {q4("ay")} AS ay, {q4("least(sqrt(ax * ax + ay * ay), CASE WHEN ball THEN 13.5 ELSE 6.0 END::DOUBLE)")} AS a FROM v2"""


@query(f"WITH {MOVED}, {accelerated('v1')}")
def w_kinematics(spark, sf_dir):
    """Velocity, acceleration and clamps."""
    d = kinematics.kinematics(feed(spark, sf_dir), SOCCER, smoothing=False)
    return d.select("id", "frame_id", *(r4(c).alias(c) for c in ("vx", "vy", "v", "ax", "ay", "a")))


def smooth_sql(c: str) -> str:
    out = []
    for half in (3, 1):
        size, sq = 2 * half + 1, sum(t * t for t in range(-half, half + 1))
        p = "OVER (PARTITION BY id)"
        ends = []
        for at, t in ((f"rn <= {size}", f"(rn - 1 - {half})"), (f"rn > n - {size}", f"(rn - n + {half})")):
            ends.append(f"(sum(CASE WHEN {at} THEN {c} END) {p} / {size}.0::DOUBLE + sum(CASE WHEN {at} THEN {c} * {t} END) {p} / {sq}.0::DOUBLE * {t})")
        inside = f"avg({c}) OVER (PARTITION BY id ORDER BY t_ms, frame_id ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
        out.append(f"CASE WHEN n < {size} THEN {c} WHEN rn <= {half} THEN {ends[0]} WHEN rn > n - {half} THEN {ends[1]} ELSE {inside} END")
    return f"CASE WHEN ball THEN {out[1]} ELSE {out[0]} END"


@query(f"""WITH {MOVED}, n1 AS (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY id) AS n FROM v1),
s1 AS (SELECT id, frame_id, t_ms, ball, {smooth_sql("vx")} AS vx, {smooth_sql("vy")} AS vy FROM n1), {accelerated("s1")}""")
def w3_smoothing(spark, sf_dir):
    """Savitzky-Golay on the velocities, acceleration from the smoothed ones."""
    d = kinematics.kinematics(feed(spark, sf_dir), SOCCER)
    return d.select("id", "frame_id", *(r4(c).alias(c) for c in ("vx", "vy", "v", "ax", "ay", "a")))


# --- sources ----------------------------------------------------------------------------------------------------------

@query(f"""WITH {TRACKING} SELECT frame_id, id, {q4("x")} AS x, {q4("y")} AS y, {q4("CASE WHEN id = 'ball' THEN z ELSE 0 END")} AS z FROM t""")
def s9_unpivot(spark, sf_dir):
    """Wide provider rows of all 23 objects to a row per object; a missing z is 0."""
    t = tracking(spark, sf_dir)
    ids = [*(f"h{k:02}" for k in range(11)), *(f"a{k}" for k in range(11, 22)), BALL]
    pick = lambda i, c: F.max(F.when(F.col("id") == i, F.col(c))).alias(f"{i}_{c}")
    wide = t.groupBy("frame_id").agg(*(pick(i, c) for i in ids for c in "xy"), pick(BALL, "z"))
    return soccer.unpivot(wide, ["frame_id"]).select("frame_id", "id", *(r4(c).alias(c) for c in "xyz"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS key, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS name,
CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (round(s_acctbal, 2) + 0.0) END AS balance FROM supplier""")
def s1_csv_scan(spark, sf_dir):
    """CSV with several null tokens, lenient casts and a column renamed by season."""
    path = scratch(spark, "csv")
    null = lambda c, m, token: F.when(F.col("s_suppkey") % m == 0, token).otherwise(c.cast("string"))
    table(spark, sf_dir, "supplier").select("s_suppkey", null(F.col("s_name"), 7, "NA").alias("club"), null(F.round("s_acctbal", 2), 5, "NULL").alias("balance")).write.csv(path, header=True, quote='"', escape='"')
    d = football.renamed(football.scan(spark, path, {"s_suppkey": "bigint", "balance": "double"}), {"club": "name", "team": "name"})
    return d.select(F.col("s_suppkey").alias("key"), "name", (F.col("balance") + 0.0).alias("balance"))


@query("""SELECT event_id AS frame_id, 'g-' || CAST(user_id % 7 AS VARCHAR) AS game_id, CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END * (value - 250) * (105.0::DOUBLE / 500) + 0.0 AS x,
CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END * (CAST(event_id % 100 AS DOUBLE) - 50) * (68.0::DOUBLE / 100) + 0.0 AS y FROM events""")
def s6_centred(spark, sf_dir):
    """Provider coordinates as metres from the centre, sides changed in one period; ids made from columns."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), scalar.dashed(F.lit("g"), F.col("user_id") % 7).alias("game_id"), (1 + F.col("event_id") % 2).alias("period_id"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    d = soccer.centred(e, 250, 50, 500, 100, SOCCER, flip_periods=(2,))
    return d.select("frame_id", "game_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


@query("""WITH p AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(event_id % 5 ORDER BY event_id) AS kinds FROM events GROUP BY user_id)
SELECT user_id, len(ids) AS n, ids[1:3] IS NOT NULL AS has_slice, list_sum(ids[1:3])::BIGINT AS first_three, len(list_filter(kinds, lambda x: x <> 0)) AS nonzero, len(list_filter([0, 1, 2, 3, 4, 9], lambda x: NOT list_contains(kinds, x))) AS absent FROM p""")
def f26_arrays(spark, sf_dir):
    """Arrays in order, slices, nonzero elements and set differences."""
    e = table(spark, sf_dir, "events")
    p = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 5).alias("kind")))).alias("r"))
    ids, kinds = F.transform("r", lambda x: x["event_id"]), F.transform("r", lambda x: x["kind"])
    total = F.aggregate(F.slice(ids, 1, 3), F.lit(0).cast("long"), lambda a, x: a + x)
    allowed = F.array(*(F.lit(k).cast("long") for k in (0, 1, 2, 3, 4, 9)))
    n = lambda c: F.size(c).cast("long")
    return p.select("user_id", n(ids).alias("n"), F.slice(ids, 1, 3).isNotNull().alias("has_slice"), total.alias("first_three"), n(F.filter(kinds, lambda x: x != 0)).alias("nonzero"), n(F.array_except(allowed, kinds)).alias("absent"))


#: Frame numbers that a set of frames spans.
SET = 50_000


def xml_files(t: DataFrame, path: str) -> None:
    """``t`` as a positions XML, a set of frames per object, half and stretch of frames, and a match information XML.

    A set is no longer than a half of a real match, however many frames there are.
    """
    attribute = lambda name, value: F.concat(F.lit(f'{name}="'), value.cast("string"), F.lit('" '))
    ball = F.col("id") == BALL
    frame = F.concat(F.lit("<Frame "), attribute("N", F.col("frame_id")), attribute("X", F.col("x")), attribute("Y", F.col("y")), F.when(ball, F.concat(
        attribute("Z", F.col("z")), attribute("BallPossession", F.when(F.col("ball_owning_team_id") == "home", 1).otherwise(2)), attribute("BallStatus", F.lit(1)))).otherwise(F.lit("")), F.lit("/>"))
    sets = t.groupBy("period_id", "id", "team_id", F.expr(f"frame_id div {SET}")).agg(F.array_join(F.collect_list(frame), "").alias("frames"))
    head = F.concat(F.lit("<FrameSet "), attribute("GameSection", F.when(F.col("period_id") == 1, "firstHalf").otherwise("secondHalf")), attribute("MatchId", F.lit("m")), attribute("TeamId", F.when(F.col("id") == BALL, "BALL").otherwise(F.col("team_id"))), attribute("PersonId", F.col("id")), F.lit(">"))
    file = F.concat(F.lit("<PutDataRequest><Positions>"), head, "frames", F.lit("</FrameSet></Positions></PutDataRequest>"))
    sets.select(file).write.option("maxRecordsPerFile", 1).text(f"{path}/tracking")
    player = F.concat(F.lit("<Player "), attribute("PersonId", F.col("id")), F.when(F.col("position_name") == "GK", attribute("PlayingPosition", F.lit("TW"))).otherwise(F.lit("")), F.lit("/>"))
    teams = t.where(F.col("id") != BALL).select("team_id", "id", "position_name").distinct().groupBy("team_id").agg(F.array_join(F.collect_list(player), "").alias("p"))
    team = F.concat(F.lit("<Team "), attribute("TeamId", F.col("team_id")), F.lit("><Players>"), "p", F.lit("</Players></Team>"))
    m = teams.groupBy().agg(F.concat(F.lit('<MatchInformation><General MatchId="m" HomeTeamId="home" GuestTeamId="away"/><Teams>'), F.array_join(F.collect_list(team), ""), F.lit("</Teams></MatchInformation>")))
    m.coalesce(1).write.text(f"{path}/meta")


@query(f"""WITH {TRACKING}, p AS (SELECT *, min(frame_id) OVER (PARTITION BY period_id) AS f FROM t)
SELECT period_id, frame_id, id, CASE WHEN id = 'ball' THEN 'ball' ELSE team_id END AS team_id, CASE WHEN id = 'ball' THEN 'ball' WHEN position_name = 'GK' THEN 'GK' END AS position_name, (frame_id - f) * 40 AS t_ms, ball_owning_team_id, 'alive' AS ball_state,
  {q4("CASE WHEN ball_owning_team_id <> 'home' THEN -x ELSE x END")} AS x, {q4("CASE WHEN ball_owning_team_id <> 'home' THEN -y ELSE y END")} AS y, {q4("CASE WHEN id = 'ball' THEN z ELSE 0 END")} AS z FROM p""")
def s5_positions_xml(spark, sf_dir):
    """Provider files written, read with their roster and taken through the whole pipeline."""
    path = scratch(spark, "provider")
    xml_files(tracking(spark, sf_dir), path)
    d = soccer.load_feed(providers.sportec(spark, f"{path}/tracking", f"{path}/meta"), SOCCER)
    return d.select("period_id", "frame_id", "id", "team_id", "position_name", "t_ms", "ball_owning_team_id", "ball_state", *(r4(c).alias(c) for c in "xyz"))


@query(f"""WITH {TRACKING}, p AS (SELECT *, CASE WHEN period_id = 1 THEN 0 ELSE 2700000 END AS f FROM t)
SELECT frame_id, id, CAST(frame_id * 40 AS BIGINT) AS t_ms, ball_owning_team_id, {q4("x")} AS x, {q4("y")} AS y, {q4("CASE WHEN id = 'ball' THEN z ELSE 0 END")} AS z FROM p""")
def s5_structured_json(spark, sf_dir):
    """Frames as an array of JSON with trackable objects, and the match data that names them."""
    path, t = scratch(spark, "structured"), tracking(spark, sf_dir)
    number = F.when(F.col("id") == BALL, 55).otherwise(1000 + F.col("i"))
    ms = F.col("frame_id") * 40 + F.when(F.col("period_id") == 2, 2_700_000).otherwise(0)
    clock = F.format_string("%d:%02d:%02d.%02d", (ms / 3_600_000).cast("int"), ((ms % 3_600_000) / 60_000).cast("int"), ((ms % 60_000) / 1000).cast("int"), ((ms % 1000) / 10).cast("int"))
    group = F.struct(F.concat(F.first("ball_owning_team_id"), F.lit(" team")).alias("group"))
    data = F.collect_list(F.struct(number.alias("trackable_object"), "x", "y", F.when(F.col("id") == BALL, F.col("z")).alias("z")))
    f = t.groupBy(F.col("frame_id").alias("frame"), F.col("period_id").alias("period"), clock.alias("timestamp")).agg(group.alias("possession"), data.alias("data"))
    f.select(F.to_json(F.struct(*f.columns))).write.option("compression", "gzip").text(f"{path}/frames")
    people = [{"id": k, "trackable_object": 1000 + k, "team_id": 1 if k < 11 else 2, "player_role": {"acronym": "GK" if k in (0, 11) else "SUB"}} for k in range(22)]
    meta = {"id": 7, "home_team": {"id": 1}, "away_team": {"id": 2}, "ball": {"trackable_object": 55}, "players": people}
    spark.range(1).select(F.lit(json.dumps(meta))).write.text(f"{path}/match")
    rows, _, _ = providers.skillcorner(spark, f"{path}/frames", f"{path}/match", multi_line=False)
    k = F.col("id").try_cast("int")
    names = F.when(F.col("id") == BALL, F.lit(BALL)).otherwise(F.concat(F.when(k < 11, "h").otherwise("a"), F.lpad(k.cast("string"), 2, "0")))
    owner = F.when(F.col("ball_owning_team_id") == "1", "home").when(F.col("ball_owning_team_id") == "2", "away")
    return rows.select("frame_id", names.alias("id"), "t_ms", owner.alias("ball_owning_team_id"), *(r4(c).alias(c) for c in "xyz"))


PLAYER = "SELECT c_custkey AS k, CAST(5 + c_custkey % 2 AS VARCHAR) || '-' || CAST(c_custkey % 12 AS VARCHAR) AS height, CAST(150 + c_custkey % 200 AS VARCHAR) AS weight FROM customer"
FIELD = """f AS (SELECT CAST(o_orderkey AS BIGINT) AS gameid, CAST(o_custkey AS BIGINT) AS nflid, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS way,
  CAST(o_orderkey * 7 % 1200 AS DOUBLE) / 10 AS x, CAST(o_orderkey * 11 % 533 AS DOUBLE) / 10 AS y, CAST(o_orderkey * 13 % 3600 AS DOUBLE) / 10 AS o, CAST(o_orderkey * 17 % 3600 AS DOUBLE) / 10 AS dir FROM orders)"""
TENS = lambda e: f"(round(({e}) / 10) * 10)"


@query(f"""WITH {FIELD}, p AS (SELECT k, CAST(split_part(height, '-', 1) AS DOUBLE) * 30.48 + CAST(split_part(height, '-', 2) AS DOUBLE) * 2.54 AS cm,
  CAST(weight AS DOUBLE) * 0.453592 AS kg FROM ({PLAYER})),
a AS (SELECT *, (CASE WHEN way = 'left' THEN o + 180 ELSE o END) * {PI} / 180 + {PI} AS ro, (CASE WHEN way = 'left' THEN dir + 180 ELSE dir END) * {PI} / 180 + {PI} AS rd FROM f)
SELECT gameid AS game_id, nflid::DOUBLE AS id, {q4("CASE WHEN way = 'left' THEN -(x - 60) ELSE x - 60 END")} AS x, {q4("CASE WHEN way = 'left' THEN -(y - 26.65) ELSE y - 26.65 END")} AS y,
  {q4(f"ro - 2 * {PI} * floor(ro / (2 * {PI})) - {PI}")} AS o, {q4(f"rd - 2 * {PI} * floor(rd / (2 * {PI})) - {PI}")} AS dir,
  {TENS("cm")} AS height_cm, {TENS("kg")} AS weight_kg, CASE WHEN gameid % 3 = 0 THEN 'A' ELSE 'B' END AS ball_owning_team_id FROM a LEFT JOIN p ON p.k = a.nflid""")
def f_football_etl(spark, sf_dir):
    """Players and plays joined to the feed, field turned, angles wrapped, sizes in tens."""
    o = table(spark, sf_dir, "orders")
    part = lambda a, m: ((F.col("o_orderkey") * a) % m).cast("double") / 10
    raw = o.select(
        F.col("o_orderkey").cast("long").alias("gameId"), F.col("o_orderkey").cast("long").alias("playId"), F.lit(1).alias("frameId"), F.col("o_custkey").cast("double").alias("nflId"), F.lit("A").alias("club"),
        F.when(F.col("o_orderkey") % 2 == 0, "left").otherwise("right").alias("playDirection"), part(7, 1200).alias("x"), part(11, 533).alias("y"), part(13, 3600).alias("o"), part(17, 3600).alias("dir"), F.lit(0.0).alias("s"), F.lit(0.0).alias("a"),
    )
    k = F.col("c_custkey")
    players = table(spark, sf_dir, "customer").select(k.alias("nflId"), F.concat((5 + k % 2).cast("string"), F.lit("-"), (k % 12).cast("string")).alias("height"), (150 + k % 200).cast("string").alias("weight"), F.lit("QB").alias("officialPosition"))
    plays = raw.select("gameId", "playId", F.when(F.col("gameId") % 3 == 0, "A").otherwise("B").alias("possessionTeam"))
    d = football.tracking(raw, players, plays)
    return d.select("game_id", "id", *(r4(c).alias(c) for c in ("x", "y", "o", "dir")), "height_cm", "weight_kg", "ball_owning_team_id")


@query("""WITH p AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS s FROM orders)
SELECT k AS game_id, CAST((k % 15) * 60 + k % 60 AS INTEGER) AS clock_s, k % 2 = 0 AS own_half, CAST(k % 30 AS VARCHAR) || '-' || CAST(k % 20 AS VARCHAR) AS score FROM p WHERE s <> 'P'""")
def m13_play_context(spark, sf_dir):
    """Plays with some results dropped, clock, half and score."""
    k = F.col("o_orderkey").cast("long")
    o = table(spark, sf_dir, "orders").select(
        k.alias("gameId"), F.lit(1).alias("playId"), F.concat(F.lpad((k % 15).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")).alias("gameClock"), F.col("o_orderstatus").alias("passResult"),
        F.lit("A").alias("possessionTeam"), F.when(k % 2 == 0, "A").otherwise("B").alias("yardlineSide"), (k % 30).alias("preSnapHomeScore"), (k % 20).alias("preSnapVisitorScore"),
    )
    d = football.play_context(football.without_plays(o, o, ["P"]))
    return d.select(F.col("gameId").alias("game_id"), "clock_s", "own_half", "score")


# --- scalar functions -------------------------------------------------------------------------------------------------

ANGLE = "acos(greatest(-1.0, least(1.0, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE (p * r + q * s) / (na * nb) END)))"


@query(f"""WITH b AS (SELECT CAST(event_id AS BIGINT) AS k, CAST(event_id % 21 AS DOUBLE) - 10 AS p, CAST(event_id % 13 AS DOUBLE) - 6 AS q, CAST(event_id % 17 AS DOUBLE) - 8 AS r, CAST(event_id % 11 AS DOUBLE) - 5 AS s, event_id % 4 = 0 AS ball, value FROM events),
c AS (SELECT *, sqrt(p * p + q * q) AS na, sqrt(r * r + s * s) AS nb FROM b)
SELECT k, 'e-' || CAST(k AS VARCHAR) AS dashed, {q4("(p + 52.5) / 105")} AS between_, {q4("na / 125.1")} AS part, {q4(f"(atan2(q, p) + {PI}) / (2 * {PI})")} AS angle_part, {q4("(sin(p) + 1) / 2")} AS sincos,
  {q4("greatest(0.0, least(1.0, p / CASE WHEN ball THEN 28 ELSE 12 END))")} AS speed, {q4("greatest(-1.0, least(1.0, p / CASE WHEN ball THEN 13.5 ELSE 6 END))")} AS acceleration,
  {q4("greatest(0.0, least(1.0, p / CASE WHEN ball THEN 28 ELSE 12 END)) * sign(p)")} AS speed_difference,
  {q4("CASE WHEN na = 0 THEN 0 ELSE p / na END")} AS unit_x, {q4(ANGLE)} AS angle, {q4("CASE WHEN k % 9 = 0 THEN 0 ELSE value END")} AS zeroed FROM c""")
def f_scalars(spark, sf_dir):
    """Normalisers, unit vectors, angles, null and NaN filling."""
    k = F.col("event_id").cast("long")
    part = lambda m, off: (k % m).cast("double") - off
    d = table(spark, sf_dir, "events").select(k.alias("k"), part(21, 10).alias("p"), part(13, 6).alias("q"), part(17, 8).alias("r"), part(11, 5).alias("s"), (k % 4 == 0).alias("ball"), F.when(k % 18 == 0, float("nan")).when(k % 9 != 0, F.col("value")).alias("value"))
    p, q, r, s, ball = (F.col(c) for c in ("p", "q", "r", "s", "ball"))
    na = scalar.norm(p, q)
    return d.select(
        "k", scalar.dashed(F.lit("e"), F.col("k")).alias("dashed"), r4(scalar.between(p, -52.5, 52.5)).alias("between_"), r4(scalar.part_of(na, 125.1)).alias("part"), r4(scalar.angle_part(F.atan2(q, p))).alias("angle_part"),
        r4(scalar.sincos_part(F.sin(p))).alias("sincos"), r4(scalar.speed_part(p, ball, 12.0, 28.0)).alias("speed"), r4(scalar.acceleration_part(p, ball, 6.0, 13.5)).alias("acceleration"),
        r4(scalar.speed_difference_part(p, ball, 12.0, 28.0)).alias("speed_difference"), r4(scalar.unit(p, na)).alias("unit_x"), r4(scalar.angle_between(p, q, r, s)).alias("angle"), r4(scalar.zero_nan(F.col("value"))).alias("zeroed"),
    )


@query(f"""WITH b AS (SELECT CAST(event_id AS BIGINT) AS k, CAST(event_id % 12 AS DOUBLE) AS x, CAST(event_id % 9 AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) - 3 AS vx, CAST(event_id % 5 AS DOUBLE) - 2 AS vy FROM events),
u AS (SELECT *, sqrt(vx * vx + vy * vy) AS n FROM b), w AS (SELECT *, CASE WHEN n > 0 AND abs(vx / nullif(n, 0)) >= 1e-10 THEN (6 - x) / (vx / n) END AS t FROM u),
h AS (SELECT *, coalesce(t >= 0 AND y + t * (vy / nullif(n, 0)) BETWEEN 0 AND 7, false) AS hit FROM w)
SELECT k, hit, {q4("CASE WHEN hit THEN x + t * (vx / n) ELSE 0 END")} AS hit_x, {q4("CASE WHEN hit THEN y + t * (vy / n) ELSE 0 END")} AS hit_y,
  {q4("CASE WHEN hit THEN 2 * (y + t * (vy / n)) - y ELSE y END")} AS new_y, {q4("CASE WHEN hit THEN -vy ELSE vy END")} AS new_vy FROM h""")
def f27_ray_turn(spark, sf_dir):
    """Rays against a segment and half turns about the hits."""
    k = F.col("event_id").cast("long")
    d = table(spark, sf_dir, "events").select(k.alias("k"), (k % 12).cast("double").alias("x"), (k % 9).cast("double").alias("y"), ((k % 7).cast("double") - 3).alias("vx"), ((k % 5).cast("double") - 2).alias("vy"))
    hit, hx, hy = geometry.ray_hits(F.col("x"), F.col("y"), F.col("vx"), F.col("vy"), (6.0, 0.0), (6.0, 7.0))
    ny, nvy = geometry.half_turn(F.col("y"), F.col("vy"), hy, hit)
    return d.select("k", hit.alias("hit"), r4(hx).alias("hit_x"), r4(hy).alias("hit_y"), r4(ny).alias("new_y"), r4(nvy).alias("new_vy"))


# --- owner, direction, goalkeepers ------------------------------------------------------------------------------------

UNOWNED = f"""{TRACKING}, g AS (SELECT * REPLACE (CASE WHEN frame_id % 3 = 0 THEN NULL ELSE ball_owning_team_id END AS ball_owning_team_id) FROM t),
b AS (SELECT {KEYS}, x AS bx, y AS by_, z AS bz FROM t WHERE id = 'ball'),
d AS (SELECT g.*, sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_) + (z - bz) * (z - bz)) AS far FROM g JOIN b USING ({KEYS})),
o AS (SELECT {KEYS}, coalesce(min(ball_owning_team_id), arg_min(team_id, (far, id)) FILTER (id <> 'ball' AND far < 25)) AS own FROM d GROUP BY {KEYS}),
c AS (SELECT {KEYS}, own, arg_min(id, (far, id)) FILTER (id <> 'ball' AND far < 25 AND team_id = own) AS carrier FROM d JOIN o USING ({KEYS}) WHERE own IS NOT NULL GROUP BY {KEYS}, own)"""


def unowned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking(spark, sf_dir).withColumn("ball_owning_team_id", F.when(F.col("frame_id") % 3 != 0, F.col("ball_owning_team_id"))).drop("is_ball_carrier")


@query(f"WITH {UNOWNED} SELECT frame_id, id, own AS ball_owning_team_id, coalesce(id = carrier, false) AS is_ball_carrier FROM d JOIN c USING ({KEYS})")
def d4_owner_carrier(spark, sf_dir):
    """Owner given or nearest, carrier nearest of the owner's team."""
    return possession.with_owner(unowned(spark, sf_dir), SOCCER).select("frame_id", "id", "ball_owning_team_id", "is_ball_carrier")


@query(f"WITH {TRACKING} SELECT frame_id, id, {', '.join(q4(f'CASE WHEN ball_owning_team_id <> {chr(39)}home{chr(39)} THEN -{c} ELSE {c} END') + f' AS {c}' for c in ('x', 'y', 'vx', 'vy', 'ax', 'ay'))}, {q4('z')} AS z FROM t")
def d5_facing_right(spark, sf_dir):
    """Turn frames that the home team does not own."""
    return possession.facing_right(tracking(spark, sf_dir), SOCCER).select("frame_id", "id", *(r4(c).alias(c) for c in ("x", "y", "vx", "vy", "ax", "ay", "z")))


@query(f"""WITH {TRACKING}, k AS (SELECT {KEYS}, team_id, arg_min(id, (sqrt((x - g) * (x - g) + y * y), id)) AS keeper
FROM (SELECT *, CASE WHEN team_id = ball_owning_team_id THEN -52.5 ELSE 52.5 END AS g FROM t) GROUP BY {KEYS}, team_id)
SELECT frame_id, id, CASE WHEN id = 'ball' THEN 'ball' WHEN id = keeper THEN 'GK' END AS position_name FROM t JOIN k USING ({KEYS}, team_id)""")
def d6_goalkeepers(spark, sf_dir):
    """The player nearest to its own goal keeps it."""
    return possession.goalkeepers(tracking(spark, sf_dir), SOCCER).select("frame_id", "id", "position_name")


@query(f"WITH {TRACKING} SELECT frame_id, id, {q4('x')} AS x FROM t")
def d7_one_row(spark, sf_dir):
    """Repeated objects of a frame become one."""
    t = tracking(spark, sf_dir)
    late = t.withColumns({"t_ms": F.col("t_ms") + 1, "x": F.col("x") + 1})
    return possession.one_row_per_object(t.unionByName(late)).select("frame_id", "id", r4("x").alias("x"))


# --- frames -----------------------------------------------------------------------------------------------------------


@query(f"WITH {TRACKING} SELECT frame_id, count(*)::BIGINT AS n FROM t WHERE frame_id % 2 = 0 GROUP BY frame_id")
def p7_sample_frames(spark, sf_dir):
    """A rate of a half keeps every second frame. The sample is the operator itself."""
    return frames.sample_frames(tracking(spark, sf_dir), 0.5).groupBy("frame_id").agg(F.count("*").alias("n"))


@query(f"""WITH {TRACKING}, f AS (SELECT DISTINCT {KEYS} FROM t) SELECT {KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY period_id, frame_id) - 1 AS k FROM f) WHERE k % 2 = 0""")
def p8_sample_graphs(spark, sf_dir):
    """Every second graph of a game, by its place. The sample is the operator itself."""
    return frames.sample_graphs(tracking(spark, sf_dir).select(*FRAME).distinct(), 0.5)


@query(f"WITH {TRACKING} SELECT frame_id, id FROM t WHERE t_ms BETWEEN 4000 AND 20000 AND period_id = 1")
def p9_time_window(spark, sf_dir):
    """Rows of one period between two times."""
    return frames.time_window(tracking(spark, sf_dir), 4000, 20_000, 1).select("frame_id", "id")


@query("""SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_type FROM events""")
def p11_forward_fill(spark, sf_dir):
    """The last known value so far."""
    e = table(spark, sf_dir, "events").withColumn("last_type", F.when(F.col("event_id") % 4 == 0, F.col("event_type")))
    return frames.filled_forward(e, "last_type", ["user_id"], ["ts", "event_id"]).select("event_id", "last_type")


@query(f"""WITH {TRACKING} SELECT frame_id, id FROM (SELECT *, rank() OVER (PARTITION BY game_id, period_id, t_ms ORDER BY frame_id) AS r FROM t) WHERE r = 1""")
def p12_first_frame(spark, sf_dir):
    """Of the frames at one time, the first."""
    return frames.first_frame_at(tracking(spark, sf_dir, by=("game_id", "period_id", "t_ms"))).select("frame_id", "id")


@query(f"""WITH {TRACKING} SELECT game_id, arg_min(frame_id, (t_ms, frame_id)) AS frame_id, min(t_ms) AS t_ms FROM t WHERE period_id = 2 AND t_ms >= 1000 GROUP BY game_id""")
def l4_next_time(spark, sf_dir):
    """L4 and the nearest-timestamp lookup: the next frame of each game."""
    return frames.next_time(tracking(spark, sf_dir), 2, 1000)


HOLES = f"{TRACKING}, h AS (SELECT * FROM t WHERE NOT (id = 'ball' AND frame_id % 11 = 0) AND NOT (team_id = 'away' AND frame_id % 13 = 0) AND NOT (i > 7 AND i < 22 AND frame_id % 17 = 0))"


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, i = F.col("frame_id"), F.col("i")
    return tracking(spark, sf_dir).where(~((F.col("id") == BALL) & (f % 11 == 0)) & ~((F.col("team_id") == "away") & (f % 13 == 0)) & ~((i > 7) & (i < 22) & (f % 17 == 0)))


@query(f"WITH {HOLES} SELECT frame_id, id FROM h WHERE frame_id IN (SELECT frame_id FROM h GROUP BY frame_id HAVING count(DISTINCT team_id) = 3)")
def p13_whole_frames(spark, sf_dir):
    """Frames in which both teams and the ball are there."""
    return frames.whole_frames(holes(spark, sf_dir)).select("frame_id", "id")


@query(f"WITH {HOLES} SELECT frame_id, id FROM h WHERE frame_id IN (SELECT frame_id FROM h GROUP BY frame_id HAVING count(*) >= 10 AND count(*) FILTER (id = 'ball') > 0)")
def p14_football_frames(spark, sf_dir):
    """Frames with enough objects and the ball."""
    return frames.football_frames(holes(spark, sf_dir), FRAME, BALL).select("frame_id", "id")


@query(f"""WITH {HOLES} SELECT frame_id, id FROM h WHERE frame_id IN (SELECT frame_id FROM h GROUP BY frame_id
HAVING count(*) FILTER (id = 'ball') = 1 AND count(*) FILTER (team_id = ball_owning_team_id) = 11 AND count(*) FILTER (id <> 'ball' AND team_id <> ball_owning_team_id) = 11)""")
def a10_complete_frames(spark, sf_dir):
    """A10: one ball and eleven of each side."""
    return frames.complete_frames(holes(spark, sf_dir), SOCCER).select("frame_id", "id")


@query(f"""WITH {HOLES}, s AS (SELECT frame_id, any_value(ball_owning_team_id) AS own, count(*) FILTER (id = 'ball') AS b, count(*) FILTER (team_id = 'home') AS h, count(*) FILTER (team_id = 'away') AS a FROM h GROUP BY frame_id),
k AS (SELECT * FROM s WHERE (h > 0 OR own = 'home') AND (a > 0 OR own = 'away')), teams AS (SELECT frame_id, own, 'ball' AS team_id, b AS n, 1 AS want FROM k UNION ALL SELECT frame_id, own, 'home', h, 11 FROM k UNION ALL SELECT frame_id, own, 'away', a, 11 FROM k)
SELECT frame_id, team_id, want::BIGINT AS n, (want - n)::BIGINT AS added FROM teams""")
def g14_padding(spark, sf_dir):
    """Teams filled up with empty rows, then complete frames."""
    d = frames.padded(holes(spark, sf_dir), SOCCER)
    return d.groupBy(*FRAME, "team_id").agg(F.count("*").alias("n"), F.count_if(F.col("id") == "").alias("added")).drop("game_id", "period_id")


@query(f"WITH {TRACKING} SELECT DISTINCT game_id || '-' || CAST(period_id AS VARCHAR) || '-' || CAST(frame_id AS VARCHAR) AS graph_id FROM t")
def m9_graph_ids(spark, sf_dir):
    """Ids of frames, checked to be constant in each."""
    d = frames.constant_in_frame(frames.with_graph_ids(tracking(spark, sf_dir)), ["graph_id"])
    return d.select("graph_id").distinct()


@query(f"""WITH {TRACKING}, f AS (SELECT DISTINCT {KEYS}, ('0x' || substr(md5(game_id || '-' || CAST(period_id AS VARCHAR) || '-' || CAST(frame_id AS VARCHAR) || '-3'), 1, 8))::BIGINT % 2 AS label FROM t)
SELECT {KEYS}, label::INTEGER AS lo, label::INTEGER AS hi FROM f""")
def m8_dummy_labels(spark, sf_dir):
    """A 0 or 1 per frame from a hash of it."""
    return frames.with_dummy_labels(tracking(spark, sf_dir), seed=3).groupBy(*FRAME).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))


@query(f"""WITH {TRACKING} SELECT frame_id, id, row_number() OVER (PARTITION BY {KEYS} ORDER BY CASE WHEN id = 'ball' THEN 2 WHEN team_id = ball_owning_team_id THEN -1 ELSE 0 END, id) - 1 AS place FROM t""")
def l3_graph_order(spark, sf_dir):
    """Attackers, defenders, ball, then by id."""
    p = pairs.packed(tracking(spark, sf_dir), FRAME, frames.graph_order(SOCCER), ["id"])
    return p.select("frame_id", F.inline("objects")).select("frame_id", "id", F.col("row").cast("long").alias("place"))


# --- graphs -----------------------------------------------------------------------------------------------------------

BI, BJ, ATT, DEF = "a.id = 'ball'", "b.id = 'ball'", "a.team_id = a.ball_owning_team_id AND b.team_id = b.ball_owning_team_id", "a.team_id NOT IN (a.ball_owning_team_id, 'ball') AND b.team_id NOT IN (a.ball_owning_team_id, 'ball')"
KINDS = {"dense": "true", "dense_ap": ATT, "dense_dp": DEF, "split_by_team": "a.team_id = b.team_id"}
JOINS = {"ball": f"OR {BI} OR {BJ}", "ball_carrier": f"OR ({BI} AND b.is_ball_carrier) OR ({BJ} AND a.is_ball_carrier)", "no_connection": ""}


@query(f"WITH {TRACKING} SELECT a.frame_id, {', '.join(f'count(*) FILTER (({k}) {j}) AS {kn}_{jn}' for kn, k in KINDS.items() for jn, j in JOINS.items())} FROM t a JOIN t b USING ({KEYS}) GROUP BY a.frame_id")
def g1_adjacency(spark, sf_dir):
    """Edges per frame for each adjacency and ball connection."""
    p = pairs.pairs(tracking(spark, sf_dir), FRAME, frames.graph_order(SOCCER), ["id", "team_id", "ball_owning_team_id", "is_ball_carrier"])
    return p.groupBy("frame_id").agg(*(F.count_if(pairs.connected(k, j, BALL)).alias(f"{k}_{j}") for k in KINDS for j in JOINS))


@query(f"WITH {TRACKING}, c AS (SELECT a.frame_id, {', '.join(f'count(*) FILTER (({k}) {j}) AS {kn}__{jn}' for kn, k in KINDS.items() for jn, j in JOINS.items())} FROM t a JOIN t b USING ({KEYS}) GROUP BY a.frame_id), u AS (UNPIVOT c ON COLUMNS(* EXCLUDE frame_id) INTO NAME n VALUE edges) SELECT split_part(n, '__', 1) AS kind, split_part(n, '__', 2) AS connect, max(edges) AS edges FROM u GROUP BY n")
def g19_pad_sizes(spark, sf_dir):
    """The most edges that each adjacency and ball connection can have; full frames have as many."""
    return spark.createDataFrame([(k, j, pairs.most_edges(k, j)) for k in KINDS for j in JOINS], "kind string, connect string, edges long")


def sincos_sql(name: str, angle: str) -> list[tuple[str, str]]:
    return [(f"{name}_sin", f"(sin({angle}) + 1) / 2"), (f"{name}_cos", f"(cos({angle}) + 1) / 2")]


DIAGONAL = repr(SOCCER.diagonal)
NODES = [
    ("x_normed", "(x + 52.5) / 105"), ("y_normed", "(y + 34) / 68"), ("speed", "greatest(0, least(1, v / CASE WHEN id = 'ball' THEN 28 ELSE 12 END))"),
    *sincos_sql("velocity", f"(atan2(CASE WHEN n = 0 THEN 0 ELSE vy / n END, CASE WHEN n = 0 THEN 0 ELSE vx / n END) + {PI}) / (2 * {PI})"),
    ("goal_distance", f"sqrt((x - 52.5) * (x - 52.5) + y * y + z * z) / {DIAGONAL}"), ("ball_distance", f"sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_) + (z - bz) * (z - bz)) / {DIAGONAL}"),
    ("possession", "CASE WHEN team_id = ball_owning_team_id THEN 1 ELSE 0.1 END"), ("gk", "CASE WHEN position_name = 'GK' THEN 1 ELSE 0.1 END"), ("ball", "CASE WHEN id = 'ball' THEN 1 ELSE 0.1 END"),
    *sincos_sql("goal_angle", "atan2(-y, 52.5 - x)"), *sincos_sql("ball_angle", "atan2(by_ - y, bx - x)"), ("carrier", "CASE WHEN is_ball_carrier THEN 1 ELSE 0.1 END"),
]
WITH_BALL = f"{TRACKING}, b AS (SELECT {KEYS}, x AS bx, y AS by_, z AS bz FROM t WHERE id = 'ball'), w AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS n FROM t JOIN b USING ({KEYS}))"


@query(f"WITH {WITH_BALL} SELECT frame_id, id, {', '.join(f'{q4(f"CAST({e} AS DOUBLE)")} AS {c}' for c, e in NODES)}, {q4('CASE WHEN id = ' + chr(39) + 'ball' + chr(39) + ' THEN CAST(t_ms AS DOUBLE) ELSE 0 END')} AS global_t_ms FROM w")
def g8_soccer_nodes(spark, sf_dir):
    """The 15 node columns and a global one on the ball."""
    d = features.with_ball(tracking(spark, sf_dir), BALL)
    columns = features.soccer_nodes(SOCCER) | features.global_features(["t_ms"], "ball", BALL)
    return d.select("frame_id", "id", *(r4(c.cast("double")).alias(k) for k, c in columns.items()))


TURN = """acos(greatest(-1.0, least(1.0, CASE WHEN np = 0 OR nv = 0 THEN 0 ELSE (dx * dvx + dy * dvy) / (np * nv) END)))"""
EDGE_PAIRS = f"""{TRACKING}, p AS (SELECT a.frame_id, a.id AS i, a.id = 'ball' AS ball, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, b.vx - a.vx AS dvx, b.vy - a.vy AS dvy, b.v - a.v AS dv, b.a - a.a AS da, b.o - a.o AS do_, b.dir - a.dir AS dd
FROM t a JOIN t b USING ({KEYS}) WHERE a.team_id = b.team_id OR a.id = 'ball' OR b.id = 'ball'), e AS (SELECT *, sqrt(dx * dx + dy * dy) AS np, sqrt(dvx * dvx + dvy * dvy) AS nv FROM p)"""
SPEED = lambda v: f"greatest(0, least(1, {v} / CASE WHEN ball THEN 28 ELSE 12 END)) * sign({v})"
EDGES = [
    ("distance", f"sqrt(dx * dx + dy * dy + dz * dz) / {DIAGONAL}"), ("speed_difference", SPEED("dv")), ("position_cos", "(cos(atan2(dy, dx)) + 1) / 2"), ("position_sin", "(sin(atan2(dy, dx)) + 1) / 2"),
    ("velocity_cos", f"(cos({TURN}) + 1) / 2"), ("velocity_sin", f"(sin({TURN}) + 1) / 2"),
]


@query(f"WITH {EDGE_PAIRS} SELECT frame_id, i AS id, count(*) AS edges, {', '.join(f'{q4(f"sum({e})")} AS {c}' for c, e in EDGES)} FROM e GROUP BY frame_id, i")
def g9_soccer_edges(spark, sf_dir):
    """The 6 edge columns, summed over each node's edges."""
    config = graphs.GraphConfig()
    e, names = graphs.edge_table(tracking(spark, sf_dir), config, SOCCER)
    return e.groupBy("frame_id", F.col("i.id").alias("id")).agg(F.count("*").alias("edges"), *(r4(F.sum(n)).alias(n[2:]) for n in names))


YARDS = repr(GRID.diagonal)
GRID_NODES = [
    ("x_normed", "(x + 60) / 120"), ("y_normed", "(y + 26.65) / 53.3"), ("unit_s_x", "v * cos(dir) / ns"), ("unit_s_y", "v * sin(dir) / ns"), ("speed", "greatest(0, least(1, v / CASE WHEN id = 'ball' THEN 28 ELSE 12 END))"),
    ("unit_a_x", "a * cos(dir) / na"), ("unit_a_y", "a * sin(dir) / na"), ("acceleration", "greatest(-1, least(1, a / CASE WHEN id = 'ball' THEN 13.5 ELSE 6 END))"), *sincos_sql("dir", "dir"), *sincos_sql("o", "o"),
    ("goal_distance", f"sqrt((x - 60) * (x - 60) + y * y) / {YARDS}"), ("ball_distance", f"sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) / {YARDS}"), ("end_zone_distance", "(50 - x) / 120"),
    ("possession", "CASE WHEN team_id = ball_owning_team_id THEN 1 ELSE 0.1 END"), ("qb", "CASE WHEN team_id = ball_owning_team_id THEN 0.1 ELSE 0 END"), ("ball", "CASE WHEN id = 'ball' THEN 1 ELSE 0 END"),
    ("weight", "(weight_kg - 60) / 140"), ("height", "(height_cm - 150) / 75"),
]


@query(f"""WITH {TRACKING}, b AS (SELECT {KEYS}, x AS bx, y AS by_ FROM t WHERE id = 'ball'), w AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {KEYS})) AS ns, sqrt(sum(a * a) OVER (PARTITION BY {KEYS})) AS na FROM t JOIN b USING ({KEYS}))
SELECT frame_id, id, {', '.join(f'{q4(f"CAST({e} AS DOUBLE)")} AS {c}' for c, e in GRID_NODES)} FROM w""")
def g10_football_nodes(spark, sf_dir):
    """The 20 node columns of American football."""
    d = features.with_frame_units(features.with_ball(tracking(spark, sf_dir), BALL, axes="xy"), FRAME)
    return d.select("frame_id", "id", *(r4(c).alias(k) for k, c in features.football_nodes(GRID).items()))


GRID_EDGES = [
    ("distance", f"np / {YARDS}"), ("speed_difference", SPEED("dv")), ("acceleration_difference", "greatest(-1, least(1, da / CASE WHEN ball THEN 13.5 ELSE 6 END))"), ("position_cos", "(cos(atan2(dy, dx)) + 1) / 2"), ("position_sin", "(sin(atan2(dy, dx)) + 1) / 2"),
    ("dir_cos", "(cos(dd) + 1) / 2"), ("dir_sin", "(sin(dd) + 1) / 2"), ("o_cos", "(cos(do_) + 1) / 2"), ("o_sin", "(sin(do_) + 1) / 2"),
]


@query(f"WITH {EDGE_PAIRS} SELECT frame_id, i AS id, count(*) AS edges, {', '.join(f'{q4(f"sum({e})")} AS {c}' for c, e in GRID_EDGES)} FROM e GROUP BY frame_id, i")
def g11_football_edges(spark, sf_dir):
    """The 9 edge columns of American football, summed over each node's edges."""
    e, names = graphs.edge_table(tracking(spark, sf_dir), graphs.GraphConfig(), GRID)
    return e.groupBy("frame_id", F.col("i.id").alias("id")).agg(F.count("*").alias("edges"), *(r4(F.sum(n)).alias(n[2:]) for n in names))


ORDER = "CASE WHEN id = 'ball' THEN 2 WHEN team_id = ball_owning_team_id THEN -1 ELSE 0 END, id"
PLACED = f"s AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY {ORDER}) - 1 AS place FROM t)"


def weighed(columns: list[tuple[str, str]], row: str) -> str:
    """Sum of a matrix' values times their numbers in row-major order, so that a value in another place shows."""
    return " + ".join(f"({row} * {len(columns)} + {k + 1}) * CAST({e} AS DOUBLE)" for k, (_, e) in enumerate(columns))


def in_places(matrix: str) -> Column:
    """The same of an array of arrays."""
    flat = F.flatten(matrix)
    return r4(F.aggregate(F.transform(flat, lambda v, k: v * (k + 1) / 1000), F.lit(0.0), lambda a, v: a + v))


@query(f"""WITH {TRACKING}, {PLACED}, b AS (SELECT {KEYS}, x AS bx, y AS by_, z AS bz FROM t WHERE id = 'ball'), w AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS n FROM s JOIN b USING ({KEYS})),
x AS (SELECT frame_id, sum({weighed(NODES, "place")}) / 1000 AS nodes FROM w GROUP BY frame_id),
p AS (SELECT a.frame_id, a.id = 'ball' AS ball, row_number() OVER (PARTITION BY a.frame_id ORDER BY a.place, b.place) - 1 AS k, a.place * 23 + b.place AS cell, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, b.vx - a.vx AS dvx, b.vy - a.vy AS dvy, b.v - a.v AS dv
  FROM s a JOIN s b USING ({KEYS}) WHERE a.team_id = b.team_id OR a.id = 'ball' OR b.id = 'ball'), q AS (SELECT *, sqrt(dx * dx + dy * dy) AS np, sqrt(dvx * dvx + dvy * dvy) AS nv FROM p),
e AS (SELECT frame_id, count(*) AS n, sum(cell)::BIGINT AS cells, sum({weighed(EDGES, "k")}) / 1000 AS edges FROM q GROUP BY frame_id),
n AS (SELECT frame_id, any_value(game_id) || '-' || CAST(any_value(period_id) AS VARCHAR) || '-' || CAST(frame_id AS VARCHAR) AS graph_id, count(*) AS n, any_value(ball_owning_team_id) AS ball_owning_team_id, string_agg(id, ',' ORDER BY {ORDER}) AS ids FROM t GROUP BY frame_id)
SELECT frame_id, graph_id, n.n AS x_shape_0, 15::BIGINT AS x_shape_1, e.n AS e_shape_0, 6::BIGINT AS e_shape_1, e.n AS ones, cells, {q4("nodes")} AS nodes, {q4("edges")} AS edges, ids, ball_owning_team_id, NULL::BIGINT AS label FROM n JOIN e USING (frame_id) JOIN x USING (frame_id)""")
def g15_graphs(spark, sf_dir):
    """Graph rows with shapes, ids, the places of the ones, and all values of x and e by place."""
    g = graphs.build_graphs(frames.with_graph_ids(tracking(spark, sf_dir)), graphs.GraphConfig(prediction=True), SOCCER)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    ones = F.flatten("a")
    return g.select("frame_id", "graph_id", "x_shape_0", "x_shape_1", "e_shape_0", "e_shape_1", total(ones).alias("ones"), total(F.transform(ones, lambda v, k: v * k)).alias("cells"), in_places("x").alias("nodes"), in_places("e").alias("edges"), F.array_join("object_ids", ",").alias("ids"), "ball_owning_team_id", "label")


@query(f"WITH {TRACKING} SELECT 23::BIGINT AS most_nodes, 15::BIGINT AS node_features, 6::BIGINT AS edge_features, count(DISTINCT frame_id) AS graphs FROM t")
def m6_dimensions(spark, sf_dir):
    """Graphs written as Parquet, read again and measured."""
    path = scratch(spark, "graphs")
    graph_files.write_graphs(graphs.build_graphs(frames.with_graph_ids(tracking(spark, sf_dir)), graphs.GraphConfig(prediction=True), SOCCER), path)
    return graphs.dimensions(graph_files.read_graphs(spark, path))


@features.graph_feature("node", "numpy")
def twice_the_speed(**kw):
    return kw["v"] * 2


@features.graph_feature("edge", "numpy")
def gap(**kw):
    p = kw["position"]
    return ((p[:, None] - p[None]) ** 2).sum(-1) ** 0.5


@query(f"""WITH {EDGE_PAIRS}, s AS (SELECT frame_id, sum(sqrt(dx * dx + dy * dy + dz * dz)) AS g, sum({EDGES[0][1]}) AS d FROM e GROUP BY frame_id), n AS (SELECT frame_id, sum(2 * v) AS v FROM t GROUP BY frame_id)
SELECT frame_id, 16::BIGINT AS x_shape_1, 7::BIGINT AS e_shape_1, {q4("v")} AS speeds, {q4("d")} AS distances, {q4("g")} AS gaps FROM s JOIN n USING (frame_id)""")
def v_own_features(spark, sf_dir):
    """V1 V2 V3 V4 V5 V6: numpy features of one's own, called once per frame, after the built-in ones."""
    config = graphs.GraphConfig(prediction=True, node_functions=(twice_the_speed,), edge_functions=(gap,), builtin_edges=True)
    g = graphs.build_graphs(frames.with_graph_ids(tracking(spark, sf_dir)), config, SOCCER)
    total = lambda c, at: r4(F.aggregate(F.transform(c, lambda row: row[at]), F.lit(0.0), lambda a, x: a + x))
    return g.select("frame_id", "x_shape_1", "e_shape_1", total("x", 15).alias("speeds"), total("e", 0).alias("distances"), total("e", 6).alias("gaps"))


# --- pressing ---------------------------------------------------------------------------------------------------------

RUN = f"""r AS (SELECT a.frame_id, a.id AS row_id, b.id AS column_id, a.v AS rv, b.v AS cv, b.is_ball_carrier AS carries, a.team_id AS rt, b.team_id AS ct, a.ball_owning_team_id AS own,
  a.x + a.vx AS ex, a.y + a.vy AS ey, a.z + a.vz AS ez, b.x AS px, b.y AS py, b.z AS pz, b.vx AS vx, b.vy AS vy, b.vz AS vz FROM t a JOIN t b USING ({KEYS})),
q AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS sp, sqrt((ex - px) * (ex - px) + (ey - py) * (ey - py) + (ez - pz) * (ez - pz)) AS way, vx * (ex - px) + vy * (ey - py) + vz * (ez - pz) AS dot,
  sqrt((ex - px - vx * 0.7) * (ex - px - vx * 0.7) + (ey - py - vy * 0.7) * (ey - py - vy * 0.7) + (ez - pz - vz * 0.7) * (ez - pz - vz * 0.7)) AS far FROM r),
m AS (SELECT *, sp * acos(greatest(-1.0, least(1.0, dot / (sp * way + 1e-10)))) / {PI} + 0.7 + far / 12 AS tti FROM q)"""
PTI = f"1 / (1 + exp(greatest(-700.0, least(700.0, -{PI} / sqrt(3.0::DOUBLE) / 0.45 * (1.5 - tti)))))"


@query(f"""WITH {TRACKING}, {RUN}, k AS (SELECT * FROM m WHERE rt <> own AND rt <> 'ball' AND (ct = own OR ct = 'ball')),
x AS (SELECT frame_id, row_id, column_id, CASE WHEN carries THEN least(tti, min(CASE WHEN ct = 'ball' THEN tti END) OVER (PARTITION BY frame_id, row_id)) ELSE tti END AS tti, ct FROM k)
SELECT frame_id, row_id, count(*) AS cells, {q4("sum(tti)")} AS tti, {q4(f"sum({PTI})")} AS pti FROM x WHERE ct <> 'ball' GROUP BY frame_id, row_id""")
def x_pressing_teams(spark, sf_dir):
    """Defenders against the owning side, the better of carrier and ball; summed per row."""
    c = pressing.pressing_pairs(tracking(spark, sf_dir), SOCCER)
    return c.groupBy(*FRAME, "row_id").agg(F.count("*").alias("cells"), r4(F.sum("tti")).alias("tti"), r4(F.sum("pti")).alias("pti")).drop("game_id", "period_id")


@query(f"""WITH {TRACKING}, {RUN}, k AS (SELECT frame_id, own, row_id, column_id, CASE WHEN rv < 4 OR cv < 4 THEN 0 ELSE {PTI} END AS pti, CASE WHEN row_id = column_id THEN 0 ELSE tti END AS tti FROM m)
SELECT frame_id, CASE WHEN own = 'home' THEN column_id ELSE row_id END AS row_id, count(*) AS cells, {q4("sum(tti)")} AS tti, {q4("sum(pti)")} AS pti FROM k GROUP BY 1, 2""")
def x_pressing_full(spark, sf_dir):
    """All pairs with the ball, a speed threshold, home and away sides; summed per row."""
    c = pressing.pressing_pairs(tracking(spark, sf_dir), SOCCER, method="full", ball_method="include", speed_threshold=4.0, orient="home_away")
    return c.groupBy(*FRAME, "row_id").agg(F.count("*").alias("cells"), r4(F.sum("tti")).alias("tti"), r4(F.sum("pti")).alias("pti")).drop("game_id", "period_id")


@query(f"""WITH {TRACKING}, {RUN}, k AS (SELECT * FROM m WHERE rt <> own AND rt <> 'ball' AND (ct = own OR ct = 'ball')),
x AS (SELECT frame_id, row_id, column_id, CASE WHEN carries THEN least(tti, min(CASE WHEN ct = 'ball' THEN tti END) OVER (PARTITION BY frame_id, row_id)) ELSE tti END AS tti, ct FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY row_id, column_id) AS place FROM x WHERE ct <> 'ball')
SELECT frame_id, 11::INTEGER AS n_rows, 11::INTEGER AS n_columns, {q4("sum(tti * place) / 1000")} AS times, {q4(f"sum({PTI} * place) / 1000")} AS probabilities,
  string_agg(DISTINCT column_id, ',' ORDER BY column_id) AS columns, string_agg(DISTINCT row_id, ',' ORDER BY row_id) AS rows FROM p GROUP BY frame_id""")
def x7_pressing_matrices(spark, sf_dir):
    """One row per frame of matrices, all their values by place, and the ids of their rows and columns."""
    m = pressing.pressing_matrices(pressing.pressing_pairs(tracking(spark, sf_dir), SOCCER))
    return m.select("frame_id", F.size("time_to_intercept").alias("n_rows"), F.size(F.element_at("probability_to_intercept", 1)).alias("n_columns"), in_places("time_to_intercept").alias("times"), in_places("probability_to_intercept").alias("probabilities"), F.array_join("columns", ",").alias("columns"), F.array_join("rows", ",").alias("rows"))


# --- formations -------------------------------------------------------------------------------------------------------


@query(f"""WITH {TRACKING}, f AS (SELECT DISTINCT {KEYS}, ball_owning_team_id AS own FROM t), c AS (SELECT *, CASE WHEN own IS DISTINCT FROM lag(own) OVER w OR period_id IS DISTINCT FROM lag(period_id) OVER w THEN 1 ELSE 0 END AS ch FROM f WINDOW w AS (PARTITION BY game_id ORDER BY period_id, frame_id))
SELECT {KEYS}, CAST(sum(ch) OVER (PARTITION BY game_id ORDER BY period_id, frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS possession_id FROM c""")
def e8_possessions(spark, sf_dir):
    """Possession segments of frames."""
    d, name = formations.segment_ids(tracking(spark, sf_dir), "possession")
    return d.groupBy(*FRAME).agg(F.min(name).alias(name))


@query(f"""WITH {TRACKING}, s AS (SELECT *, (t_ms // 5000) * 5000 AS b FROM t) SELECT game_id, period_id, ball_owning_team_id, b AS "5s_id", id, {q4("avg(x)")} AS x, {q4("avg(y)")} AS y, arg_min(position_name, frame_id) AS position_name, count(DISTINCT frame_id) AS n_frames,
min(t_ms) AS start_t_ms, max(t_ms) AS end_t_ms, min(frame_id) AS start_frame_id, max(frame_id) AS end_frame_id FROM s GROUP BY game_id, period_id, ball_owning_team_id, b, id""")
def e12_segment_means(spark, sf_dir):
    """Time buckets and mean places."""
    d, name = formations.segment_ids(tracking(spark, sf_dir, by=("game_id", "period_id", F.expr("(t_ms div 5000) * 5000"))), "5s")
    return formations.segment_means(d, name).drop("team_id").withColumns({"x": r4("x"), "y": r4("y")})


@query(f"""WITH {TRACKING}, s AS (SELECT * REPLACE (CASE WHEN i = 5 AND frame_id % 3 = 0 THEN 'h99' ELSE id END AS id) FROM t), n AS (SELECT game_id, period_id, team_id, id, count(*) AS n, max(CASE WHEN position_name = 'GK' THEN 0 ELSE 1 END) AS o FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY game_id, period_id, team_id ORDER BY n DESC, id) AS r, sum(o) OVER (PARTITION BY game_id, period_id, team_id) AS outs FROM n)
SELECT game_id, period_id, team_id, id, n FROM k WHERE team_id = 'ball' OR outs <= 10 OR r <= 11""")
def e11_substitutes(spark, sf_dir):
    """Of twelve players of a team in a period, the eleven seen most."""
    t = tracking(spark, sf_dir)
    t = t.withColumn("id", F.when((F.col("i") == 5) & (F.col("frame_id") % 3 == 0), "h99").otherwise(F.col("id")))
    d = formations.without_substitutes(t, "period_id")
    return d.groupBy("game_id", "period_id", "team_id", "id").agg(F.count("*").alias("n"))


@query(f"""WITH {TRACKING} SELECT DISTINCT game_id, period_id, count(DISTINCT frame_id) AS n_frames, min(t_ms) AS start_t_ms, max(t_ms) AS end_t_ms, min(frame_id) AS start_frame_id, max(frame_id) AS end_frame_id FROM t GROUP BY game_id, period_id, ball_owning_team_id, id""")
def e13_segments(spark, sf_dir):
    """The segments table of a detection by period."""
    return formations.detect_formations(tracking(spark, sf_dir), SOCCER, every="period")[1]


@query()
def e_formations_per_frame(spark, sf_dir):
    """Formations per frame; optimal matching has no SQL."""
    return formations.detect_formations(tracking(spark, sf_dir), SOCCER)[0]


@query()
def e4_steady_formations(spark, sf_dir):
    """Formations by possession that change only when worth it."""
    return formations.detect_formations(tracking(spark, sf_dir), SOCCER, every="possession", change_threshold=0.1)[0]


# --- splits -----------------------------------------------------------------------------------------------------------

HASH = "((k % 1000003) * 7919 + 104729) % 999983"


@query(f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders), r AS (SELECT k, row_number() OVER (ORDER BY {HASH}, k) - 1 AS p, count(*) OVER () AS n FROM o)
SELECT k, CASE WHEN p < floor(0.7 * n) THEN 'train' WHEN p < floor(0.7 * n) + floor(0.2 * n) THEN 'test' ELSE 'validation' END AS split FROM r""")
def m2_split_rows(spark, sf_dir):
    """Rows dealt to train, test and validation by hashed order."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    return splits.split_rows(d, "k", 7, 2, 1).select("k", "split")


@query(f"""WITH o AS (SELECT CAST(o_custkey AS BIGINT) AS k FROM orders), g AS (SELECT k, count(*) AS c FROM o GROUP BY k), s AS (SELECT k, sum(c) OVER (ORDER BY {HASH}, k) - c AS b, (SELECT count(*) FROM o) AS n FROM g),
z AS (SELECT *, n - floor(0.6 * n) - floor(0.3 * n) AS v, floor(0.3 * n) AS t FROM s), e AS (SELECT min(b) AS v_end FROM z WHERE b >= v)
SELECT k, CASE WHEN b < v_end THEN 'validation' WHEN b < v_end + t THEN 'test' ELSE 'train' END AS split FROM z, e""")
def m3_split_groups(spark, sf_dir):
    """M3 M4: no group in two parts."""
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("k"))
    return splits.split_groups(d, "k", 6, 3, 1).distinct()


TEXT_HASH = lambda e: f"(('0x' || substr(md5('0:' || {e}), 1, 12))::BIGINT % 999983)"


@query(f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, 'g-' || CAST(o_custkey AS VARCHAR) AS g FROM orders), c AS (SELECT g, count(*) AS c FROM o GROUP BY g), s AS (SELECT g, sum(c) OVER (ORDER BY {TEXT_HASH("g")}, g) - c AS b, (SELECT count(*) FROM o) AS n FROM c),
z AS (SELECT *, n - floor(0.6 * n) - floor(0.3 * n) AS v, floor(0.3 * n) AS t FROM s), e AS (SELECT min(b) AS v_end FROM z WHERE b >= v)
SELECT k, CASE WHEN b < v_end THEN 'validation' WHEN b < v_end + t THEN 'test' ELSE 'train' END AS split FROM z, e, o WHERE o.g = z.g""")
def m3_split_text_groups(spark, sf_dir):
    """M3: groups that are named by text, as graph ids are."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), scalar.dashed(F.lit("g"), F.col("o_custkey")).alias("g"))
    return splits.split_groups(d, "g", 6, 3, 1).select("k", "split")


@query(f"""WITH {TRACKING}, g AS (SELECT DISTINCT frame_id FROM t), u AS (SELECT frame_id FROM g UNION ALL SELECT frame_id FROM g WHERE frame_id % 2 = 0),
r AS (SELECT frame_id, row_number() OVER (ORDER BY {HASH.replace("k", "frame_id")}, frame_id) - 1 AS p, count(*) OVER () AS n FROM u)
SELECT CASE WHEN p < floor(0.8 * n) THEN 'train' ELSE 'test' END AS part, count(*) AS graphs, sum(frame_id)::BIGINT AS frames FROM r GROUP BY 1""")
def u4_dataset(spark, sf_dir):
    """U4 M2 M6 M7: graph datasets added to each other and split."""
    t = tracking(spark, sf_dir)
    build = lambda d: datasets.graph_dataset(spark, graphs.build_graphs(frames.with_graph_ids(d), graphs.GraphConfig(prediction=True), SOCCER).select("x", "e", "a", "label", "graph_id", "frame_id"))
    both = build(t).add(build(t.where(F.col("frame_id") % 2 == 0)))
    parts = zip(("train", "test"), both.split(0.8, 0.2, by_graph_id=False), strict=True)
    train, test = (d.graphs.select(F.lit(name).alias("part"), "frame_id") for name, d in parts)
    return train.unionByName(test).groupBy("part").agg(F.count("*").alias("graphs"), F.sum("frame_id").alias("frames"))


@query(f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderkey % 6 AS INTEGER) AS q, CAST((o_orderkey % 15) AS INTEGER) AS m, CAST(o_orderkey % 60 AS INTEGER) AS s, CAST(o_orderkey % 30 AS INTEGER) AS hs, CAST(o_orderkey % 20 AS INTEGER) AS vs, CAST(o_orderkey % 25 AS DOUBLE) AS y, o_orderkey % 2 = 0 AS home FROM orders)
SELECT k AS game_id, home AS is_home, {q4("(CASE WHEN home THEN hs - vs ELSE vs - hs END) / 100.0")} AS diff, {q4("CASE WHEN home THEN 0.25 ELSE 0.75 END")} AS chance, {q4("m / (CASE WHEN q <= 4 THEN 15.0 ELSE 10.0 END)")} AS minute, {q4("s / 60.0")} AS second,
  {q4("CASE WHEN q <= 4 THEN (3600 - ((greatest(q, 1) - 1) * 900 + m * 60 + s)) / 3600.0 ELSE (600 - (m * 60 + s)) / 600.0 END")} AS game_left, {q4("(m * 60 + s) / (CASE WHEN q <= 4 THEN 900.0 ELSE 600.0 END)")} AS quarter_left, {q4("y / 50")} AS to_go,
  k % 3 = 0 AS is_pass, 'V ' || CAST(vs AS VARCHAR) || ' - H ' || CAST(hs AS VARCHAR) AS board FROM o""")
def m13_plays_features(spark, sf_dir):
    """Inputs and targets of a play: clock, score and field as shares."""
    k = F.col("o_orderkey").cast("long")
    part = lambda m: (k % m).cast("int")
    o = table(spark, sf_dir, "orders").select(
        k.alias("gameId"), F.lit(1).alias("playId"), F.when(k % 2 == 0, "H").otherwise("V").alias("possessionTeam"), part(6).alias("quarter"), part(4).alias("down"), part(25).cast("double").alias("yardsToGo"), part(50).cast("double").alias("yardlineNumber"),
        F.concat(F.lpad(part(15).cast("string"), 2, "0"), F.lit(":"), F.lpad(part(60).cast("string"), 2, "0")).alias("gameClock"), part(30).alias("preSnapHomeScore"), part(20).alias("preSnapVisitorScore"), F.lit(0.25).alias("preSnapHomeTeamWinProbability"),
        F.when(k % 3 == 0, "C").alias("passResult"), F.lit(5.0).alias("prePenaltyYardsGained"), F.lit(5.0).alias("yardsGained"),
    )
    d, _ = football.plays_features(o, o.select("gameId", F.lit("H").alias("homeTeamAbbr"), F.lit("V").alias("visitorTeamAbbr")))
    shares = {"diff": "preSnapScoreDiff", "chance": "preSnapTeamWinProbability", "minute": "quarterMinute", "second": "quarterSecond", "game_left": "gameSecondsLeft", "quarter_left": "quarterSecondsLeft", "to_go": "yardsToGo"}
    return d.select(F.col("gameId").alias("game_id"), F.col("isHome").alias("is_home"), *(r4(c).alias(n) for n, c in shares.items()), F.col("isPass").alias("is_pass"), F.col("scoreBoard").alias("board"))


@query(f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS label FROM orders), n AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM o),
r AS (SELECT o.*, row_number() OVER (PARTITION BY label ORDER BY {HASH}, k) - 1 AS p FROM o)
SELECT label, count(*) AS n, min(k) AS first_key, sum(k)::BIGINT AS keys FROM r, n WHERE p < CASE WHEN label = 1 THEN least(n1, floor(n0 * 0.4 / 0.6)) ELSE least(n0, floor(n1 * 0.6 / 0.4)) END GROUP BY label""")
def m5_balance(spark, sf_dir):
    """One label undersampled to a ratio. Leaving rows out is the operator itself."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("label"))
    return splits.balanced(d, "label", "k", 0.4).groupBy("label").agg(F.count("*").alias("n"), F.min("k").alias("first_key"), F.sum("k").alias("keys"))


# --- streaming --------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM events GROUP BY 1, 2")
def st_tumbling(spark, sf_dir):
    """Tumbling windows with a watermark, as a batch."""
    d = stream.windowed(table(spark, sf_dir, "events"), "1 hour", by=["event_type"])
    return d.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", (F.round("total", 2) + 0.0).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, g""")
def st_sessions(spark, sf_dir):
    """Sessions of a user, which end after two hours without an event."""
    d = stream.sessions(table(spark, sf_dir, "events"), "2 hours", ["user_id"])
    return d.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query(f"WITH {MOVED} SELECT id, frame_id, {q4('vx')} AS vx, {q4('vy')} AS vy FROM v1")
def st_velocities(spark, sf_dir):
    """Velocity with state over a stream of the events' files, run until all is processed."""
    base = scratch(spark, "stream")
    feed(spark, sf_dir).write.parquet(f"{base}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    stream.run_once(stream.velocities(source.select("game_id", "id", "period_id", "frame_id", "t_ms", "x", "y")), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("id", "frame_id", r4("vx").alias("vx"), r4("vy").alias("vy"))
