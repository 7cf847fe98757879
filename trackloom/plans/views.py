"""Deterministic tracking tables made from the driver's tables by integer arithmetic, in Spark and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.schema import FRAME
from trackloom.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feed: a user is an object, every tenth the ball; its value and number are a place."""
    return table(spark, sf_dir, "events").select(
        F.lit("g1").alias("game_id"), F.lit(1).alias("period_id"), F.col("event_id").alias("frame_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"),
        F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 10 == 0, "ball").otherwise("T").alias("team_id"),
        F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.lit(0.0).alias("z"),
    )


FEED = """feed AS (SELECT event_id AS frame_id, epoch_us(ts) // 1000 AS t_ms, CAST(user_id AS VARCHAR) AS id, user_id % 10 = 0 AS ball,
  value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events)"""

#: Objects of a frame: 11 of each team and the ball.
N = 23


def tenths(k: str, a: int, b: int, m: int, off: float) -> str:
    return f"CAST(({k} * {a} + i * {b}) % {m} AS DOUBLE) / CAST(10 AS DOUBLE) - CAST({off} AS DOUBLE)"


COLUMNS = {
    "game_id": "concat('g', CAST(k % 5 AS STRING))",
    "period_id": "CAST(1 + k % 2 AS INT)",
    "frame_id": "k",
    "t_ms": "(k div 2) * 40",
    "id": "CASE WHEN i = 22 THEN 'ball' ELSE concat(CASE WHEN i < 11 THEN 'h' ELSE 'a' END, lpad(CAST(i AS STRING), 2, '0')) END",
    "team_id": "CASE WHEN i = 22 THEN 'ball' WHEN i < 11 THEN 'home' ELSE 'away' END",
    "position_name": "CASE WHEN i = 22 THEN 'ball' WHEN i IN (0, 11) THEN 'GK' ELSE concat('P', CAST(i % 11 AS STRING)) END",
    "x": tenths("k", 37, 191, 1050, 52.5),
    "y": tenths("k", 53, 87, 680, 34),
    "z": "CASE WHEN i = 22 THEN CAST(k * 7 % 30 AS DOUBLE) / CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "vx": tenths("k", 11, 29, 163, 8),
    "vy": tenths("k", 17, 13, 127, 6),
    "vz": "CAST(0 AS DOUBLE)",
    "ax": tenths("k", 5, 7, 41, 2),
    "ay": tenths("k", 3, 11, 37, 2),
    "ball_owning_team_id": "CASE WHEN k % 2 = 0 THEN 'home' ELSE 'away' END",
    "is_ball_carrier": "i = CASE WHEN k % 2 = 0 THEN k % 11 ELSE 11 + k % 11 END",
    "o": "CAST((k * 31 + i * 47) % 628 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(3.14 AS DOUBLE)",
    "dir": "CAST((k * 23 + i * 59) % 628 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(3.14 AS DOUBLE)",
    "height_cm": "CAST(160 + (i * 10) % 60 AS DOUBLE)",
    "weight_kg": "CAST(70 + (i * 10) % 120 AS DOUBLE)",
}
DERIVED = {"v": "sqrt(vx * vx + vy * vy + vz * vz)", "a": "sqrt(ax * ax + ay * ay)"}


#: Frames that one task makes and works on.
FRAMES_A_TASK = 4_000


def tracking(spark: SparkSession, sf_dir: str, by: tuple[str | Column, ...] = tuple(FRAME)) -> DataFrame:
    """Customers as frames of 23 objects. Sides own the ball in turn; 5 games, 2 periods.

    Frames are dealt out by ``by``, columns of a whole frame, before they become rows: what is grouped by these columns
    is in one task and not shuffled, and there are as many tasks as frames need, however few files hold them.
    """
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-d.count() // FRAMES_A_TASK))
    whole = [c for c, e in COLUMNS.items() if not re.search(r"\bi\b", e)]
    d = d.select("k", *(F.expr(COLUMNS[c]).alias(c) for c in whole)).repartition(tasks, *by)
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    return d.select("i", *(c if c in whole else F.expr(e).alias(c) for c, e in COLUMNS.items())).withColumns({c: F.expr(e) for c, e in DERIVED.items()})


def for_duckdb(e: str) -> str:
    return e.replace("AS STRING", "AS VARCHAR").replace(" div ", " // ")


TRACKING = (
    "base AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(i AS BIGINT) AS i FROM customer, range(23) t(i)), "
    f"t0 AS (SELECT i, {', '.join(f'{for_duckdb(e)} AS {c}' for c, e in COLUMNS.items())} FROM base), "
    f"t AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in DERIVED.items())} FROM t0)"
)
