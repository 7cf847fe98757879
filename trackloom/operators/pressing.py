"""Pressing intensity: time and probability for one object to intercept another, for the pairs of each frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import clipped, norm
from trackloom.operators import frames
from trackloom.operators.pairs import packed
from trackloom.schema import FRAME, Settings

METHODS, BALL_METHODS, ORIENTS = ("teams", "full"), ("include", "exclude", "max"), ("ball_owning", "pressing", "home_away", "away_home")


def time_to_intercept(runner: str, target: str, reaction: float, speed: float) -> Column:
    """Seconds for ``runner`` to reach where ``target`` will be in a second: turning, reacting, then running.

    Both are structs with x y z vx vy vz.
    """
    r, t = (lambda c: F.col(f"{runner}.{c}")), (lambda c: F.col(f"{target}.{c}"))
    end = {c: t(c) + t(f"v{c}") for c in "xyz"}
    way = [end[c] - r(c) for c in "xyz"]
    own = norm(r("vx"), r("vy"), r("vz"))
    dot = r("vx") * way[0] + r("vy") * way[1] + r("vz") * way[2]
    turn = F.acos(clipped(dot / (own * norm(*way) + 1e-10), -1.0, 1.0))
    rest = norm(*(end[c] - (r(c) + r(f"v{c}") * reaction) for c in "xyz"))
    return own * turn / math.pi + reaction + rest / speed


def probability_to_intercept(t: Column, threshold: float, sigma: float) -> Column:
    return 1.0 / (1.0 + F.exp(clipped(-math.pi / math.sqrt(3.0) / sigma * (threshold - t), -700.0, 700.0)))


def pressing_pairs(
    df: DataFrame,
    settings: Settings = Settings(),
    start_ms: int | None = None,
    end_ms: int | None = None,
    period_id: int | None = None,
    speed_threshold: float | None = None,
    reaction_time: float = 0.7,
    time_threshold: float = 1.5,
    sigma: float = 0.45,
    method: str = "teams",
    ball_method: str = "max",
    orient: str = "ball_owning",
) -> DataFrame:
    """A row per cell of each frame's matrix: row_id, column_id, tti, pti and their places (row_no, column_no).

    Columns are the owning side (the runners), rows the others; ``full`` pairs all with all. Ball ``max`` gives the
    carrier's column the smaller time of carrier and ball and drops the ball; frames without a carrier or a ball are
    then skipped. A speed threshold of 0 is none. ``orient`` exchanges rows and columns: always for ``pressing``, in
    frames of a home owner for ``home_away``, of another owner for ``away_home``.
    """
    if method not in METHODS or ball_method not in BALL_METHODS or orient not in ORIENTS:
        raise ValueError("method, ball_method or orient is not known")
    d = frames.time_window(df, start_ms, end_ms, period_id)
    ball = F.col("team_id") == settings.ball_id
    if ball_method == "exclude":
        d = d.where(~ball)
    owner = (F.col("team_id") == F.col("ball_owning_team_id")) | ball
    order = F.struct(F.when(owner, F.when(ball, 1).otherwise(0)).otherwise(2).alias("k"), F.col("id").alias("id"))
    columns = ["id", "team_id", "ball_owning_team_id", "is_ball_carrier", "x", "y", "z", "vx", "vy", "vz", "v"]
    p = packed(d, FRAME, order, columns)
    is_ball = lambda o: o["team_id"] == settings.ball_id
    own = lambda o: (o["team_id"] == o["ball_owning_team_id"]) | is_ball(o)
    # j runs towards i; both are chosen, and the ball put apart, while a frame is one row, so that pairs need no window
    i, j = F.col("objects"), F.col("objects")
    if method == "teams":
        i, j = F.filter(i, lambda o: ~own(o)), F.filter(j, own)
    if ball_method == "max":
        p = p.where((F.size(F.filter("objects", is_ball)) == 1) & F.exists("objects", lambda o: o["is_ball_carrier"]))
        carriers = F.filter(j, lambda o: o["is_ball_carrier"])
        p = p.withColumns({"_ball": F.filter("objects", is_ball)[0], "_c": F.array_min(F.transform(carriers, lambda o: o["row"]))})
        i, j = (F.filter(x, lambda o: ~is_ball(o)) for x in (i, j))
        p = p.select(*FRAME, "_ball", "_c", j.alias("js"), F.explode(i).alias("i"))
        p = p.withColumn("_t", time_to_intercept("_ball", "i", reaction_time, settings.max_player_speed)).select(*FRAME, "_t", "_c", "i", F.explode("js").alias("j"))
    else:
        p = p.select(*FRAME, j.alias("js"), F.explode(i).alias("i")).select(*FRAME, "i", F.explode("js").alias("j"))
    p = p.withColumn("tti", time_to_intercept("j", "i", reaction_time, settings.max_player_speed))
    if ball_method == "max":
        p = p.withColumn("tti", F.when(F.col("j.row") == F.col("_c"), F.least("tti", "_t")).otherwise(F.col("tti"))).drop("_t", "_c")
    p = p.withColumn("pti", probability_to_intercept(F.col("tti"), time_threshold, sigma))
    if method == "full":
        p = p.withColumn("tti", F.when(F.col("i.row") == F.col("j.row"), 0.0).otherwise(F.col("tti")))
    if speed_threshold:
        p = p.withColumn("pti", F.when((F.col("i.v") < speed_threshold) | (F.col("j.v") < speed_threshold), 0.0).otherwise(F.col("pti")))
    home = F.col("i.ball_owning_team_id") == settings.home_team_id
    swap = {"ball_owning": F.lit(False), "pressing": F.lit(True), "home_away": home, "away_home": ~home}[orient]
    side = lambda f, a, b: F.when(swap, F.col(f"{b}.{f}")).otherwise(F.col(f"{a}.{f}"))
    return p.select(*FRAME, side("id", "i", "j").alias("row_id"), side("id", "j", "i").alias("column_id"), side("row", "i", "j").alias("row_no"), side("row", "j", "i").alias("column_no"), "tti", "pti")


def pressing_matrices(cells: DataFrame) -> DataFrame:
    """Packs ``pressing_pairs`` into one row per frame: two matrices and the ids of their rows and columns."""
    row = F.array_sort(F.collect_list(F.struct("column_no", "column_id", "tti", "pti")))
    rows = cells.groupBy(*FRAME, "row_no", "row_id").agg(row.alias("cells"))
    m = rows.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("row_no", "row_id", "cells"))).alias("m"))
    part = lambda f: F.transform("m", lambda r: F.transform(r["cells"], lambda c: c[f]))
    return m.select(
        *FRAME,
        part("tti").alias("time_to_intercept"),
        part("pti").alias("probability_to_intercept"),
        F.transform(F.element_at("m", 1)["cells"], lambda c: c["column_id"]).alias("columns"),
        F.transform("m", lambda r: r["row_id"]).alias("rows"),
    )
