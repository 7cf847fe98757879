"""All ordered pairs of the objects of a frame, from one shuffle: a frame's rows are packed once and exploded twice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENSE, DENSE_AP, DENSE_DP, SPLIT_BY_TEAM, DELAUNAY = "dense", "dense_ap", "dense_dp", "split_by_team", "delaunay"
TO_BALL, TO_CARRIER, NO_CONNECTION = "ball", "ball_carrier", "no_connection"


def packed(df: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """(by..., objects): a frame's rows as an array of structs in order, each with its ``row`` from 0."""
    objects = F.array_sort(F.collect_list(F.struct(order.alias("_o"), *columns)))
    plain = F.transform(objects, lambda x, i: F.struct(i.cast("int").alias("row"), *(x[c].alias(c) for c in columns)))
    return df.groupBy(*by).agg(plain.alias("objects"))


def pairs(df: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """(by..., i, j): structs of the row and the column object of each cell of a frame's matrix."""
    p = packed(df, by, order, columns)
    return p.select(*by, "objects", F.explode("objects").alias("i")).select(*by, "i", F.explode("objects").alias("j"))


def connected(kind: str, connect: str, ball_id: str, carrier: bool = True, i: Column | None = None, j: Column | None = None) -> Column:
    """Whether cell (i, j) of the adjacency matrix is 1.

    i and j are structs with team_id, ball_owning_team_id and is_ball_carrier; by default the columns of that name.
    """
    i, j = (F.col("i") if i is None else i), (F.col("j") if j is None else j)
    ti, tj, own = i["team_id"], j["team_id"], i["ball_owning_team_id"]
    bi, bj = ti == ball_id, tj == ball_id
    if kind == DENSE:
        a = F.lit(True)
    elif kind == DENSE_AP:
        a = (ti == own) & (tj == own)
    elif kind == DENSE_DP:
        a = (ti != own) & ~bi & (tj != own) & ~bj
    elif kind == SPLIT_BY_TEAM:
        a = ti == tj
    elif kind == DELAUNAY:
        raise NotImplementedError("delaunay adjacency")
    else:
        raise ValueError(f"no adjacency {kind!r}")
    if connect == TO_BALL:
        return a | bi | bj
    if connect == TO_CARRIER:
        if not carrier:
            raise NotImplementedError("ball_carrier connection needs a carrier column")
        return a | (bi & j["is_ball_carrier"]) | (bj & i["is_ball_carrier"])
    if connect == NO_CONNECTION:
        return a
    raise ValueError(f"no connection {connect!r}")


def connected_in_numpy(kind: str, connect: str, team: np.ndarray, own: np.ndarray, ball: int, carries: np.ndarray) -> np.ndarray:
    """``connected`` of whole frames (frames, n): codes of teams and owners, below 0 for null, and who carries the ball."""
    ti, tj, own = team[:, :, None], team[:, None, :], own[:, :, None]
    same = lambda a, b: (a == b) & (a >= 0)
    other = lambda a, b: (a != b) & (a >= 0) & (b >= 0)
    bi, bj = same(ti, ball), same(tj, ball)
    if kind == DENSE:
        a = np.ones((len(team), team.shape[1], team.shape[1]), bool)
    elif kind == DENSE_AP:
        a = same(ti, own) & same(tj, own)
    elif kind == DENSE_DP:
        a = other(ti, own) & ~bi & other(tj, own) & ~bj
    else:
        a = same(ti, tj)
    if connect == TO_BALL:
        return a | bi | bj
    if connect == TO_CARRIER:
        return a | (bi & carries[:, None, :]) | (bj & carries[:, :, None])
    return a


def most_edges(kind: str, connect: str, players: int = 11) -> int:
    """Edges of a full frame of two teams and the ball, for padding."""
    n = 2 * players + 1
    base = {DENSE: n * n, DENSE_AP: players * players, DENSE_DP: players * players, SPLIT_BY_TEAM: 2 * players * players + 1}[kind]
    if kind == DENSE or connect == NO_CONNECTION:
        return base
    extra = 4 * players if connect == TO_BALL else 2
    return base + extra + (connect == TO_BALL and kind != SPLIT_BY_TEAM)
