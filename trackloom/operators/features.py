"""Node and edge features as column expressions, and the registry for features of one's own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import scalar as S
from trackloom.schema import FRAME, FootballSettings, Settings


def graph_feature(kind: str, style: str = "columns") -> Callable:
    """Mark a function as a feature: kind ``node`` or ``edge``.

    Style ``columns`` takes settings and returns {name: Column}; style ``numpy`` takes the frame's arrays by keyword and
    returns (N,) or (N, k) for nodes, (N, N) or a tuple of such for edges.
    """
    if kind not in ("node", "edge") or style not in ("columns", "numpy"):
        raise ValueError("a feature is a node or an edge feature of style columns or numpy")

    def mark(f: Callable) -> Callable:
        f.feature_kind, f.feature_style = kind, style
        return f

    return mark


def checked(functions: list[Callable], kind: str) -> list[Callable]:
    for f in functions:
        if getattr(f, "feature_kind", None) != kind:
            raise TypeError(f"{f.__name__} is not marked as a {kind} feature")
    return functions


def with_ball(df: DataFrame, ball_id: str, by: list[str] = FRAME, axes: str = "xyz") -> DataFrame:
    """Add ball_x, ball_y (and ball_z) of the row's frame."""
    w = Window.partitionBy(*by)
    return df.withColumns({f"ball_{c}": F.max(F.when(F.col("team_id") == ball_id, F.col(c))).over(w) for c in axes})


def sincos(name: str, angle: Column) -> dict[str, Column]:
    return {f"{name}_sin": S.sincos_part(F.sin(angle)), f"{name}_cos": S.sincos_part(F.cos(angle))}


@graph_feature("node")
def soccer_nodes(s: Settings) -> dict[str, Column]:
    """The 15 default node columns, of rows that ``with_ball`` has widened."""
    ball = F.col("team_id") == s.ball_id
    size = S.norm(F.col("vx"), F.col("vy"), F.col("vz"))
    heading = S.angle_part(F.atan2(S.unit(F.col("vy"), size), S.unit(F.col("vx"), size)))
    to_goal = F.atan2(-F.col("y"), s.x_max - F.col("x"))
    to_ball = F.atan2(F.col("ball_y") - F.col("y"), F.col("ball_x") - F.col("x"))
    either = lambda c, other: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(other)
    out = {
        "x_normed": S.between(F.col("x"), -s.x_max, s.x_max),
        "y_normed": S.between(F.col("y"), -s.y_max, s.y_max),
        "speed": S.speed_part(F.col("v"), ball, s.max_player_speed, s.max_ball_speed),
        **sincos("velocity", heading),
        "goal_distance": S.part_of(S.norm(F.col("x") - s.x_max, F.col("y"), F.col("z")), s.diagonal),
        "ball_distance": S.part_of(S.norm(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y"), F.col("z") - F.col("ball_z")), s.diagonal),
        "possession": either(F.col("team_id") == F.col("ball_owning_team_id"), s.defending_team_node_value),
        "gk": either(F.col("position_name") == "GK", 0.1),
        "ball": either(ball, 0.1),
        **sincos("goal_angle", to_goal),
        **sincos("ball_angle", to_ball),
        "carrier": either(F.col("is_ball_carrier"), 0.1),
    }
    return {k: S.zero_nan(v) for k, v in out.items()}


def with_differences(cells: DataFrame, s: Settings) -> DataFrame:
    """Add what edge features share to rows (i, j) from ``pairs``.

    A projection of its own: all features in one would compile to a method too long for the JIT.
    """
    i, j = (lambda c: F.col(f"i.{c}")), (lambda c: F.col(f"j.{c}"))
    football = isinstance(s, FootballSettings)
    d = cells.withColumns({"i_ball": i("team_id") == s.ball_id, **{f"p_{c}": i(c) - j(c) for c in ("xy" if football else "xyz")}, "d_v": S.zero_nan(j("v") - i("v"))})
    if football:
        d = d.withColumns({"d_a": S.zero_nan(j("a") - i("a")), "d_dir": j("dir") - i("dir"), "d_o": j("o") - i("o"), "gap": S.norm(F.col("p_x"), F.col("p_y"))})
    else:
        d = d.withColumns({"gap": S.norm(F.col("p_x"), F.col("p_y"), F.col("p_z")), "turn": S.angle_between(F.col("p_x"), F.col("p_y"), j("vx") - i("vx"), j("vy") - i("vy"))})
    return d.withColumn("place", S.zero_nan(F.atan2("p_y", "p_x")))


@graph_feature("edge")
def soccer_edges(s: Settings) -> dict[str, Column]:
    """The 6 default edge columns, of rows that ``with_differences`` has widened.

    ``turn`` is between the line from j to i and the difference of the velocities of j and i.
    """
    part = lambda c: S.sincos_part(S.zero_nan(c))
    return {
        "distance": S.part_of(S.zero_nan(F.col("gap")), s.diagonal),
        "speed_difference": S.speed_difference_part(F.col("d_v"), F.col("i_ball"), s.max_player_speed, s.max_ball_speed),
        "position_cos": part(F.cos("place")),
        "position_sin": part(F.sin("place")),
        "velocity_cos": part(F.cos("turn")),
        "velocity_sin": part(F.sin("turn")),
    }


def with_frame_units(df: DataFrame, by: list[str]) -> DataFrame:
    """Add unit_s_x, unit_s_y, unit_a_x, unit_a_y: along ``dir``, divided by the norm over the whole frame."""
    w = Window.partitionBy(*by)
    for c in "sa":
        size, angle = S.zero_nan(F.col("v" if c == "s" else "a")), S.zero_nan(F.col("dir"))
        total = F.sqrt(F.sum(size * size).over(w))
        df = df.withColumns({f"unit_{c}_x": S.unit(size * F.cos(angle), total), f"unit_{c}_y": S.unit(size * F.sin(angle), total)})
    return df


@graph_feature("node")
def football_nodes(s: FootballSettings) -> dict[str, Column]:
    """The 20 node columns, of rows that ``with_ball`` and ``with_frame_units`` have widened."""
    ball, own = F.col("team_id") == s.ball_id, F.col("team_id") == F.col("ball_owning_team_id")
    part = lambda c: S.sincos_part(S.zero_nan(c))
    own = F.coalesce(own, F.lit(False))
    out = {
        "x_normed": S.between(F.col("x"), -s.x_max, s.x_max),
        "y_normed": S.between(F.col("y"), -s.y_max, s.y_max),
        "unit_s_x": F.col("unit_s_x"),
        "unit_s_y": F.col("unit_s_y"),
        "speed": S.speed_part(F.col("v"), ball, s.max_player_speed, s.max_ball_speed),
        "unit_a_x": F.col("unit_a_x"),
        "unit_a_y": F.col("unit_a_y"),
        "acceleration": S.acceleration_part(F.col("a"), ball, s.max_player_acceleration, s.max_ball_acceleration),
        "dir_sin": part(F.sin("dir")),
        "dir_cos": part(F.cos("dir")),
        "o_sin": part(F.sin("o")),
        "o_cos": part(F.cos("o")),
        "goal_distance": S.part_of(S.norm(F.col("x") - s.x_max, F.col("y")), s.diagonal),
        "ball_distance": S.part_of(S.norm(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y")), s.diagonal),
        "end_zone_distance": S.part_of(s.end_zone - F.col("x"), s.length),
        "possession": F.when(own, 1.0).otherwise(s.defending_team_node_value),
        "qb": F.when(F.col("position_name") == "QB", 1.0).when(own, s.attacking_non_qb_node_value).otherwise(0.0),
        "ball": F.when(ball, 1.0).otherwise(0.0),
        "weight": S.between(F.col("weight_kg"), s.min_weight, s.max_weight),
        "height": S.between(F.col("height_cm"), s.min_height, s.max_height),
    }
    return {k: S.zero_nan(v) for k, v in out.items()}


@graph_feature("edge")
def football_edges(s: FootballSettings) -> dict[str, Column]:
    """The 9 edge columns, of rows that ``with_differences`` has widened; all 0 where a distance is unknown, but for
    the acceleration difference."""
    known = lambda c: F.when(F.col("gap") < float("inf"), c).otherwise(0.0)  # noqa: E731  NaN is above infinity
    part = lambda c: known(S.sincos_part(S.zero_nan(c)))
    return {
        "distance": S.part_of(S.zero_nan(F.col("gap")), s.diagonal),
        "speed_difference": known(S.speed_difference_part(F.col("d_v"), F.col("i_ball"), s.max_player_speed, s.max_ball_speed)),
        "acceleration_difference": S.acceleration_part(F.col("d_a"), F.col("i_ball"), s.max_player_acceleration, s.max_ball_acceleration),
        "position_cos": part(F.cos("place")),
        "position_sin": part(F.sin("place")),
        "dir_cos": part(F.cos("d_dir")),
        "dir_sin": part(F.sin("d_dir")),
        "o_cos": part(F.cos("d_o")),
        "o_sin": part(F.sin("d_o")),
    }


def edges_in_numpy(v: dict[str, np.ndarray], cells: tuple[np.ndarray, ...], ball: np.ndarray, s: Settings) -> np.ndarray:
    """The columns of ``soccer_edges`` or ``football_edges`` (cells, columns) for cells (frame, i, j) of whole frames.

    ``v`` has columns (frames, n), NaN for null, and ``ball`` who is the ball. The same as by ``with_differences``, but
    without a row per pair.
    """
    f, i, j = cells
    less, more = (lambda c: v[c][f, i] - v[c][f, j]), (lambda c: v[c][f, j] - v[c][f, i])
    zero = lambda a: np.where(np.isnan(a), 0.0, a)
    clip = lambda a, low: np.fmax(np.fmin(a, 1.0), low)  # noqa: E731  NaN becomes 1, as in Spark
    part = lambda a: (zero(a) + 1) / 2
    unit = lambda a, size: np.where(size == 0, 0.0, a / np.where(size == 0, 1.0, size))
    by_kind = lambda player, other: np.where(ball[f, i], other, player)
    with np.errstate(all="ignore"):
        px, py, dv = less("x"), less("y"), zero(more("v"))
        flat = np.sqrt(px * px + py * py)
        place = zero(np.arctan2(py, px))
        speed = clip(dv / by_kind(s.max_player_speed, s.max_ball_speed), 0.0) * np.sign(dv)
        if isinstance(s, FootballSettings):
            known = lambda a: np.where(flat < np.inf, a, 0.0)
            turns = [known(part(g(more(c)))) for c in ("dir", "o") for g in (np.cos, np.sin)]
            faster = clip(zero(more("a")) / by_kind(s.max_player_acceleration, s.max_ball_acceleration), -1.0)
            return np.stack([zero(flat) / s.diagonal, known(speed), faster, known(part(np.cos(place))), known(part(np.sin(place))), *turns], 1)
        pz, dx, dy = less("z"), more("vx"), more("vy")
        size = np.sqrt(dx * dx + dy * dy)
        turn = np.arccos(clip(unit(px, flat) * unit(dx, size) + unit(py, flat) * unit(dy, size), -1.0))
        gap = np.sqrt(px * px + py * py + pz * pz)
        return np.stack([zero(gap) / s.diagonal, speed, part(np.cos(place)), part(np.sin(place)), part(np.cos(turn)), part(np.sin(turn))], 1)


def global_features(columns: list[str], where: str, ball_id: str) -> dict[str, Column]:
    """Columns of a whole frame on its nodes: on the ball's row only, or on all."""
    if where not in ("ball", "all"):
        raise ValueError("global features go to the ball or to all")
    return {f"global_{c}": F.col(c) if where == "all" else F.when(F.col("team_id") == ball_id, F.col(c)).otherwise(0.0) for c in columns}
