"""Formation detection: templates scaled to a team's box and matched to its players at least total distance."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.assignment import assign_many
from trackloom.operators import frames
from trackloom.schema import BALL, FRAME, Settings

#: Fixed names: the formations of the published 19-cluster catalogue, as digits of lines from the back.
CLUSTERS = ["5221", "352", "343flat", "3232", "4222", "41212", "343", "41221", "433", "4321", "4141", "442", "3331", "31312", "3241", "3142", "2422", "2332", "2431"]
#: Names of other formations in use, of ten, nine and eight outfield players.
TENS = ["451", "4411", "4231", "532", "541", "3511", "3421", "3412", "4132", "424", "4312", "4213", "3313", "3322", "3241", "3223", "42211", "42121", "41311", "32221", "32311", "31213", "31222", "5311", "5212", "5131", "2431", "2341", "235", "325", "334", "253"]
NINES = ["441", "432", "342", "351", "531", "333", "4311", "4221", "4131", "3411", "3321", "3231", "252", "522"]
EIGHTS = ["332", "431", "341", "422", "323", "242", "521", "3311", "3221", "4211"]
CATALOGUE = [*dict.fromkeys([*CLUSTERS, *TENS]), *NINES, *EIGHTS]
#: A template: places (n, 2) in [0, 1] of a team that plays to the right, and their labels.
Template = tuple[np.ndarray, list[str]]
#: Teams whose distances are held at a time.
TEAMS = 2_048
#: Frame numbers of a block, within which changes of possession are counted.
BLOCK = 65_536
#: Substitutes that every task gets; more are joined by a shuffle.
FEW = 100_000
#: Fixed names of places in a line of so many players, from left to right.
LINES = {1: ["C"], 2: ["LC", "RC"], 3: ["L", "C", "R"], 4: ["L", "LC", "RC", "R"], 5: ["L", "LC", "C", "RC", "R"]}


@cache
def template(name: str) -> Template:
    """Places (n, 2) of a formation that plays to the right, in [0, 1], and their labels.

    Lines are evenly spaced from the back, players evenly across a line; ``flat`` puts the last line level.
    """
    digits = [int(d) for d in re.sub(r"\D", "", name)]
    if not digits or any(d > 5 or d < 1 for d in digits):
        raise ValueError(f"no formation {name!r}")
    xy, labels = [], []
    for k, d in enumerate(digits):
        zone = "B" if k == 0 else "F" if k == len(digits) - 1 else "M" if len(digits) == 3 else f"M{k}"
        for j, side in enumerate(LINES[d]):
            bow = 0.0 if "flat" in name or d < 3 else 0.04 * (1 - abs(2 * j / (d - 1) - 1))
            xy.append((k / (len(digits) - 1 or 1) + (bow if k == len(digits) - 1 else -bow), 1 - (j + 0.5) / d if d > 1 else 0.5))
            labels.append(side + zone)
    return np.array(xy), labels


def catalogue(names: Iterable[str] | Mapping[str, Template] | None = None) -> dict[int, dict[str, Template]]:
    """Templates by number of outfield players: of names, or given ones by name; by default of CATALOGUE."""
    out: dict[int, dict] = {}
    for n in CATALOGUE if names is None else names:
        xy, labels = names[n] if isinstance(names, Mapping) else template(n)
        if np.shape(xy) != (len(labels), 2):
            raise ValueError(f"formation {n!r} must have a place (x, y) for each label")
        out.setdefault(len(labels), {})[n] = np.asarray(xy, float), list(labels)
    return out


class Matcher:
    """Fits templates to players: all templates of a size share one box, which is stretched to the players' box."""

    def __init__(self, names: Iterable[str] | Mapping[str, Template] | None = None):
        self.by_size = {n: (list(t), np.array([v[0] for v in t.values()]), [v[1] for v in t.values()]) for n, t in catalogue(names).items()}
        #: Templates of a size share most of their places: each of them once, and which a template has.
        self.points = {}
        for n, (_, places, _) in self.by_size.items():
            points, at = np.unique(places.reshape(-1, 2), axis=0, return_inverse=True)
            self.points[n] = points, at.reshape(-1, n)

    def fit(self, xy: np.ndarray, to_right: bool) -> tuple[str, list[str], float] | None:
        """(formation, a label per player, cost), or None without a template of this size. The first of equals wins."""
        if len(xy) not in self.by_size:
            return None
        names, _, labels = self.by_size[len(xy)]
        best, match, cost = (x[0] for x in self.fit_many(np.asarray(xy, float)[None], np.array([to_right])))
        return names[best], [labels[best][m] for m in match], float(cost)

    def fit_many(self, xy: np.ndarray, to_right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best template, match and cost of each of the teams (teams, players, 2), all of a size that has templates.

        Distances are taken once per place, as templates share places. Templates are tried in order of a lower bound for all
        teams at once: each player's nearest place, and what the places' nearest players cost beyond that, or the same from
        the places' side if it is more. A team is done when its next bound is above its best cost.
        """
        teams, n, _ = xy.shape
        points, at = self.points[n]
        low, high = points.min(0), points.max(0)
        own_low, own_high = xy.min(1), xy.max(1)
        scale = np.where(high > low, (own_high - own_low) / np.where(high > low, high - low, 1), 1)
        square = 0.0
        for c in (0, 1):
            # turned, a template is the same places from the box's other corner
            from_corner = np.where(to_right, (points[:, c] - low[c])[:, None], (high[c] - points[:, c])[:, None])
            way = np.ascontiguousarray(xy[:, :, c].T) - (from_corner * scale[:, c] + own_low[:, c])[:, None]
            square = square + way * way
        far = np.sqrt(square)  # (points, players, teams), so that sums and minima go over whole rows of teams
        bound = np.empty((teams, len(at)))
        for k, own in enumerate(at):
            cost = far[own]
            nearest, other = cost.min(0), cost.min(1)
            least = np.maximum(nearest.sum(0) + (cost - nearest).min(1).sum(0), other.sum(0) + (cost - other[:, None]).min(0).sum(0))
            bound[:, k] = least * (1 - 1e-12)  # rounding must not raise it
        order = np.argsort(bound, axis=1, kind="stable")
        best, total, match = np.full(teams, len(at)), np.full(teams, np.inf), np.zeros((teams, n), int)
        live = np.arange(teams)
        for nth in range(len(at)):
            k = order[live, nth]
            going = bound[live, k] <= total[live]
            live, k = live[going], k[going]
            if not len(live):
                break
            own = far[at[k][:, None], np.arange(n)[None, :, None], live[:, None, None]]
            found = assign_many(own)
            sums = np.take_along_axis(own, found[:, :, None], 2)[:, :, 0].sum(1)
            better = (sums < total[live]) | ((sums == total[live]) & (k < best[live]))
            won = live[better]
            best[won], total[won], match[won] = k[better], sums[better], found[better]
        return best, match, total


DETECTED = "team_id string, is_attacking boolean, ids array<string>, positions array<string>, formation string, cost double, players int"


def detect(df: DataFrame, keys: list[str], formations: tuple[str, ...] | Mapping[str, Template] | None = None) -> DataFrame:
    """A row per team of each group: its formation, and its players' positions.

    Teams with another number of outfield players than a template has, or a player without a place, get no row. Teams
    go to Python in Arrow batches, and those of a size are matched together.
    """
    players = F.array_sort(F.collect_list(F.when(F.col("position_name").isNull() | (F.col("position_name") != "GK"), F.struct("id", "x", "y"))))
    keepers = F.array_sort(F.collect_list(F.when(F.col("position_name") == "GK", F.col("id"))))
    teams = df.where(F.col("team_id") != BALL).groupBy(*keys, "ball_owning_team_id", "team_id").agg(players.alias("players"), keepers.alias("keepers"))
    attacks = F.coalesce(F.col("team_id") == F.col("ball_owning_team_id"), F.lit(False))
    part = lambda c: F.transform("players", lambda p: p[c])
    teams = teams.select(*keys, "ball_owning_team_id", "team_id", attacks.alias("is_attacking"), part("id").alias("ids"), part("x").cast("array<double>").alias("x"), part("y").cast("array<double>").alias("y"), "keepers")
    names = [*keys, "ball_owning_team_id", *(f.split()[0] for f in DETECTED.split(", "))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in teams.schema.fields if f.name in keys) + ", ball_owning_team_id string, " + DETECTED

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        matcher = Matcher(formations)
        for b in batches:
            size = pc.list_value_length(b.column("x")).to_numpy(zero_copy_only=False)
            to_right = np.array(b.column("is_attacking").to_pylist(), bool)
            for n in sorted(set(size.tolist()) & set(matcher.by_size)):
                rows = np.flatnonzero(size == n)
                for a in range(0, len(rows), TEAMS):
                    at = rows[a : a + TEAMS]
                    part = b.take(pa.array(at))
                    xy = np.stack([part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n) for c in "xy"], 2)
                    known = np.isfinite(xy).all((1, 2))
                    part, xy, at = part.filter(pa.array(known)), xy[known], at[known]
                    if not len(at):
                        continue
                    best, match, cost = matcher.fit_many(xy, to_right[at])
                    own, _, labels = matcher.by_size[n]
                    gk = part.column("keepers").to_pylist()
                    ids = [i + g for i, g in zip(part.column("ids").to_pylist(), gk, strict=True)]
                    places = [[labels[k][m] for m in ms] + ["GK"] * len(g) for k, ms, g in zip(best.tolist(), match.tolist(), gk, strict=True)]
                    made = [pa.array(ids, pa.list_(pa.string())), pa.array(places, pa.list_(pa.string())), pa.array([own[k] for k in best.tolist()], pa.string()), pa.array(cost), pa.array(np.full(len(at), n, np.int32))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keys, "ball_owning_team_id", "team_id", "is_attacking")), *made], names)

    return teams.mapInArrow(run, schema)


def steady(found: DataFrame, keys: list[str], threshold: float | None, after_possession: bool = True) -> DataFrame:
    """Keep a team's last formation until a new one is worth it, in order of ``keys`` within a game.

    A new one is taken if it is the first, the players differ, the team changes between attack and defence (with
    ``after_possession``), or the old cost is more than ``threshold`` above the new one. Costs are computed before, in
    parallel; only this fold is in order, for one team of one game at a time.
    """
    if threshold is None:
        return found

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys).reset_index(drop=True)
        held = None
        for k, r in enumerate(pdf.itertuples(index=False)):
            new = held is None or set(held.ids) != set(r.ids) or (after_possession and held.is_attacking != r.is_attacking) or (held.cost - r.cost) / max(r.cost, 1e-12) > threshold
            if new:
                held = r
            else:
                at = dict(zip(held.ids, held.positions, strict=True))
                pdf.at[k, "positions"] = [at[i] for i in r.ids]
                pdf.at[k, "formation"] = held.formation
        return pdf

    return found.groupBy("game_id", "team_id").applyInPandas(fold, found.schema)


def segment_ids(df: DataFrame, every: str) -> tuple[DataFrame, str]:
    """Add the segment of each frame: ``possession``, ``period`` or a time bucket such as ``30s``, ``5m``, ``1h``."""
    if every == "possession":
        one = df.groupBy(*FRAME).agg(F.min("ball_owning_team_id").alias("_own")).withColumn("_k", F.struct("period_id", F.floor(F.col("frame_id") / BLOCK)))
        # changes are counted in blocks of frame numbers, so no task needs all frames of a game; then blocks are put together.
        # As a struct is never null, both sides of their join have the same filters, and one shuffle
        part, period = ["game_id", "_k"], F.col("_k.period_id")
        w, v = Window.partitionBy(*part).orderBy("frame_id"), Window.partitionBy("game_id").orderBy("_k")
        so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
        one = one.withColumn("_c", F.when((F.row_number().over(w) > 1) & ~F.col("_own").eqNullSafe(F.lag("_own").over(w)), 1).otherwise(0))
        one = one.withColumn("_n", F.sum("_c").over(so_far(w)))
        at = F.struct("frame_id")
        blocks = one.groupBy(*part).agg(F.min_by("_own", at).alias("_first"), F.max_by("_own", at).alias("_last"), F.max("_n").alias("_all"))
        changed = ~F.col("_first").eqNullSafe(F.lag("_last").over(v)) | ~period.eqNullSafe(F.lag(period).over(v))
        blocks = blocks.withColumn("_c", F.when(changed, 1).otherwise(0))
        blocks = blocks.select(*part, (F.sum(F.col("_c") + F.col("_all")).over(so_far(v)) - F.col("_all")).alias("_before"))
        ids = one.join(blocks.hint("shuffle_hash"), part).select(*FRAME, (F.col("_before") + F.col("_n")).alias("possession_id"))
        # a row per frame: never broadcast, whatever its estimated size
        return df.join(ids.hint("shuffle_hash"), FRAME), "possession_id"
    if every == "period":
        return df, "period_id"
    m = re.fullmatch(r"(\d+)(ms|s|m|h)", every)
    if not m:
        raise ValueError(f"{every!r} is no interval")
    width = int(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}[m[2]]
    return df.withColumn(f"{every}_id", F.expr(f"(t_ms div {width}) * {width}")), f"{every}_id"


def without_substitutes(df: DataFrame, segment: str, substitutions: str = "drop", most: int = 11) -> DataFrame:
    """In segments with over 10 outfield players of a team, keep its 11 objects with most rows (ties by id).

    Substitutes are looked up at once, as they are few: by estimates all rows could be shuffled and sorted for them.
    """
    if substitutions == "merge":
        raise NotImplementedError("merging substitutes")
    if substitutions != "drop":
        raise ValueError("substitutions must be drop")
    keys = list(dict.fromkeys(["game_id", "period_id", segment, "team_id"]))
    per = df.groupBy(*keys, "id").agg(F.count("*").alias("n"), F.max(F.when(F.col("position_name") == "GK", 0).otherwise(1)).alias("out"))
    w = Window.partitionBy(*keys)
    per = per.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "id")), "outs": F.sum("out").over(w)})
    drop = per.where((F.col("team_id") != BALL) & (F.col("outs") > 10) & (F.col("r") > most)).select(*keys, "id")
    found = drop.limit(FEW + 1).collect()
    if len(found) > FEW:
        return df.join(drop.hint("shuffle_hash"), [*keys, "id"], "left_anti")
    return df.join(F.broadcast(df.sparkSession.createDataFrame(found, drop.schema)), [*keys, "id"], "left_anti") if found else df


def segment_means(df: DataFrame, segment: str) -> DataFrame:
    """Mean place of each object per segment, with the segment's frames and times as that object saw them."""
    keys = list(dict.fromkeys(["game_id", "period_id", "ball_owning_team_id", segment, "id"]))
    return df.groupBy(*keys).agg(
        F.avg("x").alias("x"),
        F.avg("y").alias("y"),
        F.min_by("position_name", F.struct("frame_id")).alias("position_name"),
        F.min_by("team_id", F.struct("frame_id")).alias("team_id"),
        F.count_distinct("frame_id").alias("n_frames"),
        F.min("t_ms").alias("start_t_ms"),
        F.max("t_ms").alias("end_t_ms"),
        F.min("frame_id").alias("start_frame_id"),
        F.max("frame_id").alias("end_frame_id"),
    )


def segments_of(means: DataFrame, segment: str) -> DataFrame:
    return means.select("game_id", segment, "n_frames", "start_t_ms", "end_t_ms", "start_frame_id", "end_frame_id").distinct()


def positions_of(found: DataFrame, keys: list[str]) -> DataFrame:
    z = F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("positions").alias("position")))
    return found.select(*keys, "ball_owning_team_id", "team_id", "formation", "is_attacking", z.alias("_z")).select(*keys, "_z.id", "team_id", "_z.position", "formation", "ball_owning_team_id", "is_attacking")


def detect_formations(
    df: DataFrame,
    settings: Settings = Settings(),
    start_ms: int | None = None,
    end_ms: int | None = None,
    period_id: int | None = None,
    every: str = "frame",
    formations: tuple[str, ...] | Mapping[str, Template] | None = None,
    substitutions: str = "drop",
    change_after_possession: bool = True,
    change_threshold: float | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(positions, segments). Positions: a row per object and frame or segment; segments: None per frame.

    ``formations`` names templates, or gives them as {name: (places, labels)}; CATALOGUE is the default.
    """
    if settings.orientation != "ball_owning":
        raise ValueError("formations need ball-owning orientation")
    d = frames.time_window(df, start_ms, end_ms, period_id)
    if every == "frame":
        keys, means, segments = FRAME, d, None
    else:
        d, segment = segment_ids(d, every)
        means = segment_means(without_substitutes(d, segment, substitutions), segment)
        keys, segments = list(dict.fromkeys(["game_id", "period_id", segment])), segments_of(means, segment)
    found = steady(detect(means, keys, formations), keys[1:], change_threshold, change_after_possession)
    ball = means.where(F.col("team_id") == BALL).select(*keys, "id", "team_id", F.lit(BALL).alias("position"), F.lit(BALL).alias("formation"), "ball_owning_team_id", F.lit(None).cast("boolean").alias("is_attacking"))
    return positions_of(found, keys).unionByName(ball), segments
