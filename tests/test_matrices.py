"""Matrices of packed frames: no row per pair, few frames held at a time, and the same values as by columns."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_tracking import SOCCER
from trackloom.functions.assignment import assign
from trackloom.operators import formations, frames, graphs, pressing
from trackloom.plans.views import tracking
from trackloom.schema import BALL, FootballSettings

DATA = "/root/testdata/sf0.001"


def test_pairs_never_become_rows(spark):
    g = graphs.build_graphs(frames.with_graph_ids(tracking(spark, DATA)), graphs.GraphConfig(prediction=True), SOCCER)
    text = g._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate explode") == 1 and text.count("Exchange ") == 1  # the objects of a frame, dealt once
    assert "ArrowEvalPython" not in g.select("frame_id", "label")._jdf.queryExecution().executedPlan().toString()


def test_slices_and_sizes_keep_their_places(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SLICE", 7)
    t = tracking(spark, DATA).where("frame_id % 3 > 0 or i <> 4")  # frames of two sizes
    for settings in (SOCCER, FootballSettings(ball_id=BALL)):
        config = graphs.GraphConfig(prediction=True)
        cells, names = graphs.edge_table(t, config, settings)
        want = {r.frame_id: r.e for r in cells.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("i.row", F.col("j.row").alias("j"), F.array(*names).alias("f")))).alias("e")).collect()}
        got = graphs.build_graphs(frames.with_graph_ids(t), config, settings).collect()
        assert len(got) == len(want) and len({r.x_shape_0 for r in got}) == 2
        for r in got:
            assert np.allclose(r.e, [c.f for c in want[r.frame_id]], atol=1e-7)
            assert [(i, j) for i, row in enumerate(r.a) for j, v in enumerate(row) if v] == [(c.row, c.j) for c in want[r.frame_id]]


def test_pressing_pairs_are_not_sorted(spark):
    for method in pressing.METHODS:
        text = pressing.pressing_pairs(tracking(spark, DATA), SOCCER, method=method)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in text and "Sort [" not in text


def test_pressing_columns_of_odd_carriers(spark):
    """The ball's time goes to the first carrier of the chosen columns; without one frames stay as they are."""
    t = tracking(spark, DATA).where("frame_id < 8")
    several = t.withColumn("is_ball_carrier", F.col("i").isin(3, 4, 15, 22))
    plain = pressing.pressing_pairs(t, SOCCER, ball_method="include", method="full").collect()
    time = {(c.frame_id, c.row_id, c.column_id): c.tti for c in plain}
    got = pressing.pressing_pairs(several, SOCCER).collect()
    assert len(got) == 8 * 121
    for c in got:
        own = time[c.frame_id, c.row_id, c.column_id]
        first = c.column_id == ("h03" if c.frame_id % 2 == 0 else "a15")
        assert c.tti == (min(own, time[c.frame_id, c.row_id, "ball"]) if first else own)
    assert pressing.pressing_pairs(t.withColumn("is_ball_carrier", F.lit(False)), SOCCER).count() == 0


def test_few_templates_are_matched(monkeypatch):
    """The best of all templates for teams of any size and shape, and most templates ruled out by their bounds."""
    matcher, rng, solved = formations.Matcher(), np.random.default_rng(4), []
    many = formations.assign_many
    monkeypatch.setattr(formations, "assign_many", lambda cost: solved.append(len(cost)) or many(cost))
    for n, (names, places, _) in matcher.by_size.items():
        xy = np.concatenate([rng.integers(-50, 50, (60, n, 2)).astype(float), rng.random((60, n, 2)) * 9, np.zeros((1, n, 2)), rng.random((20, n, 2)) * [0, 5]])
        right = rng.random(len(xy)) < 0.5
        best, match, total = matcher.fit_many(xy, right)
        low, high = places.min((0, 1)), places.max((0, 1))
        for team, to_right, k, m, t in zip(xy, right, best, match, total, strict=True):
            scaled = np.where(to_right, places - low, high - places) * ((team.max(0) - team.min(0)) / (high - low)) + team.min(0)
            cost = np.linalg.norm(team[None, :, None] - scaled[:, None], axis=-1)
            sums = [c[range(n), assign(c)].sum() for c in cost]
            assert sorted(m) == list(range(n)) and np.isclose(cost[k][range(n), m].sum(), t, rtol=1e-12) and np.isclose(t, min(sums), rtol=1e-12)
            assert np.isclose(sums[k], min(sums), rtol=1e-12)
    solved.clear()
    k, i = np.arange(1000)[:, None], np.arange(1, 11)
    matcher.fit_many(np.stack([(k * 37 + i * 191) % 1050 / 10 - 52.5, (k * 53 + i * 87) % 680 / 10 - 34], 2), np.arange(1000) % 2 == 0)
    assert sum(solved) < 3_500
