"""Tracking operators on small made tables: published formulas, invariants and errors."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry
from trackloom.functions.assignment import assign
from trackloom.operators import formations, frames, graphs, kinematics, pairs, possession, pressing, splits
from trackloom.operators.features import graph_feature
from trackloom.schema import FRAME, Settings
from trackloom.sources import football, graph_files, soccer
from trackloom.streaming import feed

SOCCER = Settings()


def frame(f, home=11, away=11, ball=True, owner="home", game="g1", period=1):
    rng = random.Random(f)
    rows = []
    for team, n in (("home", home), ("away", away)):
        for k in range(n):
            rows.append((f"{team[0]}{k:02d}", team, "GK" if k == 0 else f"P{k}", k == 3 and team == owner))
    if ball:
        rows.append(("ball", "ball", "ball", False))
    out = []
    for i, t, pos, carries in rows:
        vx, vy = rng.uniform(-8, 8), rng.uniform(-6, 6)
        out.append((game, period, f, f * 40, i, t, pos, rng.uniform(-50, 50), rng.uniform(-30, 30), 0.0, vx, vy, 0.0, math.hypot(vx, vy), owner, carries))
    return out


KIND = "game_id string, period_id int, frame_id long, t_ms long, id string, team_id string, position_name string, x double, y double, z double, vx double, vy double, vz double, v double, ball_owning_team_id string, is_ball_carrier boolean"


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(frame(1) + frame(2, owner="away"), KIND).cache()


# --- motion -----------------------------------------------------------------------------------------------------------


def fitted(v, half):
    n, w = len(v), 2 * half + 1
    if n < w:
        return v
    out = []
    for k in range(n):
        a = min(max(k - half, 0), n - w)
        x = np.arange(a, a + w)
        slope, at0 = np.polyfit(x, v[a : a + w], 1)
        out.append(slope * k + at0)
    return out


@pytest.mark.parametrize("n", [1, 3, 6, 7, 20])
def test_smoothing_is_a_line_fit(spark, n):
    rng = random.Random(n)
    v = [rng.uniform(-5, 5) for _ in range(n)]
    d = spark.createDataFrame([("g", "a", 1, k, k * 40, "T", float(x)) for k, x in enumerate(v)], "game_id string, id string, period_id int, frame_id long, t_ms long, team_id string, vx double")
    for half in (1, 3):
        got = [r.s for r in kinematics.smooth(d, {"vx": "s"}, half).orderBy("frame_id").collect()]
        assert np.allclose(got, fitted(v, half))


def test_motion_without_time(spark):
    """Two rows at one time: velocity 0, not an error."""
    d = spark.createDataFrame([("g", "a", 1, k, t, "T", float(k), 0.0, 0.0) for k, t in enumerate([0, 40, 40, 80])], "game_id string, id string, period_id int, frame_id long, t_ms long, team_id string, x double, y double, z double")
    got = kinematics.kinematics(d, SOCCER, smoothing=False).orderBy("frame_id").collect()
    assert [r.vx for r in got] == [0.0, 25.0, 0.0, 25.0] and [r.v for r in got] == [0.0, 12.0, 0.0, 12.0]


# --- geometry and assignment ------------------------------------------------------------------------------------------


def test_rays(spark):
    d = spark.createDataFrame([(0.0, 1.0, 1.0, 0.0), (0.0, 1.0, -1.0, 0.0), (5.0, 6.0, 1.0, 1.0), (5.0, 6.5, 1.0, 1.0), (5.0, 0.0, 0.0, 1.0), (6.0, 3.0, 0.0, 0.0)], "x double, y double, vx double, vy double")
    c = [F.col(k) for k in ("x", "y", "vx", "vy")]
    hit, x, y = geometry.ray_hits(*c, (6.0, 0.0), (6.0, 7.0))
    assert [tuple(r) for r in d.select(hit, x, y).collect()] == [(True, 6.0, 1.0), (False, 0.0, 0.0), (True, 6.0, 7.0), (False, 0.0, 0.0), (False, 0.0, 0.0), (False, 0.0, 0.0)]
    hit, x, y = geometry.ray_hits(*c, (0.0, 8.0), (10.0, 8.0))
    assert [r[0] for r in d.select(hit).collect()] == [False, False, True, True, True, False]
    with pytest.raises(NotImplementedError):
        geometry.ray_hits(*c, (0.0, 0.0), (1.0, 1.0))


def test_assignment():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (5, 5), (6, 6), (3, 5)):
        for _ in range(10):
            cost = rng.random((n, m)).round(1)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            match = assign(cost)
            assert len(set(match)) == n and np.isclose(cost[np.arange(n), match].sum(), best)


# --- possession -------------------------------------------------------------------------------------------------------


def test_turning_twice_is_nothing(two):
    once = possession.facing_right(two, SOCCER)
    again = possession.facing_right(once, SOCCER)
    assert sorted(map(str, again.collect())) == sorted(map(str, two.collect())) and once.where("frame_id = 2").first().x != two.where("frame_id = 2").first().x


def test_owner_needs_to_be_near(spark, two):
    far = two.withColumns({"ball_owning_team_id": F.lit(None).cast("string"), "x": F.when(F.col("id") == "ball", 0.0).otherwise(F.when(F.col("frame_id") == 1, 100.0).otherwise(F.col("x")))})
    got = possession.with_owner(far.drop("is_ball_carrier"), SOCCER)
    assert {r.frame_id for r in got.collect()} == {2}
    assert got.where("is_ball_carrier").count() == 1 and possession.owners_missing(far)
    assert got.where("is_ball_carrier").first().team_id == got.first().ball_owning_team_id


def test_settings():
    with pytest.raises(TypeError):
        Settings(ball_carrier_threshold=25)
    with pytest.raises(ValueError):
        Settings(orientation="not_set")


# --- frames and graphs ------------------------------------------------------------------------------------------------


def test_padding(spark):
    d = spark.createDataFrame(frame(1, home=9) + frame(2, ball=False) + frame(3, away=0) + frame(4), KIND)
    got = frames.padded(d, SOCCER)
    n = {(r.frame_id, r.team_id): r["count"] for r in got.groupBy("frame_id", "team_id").count().collect()}
    assert n == {(f, t): c for f in (1, 2, 4) for t, c in (("home", 11), ("away", 11), ("ball", 1))}
    added = got.where("id = ''").collect()
    assert len(added) == 3 and all(r.x == 0 and r.position_name == "" and r.is_ball_carrier is False and r.t_ms == r.frame_id * 40 for r in added)


def test_time_window_arguments(two):
    with pytest.raises(ValueError):
        frames.time_window(two, 0, None, 1)
    assert frames.time_window(two, None, None, None) is two


def test_constant_in_frame(two):
    with pytest.raises(Exception, match="one value"):
        frames.constant_in_frame(two, ["x"]).collect()


def test_edges_and_pad_sizes(two):
    p = pairs.pairs(two, FRAME, frames.graph_order(SOCCER), ["id", "team_id", "ball_owning_team_id", "is_ball_carrier"])
    for kind in (pairs.DENSE, pairs.DENSE_AP, pairs.DENSE_DP, pairs.SPLIT_BY_TEAM):
        for connect in (pairs.TO_BALL, pairs.TO_CARRIER, pairs.NO_CONNECTION):
            n = p.where(pairs.connected(kind, connect, "ball")).groupBy("frame_id").count().collect()
            assert {r["count"] for r in n} == {pairs.most_edges(kind, connect)}
    assert pairs.most_edges(pairs.SPLIT_BY_TEAM, pairs.TO_BALL) == 287
    with pytest.raises(NotImplementedError):
        pairs.connected(pairs.DELAUNAY, pairs.TO_BALL, "ball")


def test_graphs(two):
    g = graphs.build_graphs(frames.with_dummy_labels(frames.with_graph_ids(two)), settings=SOCCER).orderBy("frame_id").collect()
    assert len(g) == 2 and all(r.x_shape_0 == 23 and r.x_shape_1 == 15 and r.e_shape_0 == 287 and r.e_shape_1 == 6 and sum(map(sum, r.a)) == 287 and r.label in (0, 1) for r in g)
    assert [r.object_ids[0][0] for r in g] == ["h", "a"] and all(r.object_ids[-1] == "ball" and len(r.x) == 23 and len(r.e) == 287 for r in g)
    assert all(0 <= v <= 1 for r in g for row in r.e for v in row)
    with pytest.raises(ValueError):
        graphs.build_graphs(two)
    with pytest.raises(ValueError):
        graphs.build_graphs(frames.with_graph_ids(two))
    with pytest.raises(ValueError):
        graphs.GraphConfig(adjacency="ring")


@graph_feature("node", "numpy")
def speed_twice(**kw):
    return kw["v"] * 2


@graph_feature("edge", "numpy")
def gaps(**kw):
    p = kw["position"]
    d = np.linalg.norm(p[:, None] - p[None], axis=-1)
    return d, d.T


@graph_feature("node", "numpy")
def wrong(**kw):
    return np.zeros(3)


def test_own_features(spark, two):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    d = frames.with_graph_ids(two)
    config = graphs.GraphConfig(prediction=True, node_functions=(speed_twice,), edge_functions=(gaps,))
    r = graphs.build_graphs(d, config, SOCCER).orderBy("frame_id").first()
    plain = graphs.build_graphs(d, graphs.GraphConfig(prediction=True), SOCCER).orderBy("frame_id").first()
    v = {x.id: x.v for x in two.where("frame_id = 1").collect()}
    assert r.x_shape_1 == 16 and r.object_ids == plain.object_ids and r.a == plain.a and np.allclose([row[:15] for row in r.x], plain.x)
    assert np.allclose([row[15] for row in r.x], [2 * v[i] for i in r.object_ids]) and r.e_shape_1 == 2
    with pytest.raises(Exception, match="must return"):
        graphs.build_graphs(d, graphs.GraphConfig(prediction=True, node_functions=(wrong,)), SOCCER).collect()
    with pytest.raises(TypeError):
        graphs.build_graphs(d, graphs.GraphConfig(prediction=True, node_functions=(gaps,)), SOCCER)
    with pytest.raises(ValueError):
        graph_feature("face")


def test_graph_files(spark, two, tmp_path):
    g = graphs.build_graphs(frames.with_graph_ids(two), graphs.GraphConfig(prediction=True), SOCCER)
    with pytest.raises(ValueError):
        graph_files.to_pickle(g, str(tmp_path / "a.pickle"))
    graph_files.to_pickle(g, str(tmp_path / "new" / "a.pickle.gz"))
    back = graph_files.from_pickle(str(tmp_path / "new"))
    assert len(back) == 2 and back[0]["e"].shape == (287, 6) and back[0]["a"].sum() == 287
    try:
        import torch_geometric  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            next(graph_files.to_torch(g))


# --- pressing ---------------------------------------------------------------------------------------------------------


def seconds(runner, target, reaction=0.7, speed=12.0):
    """The published formula on plain vectors."""
    p1, v1, p2, v2 = (np.array(x, float) for x in (runner[:3], runner[3:], target[:3], target[3:]))
    d2 = p2 + v2
    way = d2 - p1
    turn = np.arccos(v1 @ way / (np.linalg.norm(v1) * np.linalg.norm(way) + 1e-10))
    return np.linalg.norm(v1) * turn / np.pi + reaction + np.linalg.norm(d2 - (p1 + v1 * reaction)) / speed


def test_pressing(two):
    of = {(r.frame_id, r.id): r for r in two.collect()}
    vec = lambda r: [r.x, r.y, r.z, r.vx, r.vy, r.vz]
    cells = pressing.pressing_pairs(two, SOCCER).collect()
    assert len(cells) == 2 * 121 and all(0 <= c.pti <= 1 for c in cells)
    for c in cells:
        runner, target = of[c.frame_id, c.column_id], of[c.frame_id, c.row_id]
        assert runner.team_id == runner.ball_owning_team_id != target.team_id
        want = seconds(vec(runner), vec(target))
        if runner.is_ball_carrier:
            want = min(want, seconds(vec(of[c.frame_id, "ball"]), vec(target)))
        assert math.isclose(c.tti, want, rel_tol=1e-9)
    full = pressing.pressing_pairs(two, SOCCER, method="full", ball_method="include").collect()
    assert len(full) == 2 * 529 and all(c.tti == 0 for c in full if c.row_id == c.column_id)
    assert len(pressing.pressing_pairs(two, SOCCER, method="full").collect()) == 2 * 484
    slow = pressing.pressing_pairs(two, SOCCER, ball_method="exclude", speed_threshold=3.0).collect()
    assert all((c.pti == 0) == (of[c.frame_id, c.row_id].v < 3 or of[c.frame_id, c.column_id].v < 3) for c in slow)
    turned = {(c.frame_id, c.column_id, c.row_id): c.tti for c in pressing.pressing_pairs(two, SOCCER, orient="pressing").collect()}
    assert turned == {(c.frame_id, c.row_id, c.column_id): c.tti for c in cells}
    home = pressing.pressing_pairs(two, SOCCER, orient="home_away").collect()
    assert all(c.row_id[0] == "h" for c in home)
    with pytest.raises(ValueError):
        pressing.pressing_pairs(two, SOCCER, method="half")
    m = pressing.pressing_matrices(pressing.pressing_pairs(two, SOCCER)).orderBy("frame_id").first()
    at = {(c.row_id, c.column_id): c.tti for c in cells if c.frame_id == 1}
    assert all(m.time_to_intercept[i][j] == at[r, c] for i, r in enumerate(m["rows"]) for j, c in enumerate(m["columns"]))


# --- formations -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["433", "442", "352", "4231"])
def test_templates_find_themselves(name):
    xy, labels = formations.template(name)
    m = formations.Matcher((name, "532", "343"))
    got = m.fit(xy * [40, 50] + [-20, -25], True)
    assert got[0] == name and got[1] == labels and math.isclose(got[2], 0, abs_tol=40)
    turned = m.fit((1 - xy) * [40, 50], False)
    assert turned[0] == name and turned[1] == labels


def test_bounds_do_not_change_the_choice():
    rng = np.random.default_rng(2)
    m = formations.Matcher()
    for _ in range(20):
        xy = rng.normal(0, 15, (10, 2))
        names, places, _ = m.by_size[10]
        low, high = places.min((0, 1)), places.max((0, 1))
        scaled = (places - low) * ((xy.max(0) - xy.min(0)) / (high - low)) + xy.min(0)
        cost = np.linalg.norm(xy[None, :, None] - scaled[:, None], axis=-1)
        totals = [c[np.arange(10), assign(c)].sum() for c in cost]
        got = m.fit(xy, True)
        assert got[0] == names[int(np.argmin(totals))] and math.isclose(got[2], min(totals))


def test_detection(spark):
    rows = [r for f in range(6) for r in frame(f, owner="home" if f < 3 else "away")]
    d = spark.createDataFrame(rows, KIND)
    out, segments = formations.detect_formations(d, SOCCER)
    assert segments is None and out.count() == 6 * 23 and out.where("id = 'ball' and is_attacking is null and position = 'ball'").count() == 6
    assert out.where("position = 'GK'").count() == 12
    out, segments = formations.detect_formations(d, SOCCER, every="possession", change_threshold=0.1)
    assert out.count() == 2 * 23 and {r.n_frames for r in segments.collect()} == {3}
    for every in ("5mm", "x", "10"):
        with pytest.raises(ValueError):
            formations.detect_formations(d, SOCCER, every=every)
    with pytest.raises(NotImplementedError):
        formations.without_substitutes(d, "period_id", "merge")
    with pytest.raises(ValueError):
        formations.detect_formations(d, Settings(orientation="home_away"))


def test_steady(spark):
    kind = f"game_id string, k int, ball_owning_team_id string, {formations.DETECTED}"
    rows = [("g", k, "t", "t", True, ["a", "b"], [f"p{k}", f"q{k}"], f"f{k}", c, 2) for k, c in enumerate([1.0, 0.95, 0.5, 0.49])]
    got = formations.steady(spark.createDataFrame(rows, kind), ["k"], 0.2).orderBy("k").collect()
    assert [r.formation for r in got] == ["f0", "f0", "f2", "f2"] and got[1].positions == ["p0", "q0"]


# --- splits -----------------------------------------------------------------------------------------------------------


def test_splits(spark):
    d = spark.range(1000).withColumn("g", F.col("id") % 37).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    n = {r.split: r["count"] for r in splits.split_rows(d, "id", 7, 2, 1, seed=5).groupBy("split").count().collect()}
    assert n == {"train": 700, "test": 200, "validation": 100}
    assert {r.id for r in splits.split_rows(d, "id", 8, 2, seed=None).where("split = 'test'").collect()} == set(range(800, 1000))
    g = splits.split_groups(d, "g", 6, 3, 1)
    assert g.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert g.where("split = 'validation'").count() >= 100 and g.where("split = 'test'").count() >= 300
    b = {r.label: r["count"] for r in splits.balanced(d, "label", "id", 0.5).groupBy("label").count().collect()}
    assert b == {1: 100, 0: 100}
    assert splits.balanced(d, "label", "id", 0.105) is d
    with pytest.raises(ValueError):
        splits.split_groups(d, "g", 1, 3, 1)
    assert splits.sizes(10, 0.8, 0.2) == (8, 2, 0)


# --- sources ----------------------------------------------------------------------------------------------------------


def test_wide_feed(spark):
    wide = spark.createDataFrame([("g", 1, k, k * 40, "home", 0.0, 0.0, None, float(k), 1.0, -float(k), 2.0) for k in range(10)], "game_id string, period_id int, frame_id long, t_ms long, ball_owning_team_id string, ball_x double, ball_y double, ball_z double, `p.1_x` double, `p.1_y` double, p2_x double, p2_y double")
    players = spark.createDataFrame([("g", "p.1", "home", "GK"), ("g", "p2", "away", "ST")], "game_id string, id string, team_id string, position_name string")
    d = soccer.from_wide(wide, players)
    assert d.count() == 30 and {r.z for r in d.collect()} == {0.0} and d.where("is_ball_carrier").select("id").distinct().collect()[0].id == "p.1"
    assert {r.team_id for r in d.collect()} == {"home", "away", "ball"}
    c = soccer.centred(spark.createDataFrame([(1, 0.0, 100.0), (2, 0.0, 100.0)], "period_id int, x double, y double"), 50, 50, 100, 100, flip_periods=(2,)).collect()
    assert [(r.x, r.y) for r in c] == [(-52.5, 34.0), (52.5, -34.0)]


def test_rosters(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<R><MatchInformation><General MatchId="M1" HomeTeamId="T1"/><Teams><Team TeamId="T1"><Players><Player PersonId="1" Shortname="A" Starting="true" PlayingPosition="TW"/><Player PersonId="2" Shortname="B" Starting="false"/></Players></Team><Team TeamId="T2"><Players><Player PersonId="3" Shortname="C" Starting="true"/><Player PersonId="4" Shortname="D" Starting="true"/></Players></Team></Teams></MatchInformation></R>')
    got = {tuple(r) for r in soccer.roster_xml(spark, str(tmp_path / "m.xml")).collect()}
    assert got == {("M1", "1", "T1", "A", "TW", True), ("M1", "2", "T1", "B", None, False), ("M1", "3", "T2", "C", None, True), ("M1", "4", "T2", "D", None, True)}
    (tmp_path / "m.json").write_text('{"id": 7, "players": [{"id": 1, "team_id": 5, "first_name": "A", "last_name": "B", "player_role": {"acronym": "GK"}}]}')
    assert [tuple(r) for r in soccer.roster_json(spark, str(tmp_path / "m.json")).collect()] == [("7", "1", "5", "A B", "GK")]


def test_lenient_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('club,n,note\nX,1,"a, ""b"""\nNA,x,NULL\n"",NA,z\n')
    got = football.scan(spark, str(tmp_path / "a.csv"), {"n": "int"}).collect()
    assert [tuple(r) for r in got] == [("X", 1, 'a, "b"'), (None, None, None), (None, None, "z")]


# --- streaming --------------------------------------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import types as T

    rows = [(k % 3, f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00", float(k)) for k in range(0, 300, 7)]
    d = spark.createDataFrame(rows, "u int, s string, value double").select("u", F.to_timestamp("s").alias("ts"), "value")
    d.write.parquet(str(tmp_path / "in"))
    schema = T.StructType([T.StructField("u", T.IntegerType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])
    s = feed.windowed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "30 minutes", "10 minutes", "0 seconds", ["u"])
    feed.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in feed.windowed(d, "30 minutes", "10 minutes", by=["u"]).collect()}
    assert got and got <= want and all(r[0].isoformat() >= "2024-01-01T04" for r in want - got), "only windows that are still open are missing"


def test_sessions_as_a_stream(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02d}:{m:02d}:00") for u in (1, 2) for h, m in ((0, 0), (0, 20), (3, 0), (3, 10), (9, 0))]
    d = spark.createDataFrame(rows, "u int, s string").select("u", F.to_timestamp("s").alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    s = feed.sessions(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "1 hour", ["u"], "0 seconds")
    feed.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in feed.sessions(d, "1 hour", ["u"]).collect()}
    assert got < want and len(got) == 4 and {r[3] for r in want - got} == {1}, "only the last sessions are still open"


def test_scratch_is_removed(spark):
    import os

    from trackloom.sources import files

    path = files.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file://")
    assert os.path.isdir(local) and path.startswith(files.shared_root(spark)) and files.cleanup(spark) >= 1
    assert not os.path.exists(local) and files.cleanup(spark) == 0


@graph_feature("node", "numpy")
def what_is_given(**kw):
    assert kw["feature_opts"] == {"scale": 3} and kw["ball_id"] == "ball" and kw["possession_team_id"] == kw["ball_owning_team_id"][0]
    assert kw["velocity"].shape == kw["position"].shape == (23, 3) and kw["ball_idx"].tolist() == [22]
    assert (kw["ball_position"] == kw["position"][22]).all() and kw["is_ball_carrier"][kw["ball_carrier_idx"]] and kw["is_gk"].sum() == 2
    return np.full((23, 2), kw["feature_opts"]["scale"])


def test_builtin_edges_next_to_own_nodes(spark, two):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    d = frames.with_graph_ids(two)
    plain = graphs.build_graphs(d, graphs.GraphConfig(prediction=True), SOCCER).orderBy("frame_id").collect()
    config = graphs.GraphConfig(prediction=True, node_functions=(what_is_given,), feature_opts={"scale": 3})
    for r, p in zip(graphs.build_graphs(d, config, SOCCER).orderBy("frame_id").collect(), plain, strict=True):
        assert r.e_shape_1 == 6 and np.allclose(r.e, p.e) and r.x_shape_1 == 17 and np.allclose([row[:15] for row in r.x], p.x) and {row[16] for row in r.x} == {3}
    both = graphs.GraphConfig(prediction=True, edge_functions=(gaps,), builtin_edges=True)
    r = graphs.build_graphs(d, both, SOCCER).orderBy("frame_id").first()
    assert r.e_shape_1 == 8 and np.allclose([row[:6] for row in r.e], plain[0].e) and np.allclose([row[6] for row in r.e], np.array(r.e)[:, 7])
    own = graphs.build_graphs(d, graphs.GraphConfig(prediction=True, node_functions=(speed_twice,), builtin_nodes=False), SOCCER).first()
    assert own.x_shape_1 == 1
    labels = d.withColumn("label", F.when(F.col("id") == "ball", 1).otherwise(0))
    for c in (graphs.GraphConfig(), graphs.GraphConfig(node_functions=(speed_twice,)), graphs.GraphConfig(prediction=True, global_cols=("x",))):
        with pytest.raises(Exception, match="one value"):
            graphs.build_graphs(labels, c, SOCCER).collect()
    for c in ({}, {"node_functions": (speed_twice,)}):
        with pytest.raises(NotImplementedError):
            graphs.build_graphs(d, graphs.GraphConfig(prediction=True, adjacency="delaunay", **c), SOCCER)
    for bad in ({"pad": 1}, {"sample_rate": "half"}, {"global_cols": "x"}, {"label_col": 3}, {"feature_opts": []}):
        with pytest.raises(TypeError):
            graphs.GraphConfig(**bad)


def test_published_time_to_intercept(spark):
    """A runner of the owning side and a defender of a published frame, and the published time."""
    runner = dict(team_id="own", x=-2.1199999999999974, y=9.850000000000001, vx=0.0, vy=0.0)
    target = dict(team_id="other", x=-20.669999999999998, y=-4.560000000000002, vx=0.3928571428571188, vy=-0.21428571428569082)
    shared = dict(game_id="g", period_id=1, frame_id=1, t_ms=0, ball_owning_team_id="own", is_ball_carrier=False, z=0.0, vz=0.0, v=0.0)
    (cell,) = pressing.pressing_pairs(spark.createDataFrame([{**shared, **o, "id": o["team_id"]} for o in (runner, target)]), SOCCER, ball_method="exclude").collect()
    assert (cell.row_id, cell.column_id) == ("other", "own") and cell.tti == pytest.approx(2.6428493704618106, abs=1e-9)
