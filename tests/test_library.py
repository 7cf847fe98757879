"""Readers of providers' files, lookups, football loading and graph datasets on small made tables."""

import gzip
import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tracking import KIND, SOCCER, frame
from trackloom.operators import datasets, frames, graphs, splits
from trackloom.sources import football, graph_files, providers, soccer


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(frame(1) + frame(2, owner="away"), KIND)


# --- readers ----------------------------------------------------------------------------------------------------------

META = '<R><MatchInformation><General MatchId="M" HomeTeamId="T1" GuestTeamId="T2"/><Teams><Team TeamId="T1"><Players><Player PersonId="1" PlayingPosition="TW"/><Player PersonId="2"/></Players></Team><Team TeamId="T2"><Players><Player PersonId="3" PlayingPosition="TW"/><Player PersonId="4"/></Players></Team></Teams></MatchInformation></R>'


def positions(owner):
    sets = []
    for section, first in (("firstHalf", 10_000), ("secondHalf", 100_000)):
        for team, person in (("T1", "1"), ("T1", "2"), ("T2", "3"), ("T2", "4"), ("referee", "9"), ("BALL", "B")):
            ball = f'Z="0.5" BallPossession="{owner}" BallStatus="0"' if team == "BALL" and owner else ""
            body = "".join(f'<Frame N="{first + k}" T="x" X="{k + int(person, 16)}.5" Y="-3" {ball}/>' for k in range(3))
            sets.append(f'<FrameSet GameSection="{section}" MatchId="M" TeamId="{team}" PersonId="{person}">{body}</FrameSet>')
    return f"<R><Positions>{''.join(sets)}</Positions></R>"


def test_positions_xml(spark, tmp_path):
    (tmp_path / "meta.xml").write_text(META)
    (tmp_path / "p.xml").write_text(positions(2))
    rows, players, home = providers.sportec(spark, str(tmp_path / "p.xml"), str(tmp_path / "meta.xml"))
    got = rows.collect()
    assert home == "T1" and {(r.id, r.team_id, r.position_name) for r in players.collect()} == {("1", "T1", "GK"), ("2", "T1", None), ("3", "T2", "GK"), ("4", "T2", None)}
    assert len(got) == 30 and {r.id for r in got} == {"1", "2", "3", "4", "ball"} and {r.ball_owning_team_id for r in got} == {"T2"} and {r.ball_state for r in got} == {"dead"}
    assert {(r.period_id, r.frame_id, r.t_ms) for r in got} == {(p, first + k, 40 * k) for p, first in ((1, 10_000), (2, 100_000)) for k in range(3)}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        d = soccer.load_feed((rows, players, home)).collect()
    assert len(d) == 30 and {r.position_name for r in d if r.id in "13"} == {"GK"} and {r.x for r in d if r.id == "1" and r.frame_id == 10_000} == {-1.5}


def test_warns_of_missing_owners(spark, tmp_path):
    (tmp_path / "meta.xml").write_text(META)
    (tmp_path / "p.xml").write_text(positions(None))
    with pytest.warns(UserWarning, match="owners are inferred"):
        d = soccer.load_feed(providers.sportec(spark, str(tmp_path / "p.xml"), str(tmp_path / "meta.xml")))
    assert {r.ball_owning_team_id for r in d.collect()} == {"T2"}  # the ball is at 11.5, nearest to player 4


def test_structured_json(spark, tmp_path):
    meta = {"id": 7, "home_team": {"id": 1}, "away_team": {"id": 2}, "ball": {"trackable_object": 55}, "players": [{"id": 31, "trackable_object": 310, "team_id": 1, "player_role": {"acronym": "GK"}}, {"id": 32, "trackable_object": 320, "team_id": 2, "player_role": {"acronym": "CF"}}]}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    objects = [{"trackable_object": 310, "track_id": 1, "x": 1.0, "y": 2.0}, {"trackable_object": 320, "x": 3.0, "y": 4.0}, {"trackable_object": 55, "x": 5.0, "y": 6.0, "z": 0.5}, {"trackable_object": 999, "x": 0.0, "y": 0.0}]
    f = [
        {"frame": 1, "period": 1, "timestamp": "0:00:01.20", "possession": {"group": "home team", "trackable_object": 310}, "data": objects},
        {"frame": 2, "period": 2, "timestamp": None, "time": "45:00.1", "possession": {"group": None}, "data": objects},
        {"frame": 3, "period": None, "timestamp": None, "data": []},
    ]
    with gzip.open(tmp_path / "t.json.gz", "wt") as out:
        json.dump(f, out)
    rows, players, home = providers.skillcorner(spark, str(tmp_path / "t.json.gz"), str(tmp_path / "m.json"))
    got = {(r.frame_id, r.id): r for r in rows.collect()}
    assert home == "1" and set(got) == {(k, i) for k in (1, 2) for i in ("31", "32", "ball")}
    assert got[1, "31"].t_ms == 1200 and got[2, "31"].t_ms == 100 and got[1, "ball"].ball_owning_team_id == "1" and got[2, "ball"].ball_owning_team_id is None and got[1, "ball"].z == 0.5
    assert soccer.player_by_id(players, "32").position_name == "CF" and soccer.team_id_of_player(players, "31") == "1" and soccer.team_id_of_player(players, "77") is None


def test_json_lines_and_dat(spark, tmp_path):
    line = {"period": 1, "frameIdx": 4, "gameClock": 0.16, "live": True, "lastTouch": "away", "ball": {"xyz": [1, 2, 0.5]}, "homePlayers": [{"playerId": "a", "xyz": [1, 2, 0]}], "awayPlayers": [{"playerId": "b", "xyz": [3, 4, 0]}]}
    (tmp_path / "s.jsonl").write_text(json.dumps(line) + "\n" + json.dumps({**line, "frameIdx": 5, "ball": None, "live": False}) + "\n")
    rows, players, home = providers.second_spectrum(spark, str(tmp_path / "s.jsonl"), "g")
    got = {(r.frame_id, r.id): tuple(r) for r in rows.collect()}
    assert len(got) == 5 and got[4, "ball"] == ("g", 1, 4, 160, "alive", "away", "ball", 1.0, 2.0, 0.5) and got[5, "b"][4] == "dead"
    assert {(r.id, r.team_id) for r in players.collect()} == {("a", "home"), ("b", "away")} and home == "home"
    (tmp_path / "t.dat").write_text("100:1,5,9,100,-250,1.0;0,6,4,300,50,2.0;3,7,0,0,0,0;:10,20,30,5.5,A,Alive;:\n101:1,5,9,110,-250,1.0;:10,20,30,5.5,H,Dead;:\n999:1,5,9,0,0,0;:0,0,0,0,H,Alive;:\n")
    rows, players, _ = providers.tracab(spark, str(tmp_path / "t.dat"), "g", {1: (100, 200)})
    got = {(r.frame_id, r.id): tuple(r) for r in rows.collect()}
    assert set(got) == {(100, "home-9"), (100, "away-4"), (100, "ball"), (101, "home-9"), (101, "ball")}
    assert got[100, "home-9"] == ("g", 1, 100, 0, "alive", "away", "home-9", 1.0, -2.5, 0.0) and got[101, "ball"][3:6] == (40, "dead", "home") and got[100, "ball"][7:] == (0.1, 0.2, 0.3)


def test_goalkeepers_by_game_and_game_ids(spark):
    rows = [r for g in ("g1", "g2") for f in (1, 2) for r in frame(f, game=g)]
    d = spark.createDataFrame(rows, KIND).withColumn("position_name", F.when((F.col("game_id") == "g1") | (F.col("id") == "ball"), F.col("position_name")))
    got = soccer.load(d.select("game_id", "period_id", "frame_id", "t_ms", "id", "team_id", "position_name", "ball_owning_team_id", "x", "y", "z"), SOCCER).collect()
    assert {r.position_name for r in got if r.game_id == "g1" and r.id == "h05"} == {"P5"}
    keepers = {(r.frame_id, r.team_id): r.id for r in got if r.game_id == "g2" and r.position_name == "GK"}
    assert len(keepers) == 4 and {r.position_name for r in got if r.game_id == "g2" and r.team_id != "ball"} == {"GK", None}
    ids = soccer.with_game_id(spark.createDataFrame([(None,), ("a",)], "game_id string"), "match.xml").collect()
    assert {r.game_id for r in ids} == {"match.xml", "a"} and soccer.with_game_id(spark.range(1), "m").first().game_id == "m"


# --- football ---------------------------------------------------------------------------------------------------------


def test_football_from_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("gameId,playId,nflId,frameId,club,playDirection,x,y,s,a,o,dir\n1,2,7,1,AA,left,10,20,1.5,0.5,90,45\n1,2,NA,1,football,left,60,26.65,1,0,NA,NA\n")
    (tmp_path / "p.csv").write_text("nflId,height,weight,position\n7,6-1,200,QB\n8,NA,NA,CB\n")
    (tmp_path / "y.csv").write_text("gameId,playId,possessionTeam\n1,2,AA\n")
    got = {r.id: r for r in football.load(spark, *(str(tmp_path / f"{n}.csv") for n in "tpy")).collect()}
    assert got[7.0].position_name == "QB" and (got[7.0].x, got[7.0].frame_id, got[7.0].height_cm, got[7.0].weight_kg, got[7.0].ball_owning_team_id) == (50.0, 200_001, 190.0, 90.0, "AA")
    assert got[football.BALL_ID].team_id == got[football.BALL_ID].position_name == "football" and got[football.BALL_ID].o is None


def test_before_snap(spark):
    rows = []
    for play, events in ((1, [None, "huddle_break_offense", None, "line_set", None, "ball_snap"]), (2, ["line_set", "timeout_home", None, None, None, "ball_snap"])):
        rows += [(1, play, n, k, e, "SNAP" if k == 5 else "BEFORE_SNAP") for n in (7.0, None) for k, e in enumerate(events)] + [(1, play, 7.0, 6, "pass_forward", "AFTER_SNAP")]
    got = football.before_snap(spark.createDataFrame(rows, "gameId long, playId long, nflId double, frameId long, event string, frameType string")).collect()
    assert {(r.playId, r.nflId, r.frameId, r.event) for r in got} == {(1, n, k, "line_set") for n in (7.0, None) for k in (3, 4)}


# --- graph datasets and splits ----------------------------------------------------------------------------------------


def test_datasets(spark, two, tmp_path):
    g = graphs.build_graphs(frames.with_dummy_labels(frames.with_graph_ids(two)), settings=SOCCER)
    d = datasets.GraphDataset(g)
    assert len(d.add(g.drop("object_ids"))) == 4 and d.dimensions() == (2, 15, 6, 1, 23)
    graph_files.to_pickle(g, str(tmp_path / "a.pickle.gz"))
    for back in (datasets.graph_dataset(spark, pickle_file=str(tmp_path / "a.pickle.gz")), datasets.graph_dataset(spark, pickle_folder=str(tmp_path)), datasets.graph_dataset(spark, graphs=list(d.records()))):
        a, b = (sorted(x.records(), key=lambda r: r["id"]) for x in (d, back))
        assert all((p["x"] == q["x"]).all() and (p["e"] == q["e"]).all() and (p["a"] == q["a"]).all() and p["label"] == q["label"] and p["object_ids"] == q["object_ids"] for p, q in zip(a, b, strict=True))
    train, test = d.split(1, 1)
    assert len(train) == len(test) == 1 and len(d.split(1, 1, by_graph_id=False)) == 2
    for bad in ({}, {"graphs": []}, {"graphs": [3]}, {"graphs": g, "parquet": "x"}):
        with pytest.raises(ValueError):
            datasets.graph_dataset(spark, **bad)
    with pytest.raises(ValueError, match="format"):
        d.records("other")
    with pytest.raises(ValueError, match="missing"):
        datasets.GraphDataset(spark.range(3))
    for kind in ("pyg", "spektral"):
        with pytest.raises(ImportError):
            next(d.records(kind))
    assert set(datasets.dummy_labels([3, 3, 4]).values()) <= {0, 1} and datasets.dummy_graph_ids([9, 9, 5]) == {9: 0, 5: 1}


def test_text_and_missing_groups(spark):
    d = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 != 3, F.concat(F.lit("g-"), F.col("id") % 37)).alias("graph_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    s = splits.split_groups(d, "graph_id", 6, 3, 1)
    assert s.count() == 1000 and s.groupBy("graph_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split for r in s.select("split").distinct().collect()} == {"train", "test", "validation"}
    for none in (d.drop("graph_id"), d.withColumn("graph_id", F.lit(None).cast("string"))):
        with pytest.warns(UserWarning, match="split by id"):
            n = {r.split: r["count"] for r in splits.split_groups(none, "graph_id", 8, 2, key="id").groupBy("split").count().collect()}
        assert n == {"train": 800, "test": 200}
    with pytest.raises(ValueError):
        splits.split_groups(d.drop("graph_id"), "graph_id", 8, 2)
    t = d.withColumn("name", F.concat(F.lit("n"), F.col("id")))
    assert {r.split: r["count"] for r in splits.split_rows(t, "name", 7, 2, 1).groupBy("split").count().collect()} == {"train": 700, "test": 200, "validation": 100}
    assert {r.label: r["count"] for r in splits.balanced(t, "label", "name", 0.5).groupBy("label").count().collect()} == {0: 200, 1: 200}
    with pytest.raises(TypeError):
        splits.split_rows(t, "name", 7, 2, seed=None)


def test_keywords_without_a_ball():
    kw = graphs.keywords({"id": ["a", "b"], "team_id": ["home", "away"], "ball_owning_team_id": ["home"] * 2, "x": [np.nan, 1.0], "y": [0.0, 2.0]}, graphs.GraphConfig(), SOCCER)
    assert kw["ball_idx"] == 0 and kw["ball_carrier_idx"] is None and (kw["ball_position"] == 0).all() and kw["position"][0, 0] == 1e-10


# --- formations -------------------------------------------------------------------------------------------------------


def least_costs(cost):
    """Cost of the best match of each matrix (problems, n, n), over all subsets of places."""
    problems, n, _ = cost.shape
    best = np.full((1 << n, problems), np.inf)
    best[0] = 0
    for mask in range(1 << n):
        i = mask.bit_count()
        if i < n:
            for j in range(n):
                if not mask >> j & 1:
                    best[mask | 1 << j] = np.minimum(best[mask | 1 << j], best[mask] + cost[:, i, j])
    return best[-1]


def test_formation_query_against_brute_force(spark):
    """Every team of every frame of the registered query: no template and no match costs less."""
    from trackloom.operators import formations
    from trackloom.plans import catalog
    from trackloom.plans.views import tracking

    data = "/root/testdata/sf0.001"
    teams = {}
    for r in tracking(spark, data).where("id <> 'ball' and position_name <> 'GK'").collect():
        teams.setdefault((r.frame_id, r.team_id), []).append((r.id, r.x, r.y, r.team_id == r.ball_owning_team_id))
    got = {}
    for r in catalog.QUERIES["e_formations_per_frame"](spark, data).collect():
        if r.id != "ball":
            got.setdefault((r.frame_id, r.team_id), {})[r.id] = (r.formation, r.position)
    assert set(got) == set(teams)
    names, places, labels = formations.Matcher().by_size[10]
    low, high = places.min((0, 1)), places.max((0, 1))
    keys = sorted(teams)
    own = [sorted(teams[k]) for k in keys]
    xy = np.array([[p[1:3] for p in t] for t in own])
    corner = np.where(np.array([t[0][3] for t in own])[:, None, None, None], places - low, high - places)
    scaled = corner * ((xy.max(1) - xy.min(1)) / (high - low))[:, None, None] + xy.min(1)[:, None, None]
    cost = np.linalg.norm(xy[:, None, :, None] - scaled[:, :, None], axis=-1)
    least = least_costs(cost.reshape(-1, 10, 10)).reshape(len(keys), len(names))
    for k, t, c, costs in zip(keys, own, cost, least, strict=True):
        best = names[int(np.argmin(costs))]
        found = got[k]
        assert {f for f, _ in found.values()} == {best} or np.isclose(costs[names.index(found[t[0][0]][0])], costs.min(), rtol=1e-12)
        at = names.index(found[t[0][0]][0])
        match = [labels[at].index(found[p[0]][1]) for p in t]
        assert sorted(match) == list(range(10)) and np.isclose(c[at][range(10), match].sum(), costs.min(), rtol=1e-9)
        assert [p for _, p in found.values()].count("GK") == 1


def test_many_assignments_and_given_places():
    from trackloom.functions.assignment import assign, assign_many
    from trackloom.operators import formations

    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (3, 3), (4, 7), (10, 10)):
        cost = np.concatenate([rng.random((40, n, m)), rng.integers(0, 3, (40, n, m))])  # and with many ties
        assert (assign_many(cost) == [assign(c) for c in cost]).all()
    assert assign_many(np.empty((0, 3, 3))).shape == (0, 3)
    with pytest.raises(ValueError):
        assign_many(np.zeros((1, 3, 2)))
    given = {"mine": (np.array([[0, 0], [1, 0], [0, 1.0]]), ["A", "B", "C"]), "flat": ([[0, 0], [0, 1], [0, 2.0]], ["x", "y", "z"])}
    m = formations.Matcher(given)
    assert m.fit(np.array([[5, 5], [9, 5], [5, 9.0]]), True)[:2] == ("mine", ["A", "B", "C"]) and m.fit(np.zeros((4, 2)), True) is None
    with pytest.raises(ValueError, match="for each label"):
        formations.Matcher({"bad": ([[0, 0]], ["A", "B"])})
    assert {len(formations.template(n)[1]) for n in formations.CATALOGUE} == {8, 9, 10} and len(formations.CATALOGUE) >= 65


def test_moved_in_numpy():
    from trackloom.streaming import feed

    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        t, x, y = np.sort(rng.integers(0, 6, n)) * 40, rng.random(n), rng.random(n)
        last = None if rng.random() < 0.4 else (int(rng.integers(0, 3)) * 40, 0.5, 0.25)
        got = feed.moved(t, x, y, last)
        want = []
        for k in range(n):
            dt = (t[k] - last[0]) / 1000 if last else 0
            want.append(((x[k] - last[1]) / dt, (y[k] - last[2]) / dt) if dt > 0 else (0, 0))
            if last is None or dt > 0:
                last = (int(t[k]), x[k], y[k])
        assert np.allclose(np.array(want).T, got[:2]) and got[2] == last
