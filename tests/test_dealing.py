"""Tasks grow with the frames, and what is grouped by what frames are dealt by is not shuffled again."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import formations
from trackloom.plans import catalog, views

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d7_one_row", "e12_segment_means", "p12_first_frame", "g14_padding", "x_pressing_teams", "x7_pressing_matrices"])
def test_dealt_once(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    exchanges = [line for line in text.splitlines() if "Exchange " in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_tasks_grow_with_frames(spark, monkeypatch):
    monkeypatch.setattr(views, "FRAMES_A_TASK", 10)
    frames = spark.read.parquet(f"{DATA}/customer.parquet").count()
    t = views.tracking(spark, DATA)
    assert t.rdd.getNumPartitions() == -(-frames // 10) > 4 and t.count() == 23 * frames
    assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES["l4_next_time"](spark, DATA))


def test_frames_of_possessions_are_not_broadcast(spark):
    d, _ = formations.segment_ids(views.tracking(spark, DATA), "possession")
    assert "BroadcastHashJoin" not in plan(d) and "ShuffledHashJoin" in plan(d)


def test_sets_of_frames_are_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "SET", 50)
    t = views.tracking(spark, DATA)
    catalog.xml_files(t, str(tmp_path))
    sets = spark.read.text(str(tmp_path / "tracking")).selectExpr("length(value) - length(replace(value, '<Frame ', '')) as n").collect()
    assert len(sets) > 46 and max(r.n for r in sets) <= 50 * len("<Frame ") and sum(r.n for r in sets) == t.count() * len("<Frame ")


def test_possessions_go_on_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(formations, "BLOCK", 7)
    owner = lambda g, f: None if f % 29 == 3 else "home" if (f * f // (60 + g)) % 3 else "away"
    rows = [(f"g{g}", p, f, owner(g, f)) for g in range(3) for p in (1, 2) for f in range(100 * p - 150, 100 * p) if f % 5 or f > 60]
    d, name = formations.segment_ids(spark.createDataFrame(rows, "game_id string, period_id int, frame_id long, ball_owning_team_id string"), "possession")
    dealt = [line.split("hashpartitioning(")[1] for line in plan(d).splitlines() if "Exchange hashpartitioning(game_id" in line]
    assert sum(line.startswith("game_id") and ", 4)" in line and "_k" not in line and "period_id" not in line for line in dealt) == 1  # only blocks are dealt by game alone
    assert any("_k" in line for line in dealt)
    want, last, n = {}, None, 0
    for g, p, f, own in sorted(rows, key=lambda r: r[:3]):
        n = 1 if not last or last[0] != g else n + (last[1:] != (p, own))
        last = (g, p, own)
        want[g, p, f] = n
    assert {(r.game_id, r.period_id, r.frame_id): r[name] for r in d.collect()} == want and len(set(want.values())) > 10


def with_twelfth(t):
    return t.withColumn("id", F.when((F.col("i") == 5) & (F.col("frame_id") % 3 == 0), "h99").otherwise(F.col("id")))


def test_rows_are_not_shuffled_for_substitutes(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if the files were large
    try:
        t = views.tracking(spark, DATA)
        for d in (formations.without_substitutes(t, "period_id"), formations.without_substitutes(with_twelfth(t), "period_id")):
            assert "SortMergeJoin" not in plan(d) and "ENSURE_REQUIREMENTS" not in plan(d)
            few = sorted(d.select("frame_id", "id").collect())
        monkeypatch.setattr(formations, "FEW", 1)
        many = formations.without_substitutes(with_twelfth(t), "period_id")
        assert "ShuffledHashJoin" in plan(many) and sorted(many.select("frame_id", "id").collect()) == few
        assert len(few) < t.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
