"""The corpus pipeline on a small made corpus: each stage on its own input, and the whole run."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm import brute
from trackloom.llm import toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(k, " ".join(f"b{k}w{j}" for j in range(rng.randrange(9, 20)))) for k in range(20)]
    texts = []
    for i in range(500):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(6, 120))]
        if i % 7 == 0:
            w[len(w) // 2 : len(w) // 2] = rng.choice(items)[1].split()
        if i % 6 == 1:
            w += ["vile", "scumbag"]
        texts.append(w)
    for i in range(120):
        w = list(texts[rng.randrange(500)])
        if i % 2:
            w[rng.randrange(len(w))] = "changed"
        texts.append(w)
    rows = [(i, " ".join(w), "en", f"s{rng.randrange(4)}" if i % 3 else "hot", len(" ".join(w))) for i, w in enumerate(texts)]
    rows += [(9000, None, None, None, None), (9001, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int("scumbag" in w), 1) for i, w in enumerate(texts) if rng.random() < 0.6]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def results(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs[-1], folder).write.parquet(f"{out}/{name}")
        docs.append(spark.read.parquet(f"{out}/{name}"))
    return docs


def test_columns(results):
    assert all(d.columns == corpus_pipeline.COLUMNS for d in results[:-1])
    assert results[-1].columns == [*corpus_pipeline.COLUMNS, "size", "shard", "slot"]


def test_toxicity(spark, folder, results):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in results[:2])
    scores = {r.doc_id: r.score for r in toxicity.score(results[0], toxicity.train(results[0], spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    assert set(after) == {i for i in before if scores[i] < 0.5}
    bad = {i for i, t in before.items() if t and "scumbag" in t}
    assert len(bad & set(after)) <= 0.05 * len(bad) and len(set(before) - bad - set(after)) <= 0.02 * len(before)


def test_near_copies(results):
    before = [(r.doc_id, r.text) for r in results[1].collect()]
    keep = {i for i, _, c in brute.near(before) if i == c}
    assert {r.doc_id for r in results[2].collect()} == keep and len(keep) < len(before)


def test_decontamination(spark, folder, results):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in results[2].collect()}
    after = {r.doc_id: r for r in results[3].collect()}
    hits = {r[0]: r[2] for r in brute.decontaminate([(i, r.text) for i, r in before.items()], items)}
    assert set(before) == set(after) and any(hits.values())
    for i, r in after.items():
        if hits[i]:
            assert len(brute.WORD.findall(r.text)) == len(brute.WORD.findall(before[i].text)) - hits[i] and r.n_chars == len(r.text)
        else:
            assert tuple(r) == tuple(before[i])
    assert not any(r[2] for r in brute.decontaminate([(i, r.text) for i, r in after.items()], items))


def test_mixing_and_sharding(results):
    before, mixed, sharded = (d.collect() for d in results[3:])
    assert Counter(map(tuple, before)) == Counter(map(tuple, mixed)) == Counter(tuple(r)[:5] for r in sharded)
    in_files = results[4].select("doc_id", "source", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    order = [r.doc_id for r in in_files]
    by = defaultdict(list)
    for r in sharded:
        by[r.shard].append(r)
    cut = [r.doc_id for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert cut == order, "shards follow the order of the mix"
    mean = sum(r["size"] for r in sharded) / 16
    assert all(abs(sum(r["size"] for r in v) - mean) <= max(r["size"] for r in sharded) for v in by.values())
    # while all sources last, each one's share in any stretch is near its weight
    n = Counter(r.source for r in before)
    weight = {s: c**0.5 for s, c in n.items()}
    first = min(n[s] / weight[s] for s in n if n[s] > 20) * sum(weight.values())
    head = Counter(r.source for r in in_files[: int(first * 0.8)])
    assert all(abs(head[s] - 0.8 * first * w / sum(weight.values())) <= 40 for s, w in weight.items() if n[s] > 20)


def test_run(spark, folder, results):
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in results[-1].collect()}


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


@pytest.fixture
def odd(spark, tmp_path):
    """Repeated rows, nulls in every column, long texts, and extra columns whose names clash with the stages' own."""
    rng = random.Random(3)
    items = [(1, " ".join(f"b{j}" for j in range(12)))]
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(250_000))
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [rows[4]] * 5 + [(100, long, "en", "s1", len(long)), (101, long + " end", None, "s2", None), (102, f"{long} {items[0][1]}", "en", None, 1)]
    rows += [(None, None, None, None, None), (None, "a text without an id", "en", "s1", 20), (103, "", "en", "s1", 0), (104, items[0][1], "en", "s1", 3), (105, None, "en", "s0", 0)]
    clash = ["score", "positive", "n", "e", "fp", "items", "n_words", "span_start", "_file", "file", "row", "h", "g", "size", "shard", "slot", "part", "mix_slot", "_mix_s", "_metadata"]
    d = spark.createDataFrame(rows, KIND)
    d = d.selectExpr("*", *(f"'x' AS {c}" for c in clash))
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, None) for i in range(50)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, items


def test_stages_on_odd_rows(spark, odd, tmp_path):
    folder, rows, items = odd
    d, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, folder).write.parquet(f"{tmp_path}/out/{name}")
        d = spark.read.parquet(f"{tmp_path}/out/{name}")
        out.append([tuple(r) for r in d.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == corpus_pipeline.COLUMNS
    assert Counter(out[0]) == Counter(rows), "without toxic labels all stay"
    gone = Counter(out[0]) - Counter(out[1])
    assert {r[0] for r in gone} == {101, 102} and sum(gone.values()) == 2
    by = {r[0]: r for r in out[2]}
    assert by[104][1] == "" and by[104][4] == 0 and by[105][1] is None
    assert Counter(r for r in out[1] if r[0] != 104) == Counter(r for r in out[2] if r[0] != 104)
    assert Counter(out[2]) == Counter(out[3]) == Counter(r[:5] for r in out[4])
    brute.shard_law([r[5:] for r in out[4]])
