"""Each operator on small tables: against brute force where there is one, and on nulls, ties, repeats and empty input."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trackloom.llm import decontaminate, exact_dedup, language, line_spread, mixing, ngram_join, queries, sharding, token_store, toxicity, warc
from trackloom.llm.common import Scratch, components, shared_root
from trackloom.llm.fm_index import FMIndex, suffix_array
from trackloom.llm.quotient import CountingQuotientFilter

DOC = "doc_id long, text string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.choice([1, 3, 4, 5, 30, 80, 200])) for _ in range(60)]
    near = []
    for t in base[:30]:
        w = t.split()
        for k in range(3):
            v = list(w)
            for _ in range(len(v) * k // 40):
                v[rng.randrange(len(v))] = f"x{rng.randrange(50)}"
            near.append(" ".join(v))
    odd = [None, "", "   ", "\n\t", "a", "A", "a  b", "a b", "É é", "x\x00y", "😀 ok", words(rng, 5000)]
    texts = base + near + odd + odd
    return [(i * 3 % 1000, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- exact dedup ------------------------------------------------------------------------------------------------------


def test_dedup(scratch, docs):
    assert rows(exact_dedup.dedup(scratch, docs)) == sorted(brute.exact(corpus()), key=str)


def test_dedup_null_ids_repeats_empty(spark, scratch):
    data = [(None, "a"), (None, "a"), (4, "a"), (7, "b"), (7, "b"), (None, "c")]
    d = spark.createDataFrame(data, DOC).withColumn("fp", F.lit(1)).withColumn("t", F.lit("x"))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(scratch, d).collect()}
    assert got == {(None, 4, 3, False), (4, 4, 3, True), (7, 7, 2, True), (None, None, 1, True)}
    assert rows(exact_dedup.dedup(scratch, spark.createDataFrame([], DOC))) == []


@pytest.mark.parametrize("bits", [12, 20, 50])
def test_quotient_filter(bits):
    rng = np.random.default_rng(bits)
    parts = []
    for k in range(4):
        v = rng.integers(0, 1 << bits, 700 * k, dtype=np.uint64)
        v = np.r_[v, np.repeat(v[:5], 3000)]
        values, counts = np.unique(v, return_counts=True)
        f = CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(values, counts, bits).to_bytes())
        got, n = f.items()
        assert (got == values).all() and (n == counts).all()
        parts.append((f, v))
    values, counts = np.unique(np.concatenate([v for _, v in parts]), return_counts=True)
    got, n = CountingQuotientFilter.merge([f for f, _ in parts], bits).items()
    assert (got == values).all() and (n == counts).all()


# --- decontamination --------------------------------------------------------------------------------------------------


def test_suffix_array_and_index():
    rng = np.random.default_rng(3)
    for size, alphabet in ((0, 2), (1, 2), (50, 2), (400, 3), (300, 50)):
        s = rng.integers(1, alphabet + 1, size)
        if size == 400:
            s = np.tile(s[:100], 4)
        assert suffix_array(s).tolist() == sorted(range(size), key=lambda i: s[i:].tolist())
        if not size:
            continue
        index = FMIndex(s)
        for n in (1, 2, 5):
            starts = rng.integers(0, max(1, size - n), 20)
            pats = np.array([s[a : a + n] if a + n <= size else np.r_[s[a:], np.ones(n - size + a, int)] for a in starts])
            pats = np.r_[pats, np.full((1, n), alphabet + 40)]
            low, high = index.search(pats, np.full(len(pats), n))
            for p, a, b in zip(pats, low, high, strict=True):
                want = [i for i in range(size - n + 1) if (s[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def bench_items():
    rng = random.Random(9)
    return [(i, words(rng, n, 60)) for i, n in enumerate([8, 9, 20, 3, 1, 0, 40, 12])] + [(50, None), (51, "w1 w2"), (None, "w3 w4 w5"), (52, "the SAME item twice here, is the same."), (53, "the same item twice here is the same")]


def leaky():
    rng = random.Random(2)
    items = [t for _, t in bench_items() if t]
    out = [(i, " ".join([words(rng, rng.randrange(9), 60), rng.choice(items), words(rng, 7, 60), rng.choice(items)])) for i in range(40)]
    return [*out, (900, None), (901, ""), (902, "...!!"), (903, "The same Item; twice (here) is the same"), (0, out[0][1])]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontaminate(spark, block):
    d = spark.createDataFrame(leaky(), DOC).repartition(3)
    b = spark.createDataFrame(bench_items(), "item_id long, text string")
    found = decontaminate.contaminated_spans(d, b, block_bytes=block)
    want = brute.decontaminate(leaky(), [(("null" if i is None else i), t) for i, t in bench_items()])
    assert rows(decontaminate.digest(found)) == sorted(want, key=str)
    clean = decontaminate.contaminated_spans(d, b, block_bytes=block, remove=True)
    again = decontaminate.contaminated_spans(spark.createDataFrame([(r.doc_id, r.text) for r in clean.collect()], DOC), b)
    assert all(r.n_hit < 8 for r in decontaminate.digest(again).collect())


def test_decontaminate_long_and_empty(spark):
    b = spark.createDataFrame(bench_items(), "item_id long, text string")
    d = spark.createDataFrame([(1, words(random.Random(1), 30_000, 3000) + " " + bench_items()[2][1])], DOC)
    assert decontaminate.digest(decontaminate.contaminated_spans(d, b)).first().n_items >= 1
    assert decontaminate.contaminated_spans(d.limit(0), b).count() == 0
    assert decontaminate.contaminated_spans(d, b.limit(0)).first()["items"] == []


# --- n-gram join ------------------------------------------------------------------------------------------------------


def test_near(scratch, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(scratch, docs).collect()}
    assert got == set(brute.near(corpus()))


def test_near_threshold_and_chain(spark, scratch):
    """Sets at exactly four fifths link; chains connect through members that do not link themselves."""
    rng = random.Random(8)
    w = [f"q{i}" for i in range(300)]
    data = []
    for k in range(40):
        data.append((k, " ".join(w[k * 4 : k * 4 + 94])))
    for k in range(30):
        n = rng.randrange(20, 60)
        t = [f"r{k}_{i}" for i in range(n)]
        data += [(1000 + 10 * k + j, " ".join(t[: n - j])) for j in range(6)]
    shared = [f"s{i}" for i in range(60)]
    data += [(5000 + k, " ".join([*shared, *(f"u{k}_{i}" for i in range(k % 25))])) for k in range(120)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(scratch, spark.createDataFrame(data, DOC).repartition(4)).collect()}
    assert got == set(brute.near(data))


def test_near_random_sets(spark, scratch):
    """Many overlapping documents of one small vocabulary of phrases, so that all sorts of overlaps occur."""
    rng = random.Random(21)
    phrases = [[f"p{i}_{j}" for j in range(12)] for i in range(40)]
    data = []
    for k in range(250):
        size = rng.choice([4, 6, 8, 10])
        start = rng.randrange(30)
        chosen = phrases[start : start + size]
        body = [w for p in chosen for w in p]
        for _ in range(rng.choice([0, 0, 1, 2])):
            body[rng.randrange(len(body))] = f"z{k}"
        data.append((k, " ".join(body)))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(scratch, spark.createDataFrame(data, DOC).repartition(5)).collect()}
    assert got == set(brute.near(data))


def test_near_nulls_and_empty(spark, scratch):
    d = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (1, "A B C"), (3, None), (3, None), (4, "")], DOC).withColumns({"n": F.lit(1), "t": F.lit(1)})
    got = rows(ngram_join.near_groups(scratch, d))
    assert got == sorted([(None, 1, None), (2, 1, 1), (1, 1, 1), (3, 0, 3), (3, 0, 3), (4, 0, 4)], key=str)
    assert rows(ngram_join.near_groups(scratch, spark.createDataFrame([], DOC))) == []


def test_components(spark, scratch):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300)]
    got = dict(components(scratch, spark.createDataFrame(edges, "a long, b long")).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


# --- sharding ---------------------------------------------------------------------------------------------------------


def check_shards(got, tolerance):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and all(0 <= s < 16 for s in by)
    mean = sum(r["size"] for r in got) / 16
    most = max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in by[s]) - mean) <= tolerance * mean + most for s in range(16))


def test_shards(spark, scratch, docs):
    rng = random.Random(4)
    data = corpus() + [(2000 + i, words(rng, 40)) for i in range(2500)] + [(9000 + i, "one text that a third has " * 8) for i in range(1200)]
    d = spark.createDataFrame(data, DOC).repartition(4)
    got = sharding.shard_documents(scratch, d).collect()
    assert len(got) == len(data)
    check_shards(got, 0.01)
    import zlib

    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    of = dict(data)
    spread = defaultdict(set)
    for r in got:
        spread[of[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in spread.values()) <= 8, "groups are cut only where a shard needs it"


def test_shards_hold_the_documents(spark, scratch, docs):
    d = docs.select("doc_id", "text", F.col("doc_id").alias("shard"), F.lit("x").alias("h"))
    got = sharding.shard_documents(scratch, d).collect()
    kept = spark.read.parquet(scratch.path("shards")).select("document.*", F.col("shard").alias("at"), "slot").collect()
    assert Counter(tuple(r)[:4] for r in kept) == Counter(map(tuple, d.collect()))
    assert Counter((r.doc_id, r["at"], r.slot, len((r.text or "").encode()) + 1) for r in kept) == Counter((r.doc_id, r.shard, r.slot, r["size"]) for r in got)


@pytest.mark.parametrize("ids", ["one", "none", "own"])
def test_shards_cut_repeated_rows(spark, scratch, ids):
    """One row repeated for most of the bytes: its copies are dealt to many shards."""
    rng = random.Random(5)
    one = {"one": lambda i: 7, "none": lambda i: None, "own": lambda i: 10_000 + i}[ids]
    data = [(i, words(rng, 1)) for i in range(2000)] + [(one(i), "a text like many others") for i in range(2000)]
    got = sharding.shard_documents(scratch, spark.createDataFrame(data, DOC).repartition(3)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t) + 1) for i, t in data)
    brute.shard_law([(r["size"], r.shard, r.slot) for r in got])


def test_shards_long_texts(spark, scratch):
    data = [(0, "é" * 3_000_000), (1, "word " * 400_000)] + [(i, "w" * (i % 50)) for i in range(2, 800)]
    got = sharding.shard_documents(scratch, spark.createDataFrame(data, DOC).repartition(3)).collect()
    assert {r.doc_id: r["size"] for r in got} == {i: len(t.encode()) + 1 for i, t in data}
    brute.shard_law([(r["size"], r.shard, r.slot) for r in got])


def test_shards_few_rows(spark, scratch):
    assert rows(sharding.shard_documents(scratch, spark.createDataFrame([], DOC))) == []
    got = sharding.shard_documents(scratch, spark.createDataFrame([(1, None), (None, "a"), (1, None)], DOC).withColumn("shard", F.lit(1))).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, None: 1}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_period_keeps_windows():
    for weights in ({"a": 1, "b": 1}, {"a": 3, "b": 5, "c": 8}, {"a": 1, "b": 999}, {f"s{i}": i + 1 for i in range(20)}):
        order = mixing.one_period(weights)
        period, ran = sum(weights.values()), Counter()
        for slot, (s, k) in enumerate(order):
            release, deadline = mixing.windows(weights[s], period, k)
            assert release <= slot < deadline and k == ran[s]
            ran[s] += 1
            assert all(abs(ran[x] - w * (slot + 1) / period) < 1 for x, w in weights.items())
        assert ran == weights


def test_mix(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["a", "b", "c", None]) if i % 3 else "hot") for i in range(3000)]
    d = spark.createDataFrame(data, "doc_id long, source string").repartition(5)
    got = mixing.mix(d, {"hot": 1, "a": 2, "b": 3, "c": 3, None: 1}, block_rows=8).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(data)
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_block, r.mix_phase, r.mix_release, r.mix_deadline)) == (r.source, r.mix_block, r.mix_phase, r.mix_release, r.mix_deadline)
    assert sorted(slots) == list(range(len(slots)))
    last, start, ran = -1, 0, Counter()
    whole = mixing.whole_weights({"s:hot": 1, "s:a": 2, "s:b": 3, "s:c": 3, "null": 1})
    key = lambda s: "null" if s is None else f"s:{s}"
    left = Counter({key(s): -(-n // 8) for s, n in Counter(s for _, s in data).items()})
    for slot in sorted(slots):
        s, _, phase, release, deadline = slots[slot]
        if phase != last:
            last, start, ran = phase, slot, Counter()
            active = {x: whole[x] for x in left if left[x]}
        assert release <= slot - start < deadline
        ran[key(s)] += 1
        left[key(s)] -= 1
        assert all(abs(ran[x] - w * (slot - start + 1) / sum(active.values())) < 1 for x, w in active.items())


def test_mix_edges(spark):
    kind = "doc_id long, source string"
    assert rows(mixing.mix(spark.createDataFrame([], kind))) == []
    got = mixing.mix(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], kind)).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, None: 1}
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a")], kind), {"b": 1})
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(i, f"s{i}") for i in range(5)], kind), period=3)


@pytest.mark.parametrize("n", [20, 1500])
def test_mix_holds_the_given_weights(spark, n):
    """Against the weights as given, not as rounded; more sources than PERIOD has parts."""
    weights = {f"s{i}": 0.7 * n if i == 0 else 1 + i / 7 % 0.9 for i in range(n)}
    data = [(i, "s0") for i in range(1500)] + [(10_000 + i, f"s{1 + i % (n - 1)}") for i in range(3 * n)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, source string"), weights, block_rows=1).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(data)
    order = sorted((r.mix_slot, r.mix_phase, r.source) for r in got)
    assert [slot for slot, _, _ in order] == list(range(len(data)))
    total, ran = sum(weights.values()), Counter()
    for slot, phase, s in order:
        if phase:
            break
        ran[s] += 1
        assert all(abs(ran[x] - weights[x] / total * (slot + 1)) < 1 + 1e-9 for x in (s, "s0"))
    assert sum(ran.values()) > 20 and all(abs(ran[x] - w / total * sum(ran.values())) < 1 + 1e-9 for x, w in weights.items())


@pytest.mark.parametrize("seed", range(4))
def test_mix_is_the_schedule(spark, seed):
    """Every block's place against a scheduler that looks at all sources in each slot; some ids repeat or are null."""
    rng = random.Random(seed)
    sources = ["a", "b", "", None, "s:a", "null"][: 3 + seed]
    data = [(rng.choice([None, 3, rng.randrange(10**6)]), rng.choice(sources) if rng.random() < 0.5 else "hot", f"t{i}") for i in range(700)]
    weights = {s: rng.choice([1, 2, 7, 0.5]) for s in [*sources, "hot"]}
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, source string, text string").repartition(3), weights, block_rows=4).collect()
    assert Counter(tuple(r)[:3] for r in got) == Counter(data)
    key = lambda s: "null" if s is None else f"s:{s}"
    counts = Counter(key(s) for _, s, _ in data)
    want = brute.mix(mixing.exact_weights({key(s): w for s, w in weights.items() if counts[key(s)]}), {s: -(-n // 4) for s, n in counts.items()})
    slots = defaultdict(list)
    for r in got:
        slots[r.mix_slot].append(r)
    assert sorted(slots) == list(range(len(want)))
    for slot, (s, block, phase, release, deadline) in enumerate(want):
        rows_ = slots[slot]
        assert {(key(r.source), r.mix_block, r.mix_phase, r.mix_release, r.mix_deadline) for r in rows_} == {(s, block, phase, release, deadline)}
        assert sorted(r.mix_row for r in rows_) == list(range(min(4, counts[s] - 4 * block)))
    assert [(r.mix_slot, r.mix_row) for r in got] == sorted((r.mix_slot, r.mix_row) for r in got), "partitions are in order"


def test_mixed_corpus_is_written(spark, scratch, tmp_path):
    data = [(i, f"text {i}", "ab"[i % 3 == 0]) for i in range(300)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_documents(scratch, d).select("doc_id", "text", "source", "mix_slot", "mix_row", "_metadata.file_name", "_metadata.row_index").collect()
    assert Counter(tuple(r)[:3] for r in got) == Counter(data)
    assert sorted(got, key=lambda r: (r.file_name, r.row_index)) == sorted(got, key=lambda r: (r.mix_slot, r.mix_row))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    before = set(Path(shared_root(spark).removeprefix("file://")).iterdir())
    assert queries.op1_pfair_mix(spark, str(tmp_path)).count() == 300
    (made,) = set(Path(shared_root(spark).removeprefix("file://")).iterdir()) - before
    assert Counter(tuple(r) for r in spark.read.parquet(f"{made}/mixed").select("doc_id", "text", "source").collect()) == Counter(data)


def test_whole_weights_round_plainly():
    for n in (20, 200, 500):
        got = mixing.whole_weights({"a": n - 1} | {f"s{i}": 1 for i in range(n - 1)})
        assert sum(got.values()) == 1000 and abs(got["a"] - 500) <= 1
    assert mixing.whole_weights({"a": 1e9, "b": 1, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert mixing.whole_weights({"a": 1, "b": 1, "c": 1}, 3) == {"a": 1, "b": 1, "c": 1}


def test_clashing_columns(spark):
    """Result columns of the same name are replaced, other columns stay."""
    d = spark.createDataFrame([(1, "la lo", "aa", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    d = d.withColumns({c: F.lit("old") for c in ("_s", "_k", "mix_slot", "items", "n_words", "score", "rejected", "range", "t")})
    b = spark.createDataFrame([(1, "la lo")], "item_id long, text string")
    mixed, found = mixing.mix(d).collect(), decontaminate.contaminated_spans(d, b).collect()
    model = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    scored, known = toxicity.score(d, model).collect(), language.identify(d, language.train(d)).collect()
    assert all(r["_s"] == r["_k"] == r["t"] == "old" for rows_ in (mixed, found, scored, known) for r in rows_)
    assert sorted(r.mix_slot for r in mixed) == [0, 1] and sorted(r.n_words for r in found) == [0, 2] and all(0 <= r.score <= 1 for r in [*scored, *known])


# --- archive ----------------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"
PAGES = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n"), (6, "u", "x" * 100_000), (7, "u", "x" * 100_000), (None, "n", "alone"), (None, "n", "<p>é</p>")]


def test_archive(spark, scratch):
    d = spark.createDataFrame(PAGES, PAGE).withColumns({"payload": F.lit(1), "sha256": F.lit("x"), "header": F.lit(2)})
    got = warc.archive_pages(scratch, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = brute.warc([(p, h) for p, _, h in PAGES])
    assert rows(got) == sorted(want, key=str)
    once = spark.read.parquet(scratch.path("archive") + "/payloads")
    assert once.count() == once.select("sha256").distinct().count() == 5


def test_archive_small_payloads_and_damage(spark, scratch):
    d = spark.createDataFrame(PAGES, PAGE)
    got = warc.archive_pages(scratch, d, min_revisit_bytes=50).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(got) == sorted(brute.warc([(p, h) for p, _, h in PAGES], 50), key=str)
    path = scratch.path("archive")
    spark.read.parquet(f"{path}/payloads").select("sha256", F.concat("payload", F.lit(b"!")).alias("payload")).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, f"{path}2").collect()
    assert warc.archive_pages(Scratch(spark, "none"), d.limit(0)).count() == 0


def test_revisits_are_rebuilt_and_verified(spark, scratch):
    got = warc.archive_pages(scratch, spark.createDataFrame(PAGES, PAGE)).collect()
    assert Counter((r.page_id, bytes(r.content)) for r in got) == Counter((p, (h or "").encode()) for p, _, h in PAGES)
    assert {r.record_type for r in got if r.payload is None} == {"revisit"}
    path = scratch.path("archive")
    h = spark.read.parquet(f"{path}/headers")
    revisit = F.col("record_type") == "revisit"
    bad = {"digest": F.regexp_replace("header", "sha1:.{4}", "sha1:AAAA"), "length": F.regexp_replace("header", r"(?<=charset=utf-8\r\nContent-Length: )\d", "77")}
    for name, header in bad.items():
        h.withColumn("header", F.when(revisit, header).otherwise(F.col("header"))).write.parquet(f"{path}-{name}/headers")
        spark.read.parquet(f"{path}/payloads").write.parquet(f"{path}-{name}/payloads")
        with pytest.raises(Exception, match="damaged"):
            warc.read_archive(spark, f"{path}-{name}").collect()


def test_warc_files(spark, scratch):
    a = warc.archive_pages(scratch, spark.createDataFrame(PAGES, PAGE))
    warc.export_warc(a, scratch.path("files"))
    back = warc.import_warc(spark, scratch.path("files"))
    want = Counter((r.header, bytes(r.payload or b"")) for r in a.collect())
    assert Counter((r.header, bytes(r.payload)) for r in back.collect()) == want


# --- lines ------------------------------------------------------------------------------------------------------------


def test_spread(spark, scratch):
    rng = random.Random(6)
    data = []
    for i in range(300):
        site = rng.choice([f"s{k}" for k in range(30)] + [None])
        text = [f"own {i} {k}" for k in range(3)] + (["all rights reserved "] if i % 2 else []) + ([f" phrase {rng.randrange(12)}"] * 2) + ["", "  "]
        rng.shuffle(text)
        data.append((i, None if i % 50 == 7 else "\n".join(text), site))
    data += [(5, "other text\nall rights reserved", "s1"), (299, data[299][1], data[299][2])]
    for least in (2, 8, 13):
        d = spark.createDataFrame(data, "doc_id long, text string, site string").withColumn("line", F.lit("x")).repartition(4)
        got = line_spread.remove_spread_lines(scratch, d, least)
        assert rows(got) == sorted(brute.spread(data, least), key=str)
    assert rows(line_spread.remove_spread_lines(scratch, spark.createDataFrame([], "doc_id long, text string, site string"))) == []


# --- token store ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 1003, dtype=np.uint64).astype(np.uint32)
    assert (token_store.unpack(token_store.pack(ids, width), width, len(ids)) == ids).all()
    f = token_store.TokenFile(token_store.encode_file([3, None, 9], np.array([1000, 0, 3]), ids, width, block_ids=64) + b"\n")
    assert f.doc_ids == [3, None, 9] and f.lengths.tolist() == [1000, 0, 3]
    for a, b in ((0, 1003), (63, 65), (64, 128), (1000, 1003), (5, 5)):
        assert (f.ids(a, b) == ids[a:b]).all()


def tokenizer_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_tokens(spark, scratch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    odd = [(3001, "a<|endoftext|>b <|ENDOFTEXT|>"), (3002, "J̌ x İ I'LL don't"), (None, "no id"), (3003, "a\x1cb\x85c d"), (3001, "again")]
    data = corpus() + odd
    d = spark.createDataFrame(data, DOC).withColumn("file", F.lit(1)).repartition(4)
    token_store.write_tokens(d, scratch.path("t"), path, 49_408, 2, True, 3)
    got = token_store.read_tokens(scratch, spark, scratch.path("t"))
    assert rows(got) == sorted(brute.tokens(data, Tokenizer.from_file(path)), key=str)


def test_tokens_empty(spark, scratch):
    token_store.write_tokens(spark.createDataFrame([], DOC), scratch.path("t"), tokenizer_path(), 49_408, 2, True, 3)
    assert rows(token_store.read_tokens(scratch, spark, scratch.path("t"))) == []


# --- classifiers ------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(7)
    data, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = [f"w{rng.randrange(80)}" for _ in range(rng.randrange(5, 40))] + ([rng.choice(["vile", "scumbag", "filthy"])] * 2 if bad else [])
        rng.shuffle(w)
        data.append((i, " ".join(w)))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    d = spark.createDataFrame(data + [(None, None), (5, data[5][1])], DOC).withColumns({"lang": F.lit("x"), "score": F.lit(9)})
    got = toxicity.toxicity(d, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert len(got) == 902 and sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    nothing = toxicity.toxicity(d, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.predicted for r in nothing} == {0}
    assert toxicity.toxicity(d.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_language(spark):
    rng = random.Random(7)
    syllables = {"aa": ["la", "lo", "mi", "ré"], "bb": ["sch", "ung", "keit", "ß"], "cc": ["th", "ing", "wh", "ed"]}
    data = []
    for i in range(600):
        lang = rng.choice(list(syllables))
        data.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randrange(1, 30))), lang))
    extra = [(1000, None, "aa"), (1001, "123 ...", "aa"), (1002, "ung keit", None), (None, "la lo", "aa"), (1, data[1][1], data[1][2])]
    d = spark.createDataFrame(data + extra, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = language.language(d).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    truth = {i: x for i, _, x in data}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1002].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 605
    assert {r.lang_pred for r in language.language(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language(d.limit(0)).count() == 0


def test_toxicity_gradient_is_that_of_the_risk():
    """Sums over parts of the rows give the gradient of the written risk, by differences."""
    rng = np.random.default_rng(4)
    size, prior = 5, 0.2
    parts = []
    for _ in range(3):
        n = int(rng.integers(5, 30))
        on = rng.random((n, size)) < 0.4
        row, col = np.nonzero(on)
        parts.append((rng.random(n) < 0.4, row, col, on))
    loss = lambda z: np.logaddexp(0, -z)

    def risk(x):
        z = [on @ x[:-1] + x[-1] for *_, on in parts]
        p, u = np.concatenate([v[q[0]] for v, q in zip(z, parts, strict=True)]), np.concatenate(z)
        negative = loss(-u).mean() - prior * loss(-p).mean()
        return (prior * loss(p).mean() + negative) if negative >= 0 else -negative

    for x in (rng.normal(size=size + 1), np.r_[np.full(size, 3.0), -9.0], np.r_[np.full(size, -4.0), 0.0]):
        sums = []
        for p, row, col, _ in parts:
            s = toxicity.Sums(size)
            s.add(x, p, row, col)
            sums.append(s.pack())
        got = toxicity.Sums.unpack(sums, size).step(prior)
        want = [(risk(x + e) - risk(x - e)) / 2e-6 for e in np.eye(size + 1) * 1e-6]
        assert np.allclose(got, want, atol=1e-5)


def test_features_of_long_texts(monkeypatch):
    """Read in blocks, a text has the features that it has as a whole."""
    rng = random.Random(8)
    text = words(rng, 500_000, 30_000) + " " + "z" * 1_200_000 + " end"
    wanted = np.random.default_rng(1).random(toxicity.FEATURES) < 0.3
    blockwise = [toxicity.features([text], w) for w in (None, wanted)]
    monkeypatch.setattr(toxicity, "BATCH_BYTES", 1 << 30)
    for (d, f), w in zip(blockwise, (None, wanted), strict=True):
        d2, f2 = toxicity.features([text], w)
        assert (f == f2).all() and (d == d2).all() and len(f) > 1000


def test_toxicity_edges(spark, monkeypatch):
    """Ties, empty and long texts, repeated rows; the fit's last steps read rows beyond the first ones' bound."""
    monkeypatch.setattr(toxicity, "FIRST_ROWS", 50)
    rng = random.Random(3)
    data = [(i, " ".join([f"w{rng.randrange(90)}" for _ in range(12)] + (["vile"] if i % 5 == 0 else []))) for i in range(1500)]
    long = ("w1 w2 w3 " * 400_000) + "vile"
    odd = [(9001, ""), (9002, None), (9003, long), (9004, "vile"), (9004, "vile"), (9005, "x" * 2_500_000)]
    labels = [(i, int(i % 5 == 0)) for i in range(0, 1500, 2)] + [(2, 0), (99_999, 1)]
    d = spark.createDataFrame(data + odd, DOC).withColumns({c: F.lit("x") for c in ("positive", "features", "h", "score", "n")}).repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("vile"))
    got = toxicity.toxicity(d, lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 1506 and by[9001].score == by[9002].score < 0.5
    assert by[9004].predicted == by[9003].predicted == 1 and by[9005].predicted == 0
    assert len({r.score for r in got if r.doc_id == 9004}) == 1
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in got if r.doc_id < 1500 and r.held_out) >= 0.99 * sum(r.held_out and r.doc_id < 1500 for r in got)
    model = toxicity.Model(np.zeros(toxicity.FEATURES), 0.0)
    assert {r.score for r in toxicity.score(d, model).collect()} == {0.5}


def test_hashes_do_not_hang_on_place():
    """A word's hash is the same in any text; words longer than a block too."""
    from trackloom.llm import hashing

    giant = b"g" * (hashing.BLOCK + 5)
    words_ = [b"a", b"ab", "é".encode(), b"abcdef", giant, b"h" * (hashing.BLOCK - 1), b"h" * hashing.BLOCK, b"abcdefg"]
    alone = {w: hashing.hashed(w + b" ", (4, 5)) for w in words_}
    raw = b"  ".join(words_ * 2) + b"   "
    start, h, heads = hashing.hashed(raw, (4, 5))
    assert [raw[a : a + len(w)] for a, w in zip(start.tolist(), words_ * 2, strict=True)] == words_ * 2
    assert h.tolist() == [alone[w][1][0] for w in words_ * 2] and len(set(h.tolist())) == len(words_)
    for k, n in enumerate((4, 5)):
        long = [w for w in words_ * 2 if len(w) > n]
        assert [(words_ * 2)[i] for i in heads[k][0]] == long
        assert heads[k][1].tolist() == [hashing.hashed(w[:n] + b" ")[1][0] for w in long]
    assert [len(x) for x in hashing.hashed(b"", (4,))[:2]] == [0, 0]


def test_language_long_and_many(spark):
    """Counts of very long texts don't wrap, and many languages are clustered apart; ties go to the first name."""
    assert language.counts(["ab " * 200_000])[0].max() >= 199_999
    whole = "Zażółć gęślą jaźń " * 150_000
    cut = language.counts([whole])[0]
    from unittest import mock

    with mock.patch.object(language, "PIECE", 1000):
        assert (language.counts([whole])[0] == cut).all()
    rng = random.Random(2)
    data = []
    for k in range(70):
        own = [chr(97 + k % 26) + chr(97 + k // 5) + chr(97 + (k * 7) % 26) for _ in range(1)] + [f"{chr(0x400 + k)}{chr(0x400 + 3 * k)}"]
        data += [(k * 100 + j, " ".join(rng.choices(own, k=20)), f"l{k:02}") for j in range(15)]
    data += [(7, data[7][1], data[7][2])] * 3000 + [(8000, "", None), (8001, whole, None)]
    got = language.language(spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("h", F.lit("x")).repartition(4)).collect()
    held = [r for r in got if r.held_out and r.doc_id < 7000]
    assert sum(r.lang_pred == f"l{r.doc_id // 100:02}" for r in held) >= 0.95 * len(held)
    assert {(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id == 8000} == {("und", 0.0, True)}
    two = spark.createDataFrame([(i, "la li lo", x) for i in range(40) for x in ("bb", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.language(two).collect()} == {"aa"}


def test_tokens_of_fresh_words():
    """Batches whose words hardly repeat go to the tokenizer whole, others by chunks; the ids are the same."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    rng = random.Random(9)
    fresh = ["".join(rng.choices("abcdefghij KL.,'", k=400)) for _ in range(60)] + [None, "", " \n"]
    own, tokenizer = token_store.ChunkEncoder(path, True), Tokenizer.from_file(path)
    for texts, remembered in ((fresh, False), ([words(rng, 300, 50) for _ in range(20)], True), (fresh[::-1], True)):
        ids, per = own.encode(texts, 2)
        want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and per.tolist() == [len(w) for w in want]
        assert bool(own.known) is remembered


def test_tokens_long_and_wide(spark, scratch):
    """Long texts in pieces, ids that don't fit, and the check of a tokenizer's parts."""
    import json

    from tokenizers import Tokenizer

    path = tokenizer_path()
    rng = random.Random(5)
    long = " \n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz'.é", k=rng.randrange(1, 9))) for _ in range(300_000))
    data = [(1, long), (2, long), (3, "short"), (4, "q" * 1_500_000 + " end")]
    token_store.write_tokens(spark.createDataFrame(data, DOC), scratch.path("t"), path, end=2, partitions=2)
    got = rows(token_store.read_tokens(scratch, spark, scratch.path("t")))
    assert got == sorted(brute.tokens(data, Tokenizer.from_file(path)), key=str)
    with pytest.raises(ValueError, match="does not fit"):
        token_store.pack(np.array([70_000]), 16)
    assert token_store.drops_white_space(path)
    changed = json.load(open(path))
    changed["normalizer"] = None
    other = f"{scratch.root.removeprefix('file://')}.json"
    Path(other).write_text(json.dumps(changed))
    assert not token_store.drops_white_space(other)
    with pytest.raises(ValueError, match="whole texts"):
        token_store.ChunkEncoder(other, True)


def test_spread_repeats_and_long(spark, scratch):
    long = "x" * 1_200_000
    data = [(1, f"shared\n{long}\nown", f"s{k}") for k in range(9)] + [(1, "shared", "s1"), (2, "", "s1"), (None, "shared\nshared \n", None)] + [(5, "shared\nrep", "s3")] * 4
    d = spark.createDataFrame(data, "doc_id long, text string, site string").withColumns({c: F.lit("x") for c in ("file", "row", "pos", "gone", "line_a")})
    assert rows(line_spread.remove_spread_lines(scratch, d)) == sorted(brute.spread(data), key=str)


def test_decontaminate_long_texts_and_items(spark, monkeypatch):
    """Pieces of long items overlap, so no window is lost; long texts are read a piece at a time; repeated items."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 50)
    rng = random.Random(4)
    item = words(rng, 400, 5000)
    items = [(1, item), (2, item), (2, item), (3, "q" * 1_300_000 + " b c"), (4, "one two")]
    w = item.split()
    data = [(k, " ".join(["zz", *w[7 * k : 7 * k + 8], "yy"])) for k in range(56)] + [(100, words(rng, 400_000, 3000) + " " + " ".join(w[40:60])), (101, "a " + "q" * 1_300_000 + " B, c"), (102, "q" * 3_000_000)]
    d, b = spark.createDataFrame(data, DOC).repartition(2), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 23, 1 << 19):
        assert rows(decontaminate.digest(decontaminate.contaminated_spans(d, b, block_bytes=block))) == sorted(brute.decontaminate(data, items), key=str)


def test_near_long_texts(spark, scratch):
    rng = random.Random(4)
    long = words(rng, 300_000, 100_000)
    data = [(1, long), (2, long + " more"), (3, "y" * 2_000_000), (4, "Y" * 2_000_000), (5, long[: len(long) // 2])]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(scratch, spark.createDataFrame(data, DOC)).collect()}
    assert got == {(r[0], r[1], r[2]) for r in brute.near(data)}


def test_near_ids_with_several_texts(spark, scratch):
    """Rows that share an id but not their text are nodes of their own."""
    rng = random.Random(6)
    a, b = words(rng, 60, 10_000), words(rng, 60, 10_000)
    data = [(5, a), (5, b), (3, a), (9, b + " more"), (9, None), (7, words(rng, 40, 10_000)), (None, a), (5, a)]
    got = rows(ngram_join.near_groups(scratch, spark.createDataFrame(data, DOC)))
    assert got == sorted([(5, 56, 3), (5, 56, 5), (3, 56, 3), (9, 57, 5), (9, 0, 9), (7, 36, 7), (None, 56, None), (5, 56, 3)], key=str)


def test_clashing_names_of_places(spark, scratch, tmp_path):
    """Extra columns named as the operators' own, or as the files' hidden one, are kept and read as nothing else."""
    names = ["_metadata", "_mix_s", "_mix_h", "_mix_doc", "file", "row", "h", "g", "document", "size", "line_a", "gone", "_file", "_row"]
    data = [(i % 40, f"text {i}\nshared", f"s{i % 11}", *(f"{c}{i}" for c in names)) for i in range(120)]
    spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names)).repartition(2).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    assert Counter(tuple(r)[: len(data[0])] for r in mixing.mix(d).collect()) == Counter(data)
    got = sharding.shard_documents(scratch, d).collect()
    brute.shard_law([(r["size"], r.shard, r.slot) for r in got])
    spread = line_spread.remove_spread_lines(scratch, d.withColumn("site", F.col("source"))).collect()
    assert len(spread) == 120 and {r.n_removed for r in spread} == {1}
    b = spark.createDataFrame([(1, "text 7"), (2, "text 9 shared")], "item_id long, text string")
    found = decontaminate.contaminated_spans(d, b, block_bytes=20).collect()
    assert Counter(tuple(r)[: len(data[0])] for r in found) == Counter(data) and sum(len(r["items"]) for r in found) == 2
