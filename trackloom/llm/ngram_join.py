"""N-gram Jaccard self-join by vertical partitioning, and the groups of documents that its links connect."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import Scratch, by_bytes, components, lookup, tidy
from trackloom.llm.hashing import BASE, hashed, joined, mixed

#: Words of a shingle, and the least similarity in percent.
SHINGLE = 5
PERCENT = 80
#: Fragments of the global shingle order.
FRAGMENTS = 8
#: Shingles in at least so many documents are heavy: they come last in the order, by ascending count. Only this
#: many heavy shingles are told apart (16 bytes each); any set of them gives the same links.
HEAVY_COUNT = 16
HEAVY_MOST = 1 << 20
#: Shingles among which a task counts repeats.
CHUNK = 1 << 21
#: Bytes of text hashed at a time.
BATCH_BYTES = 1 << 20

#: A-Z lower-cased; the white space that separates words becomes a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and how many words each text has."""
    raw, ends = joined(texts, LOWER)
    start, h, _ = hashed(raw)
    return h, np.diff(np.searchsorted(start, np.r_[0, ends]))


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes (uint64) of each text; a text of fewer words has one, of all of them."""
    w, counts = word_hashes(texts)
    salts = [np.uint64(pow(BASE, 2 * i + 3, 1 << 64)) for i in range(k)]
    n = max(0, len(w) - k + 1)
    acc = np.zeros(n, np.uint64)
    for i, c in enumerate(salts):
        acc += w[i : i + n] * c
    acc = mixed(acc)
    out, at = [], 0
    for m in counts.tolist():
        if m >= k:
            s = np.sort(acc[at : at + m - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif m:
            whole = np.full(1, m, np.uint64)
            for i in range(m):
                whole = mixed(whole + w[at + i : at + i + 1] * salts[i])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
        at += m
    return out


def pieces(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches of about BATCH_BYTES of text, with their shingle sets."""
    for p in by_bytes(batches, text_at, most=BATCH_BYTES):
        yield p, shingle_sets(p.column(text_at).to_pylist())


def heavy_shingles(scratch: Scratch, docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of heavy shingles and their place in the order. Counts all documents; a count is what tasks
    saw at least twice, so it can miss a few. At most HEAVY_MOST entries reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeats(sets: list[np.ndarray]) -> pa.RecordBatch:
            s = np.sort(np.concatenate(sets))
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            n = np.diff(np.r_[first, len(s)])
            return pa.RecordBatch.from_arrays([pa.array(s[first[n > 1]].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["t", "n"])

        held, n = [], 0
        for _, sets in pieces(batches, 0):
            held += sets
            n += sum(map(len, sets))
            if n >= CHUNK:
                yield repeats(held)
                held, n = [], 0
        if n:
            yield repeats(held)

    t = docs.select("text").mapInArrow(tidy(count), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_COUNT)
    t = t.orderBy(F.desc("n"), "t").limit(HEAVY_MOST).toArrow()
    token, n = t.column("t").to_numpy().view(np.uint64), t.column("n").to_numpy()
    by = np.lexsort((token, n))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    order = np.argsort(token)
    return token[order], place[order]


def heavy_places(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Place of each shingle among the heavy ones, -1 for others."""
    token, place = heavy
    if not len(token) or not len(s):
        return np.full(len(s), -1)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    return np.where(token[at] == s, place[at], -1)


def prefixes(docs: DataFrame, heavy, percent: int) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, tokens, cold): set size, a digest of the set, and its first shingles in the global
    order, of which a set that is similar enough must have at least one; so many of them are not heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, sets in pieces(batches, 1):
            sizes, sig, flat, lengths, cold = [len(s) for s in sets], np.zeros((len(sets), 2), np.int64), [], [], []
            places = heavy_places(np.concatenate(sets), heavy.value)
            at = 0
            for k, s in enumerate(sets):
                n = len(s)
                place = places[at : at + n]
                at += n
                if n:
                    sig[k] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                want = n - (percent * n + 99) // 100 + 1 if n else 0
                is_heavy = place >= 0
                got = s[~is_heavy][:want]
                cold.append(len(got))
                if len(got) < want:
                    h = s[is_heavy]
                    got = np.r_[got, h[np.argsort(place[is_heavy])][: want - len(got)]]
                flat.append(got)
                lengths.append(len(got))
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(sizes, pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1]), tokens, pa.array(cold, pa.int64())], ["doc_id", "n", "sig_a", "sig_b", "tokens", "cold"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, sig_a long, sig_b long, tokens array<long>, cold long")


def segments(docs: DataFrame, heavy) -> DataFrame:
    """(e, fragment, segment): each set cut along the global order into fragments; heavy shingles are the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - (FRAGMENTS - 1).bit_length())
        for p, sets in pieces(batches, 1):
            places = heavy_places(np.concatenate(sets), heavy.value)
            ids, parts, segs, at = [], [], [], 0
            for e, s in zip(p.column(0).to_pylist(), sets, strict=True):
                is_heavy = places[at : at + len(s)] >= 0
                at += len(s)
                cold = s[~is_heavy]
                cut = np.searchsorted(cold >> shift, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                for f, seg in [*((f, cold[cut[f] : cut[f + 1]]) for f in range(FRAGMENTS)), (FRAGMENTS, s[is_heavy])]:
                    if len(seg):
                        ids.append(e)
                        parts.append(f)
                        segs.append(seg)
            ends = np.cumsum([0, *map(len, segs)])
            flat = np.concatenate(segs).view(np.int64) if segs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["e", "fragment", "segment"])

    return docs.mapInArrow(tidy(run), "e long, fragment int, segment array<long>")


def sizes_fit(nx: Column, ny: Column, percent: int) -> Column:
    return 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)


def may_link(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Whether two sets whose first common shingle is at these places (from 0) can still be similar enough."""
    return (100 + percent) * F.least(nx - px, ny - py) >= percent * (nx + ny)


def enough(m: Column, nx: Column, ny: Column, percent: int) -> Column:
    """Whether two sets with ``m`` common shingles among both their prefixes can be similar enough.

    Of the set whose prefix ends first in the order, every common shingle of the prefix is one of the m; the rest of
    the set holds ceil(percent * n / 100) - 1 others.
    """
    outside = F.ceil(percent * F.greatest(nx, ny) / F.lit(100)) - 1
    return (100 + percent) * (m + outside) >= percent * (nx + ny)


def verified(scratch: Scratch, docs: DataFrame, pairs: DataFrame, heavy, percent: int, name: str) -> DataFrame:
    """Links among ``pairs`` (x, nx, y, ny): overlaps are counted in each fragment and summed per pair."""
    ids = scratch.save(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct(), f"{name}ids")
    held = lookup(docs.select("doc_id", "text"), ids, ["doc_id"])
    seg = scratch.save(segments(held, heavy), f"{name}segments")
    left = pairs.join(seg.select(F.col("e").alias("x"), "fragment", F.col("segment").alias("left")), "x")
    both = left.join(seg.select(F.col("e").alias("y"), "fragment", F.col("segment").alias("right")), ["y", "fragment"])
    partial = both.select("x", "y", "nx", "ny", "fragment", F.size(F.array_intersect("left", "right")).cast("long").alias("o"))
    # a repeated row of a document brings the same partial overlap again
    partial = partial.groupBy("x", "y", "nx", "ny", "fragment").agg(F.max("o").alias("o"))
    total = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("o").alias("o"))
    links = total.where(100 * F.col("o") >= percent * (F.col("nx") + F.col("ny") - F.col("o")))
    out = scratch.save(links.select(F.col("x").alias("a"), F.col("y").alias("b")), name)
    scratch.drop(f"{name}ids", f"{name}segments")
    return out


def near_groups(scratch: Scratch, documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Two sets link if 100 * intersection >= percent * union. Sets without shingles link with nothing. Equal sets are
    one entity, so copies are never paired. Shingles have one global order: the rare by hash, then the heavy by count.
    A pair that links shares a shingle among the first ones of both, and is found in that shingle's bucket. First each
    bucket's members are paired with one member only, the one with the fewest rarer shingles, as an original has fewer
    of its own than its altered copies; documents that these links join need no pairing among themselves. Then every
    pair of a bucket whose members are still apart is tried, if the places and the number of common shingles at the
    beginnings of both allow a link. A pair's overlap is counted in each fragment of the order and summed.

    Links are exact up to the 64-bit hashes that stand for shingles. Null, empty and blank texts have no words. A row
    with a null doc_id gets a null component and links with nothing. Repeated rows are each returned. Rows that share a
    doc_id but not their set are nodes of their own. A text of any length is hashed whole, in pieces. An empty table
    gives an empty result; other columns are not looked at.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    heavy = spark.sparkContext.broadcast(heavy_shingles(scratch, docs))
    whole = scratch.save(prefixes(docs, heavy, percent), "prefixes")
    sig = ["sig_a", "sig_b"]
    sets = F.struct("n", *sig)
    clash = whole.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).where("lo <> hi")
    if clash.take(1):
        scratch.drop("prefixes")
        return renamed_groups(scratch, docs, percent)
    has = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    copies = whole.where(has).groupBy(*sig).agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1").select(*sig, "least")
    copies = scratch.save(copies, "copies")
    joined = lookup(whole, copies, sig, "left").withColumn("e", F.when(has, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")))
    entries = joined.where(has & (F.col("e") == F.col("doc_id"))).select("e", "n", "cold", F.posexplode("tokens").alias("p", "t"))
    entries = entries.withColumn("heavy", F.col("p") >= F.col("cold")).drop("cold")
    by = Window.partitionBy("t").orderBy("p", "e")
    first = F.first(F.struct("p", "e", "n")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rare = entries.where(~F.col("heavy")).withColumns({"first": first, "after": F.lead("e").over(by)})
    rare = rare.where((F.col("first.e") != F.col("e")) | F.col("after").isNotNull()).drop("after")
    # a heavy shingle's bucket can hold a share of all documents: its first member comes from partial minima, and a
    # join, whose large partitions Spark splits, brings it to the others
    many = entries.where("heavy")
    heads = many.groupBy("t").agg(F.min(F.struct("p", "e", "n")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    bucket = rare.unionByName(many.join(heads, "t")).drop("heavy")
    bucket = scratch.save(bucket, "buckets")
    narrow = scratch.save(joined.select("doc_id", F.col("n").alias("n_shingles"), "e"), "narrow")
    scratch.drop("copies")

    star = bucket.where(F.col("first.e") != F.col("e")).select(F.col("first.e").alias("x"), F.col("first.n").alias("nx"), F.col("e").alias("y"), F.col("n").alias("ny"))
    star = star.where(sizes_fit(F.col("nx"), F.col("ny"), percent)).groupBy("x", "nx", "y", "ny").agg(F.count("*").alias("m"))
    star = scratch.save(star.where(enough(F.col("m"), F.col("nx"), F.col("ny"), percent)).drop("m"), "star")
    links = verified(scratch, docs, star, heavy, percent, "links1")
    roots = scratch.save(components(scratch, links, "near"), "roots")

    b = lookup(bucket.drop("first"), roots.withColumnRenamed("node", "e"), ["e"], "left").withColumn("c", F.coalesce("root", "e")).drop("root")
    b = scratch.save(b, "labelled")
    apart = b.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("n0")).where("lo < hi").select("t", "n0")
    # a member too far down its set for the smallest partner that the bucket could offer pairs with none
    smallest = F.greatest(F.col("n0"), F.ceil(percent * F.col("n") / F.lit(100)))
    b = b.join(apart, "t").where((100 + percent) * (F.col("n") - F.col("p")) >= percent * (F.col("n") + smallest))
    l, r = (b.select("t", *(F.col(c).alias(c + side) for c in "enpc")) for side in "xy")
    rest = l.join(r, "t").where((F.col("cx") != F.col("cy")) & (F.col("ex") < F.col("ey")) & sizes_fit(F.col("nx"), F.col("ny"), percent) & may_link(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"), percent))
    rest = rest.select(F.col("ex").alias("x"), "nx", F.col("ey").alias("y"), "ny").distinct()
    begin = whole.select(F.col("doc_id").alias("x"), F.col("tokens").alias("left")), whole.select(F.col("doc_id").alias("y"), F.col("tokens").alias("right"))
    rest = scratch.save(rest.join(star.select("x", "y"), ["x", "y"], "left_anti"), "tried").join(begin[0], "x").join(begin[1], "y")
    rest = rest.where(enough(F.size(F.array_intersect("left", "right")), F.col("nx"), F.col("ny"), percent)).select("x", "nx", "y", "ny").distinct()
    rest = scratch.save(rest, "rest")
    scratch.drop("buckets", "labelled", "prefixes", "tried")
    if rest.take(1):
        more = verified(scratch, docs, rest, heavy, percent, "links2")
        roots = scratch.save(components(scratch, links.unionByName(more), "near"), "roots2")
    out = lookup(narrow, roots.withColumnRenamed("node", "e"), ["e"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "e").alias("component_id"))


def renamed_groups(scratch: Scratch, docs: DataFrame, percent: int) -> DataFrame:
    """``near_groups`` where an id names several texts: each id and text gets a number of its own for the join."""
    own = docs.withColumn("own", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    inner = Scratch(scratch.spark, "renamed")
    groups = scratch.save(near_groups(inner, own.select(F.col("own").alias("doc_id"), "text"), percent).withColumnsRenamed({"doc_id": "own", "component_id": "root"}), "groups")
    names = scratch.save(own.where(F.col("own").isNotNull()).select("own", "doc_id").distinct(), "names")
    named = groups.join(names, "own", "left")
    least = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return lookup(named, scratch.save(least, "least"), ["root"], "left").select("doc_id", "n_shingles", "component_id")
