"""Sharding by histogram sort: exact byte counts below candidate key boundaries choose the splitters, then one exchange."""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import Scratch, row_keyed

#: Candidate boundaries that one counting round may return to the driver.
PROBES = 1 << 16
#: Bytes of a part, about, and parts that the driver keeps splitters of; beyond so many, parts grow with the input.
PART_BYTES = 256 << 20
MOST_PARTS = 1 << 16
TOP_BITS = 12


@dataclass
class Splitter:
    key: int  # first key above the boundary, in the combined key space
    bytes_below: int
    rows_below: int


@dataclass
class KeySpace:
    """Two non-negative long columns ``h`` and ``g``, shifted to 0 and read as one number of ``bits_h + bits_g`` bits."""

    h0: int
    g0: int
    bits_h: int
    bits_g: int

    @property
    def bits(self) -> int:
        return self.bits_h + self.bits_g

    def prefix(self, bits: int) -> tuple[Column, Column]:
        """The first ``bits`` bits of a row's key as two longs: those of h and those of g."""
        h, g = F.col("h") - F.lit(self.h0), F.col("g") - F.lit(self.g0)
        if bits <= self.bits_h:
            return F.shiftright(h, self.bits_h - bits), F.lit(0).cast("long")
        return h, F.shiftright(g, self.bits - bits)

    def join(self, a: int, b: int, bits: int) -> int:
        return a if bits <= self.bits_h else (a << (bits - self.bits_h)) | b

    def split(self, key: int) -> tuple[int, int]:
        """Bounds of the columns for a full-length key."""
        return (key >> self.bits_g) + self.h0, (key & ((1 << self.bits_g) - 1)) + self.g0


def key_space(keys: DataFrame) -> tuple[KeySpace, int, int]:
    """The key space, total bytes and rows of ``keys`` (h, g, size)."""
    x = keys.agg(F.min("h"), F.max("h"), F.min("g"), F.max("g"), F.sum("size"), F.count("*")).first()
    if not x[5]:
        return KeySpace(0, 0, 1, 1), 0, 0
    return KeySpace(x[0], x[2], max(1, (x[1] - x[0]).bit_length()), max(1, (x[3] - x[2]).bit_length())), x[4], x[5]


def splitters(keys: DataFrame, space: KeySpace, total: int, rows: int, parts: int, shards: int, tolerance: float) -> list[Splitter]:
    """``parts - 1`` splitters at equal bytes; those between shards meet ``tolerance`` of a shard's bytes.

    Each round counts the exact bytes and rows of all keys below the probes of the intervals that still hold an
    unmet target, and narrows these to one probe's width. A boundary falls inside a group of equal ``h`` only when
    both ends of the group miss the tolerance. A target whose interval is one row, or one key, takes the nearer end.
    """
    each = parts // shards
    allowed = [(tolerance if i % each == 0 else 0.25 / each) * total / shards for i in range(parts)]
    found: dict[int, Splitter] = {}
    # interval prefix -> (bytes below, rows below, targets in it)
    open_: dict[int, tuple[int, int, list[int]]] = {0: (0, 0, list(range(1, parts)))}
    depth = 0
    while open_:
        step = min(TOP_BITS, max(3, int(math.log2(PROBES / len(open_)))))
        edge = space.bits_h if depth < space.bits_h else space.bits
        deeper = min(edge, depth + step)
        counted = keys
        if depth:
            a, b = space.prefix(depth)
            if depth <= space.bits_h:
                counted = keys.where(a.isin(list(open_)))
            else:
                low = depth - space.bits_h
                by_h: dict[int, list[int]] = {}
                for p in open_:
                    by_h.setdefault(p >> low, []).append(p & ((1 << low) - 1))
                hit = F.lit(False)
                for h, gs in by_h.items():
                    hit = hit | ((a == h) & b.isin(gs))
                counted = keys.where(hit)
        a, b = space.prefix(deeper)
        seen = counted.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        inside: dict[int, list[tuple[int, int, int]]] = {}
        for r in seen:
            p = space.join(r["a"], r["b"], deeper)
            inside.setdefault(p >> (deeper - depth), []).append((p, r["s"], r["n"]))
        narrower: dict[int, tuple[int, int, list[int]]] = {}
        for prefix, (bytes_, rows_, targets) in open_.items():
            cells = sorted(inside.get(prefix, []))
            ends, at_b, at_r = [], bytes_, rows_
            for p, s, n in cells:
                ends.append((at_b + s, at_r + n))
                at_b, at_r = at_b + s, at_r + n
            for i in targets:
                goal = i * total // parts
                k = min(bisect_left(ends, (goal, 0)), len(cells) - 1)
                p, s, n = cells[k]
                low_b, low_r = ends[k][0] - s, ends[k][1] - n
                lower, upper = goal - low_b, ends[k][0] - goal
                if min(abs(lower), abs(upper)) <= allowed[i] or n == 1 or deeper == space.bits:
                    below = lower <= upper
                    cut = (p if below else p + 1) << (space.bits - deeper)
                    found[i] = Splitter(cut, low_b if below else ends[k][0], low_r if below else ends[k][1])
                else:
                    narrower.setdefault(p, (low_b, low_r, []))[2].append(i)
        open_, depth = narrower, deeper
    return [found[i] for i in range(1, parts)]


def placed(docs: DataFrame, space: KeySpace, cuts: list[Splitter], parts: int) -> DataFrame:
    """Add ``part`` (how many splitters are at or below a row's key) and ``first_row`` (rows of all parts before it).

    The splitters go out as a table by the key's first 12 bits: 4096 rows and ``parts`` splitters at most.
    """
    top = min(TOP_BITS, space.bits_h)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(cuts):
        by.setdefault(min(c.key >> (space.bits - top), (1 << top) - 1), []).append(i)
    firsts = [0, *(c.rows_below for c in cuts)]
    inline, base = [], 0
    for b in range(1 << top):
        mine = by.get(b, [])
        inline.append({"b": b, "base": base, "cuts": [dict(zip("hg", space.split(cuts[i].key), strict=True)) for i in mine], "firsts": firsts[base : base + len(mine) + 1]})
        base += len(mine)
    kind = "array<struct<b:bigint,base:int,cuts:array<struct<h:decimal(20,0),g:decimal(20,0)>>,firsts:array<bigint>>>"
    lut = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(inline)), kind)))
    me = F.struct(F.col("h").cast("decimal(20,0)").alias("h"), F.col("g").cast("decimal(20,0)").alias("g"))
    d = docs.withColumn("b", space.prefix(top)[0]).join(F.broadcast(lut), "b")
    d = d.withColumn("over", F.size(F.filter("cuts", lambda c: c <= me)))
    return d.withColumns({"part": F.col("base") + F.col("over"), "first_row": F.element_at("firsts", F.col("over") + 1)}).drop("b", "base", "cuts", "firsts", "over")


def histogram_shards(docs: DataFrame, keys: DataFrame, shards: int = 16, tolerance: float = 0.002) -> DataFrame:
    """Put the rows of ``docs`` into ``shards`` shards of near equal bytes; adds ``shard`` and ``slot``.

    ``docs`` and ``keys`` hold the non-negative longs ``h`` and ``g`` (the sort key; rows of equal ``h`` are a group)
    and ``size``. Shards are consecutive ranges of the key; each is cut further into parts, so that the one exchange
    deals a shard to many tasks. ``slot`` counts from 0 without gaps in each shard, in key order. Rows with equal
    (h, g) stay together, so g should tell rows apart. Shards can be empty if there are fewer rows than shards. A row
    is never cut, so a very long text makes its shard longer by as much. An empty table gives an empty result.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    space, total, rows = key_space(keys)
    each = min(MOST_PARTS // shards, max(1, math.ceil(max(4 * n, total / PART_BYTES) / shards)))
    parts = shards * each
    cuts = splitters(keys, space, total, rows, parts, shards, tolerance) if rows else [Splitter(0, 0, 0)] * (parts - 1)
    starts = [0, *(cuts[s * each - 1].rows_below for s in range(1, shards))]
    inside = Window.partitionBy("part").orderBy("h", "g")
    start = F.element_at(F.array(*map(F.lit, starts)), F.col("shard") + 1)
    return (
        placed(docs, space, cuts, parts)
        .withColumn("shard", F.floor(F.col("part") / F.lit(each)).cast("int"))
        .withColumn("slot", (F.col("first_row") + F.row_number().over(inside) - 1 - start).cast("long"))
        .drop("part", "first_row")
    )


def text_size(docs: DataFrame) -> DataFrame:
    """Add size and text_crc32 of the text's UTF-8 bytes; null has none."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumns({"size": (F.octet_length(raw) + F.lit(1)).cast("long"), "text_crc32": F.crc32(raw)})


def shard_documents(scratch: Scratch, documents: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The documents themselves, with all their columns, are written in their shards below ``shards`` of ``scratch``: a
    folder per shard, of rows (document, slot); the result is read from there. Law ``bytes``. Equal texts are a group,
    which is cut only where a shard needs it, between any two of its rows, repeated ones too. Null text has size 1 and
    the crc32 of no bytes; a null id is a value like any other; a very long text is a row like any other; an empty
    table gives an empty result. Other columns of the input are kept, and clash with nothing.
    """
    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document"), "doc_id", "text")
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1)
    g = F.shiftrightunsigned(F.xxhash64("doc_id", "file", "row"), 1)
    keyed = text_size(row_keyed(scratch, whole, "file", "row")).select("document", h.alias("h"), g.alias("g"), "size")
    keys = scratch.save(keyed.select("h", "g", "size"), "keys")
    placed_ = histogram_shards(keyed, keys, shards).select("document", "slot", "shard")
    placed_.write.mode("overwrite").partitionBy("shard").parquet(scratch.path("shards"))
    out = scratch.spark.read.schema(placed_.schema).parquet(scratch.path("shards"))
    out = out.select(F.col("document.doc_id").alias("doc_id"), F.col("document.text").alias("text"), "shard", "slot")
    return text_size(out).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
