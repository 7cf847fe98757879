"""Mixing sources to target weights by Pfair scheduling: released blocks with deadlines, earliest deadline first."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import BROADCAST_ROWS, Scratch, lookup, row_keyed, unit_key

#: Rows of a block, the unit that is scheduled, and blocks about which it grows with the rows instead of their number.
BLOCK_ROWS = 16
MOST_BLOCKS = 1 << 20
#: Parts to which ``whole_weights`` rounds where no other number is given.
PERIOD = 1000
#: Exponent of a source's row count in its weight where no weights are given: between equal (0) and natural (1).
TEMPERATURE = 0.5
#: Blocks of a source whose places are one row of the schedule's table, and blocks up to which that table is broadcast.
PACK = 256
BROADCAST_BLOCKS = 2_000_000
NEW = ["mix_block", "mix_row", "mix_phase", "mix_release", "mix_deadline", "mix_slot"]
#: Hash buckets in which the rows of one source are numbered, so that a hot source is spread over tasks, at least, and
#: rows of the largest source's buckets from which there are more of them.
RANK_BUCKETS = 1024
BUCKET_ROWS = 1 << 20


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole numbers in exactly the same proportions; a float stands for the decimal it prints as."""
    parts = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    if any(w <= 0 for w in parts.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in parts.values()))
    whole = {s: w.numerator * (scale // w.denominator) for s, w in parts.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: w // common for s, w in whole.items()}


def whole_weights(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights rounded to positive whole numbers that add up to ``period``, by largest remainders.

    A source whose share is below one part gets 1; the others split the rest.
    """
    if len(weights) > period:
        raise ValueError("no more sources than the period has parts")
    rest, out = exact_weights(weights), {}
    while small := [s for s in rest if rest[s] * (period - len(out)) < sum(rest.values())]:
        # a share that has become small only by the others' least parts gets its own next
        out |= dict.fromkeys(small, 1)
        rest = {s: w for s, w in rest.items() if s not in out}
    spare, total = period - len(out), sum(rest.values())
    out |= {s: w * spare // total for s, w in rest.items()}
    for s in sorted(rest, key=lambda s: (-(rest[s] * spare % total), s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def windows(weight: int, period: int, block: int) -> tuple[int, int]:
    """Release time and deadline of a source's ``block``-th block, in slots: it must run in [release, deadline)."""
    return block * period // weight, -(-(block + 1) * period // weight)


def earliest_first(order: Iterable[str], weights: Mapping[str, int], period: int) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of slot after slot without end: earliest deadline first among the released.

    ``order`` has the sources by falling weight, which also breaks ties, and ``period`` is the sum of their weights.
    It is read only as far as sources get their first turn.
    """
    fresh = iter(order)
    head = next(fresh, None)
    waiting: list[tuple[int, str, int]] = []
    ready: list[tuple[int, int, str, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (windows(weights[s], period, k)[1], -weights[s], s, k))
        first = None if head is None else (windows(weights[head], period, 0)[1], -weights[head], head, 0)
        if first and (not ready or first < ready[0]):
            (deadline, _, s, k), head = first, next(fresh, None)
        else:
            deadline, _, s, k = heapq.heappop(ready)
        assert slot < deadline
        yield s, k, k * period // weights[s], deadline
        heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
        slot += 1


def falling(weights: Mapping[str, int]) -> list[str]:
    return sorted(weights, key=lambda s: (-weights[s], s))


def one_period(weights: Mapping[str, int]) -> list[tuple[str, int]]:
    """(source, block) of each slot of the first period, the sum of the weights. Then every source has had its weight."""
    period = sum(weights.values())
    turns = earliest_first(falling(weights), weights, period)
    return [next(turns)[:2] for _ in range(period)]


def schedule(weights: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, tuple[array, array, array, array]]:
    """Phase, release, deadline and slot of every block of each source, until every source has run all its ``blocks``.

    A phase ends when a source has run its last block; the rest go on with the same weights, which then are larger
    shares. In a phase every source is less than one block from its exact share at every slot. Releases and deadlines
    count from the phase's start. The time is in proportion to the blocks, and 28 bytes are kept of each.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    out = {s: (array("i"), array("q"), array("q"), array("q")) for s in left}
    order, period = falling({s: weights[s] for s in left}), sum(weights[s] for s in left)
    phase = slot = 0
    while left:
        for s, _, release, deadline in earliest_first((s for s in order if s in left), weights, period):
            for column, value in zip(out[s], (phase, release, deadline, slot), strict=True):
                column.append(value)
            slot += 1
            left[s] -= 1
            if not left[s]:
                break
        del left[s]
        period -= weights[s]
        phase += 1
        if 2 * len(left) < len(order):
            order = [s for s in order if s in left]
    return out


def packed(places: Mapping[str, tuple[array, array, array, array]]) -> pa.Table:
    """The schedule in rows of up to PACK blocks of a source: _mix_s, _mix_c (number of the row), and an array per column."""
    cuts = [(s, c) for s, columns in places.items() for c in range(-(-len(columns[0]) // PACK))]
    names = ("mix_phase", "mix_release", "mix_deadline", "mix_slot")
    ends = [0]
    for s, c in cuts:
        ends.append(ends[-1] + min(PACK, len(places[s][0]) - c * PACK))
    lists = {}
    for k, name in enumerate(names):
        flat = array("i" if k == 0 else "q")
        for columns in places.values():
            flat.extend(columns[k])
        lists[f"_{name}"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat), pa.int32() if k == 0 else pa.int64()))
    return pa.table({"_mix_s": pa.array([s for s, _ in cuts], pa.string()), "_mix_c": pa.array([c for _, c in cuts], pa.int64()), **lists})


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int | None = None, period: int | None = None, temperature: float = TEMPERATURE, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, ...) in the order of the mix, each with its place; none is left out or repeated.

    New columns: mix_block (number of the row's block in its source), mix_row (place in the block), mix_phase,
    mix_release and mix_deadline (slots within the phase), mix_slot (the block's slot in the whole schedule). The
    result's partitions, read one after the other, are in order of (mix_slot, mix_row), so files written of it hold the
    mixed corpus. Columns of these names in ``docs`` are replaced. Rows of a source are first put in order of a hash of
    doc_id, then of their place in the files they are read from, so rows that repeat an id or have none are dealt like
    others. A null source is a source of its own. Texts of any length are moved once, and looked at by nothing.

    ``weights`` names target weights by source and must have every source; without it a source's weight is its row count
    to the power ``temperature``. Weights hold exactly, or rounded to parts of ``period`` if that is given, with so many
    sources at most. ``block_rows`` is BLOCK_ROWS, and more where there would be over MOST_BLOCKS blocks. Counts per source
    and 28 bytes a block are held by the driver. An empty table gives an empty result.

    Two narrow passes over doc_id and source number the rows: they find, for each source, bucket and output partition, the
    first row there. So the documents themselves are exchanged once, straight to their place.
    """
    spark, docs = docs.sparkSession, docs.drop(*NEW)
    scratch = scratch or Scratch(spark, "mix")
    whole_rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_mix_doc"), "doc_id", "source")
    d = row_keyed(scratch, whole_rows, "_mix_f", "_mix_i").withColumns({"_mix_s": unit_key(F.col("source")), "_mix_h": F.xxhash64("doc_id", F.lit(29))})
    counts = {r["_mix_s"]: r["n"] for r in d.groupBy("_mix_s").agg(F.count("*").alias("n")).collect()}
    if weights is None:
        share = {s: float(n) ** temperature for s, n in counts.items()}
    else:
        named = {"null" if s is None else f"s:{s}": w for s, w in weights.items()}
        if missing := set(counts) - set(named):
            raise ValueError(f"no weight for {sorted(missing)}")
        share = {s: named[s] for s in counts}
    whole = exact_weights(share) if period is None else whole_weights(share, period) if share else {}
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS))
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    places = spark.createDataFrame(packed(schedule(whole, blocks)))
    few = sum(blocks.values()) <= BROADCAST_BLOCKS
    places = F.broadcast(places) if few else places
    outputs = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def placed(rows: DataFrame, at: Column, columns: list[str]) -> DataFrame:
        """Rows with their block, place in it, and these columns of the schedule; ``at`` numbers a source's rows from 0."""
        x = rows.withColumns({"mix_block": F.floor(at / block_rows).cast("long"), "mix_row": (at % block_rows).cast("int")})
        x = x.withColumn("_mix_c", F.expr(f"mix_block div {PACK}")).join(places, ["_mix_s", "_mix_c"])
        return x.withColumns({c: F.element_at(f"_{c}", (F.col("mix_block") % PACK + 1).cast("int")) for c in columns})

    # rows by bucket, numbered in it; a row's bucket hangs on the row, not on its id alone
    buckets = max(16, min(RANK_BUCKETS, BROADCAST_ROWS // 2 // max(1, len(counts))), 1 << (max(counts.values(), default=1) // BUCKET_ROWS).bit_length())
    order = ["_mix_h", "_mix_f", "_mix_i"]
    d = d.withColumn("_mix_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    cells = d.groupBy("_mix_s", "_mix_b").agg(F.count("*").alias("n"))
    cells = cells.select("_mix_s", "_mix_b", (F.sum("n").over(Window.partitionBy("_mix_s").orderBy("_mix_b")) - F.col("n")).alias("_mix_off"))
    cells = scratch.save(cells, "cells")
    ranked = d.select("_mix_s", "_mix_b", *order).withColumn("_mix_r", F.row_number().over(Window.partitionBy("_mix_s", "_mix_b").orderBy(*order)) - 1)
    ranked = lookup(ranked, cells, ["_mix_s", "_mix_b"]).withColumn("_mix_at", F.col("_mix_off") + F.col("_mix_r"))
    ranked = placed(ranked, F.col("_mix_at"), ["mix_slot"]).withColumn("_mix_k", F.expr(f"int(mix_slot * {outputs} div {max(1, sum(blocks.values()))})"))
    firsts = ranked.groupBy("_mix_s", "_mix_b", "_mix_k").agg(F.min(F.struct(*order)).alias("low"), F.min("_mix_at").alias("at"))
    firsts = firsts.groupBy("_mix_s", "_mix_b").agg(F.sort_array(F.collect_list(F.struct("low", "at", F.col("_mix_k").alias("k")))).alias("_mix_cuts"))

    x = lookup(d.drop("doc_id", "source"), scratch.save(firsts, "firsts"), ["_mix_s", "_mix_b"])
    me = F.struct(*order)
    cut = F.element_at("_mix_cuts", F.size(F.filter("_mix_cuts", lambda c: c["low"] <= me)))
    x = x.withColumns({"_mix_at": cut["at"], "_mix_k": cut["k"]}).drop("_mix_cuts")
    x = x.repartitionById(outputs, F.col("_mix_k"))
    nth = F.row_number().over(Window.partitionBy("_mix_k", "_mix_s", "_mix_b").orderBy(*order)) - 1
    x = placed(x.withColumn("_mix_at", F.col("_mix_at") + nth), F.col("_mix_at"), NEW[2:])
    x = x if few else x.repartitionById(outputs, F.col("_mix_k"))
    return x.sortWithinPartitions("mix_slot", "mix_row").select("_mix_doc.*", *NEW)


def mix_documents(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """Write the mixed corpus, whole rows in the order of the mix, as ``mixed`` of ``scratch`` and read it back."""
    return scratch.save(mix(documents, scratch=scratch), "mixed")
