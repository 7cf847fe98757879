"""Cross-site boilerplate removal by the number of distinct sites of a line, from HyperLogLog sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, Scratch, lookup, row_keyed

#: log2 of a sketch's registers: a relative standard error of 6.5 %.
LG_K = 8
#: Estimates from threshold / BAND up to threshold * BAND are counted exactly; over 7 standard errors either way.
BAND = 2.0
#: A line is known by two 64-bit hashes, so by 128 bits.
LINE = ["line_a", "line_b"]
ROW = ["file", "row"]


def lines_of(docs: DataFrame) -> DataFrame:
    """(file, row, site, pos, line_a, line_b) for each non-blank line of rows that have keys, text and site; a line is
    compared without outer blanks."""
    line = F.regexp_replace("line", r"^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$", "")
    return (
        docs.select(*ROW, "site", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"))
        .withColumn("line", line)
        .where(F.col("line") != "")
        .select(*ROW, "site", "pos", F.xxhash64("line").alias("line_a"), F.xxhash64(F.lit("b"), "line").alias("line_b"))
    )


def spread_lines(scratch: Scratch, lines: DataFrame, min_sites: int) -> DataFrame:
    """Saved table of the keys of lines that at least ``min_sites`` distinct sites have.

    Sketches are built per line before the exchange and merged after it, so a line in every document costs one
    sketch per task. Lines whose estimate is near the threshold get an exact distinct count.
    """
    sited = lines.where(F.col("site").isNotNull())
    sketches = sited.groupBy(*LINE).agg(F.hll_sketch_agg(F.xxhash64("site"), LG_K).alias("sketch"))
    est = scratch.save(sketches.select(*LINE, F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites / BAND), "spread")
    near = scratch.save(est.where(F.col("sites") <= min_sites * BAND).select(*LINE), "near")
    exact = lookup(sited.select(*LINE, "site"), near, LINE).distinct().groupBy(*LINE).agg(F.count("*").alias("sites"))
    over = exact.where(F.col("sites") >= min_sites).select(*LINE)
    return scratch.save(over.unionByName(est.where(F.col("sites") > min_sites * BAND).select(*LINE)), "over")


def remove_spread_lines(scratch: Scratch, docs: DataFrame, min_sites: int = 8) -> DataFrame:
    """Drop cross-site boilerplate lines from ``docs`` (doc_id, text, site).

    Returns doc_id, text (kept lines joined by newline; null stays null), n_lines and n_removed (longs; 0 for null).
    A line counts once per site however often it occurs there; a null site counts as none, but its rows are cleaned
    too. Blank lines are never boilerplate, and an empty text is one blank line. Repeated rows are each kept, and
    rows that share an id are cleaned apart. A text or line of any length is looked at whole. An empty table gives an
    empty result; other columns are not looked at. Lines are hashed once, into a saved table that all steps read.
    """
    docs = row_keyed(scratch, docs.select("doc_id", "text", "site"), *ROW)
    lines = scratch.save(lines_of(docs), "lines")
    over = spread_lines(scratch, lines, min_sites)
    gone = lookup(lines.select(*ROW, "pos", *LINE), over, LINE, "left_semi").groupBy(*ROW).agg(F.collect_set("pos").alias("gone"))
    gone = scratch.save(gone, "gone")
    few = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_ROWS
    keyed = docs.join(F.broadcast(gone) if few else gone, ROW, "left")
    parts = F.split(F.col("text"), "\n", -1)
    kept = F.filter(parts, lambda _, i: ~F.array_contains("gone", i))
    return keyed.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size(F.when(F.col("text").isNotNull(), parts)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("gone").isNotNull(), F.col("gone"))), F.lit(0)).cast("long").alias("n_removed"),
    )
