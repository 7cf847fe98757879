"""What the corpus operators share: shared scratch tables, size-checked lookups and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.shipping import ship
from trackloom.sources.files import remove, scratch, shared_root  # noqa: F401

#: Rows of a batch that goes to Python: texts are long, and a worker and its executor both hold whole batches.
BATCH_ROWS = 1_000
#: Bytes of text that an operator works on at a time; a longer text is worked on alone.
BATCH_BYTES = 4 << 20
#: A lookup side of at most this many narrow rows (a few longs each, so under about 40 MB) is broadcast.
BROADCAST_ROWS = 500_000


def prepare(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, and keep the session's Arrow batches to BATCH_ROWS rows."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    ship(spark)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function for mapInArrow; after a task, its worker gives freed memory back, as workers stay for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not glibc

    return run


def by_bytes(batches: Iterator[pa.RecordBatch], text_at: int, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of up to ``rows`` rows and about ``most`` bytes of the text column; a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, side="right"))))
            yield b.slice(at, stop - at)
            at = stop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run of an operator in the shared folder. They cut lineage and survive lost executors.

    Those that a result is read from stay until ``trackloom.sources.files.cleanup`` removes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = scratch(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


def lookup(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a saved narrow table: broadcast if its counted rows are few enough, else a shuffled join.

    The shuffled join deals out by all of ``on``; Spark splits its oversized partitions (skew join).
    """
    return big.join(F.broadcast(small) if small.count() <= most else small, on, how)


def row_keyed(scratch: Scratch, docs: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` with two long columns that no two rows share: a hash of the row's file path, and its number in the file.

    They are the same whenever the rows are read, however the scan is split. Rows that are not plainly those of Parquet
    files (columns and filters of one scan) are written to ``scratch`` first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()

    def keyed(d: DataFrame) -> DataFrame:
        at = d.metadataColumn("_metadata")  # the files' own, even if there is a column of that name
        return d.select("*", F.xxhash64(at["file_path"]).alias(file), at["row_index"].alias(row))

    if plan.nodeName() == "LogicalRelation":
        try:
            return keyed(docs)
        except AnalysisException:
            pass  # a format without row numbers
    return keyed(scratch.save(docs, "rows"))


def unit_key(column: Column) -> Column:
    """A string key that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("s:"), column.cast("string")), F.lit("null"))


def doc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks held-out rows. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that links reach.

    Alternates large-star and small-star steps until no edge changes; each round is a written table, so lineage
    stays short. Each step aggregates by node before it emits, so it makes as many rows as it has edges.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    last, kept = None, f"{name}0"
    for k in range(1, most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}{k}")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(kept)
        e, kept = nxt, f"{name}{k}"
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
