"""A training corpus from raw documents: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last also each row's place. ``run``
writes every stage's result as Parquet in the shared folder and reads it back as the next one's documents. The mixing
stage decides the order of the rows: it writes files in the order of the mix, and the sharding stage cuts that order
into shards, so that each shard holds the sources in their target shares.

For all stages: an empty table gives an empty one; columns of ``docs`` besides those of ``documents`` are dropped, whatever
their names; texts of any length are read whole; null and empty texts stay, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from trackloom.llm.common import Scratch, lookup, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below 0.5 stay; one at exactly 0.5 goes. The model learns from these documents and
    ``labels``.

    Null and empty texts score as the class prior does. Repeated rows get one score, so they stay or go together.
    Without labels of toxic documents all stay.
    """
    docs = docs.select(COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).where(F.col("score") < 0.5).drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram similarity links, the one with the smallest doc_id stays.

    Documents without words link with nothing and all stay, as do those with a null id. Rows that repeat the doc_id that
    stays all stay.
    """
    scratch = Scratch(spark, "near")
    groups = ngram_join.near_groups(scratch, docs)
    gone = scratch.save(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    return lookup(docs.select(COLUMNS), gone, ["doc_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; n_chars of a cut text is its new length.

    Documents with windows of one item or more lose the words of every occurrence, and keep all others; a document that
    is nothing else stays with what is left. Null texts stay null; repeated rows are cut alike; an empty benchmark cuts
    nothing.
    """
    found = decontaminate.contaminated_spans(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), remove=True)
    n_chars = F.when(F.size("span_start") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows in the order of the Pfair mix of their sources.

    A null source is a source of its own; rows that repeat, or have no id, are each placed. Ties of deadlines go to the
    larger weight, then to the source's name.
    """
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def shard_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the order of the rows of ``docs``' files into 16 shards of near equal bytes; adds size, shard and slot.

    ``docs`` must be read from files. A file's place is that of its name in the order of names, a row's its number in
    the file. Null texts have size 1. Rows are told apart by their place, so repeated ones are cut like others.
    """
    scratch = Scratch(spark, "shards")
    at = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("g"))
    names = sorted(r[0] for r in at.select("file").distinct().collect())  # names of files, of many rows each
    places = scratch.save(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "file string, h long"), "files")
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long")
    at = lookup(at, places, ["file"]).withColumn("size", size)
    keys = scratch.save(at.select("h", "g", "size"), "keys")
    return sharding.histogram_shards(at, keys).select(*COLUMNS, "size", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_mix),
]

#: Toxicity is a fitted model and mixing an online schedule, which SQL can't state; tests compare each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
