"""Exact dedup: counting quotient filters find repeated fingerprints, and only their documents are compared by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, lookup
from trackloom.llm.quotient import CountingQuotientFilter

#: Bits of a fingerprint.
BITS = 62
#: Fingerprints that one merged filter holds, about; the key ranges are as many as that takes, RANGES at least.
PER_RANGE = 1 << 19
RANGES = 256
#: Rows that one filter of a task is built from.
CHUNK = 1 << 20


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) for each value that occurs more than once in the one long column of ``fingerprints`` (0 to 2**BITS - 1).

    Each task builds filters per key range from its rows; the filters of a range are merged in one task, which holds
    about PER_RANGE distinct values however many rows there are. No value is lost or made up.
    """
    top = max(RANGES, 1 << int(np.ceil(np.log2(max(1, rows / PER_RANGE))))).bit_length() - 1
    low = BITS - top

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts).astype(np.uint64), return_counts=True)
            ranges = values >> np.uint64(low)
            first = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
            cut = np.r_[first, len(values)]
            mask = np.uint64((1 << low) - 1)
            blobs = [CountingQuotientFilter.build(values[a:b] & mask, counts[a:b], low).to_bytes() for a, b in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(ranges[first].astype(np.int64)), pa.array(blobs, pa.binary())], ["range", "filter"])

        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= CHUNK:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in t.column("filter")], low)
        values, counts = merged.items()
        keep = counts > 1
        fp = values[keep].astype(np.int64) | (key[0].as_py() << low)
        return pa.table({"fp": pa.array(fp, pa.int64()), "n": pa.array(counts[keep], pa.int64())})

    return fingerprints.mapInArrow(build, "range long, filter binary").groupBy("range").applyInArrow(merge, "fp long, n long")


def dedup(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if their normalised bytes are; the smallest doc_id of a group stays. Documents whose fingerprint
    occurs once are unique, as equal texts have equal fingerprints; all others are grouped by their whole text, not a
    digest. Null text counts as empty. A null doc_id is larger than any other; in a group of nulls only, all stay.
    Rows that repeat a doc_id with an equal text share ``kept``. A text of any length is compared whole. An empty table
    gives an empty result; other columns are not looked at.
    """
    docs = documents.select("doc_id", normalised(F.col("text")).alias("t"))
    fp = F.shiftrightunsigned(F.xxhash64("t"), 64 - BITS)
    narrow = scratch.save(docs.select("doc_id", fp.alias("fp"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")), "narrow")
    again = scratch.save(repeated_fingerprints(narrow.select("fp"), narrow.count()).select("fp"), "again")
    suspects = lookup(docs.withColumn("fp", fp), again, ["fp"])
    by_text = suspects.groupBy("t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # narrow rows know their text by its digest, which must name one text only
    groups = by_text.groupBy(F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    one = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share a SHA-256")))
    groups = scratch.save(groups.select("text_sha256", "keep_id", one.alias("group_size"), F.lit(True).alias("grouped")), "groups")
    out = lookup(narrow, groups, ["text_sha256"], "left")
    keep = F.when(F.col("grouped").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
