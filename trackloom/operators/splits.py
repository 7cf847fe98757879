"""Train, test and validation splits and label balancing of one-row-per-graph tables, by hashed order."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def sizes(n: int, train: float, test: float, validation: float | None = None) -> tuple[int, int, int]:
    """Rows of each part: ratios are made to add up to 1, train and test round down, the rest goes to the last."""
    if min(train, test, validation or 0) < 0 or train + test <= 0:
        raise ValueError("ratios must not be negative")
    total = train + test + (validation or 0)
    a = int(train / total * n)
    b = int(test / total * n) if validation else n - a
    return a, b, n - a - b if validation else 0


def shuffled(key: Column, seed: int) -> Column:
    """An arithmetic hash of an integer key that other engines can compute too."""
    return F.pmod(F.pmod(key, F.lit(1_000_003)) * 7_919 + (seed + 1) * 104_729, F.lit(999_983))


def hashed(df: DataFrame, key: str, seed: int) -> Column:
    """A number below 999,983 for a key of any type: ``shuffled`` of whole numbers, part of the md5 of others' text.

    A null key is hashed as empty text, so it has a place like any other.
    """
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return F.coalesce(shuffled(F.col(key), seed), F.lit(0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % 999_983


def ranked(df: DataFrame, order: list[Column], buckets: Column, name: str) -> DataFrame:
    """Number rows from 0 in order of (buckets, order): in each bucket, plus the rows of the buckets before it.

    No task sorts more than a bucket's rows.
    """
    d = df.withColumn("_b", buckets)
    before = d.groupBy("_b").agg(F.count("*").alias("_n"))
    before = before.withColumn("_off", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1)
    return d.join(F.broadcast(before), "_b").withColumn(name, (F.col("_off") + F.col("_r")).cast("long")).drop("_b", "_off", "_r")


#: Hash values per bucket, so a thousand buckets at most.
BUCKET = 1_000


def split_rows(df: DataFrame, key: str, train: float, test: float, validation: float | None = None, seed: int | None = 0) -> DataFrame:
    """Add ``split``: train, test or validation, by hashed order of a key; by its own order, of whole numbers, without a
    seed. Rows of equal keys are told apart in any order."""
    if seed is None and not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError("splitting in the key's own order needs a whole number")
    n = df.count()
    a, b, _ = sizes(n, train, test, validation)
    if seed is None:
        low, high = df.agg(F.min(key), F.max(key)).first()
        width = max(1, math.ceil(((high or 0) - (low or 0) + 1) / BUCKET))
        d = ranked(df, [F.col(key)], F.expr(f"(`{key}` - {low or 0}) div {width}"), "_k")
    else:
        d = ranked(df.withColumn("_h", hashed(df, key, seed)), [F.col("_h"), F.col(key)], F.expr(f"_h div {BUCKET}"), "_k").drop("_h")
    return d.withColumn("split", F.when(F.col("_k") < a, "train").when(F.col("_k") < a + b, "test").otherwise("validation")).drop("_k")


def split_groups(df: DataFrame, group: str, train: float, test: float, validation: float | None = None, seed: int = 0, key: str | None = None) -> DataFrame:
    """Add ``split`` so that no group is in two parts: groups in hashed order fill validation, then test, then train.

    A part is full when it has its rows or more. Needs train >= test >= validation. Groups are of any type; null is a
    group of its own. If there is no such column, or it is null everywhere, there is a warning, and rows are split by
    ``key`` instead.
    """
    if not train >= test >= (validation or 0):
        raise ValueError("needs train >= test >= validation")
    if group not in df.columns or not df.where(F.col(group).isNotNull()).take(1):
        if key is None:
            raise ValueError(f"no {group} to split by; name a key to split rows by")
        warnings.warn(f"no {group} is given, so rows are split by {key}", UserWarning, stacklevel=2)
        return split_rows(df, key, train, test, validation, seed)
    n = df.count()
    _, t, v = sizes(n, train, test, validation)
    per = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    per = per.withColumn("_h", hashed(per, "_g", seed)).withColumn("_b", F.expr(f"_h div {BUCKET}"))
    before = per.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = before.withColumn("_off", F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).drop("_s")
    w = Window.partitionBy("_b").orderBy("_h", "_g")
    per = per.withColumn("_in", F.sum("_n").over(w) - F.col("_n")).join(F.broadcast(before), "_b").withColumn("_k", F.col("_off") + F.col("_in"))
    # where validation really ends: the first group that starts at or after its size
    v_end = per.where(F.col("_k") >= v).agg(F.coalesce(F.min("_k"), F.lit(n))).first()[0] if v else 0
    split = F.when(F.col("_k") < v_end, "validation").when(F.col("_k") < v_end + t, "test").otherwise("train")
    per = per.select("_g", split.alias("split"))
    return df.join(per, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def balanced(df: DataFrame, label: str, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Undersample one label, by hashed order of the key, until label 1 has ``ratio`` of the rows; a nearer one stays."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if not ones + zeros or abs(ones / (ones + zeros) - ratio) <= 0.01:
        return df
    keep = {1: min(ones, int(zeros * ratio / (1 - ratio))), 0: min(zeros, int(ones * (1 - ratio) / ratio))}
    h = df.withColumn("_h", hashed(df, key, seed))
    out = [ranked(h.where(F.col(label) == v), [F.col("_h"), F.col(key)], F.expr(f"_h div {BUCKET}"), "_k").where(F.col("_k") < keep[v]) for v in (0, 1)]
    return out[0].unionByName(out[1]).drop("_h", "_k")
