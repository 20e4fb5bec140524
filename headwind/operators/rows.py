"""Row numbering, exact-size sampling, batching, top-k per group and de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwind.session import cut, shuffle_width

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_row_index(df: DataFrame, order: list[str | Column], out: str = "row_index") -> DataFrame:
    """Number all rows 0, 1, 2, … in the given order without a one-partition window.

    Rows are range-partitioned and sorted once, written to the shared folder (so the numbers stay the same when an
    executor is lost), and each partition's offset comes from the partition sizes. ``order`` should end in a unique
    column: it fixes ties, and lets the range partitioning split a key that many rows share.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    width = shuffle_width(df.sparkSession)
    placed = cut(
        df.repartitionByRange(width, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_place", _POSITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # one offset row per shuffle partition, so the broadcast side is bounded by the shuffle width
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_place").bitwiseAND((1 << _POSITION_BITS) - 1))
        .drop("_part", "_offset", "_place")
    )


def hash_order(key: Column, seed: int = 42) -> Column:
    """A repeatable pseudo-random sort key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def exact_sample(df: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """Exactly ``int(n * rate)`` rows without replacement, the same ones on every run; ``key`` must be unique.

    The sample is all rows up to the m-th smallest hash. A histogram of hash prefixes tells in which small slice that hash
    lies, only this slice is ranked, and the rows themselves are filtered, never sorted or shuffled.
    """
    hashed = df.select(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    sizes = hashed.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("c"))  # at most 65,536 rows
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy()
    placed = sizes.select(
        "p", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"),
        F.floor(F.sum("c").over(total) * F.lit(float(rate))).alias("m"),
    )
    hit = placed.where("m > before and m <= before + c").select("p", (F.col("m") - F.col("before") - 1).alias("at")).first()
    if hit is None:  # rate 0 or no rows
        return df.limit(0)
    last = with_row_index(hashed.where(F.substring("h", 1, 4) == hit["p"]), ["h", "k"], "i").where(F.col("i") == hit["at"]).first()
    h, k = hash_order(F.col(key), seed), F.col(key)
    return df.where((h < last["h"]) | ((h == last["h"]) & (k <= F.lit(last["k"]))))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark trims every partition to ``k`` before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def sample_per_group(df: DataFrame, by: list[str], key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Up to ``k`` repeatable pseudo-random rows of each group."""
    return top_k(df, by, [hash_order(F.col(key), seed), F.col(key)], k)


def latest(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_if_more(df: DataFrame, day: str, n: int = 90) -> DataFrame:
    """The last ``n`` rows by day of a daily table, or nothing when it holds no more than ``n`` rows."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.where(F.lit(n) < total).orderBy(F.col(day).desc()).limit(n)


def number_batches(df: DataFrame, order: list[str | Column], size: int, drop_tail: bool = False) -> DataFrame:
    """``batch`` and 1-based ``slot`` for every row in order; ``drop_tail`` leaves a short last batch out."""
    indexed = with_row_index(df, order, "_i")
    if drop_tail:
        total = indexed.agg(F.count("*").alias("n")).scalar()
        indexed = indexed.where(F.col("_i") < total - F.pmod(total, F.lit(size)))
    return indexed.withColumns(
        {"batch": F.floor(F.col("_i") / size).cast("long"), "slot": (F.pmod("_i", F.lit(size)) + 1).cast("int")}
    ).drop("_i")


def deduplicate(df: DataFrame, key: list[str], order: list[str], null_key: str = "keep") -> DataFrame:
    """One whole row per key, the first in ``order``; hot keys shrink before the shuffle.

    Rows with a null in the key are all kept, or folded like any other key with ``null_key="fold"``.
    """
    if null_key not in ("keep", "fold"):
        raise ValueError(f"unknown null_key {null_key!r}")
    rest = [c for c in df.columns if c not in key]
    lead = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    known = df.dropna(subset=key) if null_key == "keep" else df
    picked = known.groupBy(*key).agg(F.min(lead).alias("_r"))
    out = picked.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])
    if null_key == "keep":
        out = out.unionByName(df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])))
    return out
