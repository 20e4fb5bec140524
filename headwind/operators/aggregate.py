"""Counts, cross-tabs, shares, group means and group profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwind.functions.stats import safe_corr
from headwind.operators.rows import top_k
from headwind.session import cut

ALL_VALUES = 2**31 - 1


def value_counts(df: DataFrame, value: str, by: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Counts of each known value (in each group) as ``by…, value, n, rank`` – or without rank when all are kept.

    Ties rank by value.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    if k is None:
        return counts
    if not by:
        best = counts.orderBy(F.desc("n"), F.asc(value)).limit(k)  # k rows
        return top_k(best.withColumn("_g", F.lit(1)), ["_g"], [F.desc("n"), F.asc(value)], k).drop("_g")
    return top_k(counts, by, [F.desc("n"), F.asc(value)], k)


def shares(df: DataFrame, value: str) -> DataFrame:
    """Value counts with each value's percent of all known values."""
    counts = value_counts(df, value)
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pair counts in long form; rows with an unknown side are dropped."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Pair counts with one column per listed value of ``b``, missing pairs 0."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return pairs.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(str(v)) for v in values])


def crosstab_pct(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long cross-tab with each pair's percent of its row total."""
    pairs = crosstab(df, a, b)
    totals = pairs.groupBy(a).agg(F.sum("n").alias("_t"))
    return pairs.join(totals, a).withColumn("pct", F.col("n") * F.lit(100.0) / F.col("_t")).drop("_t")


def top_columns(df: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """The cross-tab restricted to the ``k`` values of ``b`` with the largest totals (percent of the full row)."""
    totals = crosstab(df, a, b).groupBy(b).agg(F.sum("n").alias("_n"))
    best = totals.orderBy(F.desc("_n"), F.asc(b)).limit(k).select(b)  # k rows
    return crosstab_pct(df, a, b).join(F.broadcast(best), b, "left_semi")


def pairwise_tables(df: DataFrame, labels: list[str]) -> DataFrame:
    """All pairwise contingency tables of several labelings in one scan: ``pair, a, b, n, pct``."""
    pairs = [(x, y) for i, x in enumerate(labels) for y in labels[i + 1 :]]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{x}|{y}").alias("pair"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b")
                )
                for x, y in pairs
            ]
        )
    )
    # counting full label combinations first keeps the exploded side as small as the label space
    combos = df.groupBy(*labels).agg(F.count("*").alias("m"))
    long = combos.select("m", rows.alias("r")).select("m", "r.*").where("a is not null and b is not null")
    counts = long.groupBy("pair", "a", "b").agg(F.sum("m").alias("n"))
    totals = counts.groupBy("pair", "a").agg(F.sum("n").alias("_t"))
    return counts.join(totals, ["pair", "a"]).withColumn("pct", F.col("n") * F.lit(100.0) / F.col("_t")).drop("_t")


def group_means(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("size"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


def best_and_worst(df: DataFrame, by: str, value: str) -> DataFrame:
    """The groups with the highest and the lowest mean; ties go to the smaller label."""
    means = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(value).alias("m")).where("m is not null")
    return means.agg(
        F.min_by(by, F.struct(-F.col("m"), F.col(by))).alias("best"),
        F.max("m").alias("best_mean"),
        F.min_by(by, F.struct(F.col("m"), F.col(by))).alias("worst"),
        F.min("m").alias("worst_mean"),
    )


def element_counts(df: DataFrame, by: list[str], items: str, k: int = 5) -> DataFrame:
    """The most frequent elements of a list column in each group."""
    return value_counts(df.select(*by, F.explode(items).alias("item")), "item", by, k)


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete correlations of some columns, in long form ``a, b, r``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("r")))
    return wide.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def profile(df: DataFrame, by: str, means: list[str], distributions: dict[str, int | None]) -> DataFrame:
    """Group profiles as one long table ``by, section, ord, key, n, value``.

    ``size`` and the means take one row each; every distribution takes its top values (all when the limit is None).
    The rows are read once, however many groups and sections there are: each row sends one cell per section, the map side
    folds them, and the folded counts are kept in the shared folder for the rest.
    """
    empty = F.lit(None).cast("string")
    cells = [F.struct(F.lit("size").alias("section"), F.lit(0).alias("_k"), empty.alias("key"))]
    cells += [
        F.struct(F.lit(c).alias("section"), F.lit(k or ALL_VALUES).alias("_k"), F.col(c).cast("string").alias("key"))
        for c, k in distributions.items()
    ]
    known = df.where(F.col(by).isNotNull())
    long = known.select(by, *means, F.explode(F.array(*cells)).alias("r")).select(by, *means, "r.*")
    folded = cut(
        long.where("key is not null or section = 'size'")
        .groupBy(by, "section", "_k", "key")
        .agg(F.count("*").alias("n"), *[F.avg(F.when(F.col("_k") == 0, F.col(c))).alias(f"_m{i}") for i, c in enumerate(means)])
    )
    base = folded.where("section = 'size'")
    scalar_rows = [_row("size", 0, F.lit(None), F.col("n"), F.lit(None))]
    scalar_rows += [_row(f"avg_{c}", 0, F.lit(None), F.lit(None), F.col(f"_m{i}")) for i, c in enumerate(means)]
    scalars = base.select(by, F.explode(F.array(*scalar_rows)).alias("r")).select(by, "r.*")
    if not distributions:
        return scalars
    order = [F.desc("n"), F.asc("key")]
    # each limit is ranked on its own, so that Spark trims every task to it before the shuffle
    parts = [
        top_k(folded.where((F.col("section") != "size") & (F.col("_k") == k)), [by, "section"], order, k, "ord")
        for k in sorted({k or ALL_VALUES for k in distributions.values()})
    ]
    ranked = reduce(DataFrame.unionByName, parts)
    sized = ranked.join(base.select(by, F.col("n").alias("size")), by)
    dist = sized.select(
        by, "section", F.col("ord").cast("long"), "key", "n", (F.col("n") * F.lit(100.0) / F.col("size")).alias("value")
    )
    return scalars.unionByName(dist)


def _row(section: str, order: int, key: Column, n: Column, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(order).cast("long").alias("ord"),
        key.cast("string").alias("key"),
        n.cast("long").alias("n"),
        value.cast("double").alias("value"),
    )
