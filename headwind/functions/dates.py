"""Calendar labels and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def week_end(day: Column) -> Column:
    """The Sunday that closes the Monday-to-Sunday week of ``day``."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def fill_gaps(counts: DataFrame, day: str, value: str, keys: list[str] | None = None, step_days: int = 1) -> DataFrame:
    """Add the missing steps between the first and last day (of each key) with ``value`` 0.

    ``counts`` must already be aggregated: one row per key and step. Each row stretches up to the next one, so the counts
    are read once and nothing is joined.
    """
    rows = counts.where(F.col(day).isNotNull())
    following = F.lead(day).over(W.partitionBy(*(keys or [])).orderBy(day))
    until = F.coalesce(F.date_sub(following, step_days), F.col(day))
    step = F.make_dt_interval(F.lit(step_days))
    long = rows.withColumn("_until", until).withColumn("_step", F.explode(F.sequence(F.col(day), F.col("_until"), step)))
    filled = F.when(F.col("_step") == F.col(day), F.col(value)).otherwise(0)
    return long.select(*(keys or []), F.col("_step").alias(day), filled.alias(value))
