"""Fetched API pages as rows: flattening, time ranges, page rules, currencies and backfill ranges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwind.functions.parse import iso_instant


def flatten_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of ``results``, with its place ``pos`` on the page, nested fields lifted and defaults set."""
    item = F.col("item")
    return pages.select(*keep, F.posexplode("results").alias("pos", "item")).select(
        *keep,
        "pos",
        item["title"].alias("title"),
        iso_instant(item["published_at"]).alias("published_at"),
        F.coalesce(item["votes"]["sentiment"], F.lit("neutral")).alias("sentiment"),
        item["url"].alias("url"),
        F.coalesce(
            F.transform(item["currencies"], lambda c: c["code"]), F.array().cast("array<string>")
        ).alias("currencies"),
        item["source"]["title"].alias("source"),
    )


def in_range(ts: Column, start: Column | None, end: Column | None) -> Column:
    """Inclusive on both ends; an absent bound does not restrict."""
    keep = ts.isNotNull()
    if start is not None:
        keep = keep & (ts >= start)
    if end is not None:
        keep = keep & (ts <= end)
    return keep


def last_days(now: Column, days: int = 30) -> tuple[Column, Column]:
    """The default range: the ``days`` days that end at ``now``."""
    return now - F.make_dt_interval(F.lit(days)), now


def stop_early(items: DataFrame, ts: str, start: Column, page: str = "page", mode: str = "filter") -> DataFrame:
    """Newest-first pages read until the first item older than ``start``.

    ``filter`` keeps every item that is new enough. ``compat`` loses the whole page that holds the first old item, and
    all later pages. The first old page is one small aggregate, so no ordered pass over the items is needed.
    """
    if mode == "filter":
        return items.where(F.col(ts) >= start)
    if mode != "compat":
        raise ValueError(f"unknown mode {mode!r}")
    first_old = items.where(F.col(ts) < start).agg(F.min(page).alias("p")).scalar()
    return items.where(F.coalesce(F.col(page) < first_old, F.lit(True)))


def limit_pages(
    items: DataFrame, ts: str, start: Column | None, end: Column | None, max_pages: int, page: str = "page",
    first_page: int = 1,
) -> DataFrame:
    """In-range items of at most ``max_pages`` pages, stopping after the first page with none in range.

    A page number that is missing from the items counts as a page without items.
    """
    capped = items.where(F.col(page) < first_page + max_pages)
    kept = capped.where(in_range(F.col(ts), start, end))
    pages = kept.groupBy(page).agg(F.count("*").alias("_n"))  # at most max_pages rows
    run = pages.withColumn("_place", F.row_number().over(W.orderBy(page)) - 1 + first_page)
    good = run.where(F.col("_place") == F.col(page)).select(page)
    return kept.join(F.broadcast(good), page, "left_semi")


def mentions_any(currencies: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(currencies, F.array(*[F.lit(w) for w in wanted]))


def date_pairs(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """``[d, d+1]`` day pairs from ``start`` to ``end``, the last one clamped to ``end``."""
    one = spark.range(1).select(F.lit(str(start)).cast("date").alias("s"), F.lit(str(end)).cast("date").alias("e"))
    return split_range(one, "s", "e")


def split_range(bounds: DataFrame, start: str, end: str) -> DataFrame:
    days = F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))).alias("range_start")
    return bounds.select(days, F.col(end).alias("_end")).select(
        "range_start", F.least(F.date_add("range_start", 1), F.col("_end")).alias("range_end")
    )


def backfill(items: DataFrame, ts: str, start: Column, end: Column, mode: str = "half_open") -> DataFrame:
    """Items tagged with the day range they belong to, for all ranges of ``start``..``end`` in one pass.

    ``compat`` keeps both ends inclusive, so an item at midnight sharp falls into two ranges (the last range has no
    width). A day range is found by arithmetic on the item's own day, so no join is needed.
    """
    day, at = F.to_date(ts), F.col(ts).cast("timestamp")
    if mode == "half_open":
        return items.withColumn("range_start", day).where((day >= start) & (day < end))
    if mode != "compat":
        raise ValueError(f"unknown mode {mode!r}")
    midnight = at == day.cast("timestamp")
    own = F.when((day >= start) & ((day < end) | ((day == end) & midnight)), day)
    before = F.when(midnight & (F.date_sub(day, 1) >= start) & (day <= end), F.date_sub(day, 1))
    return items.withColumn("range_start", F.explode(F.array_compact(F.array(own, before))))
