"""Writers: CSV, JSON lines, partitioned tables, text and HTML reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind.session import cut

CSV = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true", "emptyValue": "", "timestampFormat": "yyyy-MM-dd HH:mm:ssXXX"}


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a CSV can hold them."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; NULL is an unquoted blank and stays apart from the quoted empty text."""
    flat_cells(df).write.mode(mode).options(**CSV).option("nullValue", "\\N").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one record each."""
    df.write.mode(mode).json(path)


def write_ranges(df: DataFrame, path: str, column: str = "range_start", mode: str = "overwrite") -> None:
    """One folder per range start, as CSV. Rows of a range are spread over as many files as there are tasks holding
    them, so one crowded range does not end in one task."""
    flat_cells(df).write.mode(mode).partitionBy(column).options(**CSV).option("nullValue", "\\N").csv(path)


def backfill_ranges(df: DataFrame, path: str, column: str = "range_start") -> DataFrame:
    """``write_ranges`` that can be broken off and repeated: returns the table of finished ranges, ``range_start, n``.

    Ranges in ``<path>/finished`` are left alone. The others are written with dynamic partition overwrite, which replaces only
    the folders of the ranges at hand (also what a broken run left in them), and are entered as finished afterwards. So a
    repeated call adds what is missing and no row twice.
    """
    spark = df.sparkSession
    done = finished_ranges(spark, path)
    ranges = df if done is None else df.join(done.select(F.col("range_start").alias("_done")), F.col(column) == F.col("_done"), "left_anti")
    held = cut(flat_cells(ranges))  # what is written and what is entered must be the same rows
    writer = held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column)
    writer.options(**CSV).option("nullValue", "\\N").csv(f"{path}/rows")
    entered = held.groupBy(F.col(column).alias("range_start")).agg(F.count("*").alias("n"))
    entered.write.mode("append").parquet(f"{path}/finished")
    return finished_ranges(spark, path)


def finished_ranges(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/finished")
    except AnalysisException:  # first run: nothing finished yet
        return None


def write_prices(df: DataFrame, path: str) -> None:
    """Prices by month, for partition pruning."""
    df.write.mode("overwrite").partitionBy("year_month").parquet(path)


def write_price_files(df: DataFrame, root: str, symbol: str = "BTCUSDT", interval: str = "1d") -> None:
    """Prices as CSV under ``SYMBOL_INTERVAL``, with a month's files in a folder that names the month, as a fetcher lands them."""
    df.write.mode("overwrite").partitionBy("year_month").option("header", "true").csv(f"{root.rstrip('/')}/{symbol}_{interval}")


def write_trend_files(df: DataFrame, path: str, by: str, title: str) -> None:
    """One interest export per value of ``by``: a category line, a blank line, a heading, then ``key,interest`` lines.

    Exports hold a line per week or country, so one file is one row here.
    """
    line = F.concat_ws(",", F.col("key"), F.coalesce(F.when(F.col("below_one"), F.lit("<1")), F.col("interest").cast("string"), F.lit("")))
    listed = df.groupBy(by).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    head = F.concat(F.lit(f"Category: All\n\nKey,{title}: ("), F.col(by).cast("string"), F.lit(")\n"))
    listed.select(by, F.concat(head, F.array_join("_lines", "\n")).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """A report's ``line`` column as one text file in order. Reports hold a few lines per cluster, not per article."""
    lines.orderBy(*order).select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)
