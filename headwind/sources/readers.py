"""Readers: article tables, daily prices, fetched pages, interest trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind import schemas
from headwind.functions.parse import parse_list, parse_sentiment

# Article text holds line breaks and quotes, so cells are quoted and quotes doubled. A quoted file cannot be split:
# land many files, or convert to Parquet once, before reading at scale.
QUOTED_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def _checked_csv(spark: SparkSession, path, schema: str, null: str = "") -> DataFrame:
    """CSV whose header must match the schema."""
    reader = spark.read.options(**QUOTED_CSV).options(enforceSchema="false", nullValue=null)
    return reader.schema(schema).csv(path)


def read_news(spark: SparkSession, path, annotated: bool = False, null: str = "") -> DataFrame:
    """Article CSV in the column order of the schema; the header is checked against it. ``date`` is an instant."""
    return _checked_csv(spark, path, schemas.NEWS_ANNOTATED if annotated else schemas.NEWS, null)


def read_news_by_header(spark: SparkSession, path) -> DataFrame:
    """Article CSV whose columns may come in any order: matched by header name, unknown ones dropped, absent ones NULL."""
    raw = spark.read.options(**QUOTED_CSV).csv(path)
    wanted = [f.split(" ") for f in schemas.NEWS_ANNOTATED.split(", ")]
    cells = [
        (F.try_to_timestamp(name) if kind == "timestamp" else F.col(name)).alias(name) if name in raw.columns
        else F.lit(None).cast(kind).alias(name)
        for name, kind in wanted
    ]
    return raw.select(*cells)


def with_sentiment(news: DataFrame, defaults: bool = False) -> DataFrame:
    """``sentiment_class``, ``polarity`` and ``subjectivity`` beside the raw cell."""
    s = parse_sentiment("sentiment", defaults)
    return news.withColumn("_s", s).select(
        "*", F.col("_s.class").alias("sentiment_class"), F.col("_s.polarity").alias("polarity"),
        F.col("_s.subjectivity").alias("subjectivity"),
    ).drop("_s")


def read_prices(spark: SparkSession, root: str, symbol: str = "BTCUSDT", interval: str = "1d") -> DataFrame:
    """All files ``SYMBOL_INTERVAL/SYMBOL_INTERVAL_*.csv`` under ``root`` as one table with a ``date``.

    No global sort: order is taken where a window consumes it.
    """
    name = f"{symbol}_{interval}"
    raw = spark.read.schema(schemas.OHLCV).option("header", "true").csv(f"{root.rstrip('/')}/{name}/{name}_*.csv")
    return raw.withColumn("date", F.to_date("timestamp"))


def read_price_months(spark: SparkSession, root: str, months: list[str], symbol: str = "BTCUSDT", interval: str = "1d") -> DataFrame:
    """Only the files of some months (``2017_08``), by the names of files or folders: others are listed but never opened.

    Adds ``file``. The test on the file path is one on file metadata, so Spark applies it when it picks the files to scan.
    """
    name = f"{symbol}_{interval}"
    raw = spark.read.schema(schemas.OHLCV).option("header", "true").option("recursiveFileLookup", "true").csv(f"{root.rstrip('/')}/{name}")
    month = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}_\d{2})(?:\.csv|/[^/]*)$", 1)
    picked = raw.where(month.isin(months)).withColumns({"file": F.col("_metadata.file_path"), "year_month": month})
    return picked.withColumn("date", F.to_date("timestamp"))


def read_price_table(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """Prices written by ``write_prices``; a month list prunes partitions."""
    table = spark.read.parquet(path)
    return table.where(F.col("year_month").isin(months)) if months else table


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed API answers, one JSON document per file, numbered by their file name."""
    raw = spark.read.schema(schemas.API_PAGE).option("multiLine", "true").json(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).try_cast("long")
    return raw.select(number.alias("page"), "results", "next")


def read_fetched(spark: SparkSession, path) -> DataFrame:
    """Flat fetched news with ``currencies`` as a list."""
    raw = _checked_csv(spark, path, schemas.FETCHED_NEWS)
    return raw.withColumn("currencies", parse_list("currencies"))


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    """Interest export: ``key, interest, below_one``. Preamble and header lines go; blanks are NULL, '<1' is flagged."""
    raw = spark.read.schema("key string, value string").csv(path)
    number = F.col("value").try_cast("int")
    low = F.trim("value") == "<1"
    # a heading has text that is neither a number nor '<1'; the category line has no second cell at all, and its
    # key ends in the category after a colon
    heading = F.col("value").isNotNull() & number.isNull() & ~low
    preamble = F.col("value").isNull() & F.col("key").contains(": ")
    rows = raw.where(F.col("key").isNotNull() & ~heading & ~preamble)
    return rows.select("key", number.alias("interest"), F.coalesce(low, F.lit(False)).alias("below_one"))


def read_trend_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, heading, key, interest, below_one`` of many exports, each with a preamble of its own length.

    An export is small (a line per week or country) and is read whole; its lines keep their places, and its heading is the
    first line with two filled cells whose second is neither a number nor '<1'. What stands above it is the preamble.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    numbered = F.transform(lines, lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    cells = whole.select(F.col("_metadata.file_path").alias("file"), F.explode(numbered).alias("_c")).select("file", "_c.at", "_c.line")
    key, value = F.split_part("line", F.lit(","), F.lit(1)), F.trim(F.substring_index("line", ",", -1))
    split = cells.where(F.col("line").contains(",")).select("file", "at", key.alias("key"), F.nullif(value, F.lit("")).alias("value"))
    number, low = F.col("value").try_cast("int"), F.col("value") == "<1"
    title = F.col("value").isNotNull() & number.isNull() & ~low & (F.trim("key") != "")
    heads = split.where(title).groupBy("file").agg(F.min(F.struct("at", "value")).alias("_h"))
    rows = split.join(heads, "file").where(F.col("at") > F.col("_h.at"))
    return rows.select("file", F.col("_h.value").alias("heading"), "key", number.alias("interest"), F.coalesce(low, F.lit(False)).alias("below_one"))


def read_weekly_trends(spark: SparkSession, path: str) -> DataFrame:
    return read_trends(spark, path).select(F.col("key").cast("date").alias("week"), "interest", "below_one")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHECKPOINT).option("multiLine", "true").json(path)
