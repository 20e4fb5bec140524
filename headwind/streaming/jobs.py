"""Streams: landing, de-duplication, time buckets and resumable annotation.

Every stream takes all data that is available and stops, so the same call serves a backfill and a scheduled run. Progress
lives in ``<path>/_progress`` inside the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headwind.operators import annotate, ingest, rows
from headwind import schemas


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000, **options: str) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).load(path)


def finish(query: StreamingQuery) -> None:
    """Wait for an available-now stream and raise what it raised."""
    query.awaitTermination()


def append_to(stream: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append a stream to a Parquet table exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
    writer = writer.option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True)
    finish((writer.partitionBy(*partition_by) if partition_by else writer).start())


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def land_pages(spark: SparkSession, source: str, path: str) -> DataFrame:
    """New API pages under ``source`` as flat rows in a table; a second call reads only what came since."""
    pages = read_files(spark, source, schemas.API_PAGE, "json", multiLine="true")
    append_to(ingest.flatten_pages(pages), path)
    return rows_of(spark, path)


def deduplicate_to(stream: DataFrame, path: str, key: list[str], order: list[str]) -> DataFrame:
    """Append one row per key to ``path``: the first one seen, within a micro-batch the first in ``order``.

    Keys that earlier micro-batches landed are left out by a join with the landed keys, so no state is kept and no row is
    ever late, whatever the order of the files. Each micro-batch overwrites its own folder: a repeated one changes nothing.
    """

    def save(batch: DataFrame, number: int) -> None:
        fresh = rows.deduplicate(batch, key, order, null_key="fold")
        if number:
            landed = rows_of(batch.sparkSession, path).where(F.col("batch") < number).select(*[F.col(c).alias(f"_{c}") for c in key])
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
            fresh = fresh.join(landed, same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/_progress")
    finish(query.trigger(availableNow=True).start())
    return rows_of(stream.sparkSession, path).drop("batch")


STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def deduplicate_keyed(stream: DataFrame, path: str, key: list[str], order: list[str]) -> tuple[DataFrame, list[dict]]:
    """The first row of each key in ``path``, with the keys kept as state on disk; also the progress of this run's batches.

    A micro-batch looks its keys up in the state and reads nothing of what landed before, so its cost does not grow with
    history. Files may come in any order and nothing is ever late: the state holds every key (also an unknown one) for good,
    in the executors' local key-value store with change logs in the shared folder. Repeats inside an Arrow batch go before
    the shuffle, the first in ``order`` stays.
    """
    spark = stream.sparkSession

    def thin(parts):
        for part in parts:
            ordered = part.assign(_at=range(len(part))).sort_values([*order, "_at"], kind="stable")
            yield ordered.drop_duplicates(key).drop(columns="_at")

    fresh = stream.mapInPandas(thin, stream.schema).dropDuplicates(key)
    writer = fresh.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
    before = {name: spark.conf.get(name, None) for name in STATE_ON_DISK}
    try:
        for name, value in STATE_ON_DISK.items():
            spark.conf.set(name, value)
        query = writer.option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()
        finish(query)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return rows_of(spark, path), [p for p in query.recentProgress if p["numInputRows"]]


def window_counts_to(stream: DataFrame, path: str, ts: str, by: list[str], width: str = "day", delay: str = "1 day") -> dict[str, DataFrame]:
    """Event-time windows with bounded state: ``closed``, ``open`` and ``late`` tables under ``path``.

    The watermark is the latest event time of earlier micro-batches less ``delay``. A row of a window that the watermark has
    passed goes to ``late`` as it is; other rows are counted, and a window is appended to ``closed``, once, when the watermark
    passes its end. ``open`` is all that a micro-batch reads of the past: the counts of windows still open. Each micro-batch
    overwrites its own folders, so a repeated one changes nothing. Every row is in exactly one of the three; rows without an
    event time are late.
    """
    spark = stream.sparkSession
    at = F.col(ts).cast("timestamp")
    end = F.to_timestamp(F.date_add(bucket_label(at, width), 1))  # a bucket ends with its last day
    closing = F.to_timestamp(F.date_add("bucket", 1))

    def save(batch: DataFrame, number: int) -> None:
        earlier = spark.read.parquet(f"{path}/open/batch={number - 1}") if number else None
        mark = earlier.agg(F.max("high")).first()[0] if number else None
        behind = F.lit(mark).cast("timestamp") - F.expr(f"interval {delay}")
        late = at.isNull() | (F.coalesce(end <= behind, F.lit(False)) if mark is not None else F.lit(False))
        batch = batch.persist()
        try:
            batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            counted = bucket_counts(batch.where(~late), ts, by, width)
            if number:
                counted = counted.unionByName(earlier.where("n is not null").drop("high"))
            newest = batch.agg(F.max(at)).first()[0]
            high = max((t for t in (mark, newest) if t is not None), default=None)
            merged = counted.groupBy("bucket", *by).agg(F.sum("n").alias("n"))
            done = F.coalesce(closing <= F.lit(high).cast("timestamp") - F.expr(f"interval {delay}"), F.lit(False))
            merged.where(done).write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
            # one line without a window carries the mark when no window is open
            mark_line = merged.limit(0).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("n")), allowMissingColumns=True)
            still = merged.where(~done).unionByName(mark_line)
            still.withColumn("high", F.lit(high).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/open/batch={number}")
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/_progress")
    finish(query.trigger(availableNow=True).start())
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("closed", "open", "late")}
    last = tables["open"].agg(F.max("batch")).first()[0]
    return {
        "closed": tables["closed"].drop("batch"), "late": tables["late"].drop("batch"),
        "open": tables["open"].where((F.col("batch") == last) & F.col("n").isNotNull()).drop("batch", "high"),
    }


def bucket_label(at: Column, width: str) -> Column:
    if width == "day":
        return F.to_date(at)
    if width == "week":
        return F.date_add(F.to_date(F.date_trunc("week", at)), 6)
    raise ValueError(f"unknown width {width!r}")


def bucket_counts(df: DataFrame, ts: str, by: list[str], width: str = "day") -> DataFrame:
    """Counts per day or per Monday-to-Sunday week and key; ``bucket`` is the day or the closing Sunday."""
    at = F.col(ts).cast("timestamp")
    return df.where(at.isNotNull()).groupBy(bucket_label(at, width).alias("bucket"), *by).agg(F.count("*").alias("n"))


def count_to(stream: DataFrame, path: str, ts: str, by: list[str], width: str = "day") -> DataFrame:
    """``bucket, by…, n`` over all that a stream has brought to ``path``, in any order and over any number of runs.

    A micro-batch is folded to partial counts in a folder of its own; the answer is their sum, so rows cannot come late.
    At the end of a run the partial counts are folded into one base table, and later reads take that base and what is newer.
    """

    def save(batch: DataFrame, number: int) -> None:
        bucket_counts(batch, ts, by, width).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/_progress")
    finish(query.trigger(availableNow=True).start())
    return _folded(stream.sparkSession, path, ["bucket", *by])


def _folded(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    parts = rows_of(spark, path)
    newest = parts.agg(F.max("batch")).first()[0]
    try:
        base = spark.read.parquet(f"{path}/base")
    except AnalysisException:  # first run: nothing folded yet
        base = None
    if base is not None:
        upto = base.agg(F.max("upto")).first()[0]
        if upto == newest:
            return base.where(F.col("upto") == upto).drop("upto")
        parts = parts.where(F.col("batch") > upto).drop("batch").unionByName(base.where(F.col("upto") == upto).drop("upto"))
    folded = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    folded.write.mode("overwrite").parquet(f"{path}/base/upto={newest}")
    return spark.read.parquet(f"{path}/base").where(F.col("upto") == newest).drop("upto")


def annotate_new(
    stream: DataFrame, path: str, annotator: Callable, key: str, order: list[str], size: int = 10
) -> DataFrame:
    """Annotate what a stream brings in; the stream's own progress makes a restart go on where it stopped.

    Batches keep their tail: a short last batch of a micro-batch is annotated too.
    """

    def save(batch: DataFrame, number: int) -> None:
        good, bad = annotate.split_outcomes(annotate.annotate(batch, annotator, key, order, size, drop_tail=False))
        annotate.scatter(good, key).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        bad.select("batch", "error", "raw_answer").write.mode("overwrite").parquet(f"{path}/errors/run={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/_progress")
    finish(query.trigger(availableNow=True).start())
    return rows_of(stream.sparkSession, path).drop("batch")


