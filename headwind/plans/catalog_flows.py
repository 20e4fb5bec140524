"""Queries that write, stream and read back: sinks and the streaming jobs, each equal to its batch answer."""

from pyspark.sql import functions as F

from headwind.operators import ingest
from headwind.plans.catalog_articles import _LEXICON_OUT, _annotator, _readable, lexicon_sql, prepared, talk_of
from headwind.plans.fixtures import ARTICLES, PAGES, articles, pages_of_events, table
from headwind.plans.registry import query
from headwind.schemas import API_PAGE, NEWS_ANNOTATED
from headwind.session import scratch_path
from headwind.sources import readers, writers
from headwind.streaming import jobs


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files: as a pattern the path may name either."""
    return jobs.read_files(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


@query(
    "a1_a14_csv_round_trip",
    f"""with {ARTICLES} select date, source, subject, md5(title) as title, md5(text) as text, length(text) as n, title_tonality,
      len(title_verbs) as verbs from articles""",
)
def _(spark, sf):
    from headwind.functions.parse import parse_list

    path = scratch_path(spark, "articles-csv")
    order = [f.split(" ")[0] for f in NEWS_ANNOTATED.split(", ")]
    raw = articles(spark, sf).withColumn("date", F.col("date").cast("timestamp"))
    writers.write_csv(raw.select(*order), path)
    back = readers.read_news(spark, path, annotated=True, null="\\N")
    return back.select(
        F.to_date("date").alias("date"), "source", "subject", F.md5("title").alias("title"), F.md5("text").alias("text"),
        F.length("text").cast("long").alias("n"), "title_tonality",
        F.size(parse_list("title_verbs")).cast("long").alias("verbs"),
    )


@query(
    "a15_json_round_trip",
    f"with {ARTICLES} select row_id, md5(text) as text, len(title_verbs) as verbs from articles",
)
def _(spark, sf):
    path = scratch_path(spark, "articles-json")
    rows = prepared(spark, sf).select("row_id", "text", "title_verbs_parsed")
    writers.write_json(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select("row_id", F.md5("text").alias("text"), F.size("title_verbs_parsed").cast("long").alias("verbs"))


@query(
    "a18_range_files",
    f"""with {PAGES} select cast(published_at as date) as range_start, count(*) as n, min(url) as first_url from items
    where cast(published_at as date) >= date '2024-01-03' and cast(published_at as date) < date '2024-01-28' group by 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "ranges")
    items = ingest.flatten_pages(pages_of_events(spark, sf))
    lo, hi = F.lit("2024-01-03").cast("date"), F.lit("2024-01-28").cast("date")
    writers.write_ranges(ingest.backfill(items, "published_at", lo, hi), path)
    back = spark.read.options(**readers.QUOTED_CSV).csv(path)
    return back.groupBy(F.col("range_start").cast("date").alias("range_start")).agg(
        F.count("*").alias("n"), F.min("url").alias("first_url")
    )


@query(
    "l1_land_pages",
    f"with {PAGES} select url, sentiment, array_to_string(string_split(currencies, ','), ' ') as currencies, source from items",
)
def _(spark, sf):
    landed, out = scratch_path(spark, "pages"), scratch_path(spark, "landed")
    pages_of_events(spark, sf).drop("page").write.json(landed)  # one page per line
    pages = jobs.read_files(spark, landed, API_PAGE, "json", 2)
    jobs.append_to(ingest.flatten_pages(pages), out)
    return jobs.rows_of(spark, out).select("url", "sentiment", F.array_join("currencies", " ").alias("currencies"), "source")


def _landed(spark, sf, copies: int):
    """The events as a stream of several micro-batches, each with rows of all days, every row ``copies`` times."""
    path = scratch_path(spark, "events")
    events = table(spark, sf, "events")
    many = events.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    many.repartition(4, F.xxhash64("event_id", "_c")).drop("_c").write.parquet(path)
    return jobs.read_files(spark, path, events.schema, files_per_batch=1)


@query("l2_deduplicated_stream", "select event_id, event_type, value from events")
def _(spark, sf):
    kept = jobs.deduplicate_to(_landed(spark, sf, 2), scratch_path(spark, "deduplicated"), ["event_id"], ["ts"])
    return kept.select("event_id", "event_type", "value")


@query("l3_daily_stream_counts", "select cast(ts as date) as bucket, event_type, count(*) as n from events group by all")
def _(spark, sf):
    return jobs.count_to(_landed(spark, sf, 1), scratch_path(spark, "daily"), "ts", ["event_type"])


@query(
    "l3_weekly_stream_counts",
    "select cast(cast(date_trunc('week', ts) as date) + 6 as date) as bucket, event_type, count(*) as n from events group by all",
)
def _(spark, sf):
    return jobs.count_to(_landed(spark, sf, 1), scratch_path(spark, "weekly"), "ts", ["event_type"], "week")


@query("l4_resumable_annotation", f"{lexicon_sql('talk')} select key, {_LEXICON_OUT} from s")
def _(spark, sf):
    talk = talk_of(_stream(spark, sf, "conversations"))
    return _readable(jobs.annotate_new(talk, scratch_path(spark, "annotated"), _annotator(), "key", ["conv_id", "turn"]))


@query("l2_keyed_deduplication", "select event_id, event_type, value from events")
def _(spark, sf):
    kept, _ = jobs.deduplicate_keyed(_landed(spark, sf, 2), scratch_path(spark, "keyed"), ["event_id"], ["ts"])
    return kept.select("event_id", "event_type", "value")


@query(
    "l3_windows_with_late_rows",
    "select cast(ts as date) as bucket, event_type, count(*) as n from events group by all",
)
def _(spark, sf):
    """Closed windows, open ones and the rows that came behind the watermark: together every row once."""
    out = jobs.window_counts_to(_landed(spark, sf, 1), scratch_path(spark, "windows"), "ts", ["event_type"], delay="10 days")
    late = jobs.bucket_counts(out["late"], "ts", ["event_type"])
    every = out["closed"].unionByName(out["open"]).unionByName(late)
    return every.groupBy("bucket", "event_type").agg(F.sum("n").alias("n"))


@query(
    "a10_a18_repeated_backfill",
    f"""with {PAGES} select cast(published_at as date) as range_start, count(*) as n, count(*) as entered, min(url) as first_url from items
    where cast(published_at as date) >= date '2024-01-03' and cast(published_at as date) < date '2024-01-28' group by 1""",
)
def _(spark, sf):
    """A first run over some days, a run that broke off before it was entered, and a repeat over all of them."""
    path = scratch_path(spark, "backfill")
    items = ingest.flatten_pages(pages_of_events(spark, sf))
    days = lambda lo, hi: ingest.backfill(items, "published_at", F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    writers.backfill_ranges(days("2024-01-03", "2024-01-11"), path)
    writers.write_ranges(days("2024-01-11", "2024-01-20"), f"{path}/rows", mode="append")  # rows landed, nothing entered
    done = writers.backfill_ranges(days("2024-01-03", "2024-01-28"), path)
    back = spark.read.options(**readers.QUOTED_CSV).csv(f"{path}/rows")
    counts = back.groupBy(F.col("range_start").cast("date").alias("range_start")).agg(F.count("*").alias("n"), F.min("url").alias("first_url"))
    return counts.join(done.select(F.col("range_start").cast("date").alias("range_start"), F.col("n").alias("entered")), "range_start")


_MONTHS = ["1995_03", "1996_11"]


@query(
    "a2_a3_price_months",
    f"""select cast(o_orderdate as date) as date, strftime(o_orderdate, '%Y_%m') as year_month, round(max(o_totalprice), 2) as high, count(*)::double as volume,
      2::bigint as files from orders where strftime(o_orderdate, '%Y_%m') in ({", ".join(f"'{m}'" for m in _MONTHS)}) group by 1, 2""",
)
def _(spark, sf):
    """Monthly files of every day's prices, of which a read of two months opens only those two."""
    root = scratch_path(spark, "prices")
    day = F.to_date("o_orderdate")
    daily = table(spark, sf, "orders").groupBy(day.alias("timestamp")).agg(
        F.min("o_totalprice").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.avg("o_totalprice").alias("close"), F.count("*").cast("double").alias("volume"),
    )
    writers.write_price_files(daily.withColumn("year_month", F.date_format("timestamp", "yyyy_MM")).repartition("year_month"), root)
    got = readers.read_price_months(spark, root, _MONTHS)
    files = len(got.select("file").distinct().collect())  # a file for each month asked for
    return got.select("date", "year_month", F.round("high", 2).alias("high"), "volume", F.lit(files).cast("long").alias("files"))


@query(
    "a13_trend_files",
    """select 'Key' || '' as first_cell, o_orderstatus as status, strftime(cast(date_trunc('week', o_orderdate) as date), '%Y-%m-%d') as key,
      cast(count(*) as integer) as interest, count(*) < 2 as below_one from orders group by 2, 3""",
)
def _(spark, sf):
    """An export for each order status, written with its preamble and read back with the others in one scan."""
    path = scratch_path(spark, "trends")
    week = F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd")
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), week.alias("key")).agg(F.count("*").cast("int").alias("interest"))
    writers.write_trend_files(counts.withColumn("below_one", F.col("interest") < 2), path, "status", "orders")
    back = readers.read_trend_files(spark, path)
    status = F.regexp_extract("heading", r"\((.*)\)", 1)
    return back.select(F.lit("Key").alias("first_cell"), status.alias("status"), "key", F.coalesce("interest", F.lit(1)).alias("interest"), "below_one")
