import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from headwind.operators import aggregate, reports
from headwind.sources import readers, writers
from headwind.streaming import jobs


def test_price_files(spark, tmp_path):
    folder = tmp_path / "COIN_1d"
    folder.mkdir()
    head = "timestamp,open,high,low,close,volume,year_month\n"
    (folder / "COIN_1d_2024_01.csv").write_text(head + "2024-01-30,1.00000000,2,0.5,1.5,10,2024_01\n2024-01-31,1,2,0.5,1.6,10,2024_01\n")
    (folder / "COIN_1d_2024_02.csv").write_text(head + "2024-02-01,1,2,0.5,1.7,10,2024_02\n")
    (folder / "OTHER_1d_2024_02.csv").write_text(head + "2024-02-01,1,2,0.5,9.9,10,2024_02\n")
    px = readers.read_prices(spark, str(tmp_path), "COIN")
    assert [(str(r.date), r.close) for r in px.orderBy("date").collect()] == [("2024-01-30", 1.5), ("2024-01-31", 1.6), ("2024-02-01", 1.7)]
    writers.write_prices(px, str(tmp_path / "table"))
    feb = readers.read_price_table(spark, str(tmp_path / "table"), ["2024_02"])
    assert [r.close for r in feb.collect()] == [1.7]
    plan = feb._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_news_with_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_text(
        "date,sentiment,source,subject,title,text\n"
        "2024-01-01 10:00:00,\"{'class': 'negative', 'polarity': -0.1, 'subjectivity': 0.38}\",Wire,altcoin,\"A \"\"big\"\" day, really\",\"line one\nline two\"\n"
        "2024-01-02 11:00:00,,Wire,nft,,\n"
    )
    news = readers.with_sentiment(readers.read_news(spark, str(path))).orderBy("date").collect()
    assert news[0].title == 'A "big" day, really' and news[0].text == "line one\nline two"
    assert (news[0].sentiment_class, news[0].polarity, news[1].sentiment_class, news[1].title) == ("negative", -0.1, None, None)
    by_name = readers.read_news_by_header(spark, str(path))
    assert by_name.where("title is not null").count() == 1 and "text_verbs" in by_name.columns


def test_trends(spark, tmp_path):
    weekly = tmp_path / "weekly.csv"
    weekly.write_text("Category: All\n\nWeek,coin: (World)\n2020-03-29,16\n2020-04-05,17\n")
    assert [(str(r.week), r.interest) for r in readers.read_weekly_trends(spark, str(weekly)).orderBy("week").collect()] == [("2020-03-29", 16), ("2020-04-05", 17)]
    lands = tmp_path / "lands.csv"
    lands.write_text("Category: All\n\nLand,coin: (2020 - 2025)\nPeru,100\nChad,\nIran,<1\n")
    got = {r.key: (r.interest, r.below_one) for r in readers.read_trends(spark, str(lands)).collect()}
    assert got == {"Peru": (100, False), "Chad": (None, False), "Iran": (None, True)}


def test_fetched_news_and_checkpoint(spark, tmp_path):
    path = tmp_path / "fetched.csv"
    path.write_text("title,published_at,sentiment,url,currencies,source\n\"a, b\",2025-03-13 21:26:41+00:00,neutral,u,\"['BTC', 'S']\",Wire\n")
    row = readers.read_fetched(spark, str(path)).withColumn("at", F.date_format("published_at", "HH:mm:ss")).first()
    assert (row.title, row.at, row.currencies) == ("a, b", "21:26:41", ["BTC", "S"])
    mark = tmp_path / "mark.json"
    mark.write_text('{"processed_records": 20, "processed_batches": [1, 0], "results": {}}')
    assert readers.read_checkpoint(spark, str(mark)).first().processed_batches == [1, 0]


def doc(ids, nxt=None):
    item = lambda i: {"title": f"t{i}", "published_at": f"2024-01-{i:02d}T00:00:00Z", "url": f"u{i}", "source": {"title": "s"}, "currencies": [{"code": "BTC"}]}
    return json.dumps({"results": [item(i) for i in ids], "next": nxt})


def test_landed_pages_are_read_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "page-1.json").write_text(doc([1, 2], "p2"))
    (src / "page-2.json").write_text(doc([3]))
    pages = readers.read_pages(spark, str(src))
    assert {(r.page, len(r.results)) for r in pages.collect()} == {(1, 2), (2, 1)}
    assert jobs.land_pages(spark, str(src), out).count() == 3
    (src / "page-3.json").write_text(doc([4]))
    assert sorted(r.url for r in jobs.land_pages(spark, str(src), out).collect()) == ["u1", "u2", "u3", "u4"]


@pytest.fixture
def landing(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i % 90, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(20000)), "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, kind string")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in")


@pytest.mark.parametrize("width", ["day", "week"])
def test_stream_counts_equal_batch_whatever_the_order(spark, landing, tmp_path, width):
    df, src = landing
    stream = jobs.read_files(spark, src, df.schema, files_per_batch=1)
    want = {tuple(r) for r in jobs.bucket_counts(df, "ts", ["kind"], width).collect()}
    assert {tuple(r) for r in jobs.count_to(stream, str(tmp_path / "c"), "ts", ["kind"], width).collect()} == want


def test_late_days_count(spark, tmp_path):
    """One-row files whose days come in the wrong order, in two runs: nothing is late, and the base is folded once a run."""
    src, out, got = tmp_path / "in", str(tmp_path / "out"), None
    days = [dt.datetime(2024, 1, d) for d in (30, 31, 1, 2, 30)]
    for run in (days[:3], days[3:]):
        for day in run:
            spark.createDataFrame([(1, day)], "id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(src))
        stream = jobs.read_files(spark, str(src), "id long, ts timestamp", files_per_batch=1)
        got = {str(r.bucket): r.n for r in jobs.count_to(stream, out, "ts", []).collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-30": 2, "2024-01-31": 1}
    again = jobs.count_to(jobs.read_files(spark, str(src), "id long, ts timestamp", files_per_batch=1), out, "ts", [])
    assert sum(r.n for r in again.collect()) == 5


def test_stream_deduplicates_whatever_the_order(spark, landing, tmp_path):
    df, src = landing
    stream = jobs.read_files(spark, src, df.schema, files_per_batch=1)
    kept = jobs.deduplicate_to(stream, str(tmp_path / "d"), ["id"], ["ts"])
    assert sorted(r.id for r in kept.collect()) == list(range(90))
    assert kept.join(df, ["id", "ts", "kind"], "left_anti").count() == 0


def test_annotation_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.range(12).select("id", F.format_string("t%d", "id").alias("title"), F.lit("x").alias("text"))
    frame.where("id < 7").write.parquet(src)
    fn = lambda p, r: json.dumps([{"record_id": i + 1, "title_tonality": "ok"} for i in range(len(r))])
    run = lambda: jobs.annotate_new(jobs.read_files(spark, src, frame.schema), out, fn, "id", ["id"])
    assert run().count() == 7
    frame.where("id >= 7").write.mode("append").parquet(src)
    assert sorted(r.id for r in run().collect()) == list(range(12))


def report_rows(rows):
    data = [("Positive", "A", "s1", "Bitcoin", 0.5, 1)] * 3 + [("Negative", "B", "s2", "Ethereum", -0.5, 2)]
    return rows(data, "lab string, subj string, src string, cat string, pol double, id int")


def test_cluster_report_text(rows, tmp_path, spark):
    df = report_rows(rows)
    profile = aggregate.profile(df, "lab", ["pol"], {"cat": 5, "src": None})
    lines = reports.profile_lines(profile, "lab", {"avg_pol": "Average Polarity", "cat": "Top Subjects", "src": "Top Sources"})
    writers.write_lines(lines, str(tmp_path / "r"), ["grp", "sec", "pos"])
    got = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert got == [
        "--- NEGATIVE CLUSTER ---", "Size: 1 articles", "Average Polarity: -0.5000", "Top Subjects:", "  - Ethereum: 1 articles (100.0%)",
        "Top Sources:", "  - s2: 1 articles (100.0%)",
        "--- POSITIVE CLUSTER ---", "Size: 3 articles", "Average Polarity: 0.5000", "Top Subjects:", "  - Bitcoin: 3 articles (100.0%)",
        "Top Sources:", "  - s1: 3 articles (100.0%)",
    ]
    html = [r.line for r in reports.html_lines(lines.select("grp", "sec", "pos", "line"), "News").orderBy("grp", "sec", "pos").collect()]
    assert html[0].startswith("<!DOCTYPE html>") and html[-1] == "</body></html>" and "<h2>--- NEGATIVE CLUSTER ---</h2>" in html


def test_summary_lines(rows):
    df = report_rows(rows)
    lines = [r.line for r in reports.summary_lines(reports.summary_rows(df, "lab", "subj", "src", "cat", "pol")).orderBy("sec", "pos").collect()]
    assert "Total articles analyzed: 4" in lines and "Positive Cluster: 3 articles (75.0%)" in lines
    assert "- A (avg. polarity: 0.50)" in lines and "- s1 > Bitcoin (3 articles)" in lines


def test_json_sink(rows, spark, tmp_path):
    df = rows([(1, ["a"]), (2, [])], "id int, t array<string>")
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).where("size(t) = 1").first().id == 1


def test_cluster_without_local_checkpoint_folder_is_refused():
    from headwind.session import shared_dir

    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        shared_dir(Session())


@pytest.fixture
def twenty(spark, tmp_path):
    """Twenty one-file micro-batches of 30 rows, with keys from a small range, so that most repeat."""
    src = str(tmp_path / "many")
    rows = [(k * 7 % 97, dt.datetime(2024, 1, 1) + dt.timedelta(hours=(k * 37) % 600), k % 20) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, part int")
    df.repartitionByRange(20, "part").write.parquet(src)
    return df, src


def test_keyed_state_reads_only_what_is_new(spark, twenty, tmp_path):
    df, src = twenty
    kept, progress = jobs.deduplicate_keyed(jobs.read_files(spark, src, df.schema, files_per_batch=1), str(tmp_path / "k"), ["id"], ["ts"])
    assert sorted(r.id for r in kept.collect()) == list(range(97)) and kept.join(df, df.columns, "left_anti").count() == 0
    assert [p["numInputRows"] for p in progress] == [30] * 20
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 97
    df.limit(5).withColumn("id", F.col("id") + 50).write.mode("append").parquet(src)
    again, progress = jobs.deduplicate_keyed(jobs.read_files(spark, src, df.schema, files_per_batch=1), str(tmp_path / "k"), ["id"], ["ts"])
    assert sum(p["numInputRows"] for p in progress) == 5 and again.select("id").distinct().count() == again.count()


@pytest.mark.parametrize("delay", ["0 days", "3 days", "100 days"])
def test_windows_lose_nothing(spark, twenty, tmp_path, delay):
    df, src = twenty
    out = jobs.window_counts_to(jobs.read_files(spark, src, df.schema, files_per_batch=1), str(tmp_path / "w"), "ts", ["part"], delay=delay)
    late = jobs.bucket_counts(out["late"], "ts", ["part"])
    closed, open_ = out["closed"].collect(), out["open"].collect()
    assert not {(r.bucket, r.part) for r in closed} & {(r.bucket, r.part) for r in open_}
    assert len({(r.bucket, r.part) for r in closed}) == len(closed)
    every = out["closed"].unionByName(out["open"]).unionByName(late).groupBy("bucket", "part").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in every.collect()} == {tuple(r) for r in jobs.bucket_counts(df, "ts", ["part"]).collect()}
    assert (late.count() > 0) == (delay != "100 days") and (delay == "100 days") == (not closed)


def test_a_broken_backfill_is_repeated_without_double_rows(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.createDataFrame([(f"2024-01-{d:02d}", d * 10 + k) for d in range(1, 6) for k in range(3)], "range_start string, v int")
    writers.backfill_ranges(df.where("range_start < '2024-01-03'"), path)
    writers.write_ranges(df.where("range_start = '2024-01-04' and v < 42"), f"{path}/rows", mode="append")  # broken off
    for _ in range(2):
        done = writers.backfill_ranges(df, path)
        assert sorted((r.range_start.isoformat() if hasattr(r.range_start, "isoformat") else r.range_start, r.n) for r in done.collect()) == [(f"2024-01-{d:02d}", 3) for d in range(1, 6)]
        back = spark.read.options(**readers.QUOTED_CSV).csv(f"{path}/rows")
        assert sorted(int(r.v) for r in back.collect()) == sorted(r.v for r in df.collect())


def test_only_the_months_asked_for_are_opened(spark, tmp_path):
    folder = tmp_path / "COIN_1d"
    folder.mkdir()
    head = "timestamp,open,high,low,close,volume,year_month\n"
    for m in range(1, 13):
        (folder / f"COIN_1d_2024_{m:02d}.csv").write_text(head + f"2024-{m:02d}-05,1,2,0.5,{m},10,2024_{m:02d}\n")
    got = readers.read_price_months(spark, str(tmp_path), ["2024_02", "2024_11"], "COIN")
    assert sorted((r.year_month, r.close) for r in got.collect()) == [("2024_02", 2.0), ("2024_11", 11.0)]
    scan = got._jdf.queryExecution()
    scan.executedPlan()
    assert "file_path" in scan.toString()


def test_trend_files_find_their_own_headings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Category: All\n\nWeek,coin: (World)\n2020-03-29,16\n2020-04-05,<1\n")
    (tmp_path / "b.csv").write_text("note one\nCategory: Finance\n\nLand,coin: (2020 - 2025)\r\nPeru,100\r\nChad,\r\n")
    got = {(r.heading, r.key): (r.interest, r.below_one) for r in readers.read_trend_files(spark, str(tmp_path)).collect()}
    assert got == {
        ("coin: (World)", "2020-03-29"): (16, False), ("coin: (World)", "2020-04-05"): (None, True),
        ("coin: (2020 - 2025)", "Peru"): (100, False), ("coin: (2020 - 2025)", "Chad"): (None, False),
    }


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_as_a_file_or_a_folder(spark, tmp_path, files):
    """a table that is a folder of files used to give an empty stream."""
    from headwind.plans import catalog_flows

    talk = [(i, 0, "user", f"the title {i}\nis and more") for i in range(30)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(files).write.parquet(str(tmp_path / "made"))
    if files == 1:
        next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "conversations.parquet")
    else:
        (tmp_path / "made").rename(tmp_path / "conversations.parquet")
    out = str(tmp_path / "out")
    jobs.append_to(catalog_flows._stream(spark, str(tmp_path), "conversations"), out)
    assert sorted(tuple(r) for r in jobs.rows_of(spark, out).collect()) == talk
