import datetime as dt

import pytest
from pyspark.sql import functions as F

from headwind.operators import ingest
from headwind.operators import rows as row_ops

T = lambda s: F.lit(s).cast("timestamp")


def test_row_index_is_dense_even_when_one_key_dominates(spark):
    # a third of the rows share the leading key
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    got = row_ops.with_row_index(df, ["k", "id"]).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(3000))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_hot_key_is_spread_over_partitions(spark):
    df = spark.range(3000).select(F.lit(7).alias("k"), "id").repartitionByRange(8, "k", "id")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


@pytest.mark.parametrize("rate,n", [(0.25, 250), (1.0, 1000), (0.0, 0), (0.0015, 1)])
def test_sample_has_the_exact_size(spark, rate, n):
    df = spark.range(1000)
    once = {r.id for r in row_ops.exact_sample(df, "id", rate).collect()}
    assert len(once) == n
    assert once == {r.id for r in row_ops.exact_sample(df.repartition(3), "id", rate).collect()}


def test_samples_differ_by_seed(spark):
    a, b = (row_ops.exact_sample(spark.range(1000), "id", 0.1, s) for s in (1, 2))
    assert a.intersect(b).count() < 60


@pytest.mark.parametrize("drop,batches,rows_", [(True, 2, 20), (False, 3, 23)])
def test_batches_drop_the_tail(spark, drop, batches, rows_):
    out = row_ops.number_batches(spark.range(23), ["id"], 10, drop)
    assert out.select("batch").distinct().count() == batches and out.count() == rows_
    assert {tuple(r) for r in out.where("id in (0, 9, 10)").select("id", "batch", "slot").collect()} == {(0, 0, 1), (9, 0, 10), (10, 1, 1)}


def test_deduplicate_keeps_one_whole_row(rows):
    df = rows([("u", 2, "b"), ("u", 1, "a"), ("v", 3, None)], "url string, at int, t string")
    assert {tuple(r) for r in row_ops.deduplicate(df, ["url"], ["at"]).collect()} == {("u", 1, "a"), ("v", 3, None)}


def page_items(rows):
    day = lambda n: dt.datetime(2024, 1, n)
    data = [(1, 9, "a"), (1, 8, "b"), (2, 5, "c"), (2, 4, "d"), (2, 1, "e"), (3, 6, "f")]
    return rows([(p, day(d), u) for p, d, u in data], "page bigint, ts timestamp, url string")


def urls(df):
    return sorted(r.url for r in df.collect())


def test_stop_early(rows):
    items, start = page_items(rows), T("2024-01-03")
    assert urls(ingest.stop_early(items, "ts", start)) == ["a", "b", "c", "d", "f"]
    assert urls(ingest.stop_early(items, "ts", start, mode="compat")) == ["a", "b"]
    assert urls(ingest.stop_early(items, "ts", T("2023-01-01"), mode="compat")) == list("abcdef")
    with pytest.raises(ValueError):
        ingest.stop_early(items, "ts", start, mode="other")


def test_page_limit(rows):
    items = page_items(rows)
    assert urls(ingest.limit_pages(items, "ts", None, None, 1)) == ["a", "b"]
    assert urls(ingest.limit_pages(items, "ts", T("2024-01-06"), None, 10)) == ["a", "b"]  # page 2 has nothing in range
    assert urls(ingest.limit_pages(items, "ts", T("2024-01-04"), T("2024-01-08"), 10)) == ["b", "c", "d", "f"]


def test_flatten_defaults(spark):
    from headwind.schemas import API_PAGE

    doc = '{"results": [{"title": "t", "published_at": "2024-01-01T00:00:00Z", "url": "u", "source": {"title": "s"}}, {"title": "t2", "published_at": "2024-01-01T01:00:00Z", "votes": {"sentiment": "positive"}, "url": "u2", "currencies": [{"code": "BTC"}, {"code": "BTC"}], "source": {"title": "s"}}], "next": null}'
    df = spark.createDataFrame([(doc,)], "d string").select(F.from_json("d", API_PAGE).alias("p")).select("p.*")
    got = [tuple(r) for r in ingest.flatten_pages(df).select("pos", "sentiment", "currencies").collect()]
    assert got == [(0, "neutral", []), (1, "positive", ["BTC", "BTC"])]


def test_date_pairs_clamp(spark):
    got = [(r.range_start.day, r.range_end.day) for r in ingest.date_pairs(spark, "2024-01-01", "2024-01-03").collect()]
    assert got == [(1, 2), (2, 3), (3, 3)]


def test_backfill_midnights(rows):
    items = rows([(dt.datetime(2024, 1, 2), "m"), (dt.datetime(2024, 1, 2, 5), "n"), (dt.datetime(2024, 1, 3), "e"), (dt.datetime(2024, 1, 3, 1), "x")], "ts timestamp, url string")
    lo, hi = F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date")
    half = {(r.url, r.range_start.day) for r in ingest.backfill(items, "ts", lo, hi).collect()}
    assert half == {("m", 2), ("n", 2)}
    compat = sorted((r.url, r.range_start.day) for r in ingest.backfill(items, "ts", lo, hi, "compat").collect())
    assert compat == [("e", 2), ("e", 3), ("m", 1), ("m", 2), ("n", 2)]


def test_currencies(rows):
    df = rows([(["BTC", "S"],), (["XRP"],), ([],)], "c array<string>")
    assert df.where(ingest.mentions_any(F.col("c"), ["BTC", "ETH"])).count() == 1


def test_row_aligned_tables_join_by_index(spark):
    left = row_ops.with_row_index(spark.range(50).select((F.col("id") * 2).alias("a")), ["a"])
    right = row_ops.with_row_index(spark.range(50).select((F.col("id") * 3).alias("b")), ["b"])
    joined = left.join(right, "row_index")
    assert joined.count() == 50 and joined.where("a * 3 <> b * 2").count() == 0


def test_only_frequent_terms_are_folded(rows):
    """the counts of all terms of all documents used to be shuffled and written for a vocabulary of a few."""
    from headwind.operators import features

    docs = rows([(1, ["a", "b", "a", "c"]), (2, ["b", "d"]), (2, ["b"]), (None, ["a", "e"]), (4, None)], "id long, terms array<string>")
    few = features.frequent_terms(docs, "terms", 2)
    assert sorted(r.term for r in few.collect()) == ["a", "b"]
    folded = features.fold_terms(docs, "id", "terms", few)
    every = features.fold_terms(docs, "id", "terms")
    assert folded.count() == 4 < every.count()
    want = {tuple(r) for r in features.term_counts(every, "id", features.vocabulary_of(every, 2)).collect()}
    assert {tuple(r) for r in features.term_counts(folded, "id", features.vocabulary_of(folded, 2)).collect()} == want
    assert features.vocabulary_of(folded, 2).collect() == features.vocabulary_of(every, 2).collect()


def test_terms_are_folded_by_term(spark):
    """A repeated key is one document, a null key too, and what follows by term shuffles no cell again."""
    from headwind.operators import features

    data = [(1, ["b", "a", "b"]), (1, ["a"]), (2, []), (None, ["a"]), (3, ["c", "c", "c"]), (None, ["a", "d"])]
    docs = spark.createDataFrame(data, "id long, terms array<string>")
    folded = features.fold_by_term(docs, "id", "terms")
    assert sorted(map(str, folded.collect())) == sorted(map(str, features.fold_terms(docs, "id", "terms").collect()))
    plan = features.vocabulary_of(folded, min_df=2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
