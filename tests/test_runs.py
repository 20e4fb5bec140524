from conftest import SF
from pyspark.sql import functions as F

from headwind.functions import parse
from headwind.plans import fixtures, runs


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def prepared(spark):
    return parse.preprocess(fixtures.articles(spark, SF))


def test_market_study(spark):
    got = runs.market_study(fixtures.prices(spark, SF), fixtures.news(spark, SF), null_policy="skip")
    assert {k: v.count() > 0 for k, v in got.items() if k != "shifted"} == {k: True for k in got if k != "shifted"}
    assert got["lags"].count() == 11 and got["shifted"].count() >= 0


def test_focused_study(spark, tmp_path):
    out = str(tmp_path)
    df = runs.focused_study(prepared(spark), "row_id", out, 3, 3, n_init=1, method="calinski_harabasz", dims=10)
    n = prepared(spark).count()
    assert df.count() == n and df.where("source_cluster_label is null or crypto_cluster_label is null").count() == 0
    assert f"Total articles analyzed: {n}" in lines(spark, f"{out}/summary")
    text = lines(spark, f"{out}/sentiment_clusters")
    assert text[0] == "--- NEGATIVE CLUSTER ---" and any(t.startswith("Dominant Title Tonality: ") for t in text)
    sizes = [int(t.split()[1]) for t in lines(spark, f"{out}/source_clusters") if t.startswith("Size:")]
    assert sum(sizes) == n
    assert "Top Verbs:" in lines(spark, f"{out}/crypto_clusters")
    pairs = spark.read.option("header", True).csv(f"{out}/pairs")
    assert pairs.agg(F.sum(F.col("n").cast("long"))).first()[0] == 3 * n


def test_general_study(spark, tmp_path):
    df = runs.general_study(prepared(spark), "row_id", str(tmp_path), k=3, n_init=1)
    weekly = spark.read.option("header", True).csv(f"{tmp_path}/weekly")
    assert weekly.select(sum((F.col(str(i)).cast("long") for i in range(3)), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] == df.count()
    assert sum(t.startswith("--- ") for t in lines(spark, f"{tmp_path}/report")) == 3


def test_topic_study(spark, tmp_path):
    found = runs.topic_study(prepared(spark), "row_id", str(tmp_path), topics=2, k=2, rounds=2, n_init=1)
    html = lines(spark, f"{tmp_path}/report")
    assert html[0].startswith("<!DOCTYPE html>") and sum(t.startswith("<h2>") for t in html) == 2
    names = [r.cluster_name for r in found.rows.select("cluster_name").distinct().collect()]
    assert all(len(n) <= 60 for n in names)
    words = spark.read.option("header", True).csv(f"{tmp_path}/topic_words")
    assert {r.kind for r in words.select("kind").distinct().collect()} == {"verb", "adjective"}


def test_backfill(spark, tmp_path):
    pages = fixtures.pages_of_events(spark, SF)
    lo, hi = F.lit("2024-01-02").cast("date"), F.lit("2024-01-06").cast("date")
    got = runs.backfill(pages, lo, hi, ["BTC"], str(tmp_path / "b"))
    total = got["items"].count()
    assert total and got["daily"].agg(F.sum("n")).first()[0] == total
    assert abs(got["sentiment"].agg(F.sum("pct")).first()[0] - 100) < 1e-9
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).count() == total
