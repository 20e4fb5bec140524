"""Whole studies, from input tables to result tables and written reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwind.functions.dates import fill_gaps, week_end
from headwind.operators import aggregate as agg
from headwind.operators import ingest, reports, rows, series
from headwind.operators.series import daily_news
from headwind.plans import clusters, relation
from headwind.session import cut
from headwind.sources import writers

MEASURES = ["sentiment_polarity", "sentiment_subjectivity"]


def market_study(prices: DataFrame, news: DataFrame, null_policy: str = "propagate") -> dict[str, DataFrame]:
    """Every price-against-news table: correlations, subjects, sources, directions, lags, the recent days."""
    valid = relation.direction_days(prices, news)
    recent = cut(rows.last_if_more(valid, "date"))
    recent_sweep = cut(series.lag_sweep(recent))
    return {
        "daily_news": daily_news(news),
        "relation": relation.price_sentiment_relation(prices, news),
        "availability": series.availability(relation.joined_days(prices, news)),
        "subjects": relation.subject_impact(prices, news),
        "sources": relation.source_reliability(prices, news, null_policy=null_policy),
        "directions": relation.direction_summary(valid),
        "lags": series.lag_sweep(valid),
        "recent": relation.direction_summary(recent),
        "recent_lags": recent_sweep,
        "strongest_recent_lag": series.strongest_lag(recent_sweep),
        "shifted": relation.strongest_shift(recent, recent_sweep),
    }


def _report(parts: list[DataFrame], path: str) -> None:
    lines = reduce(DataFrame.unionByName, [p.select("grp", "sec", "pos", "line") for p in parts])
    writers.write_lines(lines, path, ["grp", "sec", "pos"])


def sentiment_report(df: DataFrame, key: str, path: str, by: str = "sentiment_cluster_label") -> None:
    tops = {"title_tonality": 1, "text_tonality": 1, "crypto_category": 5, "source": 5}
    headings = {
        "avg_sentiment_polarity": "Average Polarity", "avg_sentiment_subjectivity": "Average Subjectivity",
        "title_tonality": "Dominant Title Tonality", "text_tonality": "Dominant Text Tonality",
        "crypto_category": "Top Crypto Subjects", "source": "Top Sources",
    }
    lines = reports.profile_lines(
        agg.profile(df, by, MEASURES, tops), by, headings, single=("title_tonality", "text_tonality")
    )
    _report([lines, reports.sample_title_lines(df, by, key, "title")], path)


def subject_report(df: DataFrame, key: str, path: str, by: str = "crypto_cluster_label") -> None:
    """Grouped by label: clusters that share a name are reported together."""
    tops = {"crypto_category": None, "sentiment_class": None, "source": 3}
    headings = {
        "crypto_category": "Crypto Categories", "avg_sentiment_polarity": "Average Sentiment Polarity",
        "sentiment_class": "Sentiment Distribution", "source": "Top Sources",
    }
    lines = reports.profile_lines(agg.profile(df, by, MEASURES[:1], tops), by, headings)
    verbs = reports.element_lines(df, by, "title_verbs_parsed", "Top Verbs", 800)
    _report([lines, verbs, reports.sample_title_lines(df, by, key, "title")], path)


def source_report(df: DataFrame, key: str, path: str, by: str = "source_cluster_label") -> None:
    headings = {
        "source": "Top Sources", "avg_sentiment_polarity": "Average Polarity",
        "avg_sentiment_subjectivity": "Average Subjectivity", "crypto_category": "Crypto Focus",
    }
    lines = reports.profile_lines(agg.profile(df, by, MEASURES, {"source": 5, "crypto_category": 3}), by, headings)
    _report([lines, reports.sample_title_lines(df, by, key, "title")], path)


def focused_study(
    prepared: DataFrame, key: str, out: str, max_subjects: int = 8, max_sources: int = 10, n_init: int = 10,
    method: str = "silhouette", dims: int = 50, stop: list[str] | None = None,
) -> DataFrame:
    """Sentiment, subject and source clusters of prepared articles; reports, pair tables and the labelled articles go to
    ``out``. Returns the labelled articles."""
    df = clusters.sentiment_clusters(prepared, n_init=n_init)
    df, _ = clusters.subject_clusters(df, key, max_subjects, method, n_init, dims=dims, stop=stop)
    df, _ = clusters.source_clusters(df, key, max_sources, method, n_init, dims=dims, stop=stop)
    df = cut(df)
    sentiment_report(df, key, f"{out}/sentiment_clusters")
    subject_report(df, key, f"{out}/crypto_clusters")
    source_report(df, key, f"{out}/source_clusters")
    labels = ["sentiment_cluster_label", "crypto_cluster_label", "source_cluster_label"]
    writers.write_csv(agg.pairwise_tables(df, labels), f"{out}/pairs")
    writers.write_csv(df, f"{out}/combined")
    summary = reports.summary_lines(reports.summary_rows(df, *labels, "crypto_category", "sentiment_polarity"))
    writers.write_lines(summary, f"{out}/summary", ["sec", "pos"])
    return df


def general_study(prepared: DataFrame, key: str, out: str, k: int = 5, n_init: int = 10, stop: list[str] | None = None) -> DataFrame:
    """Clusters over words and numbers, their report, weekly counts per cluster and group means."""
    df = cut(clusters.general_clusters(prepared, k, n_init, stop=stop))
    tops = {"sentiment_class": None, "subject": 3, "source": 3, "title_tonality": None, "text_tonality": None}
    headings = {
        "avg_sentiment_polarity": "Average polarity", "avg_sentiment_subjectivity": "Average subjectivity",
        "sentiment_class": "Sentiment distribution", "subject": "COMMON SUBJECTS", "source": "COMMON SOURCES",
        "title_tonality": "Title tonality", "text_tonality": "Text tonality",
    }
    names = df.select("cluster", F.col("cluster_label").alias("name")).distinct()
    lines = reports.profile_lines(agg.profile(df, "cluster", MEASURES, tops), "cluster", headings, digits=2, names=names)
    _report([lines, reports.sample_title_lines(df, "cluster", key, "title")], f"{out}/report")
    weeks = df.withColumn("week", week_end(F.to_date("date")))
    writers.write_csv(agg.crosstab_wide(weeks, "week", "cluster", list(range(k))), f"{out}/weekly")
    writers.write_csv(agg.crosstab_pct(df, "cluster", "sentiment_class"), f"{out}/classes")
    writers.write_csv(agg.group_means(df, "cluster", clusters.NUMBER_FEATURES), f"{out}/means")
    return df


def topic_study(
    prepared: DataFrame, key: str, out: str, topics: int = 12, k: int = 6, rounds: int = 50, n_init: int = 10,
    stop: list[str] | None = None,
) -> clusters.TopicClusters:
    """Topic clusters, their HTML report, topic words and gap-free weekly counts."""
    found = clusters.topic_clusters(prepared, key, topics, k, rounds, n_init, stop=stop)
    df = cut(found.rows)
    names = df.select("topic_cluster", F.col("cluster_name").alias("name")).distinct()
    headings = {
        "subject": "Common Subjects", "avg_sentiment_polarity": "Average polarity",
        "avg_sentiment_subjectivity": "Average subjectivity", "sentiment_class": "Sentiment", "source": "Common Sources",
    }
    profile = agg.profile(df, "topic_cluster", MEASURES, {"subject": 5, "sentiment_class": None, "source": 3})
    lines = reports.profile_lines(profile, "topic_cluster", headings, digits=2, names=names).select("grp", "sec", "pos", "line")
    lines = lines.unionByName(reports.sample_title_lines(df, "topic_cluster", key, "title"))
    writers.write_lines(reports.html_lines(lines, "News Topic Cluster Analysis"), f"{out}/report", ["grp", "sec", "pos"])
    words = found.verb_words.withColumn("kind", F.lit("verb")).unionByName(
        found.adjective_words.withColumn("kind", F.lit("adjective"))
    )
    writers.write_csv(words, f"{out}/topic_words")
    weekly = df.groupBy("topic_cluster", week_end(F.to_date("date")).alias("week")).agg(F.count("*").alias("n"))
    writers.write_csv(fill_gaps(weekly, "week", "n", ["topic_cluster"], 7), f"{out}/weekly")
    writers.write_csv(agg.top_columns(df, "topic_cluster", "subject", 10), f"{out}/subjects")
    writers.write_csv(df.drop("features"), f"{out}/articles")
    return found


def backfill(
    pages: DataFrame, start: Column, end: Column, currencies: list[str], out: str, mode: str = "half_open"
) -> dict[str, DataFrame]:
    """Landed pages of a date range as de-duplicated rows under ``out``, one folder per day; daily counts and shares."""
    items = ingest.flatten_pages(pages).where(ingest.mentions_any(F.col("currencies"), currencies))
    tagged = ingest.backfill(items, "published_at", start, end, mode).drop("pos")
    unique = cut(rows.deduplicate(tagged, ["range_start", "url"], ["published_at"]))
    writers.write_ranges(unique, out)
    daily = unique.groupBy(F.to_date("published_at").alias("date")).agg(F.count("*").alias("n"))
    return {"items": unique, "daily": fill_gaps(daily, "date", "n"), "sentiment": agg.shares(unique, "sentiment")}
