"""The four price-against-news analyses, from article rows and daily prices to result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwind.functions.stats import avg_where, corr_from_moments, hit_rate, safe_corr, sign3, student_two_sided, t_statistic
from headwind.operators.series import daily_news, price_changes, shifted_series, strongest_lag
from headwind.session import cut


def joined_days(prices: DataFrame, news: DataFrame) -> DataFrame:
    """Every price day with its changes and, where known, that day's news."""
    return price_changes(prices).join(daily_news(news), "date", "left")


def valid_days(joined: DataFrame) -> DataFrame:
    """Days with both a price and sentiment."""
    return joined.dropna(subset=["polarity", "close"])


def price_sentiment_relation(prices: DataFrame, news: DataFrame, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Correlations, conditional means, joint-day count and lag correlations as ``metric, value``.

    One aggregation over the joined days yields every number; the result row is then turned into lines.
    """
    w = W.orderBy("date")  # days, not articles
    days = joined_days(prices, news).withColumns({f"_l{k}": F.lag("polarity", k).over(w) for k in lags})
    change, polarity, subjectivity = F.col("price_change"), F.col("polarity"), F.col("subjectivity")
    metrics = {
        "corr price_change / polarity": safe_corr(change, polarity),
        "corr price_change / subjectivity": safe_corr(change, subjectivity),
        "corr polarity / subjectivity": safe_corr(polarity, subjectivity),
        "mean polarity on rising days": avg_where(change > 0, polarity),
        "mean polarity on falling days": avg_where(change < 0, polarity),
        "joint days": F.count_if(polarity.isNotNull() & F.col("close").isNotNull()).cast("double"),
    }
    for k in lags:
        metrics[f"corr price_change / polarity {k} row(s) before"] = safe_corr(change, F.col(f"_l{k}"))
    wide = days.agg(*[c.alias(f"_{i}") for i, c in enumerate(metrics.values())])
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_{i}").alias("value")) for i, m in enumerate(metrics)])
    return wide.select(F.explode(lines).alias("x")).select("x.*")


def subject_impact(prices: DataFrame, news: DataFrame) -> DataFrame:
    """Correlation of each subject's daily article count with the price change, strongest first.

    A day without articles on a subject counts as 0, and so does the first day's unknown change. Zeros add nothing to
    the sums, so the counts stay in long form: only mention days are joined and no wide table is built.
    """
    changes = price_changes(prices).select("date", F.coalesce("price_change", F.lit(0.0)).alias("y"))
    mentions = news.where("subject is not null and date is not null").groupBy("subject", "date").agg(
        F.count("*").cast("double").alias("x")
    )
    # a subject whose articles all fall on days without a price has only zeros left, hence the left join
    sums = (
        mentions.join(changes, "date", "left")
        .withColumn("x", F.when(F.col("y").isNotNull(), F.col("x")).otherwise(0.0))
        .groupBy("subject")
        .agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.coalesce("y", F.lit(0.0))).alias("sxy"))
    )
    y = F.col("y")
    totals = changes.agg(F.struct(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(y * y).alias("syy")))
    r = corr_from_moments(*[F.col(c) for c in ("t.n", "sx", "t.sy", "sxx", "t.syy", "sxy")])
    return sums.withColumn("t", totals.scalar()).select("subject", r.alias("r")).orderBy(F.abs("r").desc_nulls_last(), "subject")


def source_reliability(prices: DataFrame, news: DataFrame, min_days: int = 5, null_policy: str = "propagate") -> DataFrame:
    """Correlation of each source's daily polarity with the next day's price change, best first.

    ``propagate``: one unknown value removes the source. ``skip``: unknown pairs are left out. Sources need more than
    ``min_days`` rows either way.
    """
    if null_policy not in ("propagate", "skip"):
        raise ValueError(f"unknown null_policy {null_policy!r}")
    daily = news.where("date is not null and source is not null").groupBy("date", "source").agg(
        F.avg("polarity").alias("polarity")
    )
    changes = price_changes(prices).select("date", "price_change", "next_day_price_change")
    x, y = F.col("polarity"), F.col("next_day_price_change")
    per_source = daily.join(changes, "date", "left").groupBy("source").agg(
        safe_corr(x, y).alias("r"), F.count("*").alias("n"), F.count_if(x.isNull() | y.isNull()).alias("nulls")
    )
    keep = (F.col("n") > min_days) & F.col("r").isNotNull()
    if null_policy == "propagate":
        keep = keep & (F.col("nulls") == 0)
    return per_source.where(keep).select("source", "r", "n").orderBy(F.desc("r"), "source")


def direction_days(prices: DataFrame, news: DataFrame) -> DataFrame:
    """News-bearing price days with both directions and whether they agree.

    One row per day, kept in the shared folder: the sweeps and summaries read it several times, the articles only once.
    """
    days = valid_days(joined_days(prices, news)).select("date", "price_change", "price_direction", "polarity")
    signed = days.withColumn("polarity_direction", sign3(F.col("polarity")))
    return cut(signed.withColumn("match", (F.col("polarity_direction") == F.col("price_direction")).cast("int")))


def direction_summary(valid: DataFrame) -> DataFrame:
    """Days, mean polarity, hit rate, same-day r, its t value and two-sided p."""
    one = valid.agg(
        F.count("*").alias("n"),
        F.avg("polarity").alias("mean_polarity"),
        hit_rate(F.col("polarity_direction"), F.col("price_direction")).alias("hit_rate"),
        safe_corr(F.col("price_direction"), F.col("polarity")).alias("r"),
    )
    tested = one.withColumn("t", t_statistic(F.col("r"), F.col("n")))
    return tested.withColumn("p", student_two_sided("t", (F.col("n") - 2).cast("double")))


def strongest_shift(valid: DataFrame, sweep: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The two series at the strongest lag; empty when that lag is 0 or its correlation is at most ``threshold``.

    All candidate lags come from one pass over the days; the winner (one row) then picks among them.
    """
    best = strongest_lag(sweep).where((F.col("lag") != 0) & (F.abs("r") > threshold)).select("lag")
    return shifted_series(valid).join(F.broadcast(best), "lag", "left_semi")
