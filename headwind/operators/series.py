"""Daily price series, daily news, lags and lead-lag sweeps.

Windows here run over *daily* rows: aggregate to days first. Pass ``symbol`` columns through ``by`` to keep many
series apart (and to give the windows a partitioning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwind.functions.stats import safe_corr, sign3


def _window(by: list[str] | None, day: str):
    return W.partitionBy(*by).orderBy(day) if by else W.orderBy(day)


def price_changes(prices: DataFrame, day: str = "date", close: str = "close", by: list[str] | None = None) -> DataFrame:
    """Percent change to the previous row, its two-way and three-way direction, and the next row's change."""
    w = _window(by, day)
    change = (F.try_divide(F.col(close), F.lag(close).over(w)) - 1) * 100
    out = prices.withColumn("price_change", change)
    return out.withColumns(
        {
            "price_change_direction": F.when(F.col("price_change") > 0, "increase").otherwise("decrease"),
            "price_direction": sign3(F.col("price_change")),
            "next_day_price_change": F.lead("price_change").over(w),
        }
    )


def daily_news(news: DataFrame, day: str = "date", classes: tuple[str, ...] = ("positive", "negative", "neutral")) -> DataFrame:
    """Per day: mean polarity and subjectivity, the most frequent class (ties: smallest) and article counts by class.

    Articles are first folded to (day, class) so a day that holds a third of all articles costs one row per class.
    """
    parts = news.where(F.col(day).isNotNull()).groupBy(day, "sentiment_class").agg(
        F.count("*").alias("m"),
        F.sum("polarity").alias("sp"),
        F.count("polarity").alias("np"),
        F.sum("subjectivity").alias("ss"),
        F.count("subjectivity").alias("ns"),
    )
    known = F.col("sentiment_class").isNotNull()
    return parts.groupBy(day).agg(
        F.try_divide(F.sum("sp"), F.sum("np")).alias("polarity"),
        F.try_divide(F.sum("ss"), F.sum("ns")).alias("subjectivity"),
        F.min(F.when(known, F.struct((-F.col("m")).alias("o"), F.col("sentiment_class").alias("c"))))["c"].alias(
            "sentiment_class"
        ),
        *[
            F.coalesce(F.sum(F.when(F.col("sentiment_class") == c, F.col("m"))), F.lit(0)).alias(c) for c in classes
        ],
    )


def availability(joined: DataFrame) -> DataFrame:
    """0 / 1 flags for days with a price and days with sentiment."""
    return joined.select(
        "date",
        F.col("close").isNotNull().cast("int").alias("has_price"),
        F.col("polarity").isNotNull().cast("int").alias("has_sentiment"),
    )


def lag_correlations(joined: DataFrame, lags: tuple[int, ...] = (1, 2, 3), by: list[str] | None = None) -> DataFrame:
    """Today's price change against sentiment some price rows earlier (all price days count as rows)."""
    w = _window(by, "date")
    lagged = joined.select(
        *(by or []), "price_change", *[F.lag("polarity", k).over(w).alias(f"_l{k}") for k in lags]
    )
    wide = lagged.groupBy(*(by or [])).agg(*[safe_corr(F.col("price_change"), F.col(f"_l{k}")).alias(f"_r{k}") for k in lags])
    return _unpivot(wide, by or [], {k: F.col(f"_r{k}") for k in lags})


def lag_sweep(valid: DataFrame, span: int = 5, by: list[str] | None = None) -> DataFrame:
    """Correlations of price direction and polarity for lags -span..span over news-bearing rows.

    Both readings of a lag are returned: ``ref_label`` is the published wording, ``lead_series`` names the series
    whose *earlier* value takes part. The two disagree on purpose: a negative lag pairs today's direction with earlier
    polarity, a positive lag pairs today's polarity with earlier direction.
    """
    w = _window(by, "date")
    keys = by or []
    shifted = valid.select(
        *keys,
        F.col("price_direction").cast("double").alias("d"),
        F.col("polarity").alias("p"),
        *[F.lag("polarity", -k).over(w).alias(f"_x{k + span}") for k in range(-span, 0)],
        *[F.lag("price_direction", k).over(w).cast("double").alias(f"_x{k + span}") for k in range(1, span + 1)],
    )

    def corr(k: int) -> Column:
        if k == 0:
            return safe_corr(F.col("p"), F.col("d"))
        return safe_corr(F.col("d") if k < 0 else F.col("p"), F.col(f"_x{k + span}"))

    wide = shifted.groupBy(*keys).agg(*[corr(k).alias(f"_r{k + span}") for k in range(-span, span + 1)])
    long = _unpivot(wide, keys, {k: F.col(f"_r{k + span}") for k in range(-span, span + 1)})
    size = F.abs("lag").cast("string")
    label = (
        F.when(F.col("lag") < 0, F.concat(F.lit("Price leads Sentiment by "), size, F.lit(" day(s)")))
        .when(F.col("lag") > 0, F.concat(F.lit("Sentiment leads Price by "), size, F.lit(" day(s)")))
        .otherwise("Same day")
    )
    lead = F.when(F.col("lag") < 0, "sentiment").when(F.col("lag") > 0, "price").otherwise("none")
    return long.withColumns(
        {"ref_label": label, "lead_series": lead}
    )


def strongest_lag(sweep: DataFrame) -> DataFrame:
    """The lag with the largest absolute correlation; the earliest lag wins a tie."""
    return sweep.where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), F.col("lag").asc()).limit(1)


def shifted_series(valid: DataFrame, span: int = 5) -> DataFrame:
    """For each lag but 0, the two series behind it day by day; the series that leads is the shifted one."""
    w = W.orderBy("date")
    direction, polarity = F.col("price_direction"), F.col("polarity")
    pairs = [
        F.struct(
            F.lit(k).alias("lag"),
            (direction if k < 0 else F.lag(direction, k).over(w)).alias("direction"),
            (F.lag(polarity, -k).over(w) if k < 0 else polarity).alias("polarity"),
        )
        for k in range(-span, span + 1)
        if k
    ]
    return valid.select("date", F.array(*pairs).alias("p")).select("date", F.explode("p").alias("p")).select("date", "p.*")


def _unpivot(wide: DataFrame, keys: list[str], cells: dict[int, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), c.alias("r")) for k, c in cells.items()])
    return wide.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
