"""Queries on prices and daily news: joins, windows, correlations, time buckets."""

from pyspark.sql import functions as F

from headwind.functions.dates import fill_gaps, month_end, week_end
from headwind.functions.stats import hit_rate
from headwind.operators import aggregate as agg
from headwind.operators import rows, series
from headwind.plans import relation
from headwind.plans.fixtures import CHANGES, DAILY, JOINED, NEWS, PRICES, news, prices, table
from headwind.plans.registry import query


def r6(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return col.alias(name or c)


CORR = "covar_pop({x}, {y}) filter ({x} is not null and {y} is not null) / nullif(stddev_pop({x}) filter ({y} is not null) * stddev_pop({y}) filter ({x} is not null), 0)"


def corr_sql(x, y):
    return CORR.format(x=x, y=y)


SWEEP_SPAN = range(-5, 6)


def _sweep_sql(source: str) -> str:
    shifted = ", ".join(
        f"lag({'polarity' if k < 0 else 'price_direction'}, {abs(k)}) over (order by date) as x{k + 5}" for k in SWEEP_SPAN if k
    )
    lines = " union all ".join(
        f"select {k} as lag, {corr_sql('price_direction' if k < 0 else 'polarity', f'x{k + 5}' if k else 'price_direction')} as r from s"
        for k in SWEEP_SPAN
    )
    return f"s as (select date, polarity, price_direction, {shifted} from {source}), sweep as ({lines})"


SWEEP_LABEL = """case when lag < 0 then 'Price leads Sentiment by ' || abs(lag) || ' day(s)' when lag > 0 then
  'Sentiment leads Price by ' || lag || ' day(s)' else 'Same day' end as ref_label,
  case when lag < 0 then 'sentiment' when lag > 0 then 'price' else 'none' end as lead_series"""

VALID = f"{JOINED}, valid as (select *, case when polarity > 0 then 1 when polarity < 0 then -1 else 0 end as polarity_direction from joined where polarity is not null and close is not null)"
RECENT = f"{VALID}, recent as (select * from valid where (select count(*) from valid) > 90 order by date desc limit 90)"


@query(
    "j1_price_sentiment_relation",
    f"""with {JOINED}, l as (select *, lag(polarity, 1) over (order by date) as l1, lag(polarity, 2) over (order by date) as l2,
      lag(polarity, 3) over (order by date) as l3 from joined),
    m as (
      select 'corr price_change / polarity' as metric, {corr_sql('price_change', 'polarity')} as value from l
      union all select 'corr price_change / subjectivity', {corr_sql('price_change', 'subjectivity')} from l
      union all select 'corr polarity / subjectivity', {corr_sql('polarity', 'subjectivity')} from l
      union all select 'mean polarity on rising days', avg(polarity) filter (price_change > 0) from l
      union all select 'mean polarity on falling days', avg(polarity) filter (price_change < 0) from l
      union all select 'joint days', count(*) filter (polarity is not null and close is not null) from l
      union all select 'corr price_change / polarity 1 row(s) before', {corr_sql('price_change', 'l1')} from l
      union all select 'corr price_change / polarity 2 row(s) before', {corr_sql('price_change', 'l2')} from l
      union all select 'corr price_change / polarity 3 row(s) before', {corr_sql('price_change', 'l3')} from l)
    select metric, round(value, 6) + 0.0 as value from m""",
)
def _(spark, sf):
    return relation.price_sentiment_relation(prices(spark, sf), news(spark, sf)).select("metric", r6("value"))


@query(
    "j2_e20_subject_impact",
    f"""with {NEWS}, {PRICES}, {CHANGES}, y as (select date, coalesce(price_change, 0) as y from change),
    g as (select s.subject, y.date, y.y, coalesce(c.n, 0) as x from (select distinct subject from news) s cross join y
      left join (select subject, date, count(*) as n from news group by all) c on c.subject = s.subject and c.date = y.date)
    select subject, round({corr_sql('x', 'y')}, 6) + 0.0 as r from g group by subject""",
)
def _(spark, sf):
    return relation.subject_impact(prices(spark, sf), news(spark, sf)).select("subject", r6("r"))


_SOURCE_DAYS = "sd as (select date, source, avg(polarity) as polarity from news group by all), m as (select sd.*, next_day_price_change from sd left join change using (date))"


@query(
    "j3_e21_source_reliability_skip",
    f"""with {NEWS}, {PRICES}, {CHANGES}, {_SOURCE_DAYS}
    select source, round({corr_sql('polarity', 'next_day_price_change')}, 6) + 0.0 as r, count(*) as n from m group by source
    having count(*) > 5 and {corr_sql('polarity', 'next_day_price_change')} is not null""",
)
def _(spark, sf):
    out = relation.source_reliability(prices(spark, sf), news(spark, sf), null_policy="skip")
    return out.select("source", r6("r"), "n")


@query(
    "j3_e21_source_reliability_propagate",
    f"""with n0 as (select 1), {NEWS}, {PRICES}, {CHANGES}, {_SOURCE_DAYS}, k as (select * from m where next_day_price_change is not null)
    select source, round({corr_sql('polarity', 'next_day_price_change')}, 6) + 0.0 as r, count(*) as n from k group by source
    having count(*) > 5 and {corr_sql('polarity', 'next_day_price_change')} is not null""",
)
def _(spark, sf):
    # news on days that have a next-day price, so that no pair is unknown
    px = prices(spark, sf)
    known = series.price_changes(px).where("next_day_price_change is not null").select("date")
    out = relation.source_reliability(px, news(spark, sf).join(known, "date", "left_semi"))
    return out.select("source", r6("r"), "n")


@query(
    "j4_e23_e24_direction_summary",
    f"""with {VALID}, a as (select count(*) as n, avg(polarity) as mean_polarity,
      avg(case when polarity_direction = price_direction then 1.0 else 0.0 end) * 100 as hit_rate,
      {corr_sql('price_direction', 'polarity')} as r from valid)
    select n, round(mean_polarity, 6) + 0.0 as mean_polarity, round(hit_rate, 6) + 0.0 as hit_rate, round(r, 6) + 0.0 as r,
      round(r * sqrt(n - 2) / sqrt(1 - r * r), 6) + 0.0 as t from a""",
)
def _(spark, sf):
    days = relation.direction_days(prices(spark, sf), news(spark, sf))
    return relation.direction_summary(days).select("n", r6("mean_polarity"), r6("hit_rate"), r6("r"), r6("t"))


@query("e24_point_biserial_p")
def _(spark, sf):
    days = relation.direction_days(prices(spark, sf), news(spark, sf))
    return relation.direction_summary(days).select("n", r6("r"), r6("t"), r6("p"))


@query("f4_f5_lag_sweep", f"with {VALID}, {_sweep_sql('valid')} select lag, round(r, 6) + 0.0 as r, {SWEEP_LABEL} from sweep")
def _(spark, sf):
    days = relation.direction_days(prices(spark, sf), news(spark, sf))
    return series.lag_sweep(days).select("lag", r6("r"), "ref_label", "lead_series")


@query(
    "f6_f7_strongest_recent_lag",
    f"""with {RECENT}, {_sweep_sql('recent')}
    select lag, round(r, 6) + 0.0 as r, {SWEEP_LABEL} from sweep where r is not null order by abs(r) desc, lag limit 1""",
)
def _(spark, sf):
    days = relation.direction_days(prices(spark, sf), news(spark, sf))
    best = series.strongest_lag(series.lag_sweep(rows.last_if_more(days, "date")))
    return best.select("lag", r6("r"), "ref_label", "lead_series")


@query(
    "f7_recent_hit_rate",
    f"""with {RECENT} select count(*) as n, min(date) as first_day, max(date) as last_day,
      round(avg(case when polarity_direction = price_direction then 1.0 else 0.0 end) * 100, 6) as hit_rate,
      round({corr_sql('price_direction', 'polarity')}, 6) + 0.0 as r from recent""",
)
def _(spark, sf):
    days = rows.last_if_more(relation.direction_days(prices(spark, sf), news(spark, sf)), "date")
    from headwind.functions.stats import safe_corr

    return days.agg(
        F.count("*").alias("n"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        r6(hit_rate(F.col("polarity_direction"), F.col("price_direction")), "hit_rate"),
        r6(safe_corr(F.col("price_direction"), F.col("polarity")), "r"),
    )


@query(
    "f8_shifted_series",
    f"""with {RECENT}, {_sweep_sql('recent')},
    best as (select lag from sweep where r is not null and lag <> 0 and abs(r) > 0.1
             and lag = (select lag from sweep where r is not null order by abs(r) desc, lag limit 1)),
    p as (select b.lag, s.* from s, best b)
    select lag, date,
      case lag {' '.join(f'when {k} then ' + ('price_direction' if k < 0 else f'x{k + 5}') for k in SWEEP_SPAN if k)} end as direction,
      round(case lag {' '.join(f'when {k} then ' + (f'x{k + 5}' if k < 0 else 'polarity') for k in SWEEP_SPAN if k)} end, 6) + 0.0 as polarity
    from p""",
)
def _(spark, sf):
    recent = rows.last_if_more(relation.direction_days(prices(spark, sf), news(spark, sf)), "date")
    out = relation.strongest_shift(recent, series.lag_sweep(recent))
    return out.select("lag", "date", "direction", r6("polarity"))


@query(
    "b10_b11_b12_f1_f2_price_changes",
    f"""with {PRICES}, {CHANGES} select date, round(price_change, 6) + 0.0 as price_change, price_change_direction,
      price_direction, round(next_day_price_change, 6) + 0.0 as next_day_price_change from change""",
)
def _(spark, sf):
    out = series.price_changes(prices(spark, sf))
    return out.select("date", r6("price_change"), "price_change_direction", "price_direction", r6("next_day_price_change"))


@query(
    "e1_d2_daily_news",
    f"""with {NEWS}, {DAILY}, c as (select date, sentiment_class, row_number() over (partition by date order by count(*) desc, sentiment_class) as rn
      from news group by date, sentiment_class)
    select d.date, round(polarity, 6) + 0.0 as polarity, round(subjectivity, 6) + 0.0 as subjectivity, c.sentiment_class,
      positive, negative, neutral from daily d join c on c.date = d.date and rn = 1""",
)
def _(spark, sf):
    out = series.daily_news(news(spark, sf))
    return out.select("date", r6("polarity"), r6("subjectivity"), "sentiment_class", "positive", "negative", "neutral")


@query(
    "d1_b13_price_days_with_news",
    f"""with {JOINED} select date, round(close, 6) as close, round(polarity, 6) + 0.0 as polarity from joined""",
)
def _(spark, sf):
    out = relation.joined_days(prices(spark, sf), news(spark, sf))
    return out.select("date", r6("close"), r6("polarity"))


@query(
    "d3_e2_subject_counts_on_price_days",
    f"""with {NEWS}, {PRICES}, {CHANGES}, c as (select date, count(*) filter (subject = 'A') as "A", count(*) filter (subject = 'N') as "N",
      count(*) filter (subject = 'R') as "R" from news group by date)
    select date, round(coalesce(price_change, 0), 6) + 0.0 as price_change, coalesce("A", 0) as "A", coalesce("N", 0) as "N",
      coalesce("R", 0) as "R" from change left join c using (date)""",
)
def _(spark, sf):
    counts = agg.crosstab_wide(news(spark, sf), "date", "subject", ["A", "N", "R"])
    joined = series.price_changes(prices(spark, sf)).select("date", "price_change").join(counts, "date", "left").fillna(0)
    return joined.select("date", r6("price_change"), "A", "N", "R")


@query(
    "d4_source_days_with_prices",
    f"""with {NEWS}, {PRICES}, {CHANGES}, sd as (select date, source, avg(polarity) as polarity from news group by all)
    select date, source, round(polarity, 6) + 0.0 as polarity, round(price_change, 6) + 0.0 as price_change,
      round(next_day_price_change, 6) + 0.0 as next_day_price_change from sd left join change using (date)""",
)
def _(spark, sf):
    per_source = news(spark, sf).groupBy("date", "source").agg(F.avg("polarity").alias("polarity"))
    changes = series.price_changes(prices(spark, sf)).select("date", "price_change", "next_day_price_change")
    out = per_source.join(changes, "date", "left")
    return out.select("date", "source", r6("polarity"), r6("price_change"), r6("next_day_price_change"))


@query(
    "f3_lag_correlations",
    f"""with {JOINED}, l as (select *, {', '.join(f'lag(polarity, {k}) over (order by date) as l{k}' for k in (1, 2, 3))} from joined)
    {' union all '.join(f"select {k} as lag, round({corr_sql('price_change', f'l{k}')}, 6) + 0.0 as r from l" for k in (1, 2, 3))}""",
)
def _(spark, sf):
    return series.lag_correlations(relation.joined_days(prices(spark, sf), news(spark, sf))).select("lag", r6("r"))


_TRIPLE = ["price_change", "polarity", "subjectivity"]


@query(
    "e18_e19_e22_correlation_matrix",
    f"with {JOINED} "
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, round({corr_sql(a, b)}, 6) + 0.0 as r from joined" for a in _TRIPLE for b in _TRIPLE
    ),
)
def _(spark, sf):
    return agg.corr_matrix(relation.joined_days(prices(spark, sf), news(spark, sf)), _TRIPLE).select("a", "b", r6("r"))


@query(
    "e17_conditional_means",
    f"""with {JOINED} select round(avg(polarity) filter (price_change > 0), 6) + 0.0 as up,
      round(avg(polarity) filter (price_change < 0), 6) + 0.0 as down from joined""",
)
def _(spark, sf):
    from headwind.functions.stats import avg_where

    j = relation.joined_days(prices(spark, sf), news(spark, sf))
    up, down = F.col("price_change") > 0, F.col("price_change") < 0
    return j.agg(r6(avg_where(up, F.col("polarity")), "up"), r6(avg_where(down, F.col("polarity")), "down"))


@query(
    "g6_availability",
    f"with {JOINED} select date, 1 as has_price, case when polarity is null then 0 else 1 end as has_sentiment from joined",
)
def _(spark, sf):
    return series.availability(relation.joined_days(prices(spark, sf), news(spark, sf)))


@query(
    "e26_news_extent",
    f"with {NEWS} select count(*) as n, min(date) as first_day, max(date) as last_day from news",
)
def _(spark, sf):
    return news(spark, sf).agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("j5_joint_days", f"with {VALID} select date, price_direction from valid")
def _(spark, sf):
    return relation.valid_days(relation.joined_days(prices(spark, sf), news(spark, sf))).select("date", "price_direction")


# --- time buckets ---------------------------------------------------------------------------------------------------

_WEEK = "cast(date_trunc('week', ts) as date) + 6"


@query("g2_weekly_counts_long", f"select cast({_WEEK} as date) as week, event_type, count(*) as n from events group by all")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(week_end(F.to_date("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "g1_weekly_counts_wide",
    f"select cast({_WEEK} as date) as week, "
    + ", ".join(f"count(*) filter (event_type = '{t}') as \"{t}\"" for t in _TYPES)
    + " from events group by 1",
)
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("week", week_end(F.to_date("ts")))
    return agg.crosstab_wide(ev, "week", "event_type", _TYPES)


@query(
    "g3_weekly_counts_gap_free",
    f"""with {NEWS}, c as (select source, cast(date_trunc('week', date) as date) + 6 as week, count(*) as n from news group by all),
    b as (select source, min(week) as lo, max(week) as hi from c group by source),
    w as (select source, cast(unnest(generate_series(lo, hi, interval 7 day)) as date) as week from b)
    select w.source, w.week, coalesce(n, 0) as n from w left join c on c.source = w.source and c.week = w.week""",
)
def _(spark, sf):
    counts = news(spark, sf).groupBy("source", week_end(F.col("date")).alias("week")).agg(F.count("*").alias("n"))
    return fill_gaps(counts, "week", "n", ["source"], 7)


@query(
    "g4_monthly_counts",
    f"""with {NEWS} select last_day(date) as month, count(*) filter (sentiment_class = 'positive') as positive,
      count(*) filter (sentiment_class = 'negative') as negative, count(*) filter (sentiment_class = 'neutral') as neutral
    from news group by 1""",
)
def _(spark, sf):
    rows_ = news(spark, sf).withColumn("month", month_end(F.col("date")))
    return agg.crosstab_wide(rows_, "month", "sentiment_class", ["positive", "negative", "neutral"])


@query(
    "g5_daily_counts_gap_free",
    """with c as (select user_id, cast(ts as date) as date, count(*) as n from events group by all),
    b as (select user_id, min(date) as lo, max(date) as hi from c group by user_id),
    w as (select user_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from b)
    select w.user_id, w.date, coalesce(n, 0) as n from w left join c on c.user_id = w.user_id and c.date = w.date""",
)
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    return fill_gaps(counts, "date", "n", ["user_id"])
