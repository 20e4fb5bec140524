import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwind.functions import dates, stats
from headwind.operators import aggregate, rows as row_ops, series
from headwind.plans import relation

D = lambda s: dt.date.fromisoformat(s)


def days(n, start="2024-01-01"):
    return [D(start) + dt.timedelta(i) for i in range(n)]


def test_changes_and_directions(rows):
    px = rows(list(zip(days(4), [10.0, 11.0, 11.0, 9.9])), "date date, close double")
    got = series.price_changes(px).orderBy("date").collect()
    assert [None if r.price_change is None else round(r.price_change, 6) for r in got] == [None, 10.0, 0.0, -10.0]
    assert [r.price_change_direction for r in got] == ["decrease", "increase", "decrease", "decrease"]
    assert [r.price_direction for r in got] == [0, 1, 0, -1]
    assert [None if r.next_day_price_change is None else round(r.next_day_price_change, 6) for r in got] == [10.0, 0.0, -10.0, None]


def test_zero_price_does_not_fail(rows):
    px = rows(list(zip(days(3), [0.0, 5.0, 5.0])), "date date, close double")
    assert [r.price_change for r in series.price_changes(px).orderBy("date").collect()] == [None, None, 0.0]


def test_most_frequent_class_ties_to_smallest(rows):
    one = days(1)[0]
    news = rows([(one, 0.5, None, c) for c in "bacca"] + [(D("2024-02-01"), None, None, None)], "date date, polarity double, subjectivity double, sentiment_class string")
    got = {r.date: r for r in series.daily_news(news, classes=("a", "b")).collect()}
    assert got[one].sentiment_class == "a" and (got[one].a, got[one].b) == (2, 1)
    assert got[D("2024-02-01")].sentiment_class is None and got[D("2024-02-01")].polarity is None


@pytest.mark.parametrize(
    "pairs,expected",
    [([(1.0, 2.0), (2.0, 2.0)], None), ([(1.0, 2.0)], None), ([(1.0, 2.0), (2.0, 4.0), (None, 9.0), (3.0, None)], 1.0), ([], None)],
)
def test_safe_corr(rows, pairs, expected):
    df = rows(pairs, "x double, y double")
    got = df.agg(stats.safe_corr(F.col("x"), F.col("y"))).first()[0]
    assert got == expected if expected is None else math.isclose(got, expected)


def test_hit_rate(rows):
    df = rows([(0, 0), (1, -1), (1, 1), (-1, -1)], "a int, b int")
    assert df.agg(stats.hit_rate(F.col("a"), F.col("b"))).first()[0] == 75.0


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (12.706205, 1, 0.05), (-1.959964, 1e6, 0.05)])
def test_two_sided_p(rows, t, df, p):
    got = rows([(t, float(df))], "t double, d double").select(stats.student_two_sided("t", "d")).first()[0]
    assert math.isclose(got, p, rel_tol=1e-4)


def test_source_needs_more_than_five_rows(rows):
    px = rows(list(zip(days(12), [float(10 + (i * 7) % 5) for i in range(12)])), "date date, close double")
    data = [(d, "six", float(i % 3)) for i, d in enumerate(days(6))] + [(d, "five", float(i % 3)) for i, d in enumerate(days(5))]
    data += [(d, "flat", 1.0) for d in days(8)] + [(d, "late", float(i)) for i, d in enumerate(days(12))]
    news = rows(data, "date date, source string, polarity double")
    strict = [r.source for r in relation.source_reliability(px, news).collect()]
    loose = {r.source for r in relation.source_reliability(px, news, null_policy="skip").collect()}
    assert strict == ["six"]  # 'late' has the last day, whose next change is unknown
    assert loose == {"six", "late"}


def test_subject_impact_equals_wide_correlation(rows):
    n = 40
    rng = np.random.default_rng(5)
    close = 100 + rng.normal(size=n).cumsum()
    px = rows([(d, float(c)) for d, c in zip(days(n), close)], "date date, close double")
    counts = {s: rng.poisson(1.0, n) for s in "abc"}
    data = [(d, s) for s, c in counts.items() for d, k in zip(days(n), c) for _ in range(k)]
    data += [(D("2030-01-01"), "far")] * 3 + [(D("2030-01-01"), "a")]
    got = {r.subject: r.r for r in relation.subject_impact(px, rows(data, "date date, subject string")).collect()}
    change = np.concatenate([[0.0], (close[1:] / close[:-1] - 1) * 100])
    for s, c in counts.items():
        assert math.isclose(got[s], np.corrcoef(change, c)[0, 1], rel_tol=1e-9)
    assert got["far"] is None


def test_lag_labels_are_kept_and_explained(rows):
    rng = np.random.default_rng(3)
    direction = rng.choice([-1, 1], 50)
    polarity = np.concatenate([[0], direction[:-1]]).astype(float)
    df = rows([(d, int(a), float(b)) for d, a, b in zip(days(50), direction, polarity)], "date date, price_direction int, polarity double")
    sweep = {r.lag: r for r in series.lag_sweep(df.where("date > '2024-01-01'")).collect()}
    assert len(sweep) == 11
    assert math.isclose(sweep[1].r, 1.0) and sweep[1].ref_label == "Sentiment leads Price by 1 day(s)" and sweep[1].lead_series == "price"
    assert sweep[-2].ref_label == "Price leads Sentiment by 2 day(s)" and sweep[-2].lead_series == "sentiment"
    assert sweep[0].ref_label == "Same day"


def test_negative_lag_uses_earlier_sentiment(rows):
    rng = np.random.default_rng(4)
    polarity = rng.choice([-1.0, 1.0], 50)
    direction = np.concatenate([[0], polarity[:-1]]).astype(int)
    df = rows([(d, int(a), float(b)) for d, a, b in zip(days(50), direction, polarity)], "date date, price_direction int, polarity double")
    sweep = {r.lag: r.r for r in series.lag_sweep(df.where("date > '2024-01-01'")).collect()}
    assert math.isclose(sweep[-1], 1.0)


def test_strongest_lag_prefers_the_earliest(rows):
    sweep = rows([(-2, -0.4), (1, 0.4), (0, 0.1), (3, None)], "lag int, r double")
    assert series.strongest_lag(sweep).first().lag == -2


def test_last_rows_only_when_there_are_more(rows):
    df = rows([(d,) for d in days(91)], "date date")
    assert row_ops.last_if_more(df, "date").count() == 90
    assert row_ops.last_if_more(df.where("date > '2024-01-01'"), "date").count() == 0


def test_calendar_labels(rows):
    df = rows([(D("2024-01-07"),), (D("2024-01-08"),), (D("2024-02-05"),)], "d date")
    got = df.select(dates.week_end(F.col("d")), dates.month_end(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [
        (D("2024-01-07"), D("2024-01-31")), (D("2024-01-14"), D("2024-01-31")), (D("2024-02-11"), D("2024-02-29")),
    ]


def test_gaps_are_filled_per_key(rows):
    df = rows([("a", D("2024-01-01"), 2), ("a", D("2024-01-04"), 1), ("b", D("2024-01-02"), 5)], "k string, d date, n bigint")
    got = sorted((r.k, r.d.day, r.n) for r in dates.fill_gaps(df, "d", "n", ["k"]).collect())
    assert got == [("a", 1, 2), ("a", 2, 0), ("a", 3, 0), ("a", 4, 1), ("b", 2, 5)]


def test_crosstabs_drop_unknown_keys(rows):
    df = rows([("x", "p"), ("x", "q"), ("x", "p"), (None, "p"), ("y", None)], "a string, b string")
    assert {(r.a, r.b, r.n) for r in aggregate.crosstab(df, "a", "b").collect()} == {("x", "p", 2), ("x", "q", 1)}
    assert [tuple(r) for r in aggregate.crosstab_wide(df, "a", "b", ["p", "q", "z"]).collect()] == [("x", 2, 1, 0)]
    assert {(r.b, round(r.pct, 4)) for r in aggregate.crosstab_pct(df, "a", "b").collect()} == {("p", 66.6667), ("q", 33.3333)}
