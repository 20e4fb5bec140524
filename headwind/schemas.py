"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

OHLCV = "timestamp date, open double, high double, low double, close double, volume double, year_month string"

NEWS = "date timestamp, sentiment string, source string, subject string, title string, text string"

NEWS_ANNOTATED = (
    NEWS + ", title_verbs string, title_adjectives string, title_tonality string, text_verbs string, "
    "text_adjectives string, text_tonality string"
)

API_PAGE = (
    "results array<struct<title:string, published_at:string, votes:struct<sentiment:string>, url:string, "
    "currencies:array<struct<code:string>>, source:struct<title:string>>>, next string"
)

FETCHED_NEWS = "title string, published_at timestamp, sentiment string, url string, currencies string, source string"

CHECKPOINT = "processed_records bigint, processed_batches array<int>"
