"""Tokens, n-grams and stop words as column expressions."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"  # words of two or more letters, digits or underscores, in any script


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of ``text``; stop words are removed here, before any n-gram is built."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def terms(text: Column, stop_words: list[str] | None = None, ngrams: tuple[int, int] = (1, 1)) -> Column:
    """The terms of a text: words, bigrams, or both.

    The word list enters the bigram expressions as a lambda variable, so a text is tokenized once and not once per use.
    """
    if ngrams not in ((1, 1), (1, 2), (2, 2)):
        raise ValueError(f"unsupported n-gram range {ngrams}")
    words = tokens(text, stop_words)
    if ngrams == (1, 1):
        return words
    build = bigrams if ngrams == (2, 2) else lambda w: F.concat(w, bigrams(w))
    return F.get(F.transform(F.array(words), build), F.lit(0))


def terms_among(words: Column, frequent: list[str]) -> Column:
    """The words of a list that are among ``frequent``, and the pairs of neighbours that both are."""
    known = F.transform(words, lambda w: F.when(w.isin(frequent), w))
    n = F.greatest(F.size(words) - 1, F.lit(0))

    def build(k: Column) -> Column:
        pairs = F.zip_with(F.slice(k, F.lit(1), n), F.slice(k, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(F.concat(k, pairs), lambda t: t.isNotNull())

    return F.get(F.transform(F.array(known), build), F.lit(0))


def default_stop_words() -> list[str]:
    """Spark's English list. Pass another list where its words must match some other tool."""
    return StopWordsRemover.loadDefaultStopWords("english")
