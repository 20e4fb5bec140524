"""Vocabularies, term counts, TF-IDF, one-hot, z-scores and feature assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwind.functions.text import bigrams, terms_among
from headwind.operators.rows import with_row_index
from headwind.session import cut_dealt, shuffle_width

BROADCAST_BYTES = 64 << 20  # counted bytes up to which a table is broadcast
FREQUENT_WORDS = 10_000  # most words that are looked up while pairs are made
VECTOR_TERMS = 1 << 18  # largest vocabulary kept as a list for vector columns


def fold_terms(docs: DataFrame, key: str, terms: str, among: DataFrame | None = None) -> DataFrame:
    """``key, term, tf``: the counts of each document's terms; folded where the document lies, before the shuffle.

    Keep the result: vocabulary, counts and weights all come from it, so the texts are read once. With a table ``among`` of a
    bounded number of terms (``frequent_terms``) only these are shuffled and kept.
    """
    long = docs.select(key, F.explode(terms).alias("term"))
    if among is not None:
        long = long.join(F.broadcast(among), "term", "left_semi")
    return long.groupBy(key, "term").agg(F.count("*").alias("tf"))


def counted(terms: Column) -> Column:
    """``term, tf`` of each different term of a list, in the row: runs of the sorted list."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | ~t.eqNullSafe(F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        ends = lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("long").alias("tf")))
        return F.get(F.transform(F.array(starts), ends), F.lit(0))

    return F.get(F.transform(F.array(F.array_sort(terms)), runs), F.lit(0))


def fold_by_term(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """``fold_terms``, kept and dealt by term: what follows by term (vocabulary, counts, numbers) shuffles no cell again."""
    cells = docs.select(key, F.explode(counted(F.col(terms))).alias("c")).select(key, "c.term", "c.tf")
    return cut_dealt(cells.repartition(shuffle_width(docs.sparkSession), "term").groupBy(key, "term").agg(F.sum("tf").alias("tf")))


def frequent_terms(docs: DataFrame, terms: str, n: int) -> DataFrame:
    """``term``: the ``n`` terms with the largest corpus counts, ties in term order: the choice of ``vocabulary_of``.

    Counts alone decide, so no document's terms are shuffled; the map side folds them before.
    """
    counts = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(n).select("term")


def _bounded(counts: DataFrame, n_docs: Column | None, max_features: int | None, min_df: int, max_df: float) -> DataFrame:
    if min_df > 1:
        counts = counts.where(F.col("df") >= min_df)
    if max_df < 1.0:
        counts = counts.where(F.col("df") <= n_docs * F.lit(float(max_df)))
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(max_features) if max_features else counts


def vocabulary_of(
    folded: DataFrame, max_features: int | None = None, min_df: int = 1, max_df: float = 1.0, n_docs: Column | None = None
) -> DataFrame:
    """``term, n, df`` of folded documents; ``max_df`` below 1 needs the number of documents (a scalar column)."""
    counts = folded.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    return _bounded(counts, n_docs, max_features, min_df, max_df)


def vocabulary(
    docs: DataFrame, terms: str, max_features: int | None = None, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """``term, n, df``: corpus count and document count of each term within the bounds.

    ``max_features`` keeps the largest corpus counts, ties in term order. Both counts come from one pass: each document
    sends its terms and its distinct terms, and the map side folds them before the shuffle.
    """
    marks = F.concat(
        F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d"))),
    )
    counts = (
        docs.select(F.explode(marks).alias("m")).select("m.*").groupBy("term").agg(F.sum("c").alias("n"), F.sum("d").alias("df"))
    )
    total = docs.agg(F.count("*").alias("n")).scalar() if max_df < 1.0 else None
    return _bounded(counts, total, max_features, min_df, max_df)


def pair_vocabulary(docs: DataFrame, words: str, max_features: int) -> DataFrame:
    """``vocabulary`` of the words and pairs of neighbours of the word lists ``words``, with far fewer pairs to count.

    No pair is more frequent than either of its words, so a pair of the ``max_features`` largest terms has two words that are
    as frequent as the ``max_features``-th word. The words alone are counted first, then these words and their pairs.
    """
    counts = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    ranked = counts.where("term is not null").orderBy(F.desc("n"), F.asc("term")).limit(FREQUENT_WORDS + 1).collect() if max_features <= FREQUENT_WORDS else []
    bar = ranked[max_features - 1]["n"] if 0 < max_features <= len(ranked) else 0
    frequent = [r["term"] for r in ranked if r["n"] >= bar]  # ties of the last one too
    if not bar or len(frequent) > FREQUENT_WORDS:  # too few words, or too many as frequent as the last
        pairs = F.get(F.transform(F.array(F.col(words)), lambda w: F.concat(w, bigrams(w))), F.lit(0))
        return vocabulary(docs.select(pairs.alias("_terms")), "_terms", max_features)
    return vocabulary(docs.select(terms_among(F.col(words), frequent).alias("_terms")), "_terms", max_features)


def term_counts(folded: DataFrame, key: str, vocab: DataFrame | None = None) -> DataFrame:
    """``key, term, tf`` restricted to a vocabulary. Whether that is broadcast is left to its real size at run time."""
    return folded if vocab is None else folded.join(vocab.select("term"), "term", "left_semi").select(key, "term", "tf")


def tfidf_long(folded: DataFrame, key: str, vocab: DataFrame, n_docs: Column) -> DataFrame:
    """``key, term, weight``: tf * (ln((1+n)/(1+df)) + 1), each document scaled to length 1. Any vocabulary size.

    Only the known terms of a document are shuffled, once, for its length.
    """
    idf = vocab.select("term", (F.log((n_docs + F.lit(1.0)) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = folded.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))  # a document's own terms
    return raw.select(key, "term", (F.col("w") / length).alias("weight"))


@dataclass
class TermSpace:
    """A bounded vocabulary in term order, with its document counts."""

    words: list[str]
    df: list[int]
    n_docs: int

    @classmethod
    def fit(cls, docs: DataFrame, terms: str, max_features: int, min_df: int = 1, max_df: float = 1.0) -> TermSpace:
        if max_features > VECTOR_TERMS:
            raise ValueError(f"vector columns hold at most {VECTOR_TERMS} terms; use tfidf_long beyond that")
        picked = vocabulary(docs, terms, max_features, min_df, max_df).collect()  # at most max_features rows
        picked.sort(key=lambda r: r["term"])
        return cls([r["term"] for r in picked], [r["df"] for r in picked], docs.count())

    def counts(self, docs: DataFrame, terms: str, out: str) -> DataFrame:
        """Sparse count vectors, no shuffle."""
        spark = docs.sparkSession  # noqa: F841 - the model needs a live session
        if not self.words:
            raise ValueError("empty vocabulary")
        return CountVectorizerModel.from_vocabulary(self.words, inputCol=terms, outputCol=out).transform(docs)

    def tfidf(self, docs: DataFrame, terms: str, out: str) -> DataFrame:
        """Sparse TF-IDF vectors of length 1, no shuffle."""
        import math

        idf = Vectors.dense([math.log((1 + self.n_docs) / (1 + d)) + 1 for d in self.df])
        counted = self.counts(docs, terms, "_tf")
        scaled = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_tfidf").transform(counted)
        return Normalizer(p=2.0, inputCol="_tfidf", outputCol=out).transform(scaled).drop("_tf", "_tfidf")


def one_hot(df: DataFrame, column: str, out: str, missing: str = "unknown", fitted_on: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One-hot vectors in label order; an unknown value becomes ``missing``. Also the labels as a table ``label, slot``.

    ``fitted_on``: a kept table with the same values, from which the labels are taken.

    Labels are numbered and joined in Spark. They are broadcast when the bytes counted allow it, else joined by a shuffle.
    """
    value = F.coalesce(column, F.lit(missing))
    filled = df.withColumn("_v", value)
    labels = with_row_index((df if fitted_on is None else fitted_on).select(value.alias("label")).distinct(), ["label"], "slot")
    slots = labels.select(F.col("label").alias("_v"), F.col("slot").cast("double").alias("_slot"))
    small = (labels.agg(F.sum(F.octet_length("label") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    joined = filled.join(F.broadcast(slots) if small else slots, "_v")
    encoder = OneHotEncoder(inputCol="_slot", outputCol=out, dropLast=False).fit(slots)
    return encoder.transform(joined).drop("_v", "_slot"), labels


def standardize(df: DataFrame, columns: list[str], suffix: str = "_z", fitted_on: DataFrame | None = None) -> DataFrame:
    """Z-scores with the population deviation; a constant column gives 0, an unknown value stays unknown.

    ``fitted_on``: a kept table with the same values, from which means and deviations are taken.
    """
    stats = (df if fitted_on is None else fitted_on).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()  # one row
    out = {}
    for i, c in enumerate(columns):
        mean, dev = stats[f"m{i}"], stats[f"s{i}"]
        if not dev:
            out[c + suffix] = F.when(F.col(c).isNotNull(), 0.0)
        else:
            out[c + suffix] = (F.col(c) - F.lit(mean)) / F.lit(dev)
    return df.withColumns(out)


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Scalars and vectors side by side in one vector; sparse inputs stay sparse."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)
