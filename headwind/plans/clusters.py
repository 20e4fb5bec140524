"""The five clusterings of annotated articles, each from prepared rows to labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.functions import fixed_values as fixed
from headwind.operators import naming
from headwind.functions.text import default_stop_words, terms
from headwind.operators import clustering, decomposition, density, features
from headwind.session import cut

TONE_FEATURES = ["sentiment_polarity", "sentiment_subjectivity", "title_tonality_score", "text_tonality_score"]
NUMBER_FEATURES = [
    "sentiment_polarity", "sentiment_subjectivity", "title_verbs_count", "title_adjectives_count", "text_verbs_count",
    "text_adjectives_count", "title_tonality_score", "text_tonality_score",
]


def _words(df: DataFrame, column: str, out: str, stop: list[str] | None, ngrams=(1, 1)) -> DataFrame:
    return df.withColumn(out, terms(F.col(column), default_stop_words() if stop is None else stop, ngrams))


def _label(df: DataFrame, names: DataFrame, cluster: str, out: str) -> DataFrame:
    """The name of each row's cluster; there is one name per cluster, so the articles themselves are never shuffled."""
    return df.join(F.broadcast(names.withColumnRenamed("name", out)), cluster, "left")


def sentiment_clusters(df: DataFrame, k: int = 3, n_init: int = 10, seed: int = 42) -> DataFrame:
    """Articles by tone: four scaled measures, K-means, clusters named by their mean polarity."""
    if k > len(fixed.POLARITY_LABELS):
        raise ValueError(f"at most {len(fixed.POLARITY_LABELS)} sentiment clusters have a name")
    filled = df.fillna(0, subset=TONE_FEATURES)
    scaled = features.standardize(filled, TONE_FEATURES)
    ready = cut(features.assemble(scaled, [f"{c}_z" for c in TONE_FEATURES]).drop(*[f"{c}_z" for c in TONE_FEATURES]))
    rows = clustering.fit_kmeans(ready, "features", k, n_init, seed).label(ready, "sentiment_cluster").drop("features")
    labels = clustering.order_by_polarity(rows, "sentiment_cluster", "sentiment_polarity", fixed.POLARITY_LABELS)
    named = labels.select("sentiment_cluster", F.col("label").alias("name"))
    return _label(rows, named, "sentiment_cluster", "sentiment_cluster_label")


def subject_features(df: DataFrame, stop: list[str] | None = None, title_terms: int = 200, word_terms: int = 100) -> DataFrame:
    """Title TF-IDF, one-hot category and word TF-IDF in one sparse vector."""
    worded = _words(_words(df, "title", "_tt", stop), "all_linguistic_features", "_wt", stop)
    held = cut(worded.select("_tt", "_wt", "crypto_category"))  # so that labels and terms don't prepare the articles again
    hot, _ = features.one_hot(worded, "crypto_category", "_hot", fitted_on=held)
    out = features.TermSpace.fit(held, "_tt", title_terms).tfidf(hot, "_tt", "_title")
    out = features.TermSpace.fit(held, "_wt", word_terms).tfidf(out, "_wt", "_word")
    return features.assemble(out, ["_title", "_hot", "_word"]).drop("_tt", "_wt", "_hot", "_title", "_word")


def source_features(df: DataFrame, stop: list[str] | None = None, word_terms: int = 200) -> DataFrame:
    """One-hot source and word counts in one sparse vector."""
    worded = _words(df, "all_linguistic_features", "_wt", stop)
    hot, _ = features.one_hot(worded, "source", "_hot")
    out = features.TermSpace.fit(worded, "_wt", word_terms).counts(hot, "_wt", "_word")
    return features.assemble(out, ["_hot", "_word"]).drop("_wt", "_hot", "_word")


def _reduced_clusters(ready: DataFrame, key: str, max_k: int, method: str, n_init: int, seed: int, dims: int, out: str):
    reduced = cut(decomposition.truncated_svd(ready, "features", dims).rows.drop("features"))
    _, scores, best = clustering.best_k(reduced, key, "reduced", max_k, method, n_init, seed)
    return best.label(reduced, out).drop("reduced"), scores


def subject_clusters(
    df: DataFrame, key: str, max_k: int = 8, method: str = "silhouette", n_init: int = 10, seed: int = 42, dims: int = 50,
    stop: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Articles by subject, k chosen by score; clusters named by their leading categories. Also returns the scores."""
    ready = cut(subject_features(df, stop))
    rows, scores = _reduced_clusters(ready, key, max_k, method, n_init, seed, dims, "crypto_cluster")
    return _label(rows, naming.category_names(rows, "crypto_cluster"), "crypto_cluster", "crypto_cluster_label"), scores


def source_clusters(
    df: DataFrame, key: str, max_k: int = 10, method: str = "silhouette", n_init: int = 10, seed: int = 42, dims: int = 50,
    stop: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Articles by source, k chosen by score; clusters named by their leading outlets. Also returns the scores."""
    ready = cut(source_features(df, stop))
    rows, scores = _reduced_clusters(ready, key, max_k, method, n_init, seed, dims, "source_cluster")
    return _label(rows, naming.outlet_names(rows, "source_cluster"), "source_cluster", "source_cluster_label"), scores


@dataclass
class TopicClusters:
    rows: DataFrame
    verb_words: DataFrame
    adjective_words: DataFrame
    verb_losses: list[float]
    adjective_losses: list[float]


def text_factors(
    df: DataFrame, key: str, column: str, topics: int, rounds: int, seed: int, stop: list[str] | None = None
) -> decomposition.Factors:
    """Non-negative topics of one text column, terms in at least 2 and at most 95 % of the articles."""
    worded = _words(df.select(key, column), column, "_t", stop)
    folded = features.fold_by_term(worded, key, "_t")
    n_docs = df.agg(F.count("*").alias("n")).scalar()
    counts = features.term_counts(folded, key, features.vocabulary_of(folded, min_df=2, max_df=0.95, n_docs=n_docs))
    return decomposition.nmf(counts, key, "term", "tf", topics, rounds, seed)


def topic_clusters(
    df: DataFrame, key: str, topics: int = 12, k: int = 6, rounds: int = 50, n_init: int = 10, seed: int = 42,
    stop: list[str] | None = None,
) -> TopicClusters:
    """Articles by verb and adjective topics and tone, named by tone, subject, source and leading topic words."""
    out, losses, words = df, [], []
    for prefix, column in (("verb", "all_verbs"), ("adj", "all_adjectives")):
        factors = text_factors(df, key, column, topics, rounds, seed, stop)
        renamed = factors.rows.select(key, *[F.col(f"w{j}").alias(f"{prefix}_topic_{j}") for j in range(topics)])
        # an article without any known term has weight 0 on every topic
        out = out.join(renamed, key, "left").fillna(0.0, subset=[f"{prefix}_topic_{j}" for j in range(topics)])
        losses.append(factors.losses)
        words.append(decomposition.topic_words(factors.terms, "term", topics))
    columns = [f"{p}_topic_{j}" for p in ("verb", "adj") for j in range(topics)]
    inputs = columns + TONE_FEATURES
    out = cut(out.fillna(0, subset=TONE_FEATURES))
    scaled = features.standardize(out, inputs)
    ready = cut(features.assemble(scaled, [f"{c}_z" for c in inputs]).drop(*[f"{c}_z" for c in inputs]))
    rows = clustering.fit_kmeans(ready, "features", k, n_init, seed).label(ready, "topic_cluster").drop("features")
    top = []
    for prefix, table in zip(("verb", "adj"), words):
        arrays = rows.select("topic_cluster", F.array(*[F.col(f"{prefix}_topic_{j}") for j in range(topics)]).alias("t"))
        first = decomposition.group_topics(arrays, "topic_cluster", "t", 1).select("topic_cluster", "topic")
        # at most 15 words per topic
        listed = table.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_l"))
        top.append(first.join(listed, "topic").select("topic_cluster", F.transform("_l", lambda r: r["term"]).alias("words")))
    names = naming.topic_names(rows, "topic_cluster", adjectives=top[1], verbs=top[0])
    return TopicClusters(_label(rows, names, "topic_cluster", "cluster_name"), words[0], words[1], losses[0], losses[1])


def general_features(df: DataFrame, stop: list[str] | None = None, max_terms: int = 100) -> DataFrame:
    """Uni- and bigram TF-IDF beside eight scaled numbers."""
    worded = _words(df.fillna(0, subset=NUMBER_FEATURES), "all_linguistic_features", "_t", stop, (1, 2))
    held = cut(worded.select("_t", *NUMBER_FEATURES))  # so that terms and means don't prepare the articles again
    out = features.TermSpace.fit(held, "_t", max_terms).tfidf(worded, "_t", "_weights")
    scaled = features.standardize(out, NUMBER_FEATURES, fitted_on=held)
    names = [f"{c}_z" for c in NUMBER_FEATURES]
    return features.assemble(scaled, ["_weights", *names]).drop("_t", "_weights", *names)


def general_clusters(df: DataFrame, k: int = 5, n_init: int = 10, seed: int = 42, stop: list[str] | None = None) -> DataFrame:
    """Articles by words and numbers; clusters named by tone, subject and source. ``features`` stays on the rows."""
    ready = cut(general_features(df, stop))
    rows = clustering.fit_kmeans(ready, "features", k, n_init, seed).label(ready)
    return _label(rows, naming.tone_names(rows, "cluster"), "cluster", "cluster_label")


def general_density(df: DataFrame, key: str, eps: float = 1.5, min_samples: int = 5) -> DataFrame:
    """DBSCAN over the same features; rows must carry ``features``."""
    return density.dbscan(df.select(key, vector_to_array("features").alias("x")), key, "x", eps, min_samples, partition="pivots")


def to_vector(df: DataFrame, x: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(x).cast("array<double>")))
