"""The corpus pipeline: language, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind.llm import language_id, packing, pii, simhash
from headwind.llm.queries import tokenizer_file
from headwind.llm.tables import fresh_name, keep


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: those without a letter. A low score alone drops nothing."""
    model = language_id.Model(language_id.learn(docs))
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    lang = fresh_name(docs, "lang_pred")
    found = language_id.decided(docs, model, "text", lang, fresh_name(docs, "score"))
    return found.where(F.col(lang) != language_id.UNDETERMINED).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the smallest id, rows without an id last; equal ids by their texts."""
    return simhash.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the names of its kinds."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokenizers, learned models and 64-bit shingle hashes are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
