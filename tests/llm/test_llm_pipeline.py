"""The pipeline against its stages done by hand."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("headwind.llm")
import corpus_pipeline
from test_llm_texts import WORD, assert_packed, brute_components, brute_fingerprint, brute_pieces, frame

from headwind.llm import language_id, pii

SF = "/root/testdata/sf0.001"


def by_hand(spark, docs):
    """Languages and weights come from the same learners; the decisions are made over plain lists."""
    rows = [r.asDict() for r in docs.collect()]
    model = language_id.Model(language_id.learn(docs))
    kept = []
    for r in rows:
        sums = sum((np.array(model.chunk(w)) for w in (r["text"] or "").lower().split()), np.zeros(len(model.langs) + 2))
        lang, score = model.decide(sums)
        if lang != "und":
            kept.append(r)
    label = brute_components([brute_fingerprint(r["text"] or "") for r in kept]) if kept else []
    lead = {}
    for k, (r, c) in enumerate(zip(kept, label)):
        key = (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).digest(), str(r))
        lead[c] = min(lead.get(c, (key, k)), (key, k))
    return [kept[k] for _, k in sorted(lead.values())]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = by_hand(spark, docs)
    left = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in kept], docs.schema)
    weights = pii.learn(left)
    texts = {r["doc_id"]: r["text"] for r in pii.redact(left, weights).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in rows) == brute_pieces([(i, t or "") for i, t in texts.items()])
    assert_packed(rows)


def test_stages_keep_columns_and_clean_rows(spark):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert docs.where("doc_id = 7").count() == 2  # the row, and another text of the same id; its repetition went
    assert docs.where("doc_id is null").count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_duplicates", "personal_data", "best_fit_packing"]


def test_rows_are_told_apart_by_id_and_text(spark):
    """Another text of a repeated id stays, copies without an id fold, and clashing names change nothing."""
    line = "a first text with some more words in it than the shingles need, "
    rows = [(1, line * 3), (1, "something else altogether, of the same id but with other words in every place of it"), (None, line * 3), (2, line * 3)]
    rows += [(None, "no id at all here, and yet copied twice over with all of these words"), (None, "no id at all here, and yet copied twice over with all of these words")]
    rows += [(3, "the row that is repeated as a whole, word by word and id by id"), (3, "the row that is repeated as a whole, word by word and id by id")]
    names = "doc_id long, text string, lang string, source string, n_chars long, _lang string, _score double, _leader long, _again boolean, lead string, mine int, digest string, again string"
    data = [(i, t, "en", "s", len(t), "x", 0.5, 1, True, "l", 1, "d", "a") for i, t in rows]
    docs = spark.createDataFrame(data, names)
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text[:12]) for r in out.collect()) == sorted(
        [("1", "a first text"), ("1", "something el"), ("None", "no id at all"), ("3", "the row that")]
    )


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.language_stage(spark, docs, SF).count() == docs.count()
    assert WORD


def test_language_stage_without_labels_drops_only_texts_without_letters(spark):
    values = ["one two three", "12 34 !", None, "", "漢字", "é", "\n?"]
    rows = [(k, v, None, "s", len(v or "")) for k, v in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language_stage(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 4, 5]
