"""N-best segmentation against full enumeration, and exact round trips."""

from collections import Counter

import pytest

pytest.importorskip("headwind.llm")
import public_tokenizers

from headwind.llm import sentencepiece_lattice as sl
from headwind.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["the", "these are", "a, b.", "x  y", "é漢\n", "tokenization", "12 34", "", " lead", "naïve…", "aaaaaaa"]


def paths(lattice, text, at=0):
    """All segmentations of a marked text: scores and ids."""
    if at == len(text):
        return [(0.0, ())]
    out, single = [], False
    for end in range(at + 1, min(len(text), at + 16) + 1):
        piece = lattice.ids.get(text[at:end])
        if piece is not None:
            single |= end == at + 1
            out += [(lattice.scores[piece] + s, (piece, *ids)) for s, ids in paths(lattice, text, end)]
    if not single:
        out += [(lattice.lowest + s, (*lattice.spelled(text[at]), *ids)) for s, ids in paths(lattice, text, at + 1)]
    return out


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("n", [1, 4, 9])
def test_nbest_against_enumeration(text, n):
    lattice = sl.lattice_of(MODEL)
    marked = sl.SPACE + text.replace(" ", sl.SPACE) if text else ""
    every = dict(Counter())
    for score, ids in paths(lattice, marked):
        every[ids] = score
    found = lattice.nbest(text, n)
    assert [round(s, 6) for s, _ in found] == [round(s, 6) for s in sorted(every.values(), reverse=True)[:n]]
    assert len({ids for _, ids in found}) == len(found)
    for score, ids in found:
        assert abs(every[ids] - score) < 1e-6
        assert lattice.decode(ids) == text


def test_byte_pieces_and_ids_match_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    lattice = sl.lattice_of(MODEL)
    for text in TEXTS:
        for _, ids in lattice.nbest(text):
            assert sp.decode(list(ids)) == text


def test_the_second_best_of_every_word():
    lattice = sl.lattice_of(MODEL)
    words = sl._Words(lattice, 4)
    for text in TEXTS + ["thorshing.", "Oichque...", "ééan漢x", "wh%%%", "x" * 40]:
        for word in lattice.words(text):
            paths = lattice.nbest_word(word, 4)
            score, second, pieces, raw, spelled = words.look([word])[0]
            assert score == pytest.approx(paths[0][0]) and spelled and pieces == len(raw) // 4
            assert second == pytest.approx(paths[0][0] - paths[1][0]) if len(paths) > 1 else second == float("inf")


def test_query_round_trips(spark):
    rows = sl.encode(spark.read.parquet(f"{SF}/documents.parquet"), MODEL, with_ids=True).collect()
    assert sorted(r.asDict().items() for r in QUERIES["op2_sentencepiece_nbest"](spark, SF).collect()) == sorted(
        {k: v for k, v in r.asDict().items() if k != "ids"}.items() for r in rows
    )
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and all(r["round_trip"] for r in rows)
    lattice = sl.lattice_of(MODEL)
    for r in rows[:40]:
        best = lattice.nbest(texts[r["doc_id"]])
        assert r["nbest_scores"] == pytest.approx([s for s, _ in best]) and r["n_pieces"] == len(best[0][1])
        assert r["ids"] == list(best[0][1]) and lattice.decode(r["ids"]) == texts[r["doc_id"]]
        assert r["best_score"] == pytest.approx(best[0][0]) and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)


def test_hard_cases(spark):
    values = [(1, None), (2, ""), (3, "x" * 20_000), (4, "wo rt " * 5_000), (None, "null id"), (5, "same"), (5, "same"), (6, "   "), (7, "👍🏽\x00\x1c")]
    docs = spark.createDataFrame([(*v, "n", 1.0, [1]) for v in values], "doc_id long, text string, n_pieces string, best_score double, ids array<int>")
    rows = sl.encode(docs, MODEL).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(v[0] for v in values) and all(r["round_trip"] for r in rows)
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert all((r["n_pieces"], r["best_score"], r["nbest_scores"]) == (0, 0.0, [0.0]) for r in empty)
    short = docs.where("length(text) < 100 or text is null")
    back = sl.decode(sl.segmentations(short, MODEL), MODEL).collect()
    known = {i: t or "" for i, t in values}
    assert all(r["text"] == known[r["doc_id"]] for r in back)
    assert sl.encode(docs.limit(0), MODEL).collect() == [] and sl.segmentations(docs.limit(0), MODEL).collect() == []
