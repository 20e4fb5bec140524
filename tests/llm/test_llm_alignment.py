"""Token alignment against a plain walk over common ends, on the smallest table and on hard cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("headwind.llm")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from headwind.llm import alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, pair long, n long, a string, best int, pairs string"
HARD = [
    None, "", " ", "\n", "   ", "one", "one two", "a  b   c    d", "trailing  ", "  leading", "x\n y\n \n z \n", "a\t\tb \x0b c\x1cd\x1e e", "<s> and </s> <unk> <0x41>",
    "<|endoftext|> in text <|endoftext|>", "it's we'll DON'T 1234567 ", "naïve ΑΣ İstanbul Straße ﬁ", "漢字 と かな 👍🏽 é", "no-break\xa0space", "x" * 20_000, "wort " * 3_000,
    "1" * 3_000, "▁ under ▁", "\x00 null", "ab" * 2_000, "()[]{}!!!???....", "の" * 500,
]


def brute(pairs):
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    to_byte = alignment.printable_bytes()
    spell = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    docs, linked = [], Counter()
    for i, t in pairs:
        t = t or ""
        a = [(k, bytes(to_byte[c] for c in own.id_to_token(k))) for k in own.encode(" " + t, add_special_tokens=False).ids]
        b = [(k, spell(k)) for k in model.encode(t)]
        want = (" " + t).encode()
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            docs.append((i, 0, 0, [], Counter()))
            continue
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        cuts = sorted(ends[0] & ends[1])
        found, links = [], Counter()
        for lo, hi in zip([0, *cuts], cuts):
            group = []
            for side in (a, b):
                at, ids = 0, []
                for k, x in side:
                    if lo <= at < hi:
                        ids.append(k)
                    at += len(x)
                group.append(ids)
            found.append(group)
            for x, n in Counter(group[0]).items():
                for y, m in Counter(group[1]).items():
                    links[x, y] += n * m
        docs.append((i, len(a), len(b), found, links))
        linked.update(links.keys())
    most = {}
    for (x, _), n in linked.items():
        most[x] = max(n, most.get(x, 0))
    out = Counter()
    for i, n_a, n_b, found, links in docs:
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in found)
        best = sum(n for (x, y), n in links.items() if linked[x, y] == most[x])
        total = sum(n * linked[p] for p, n in links.items())
        out[i, n_a, n_b, len(found), sum(links.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if n_a else ""] += 1
    return out


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 10, 0])
def test_hard(spark, frequent):
    rows = [(k, t, 1, 2, 3, "a", 4, "p") for k, t in enumerate(HARD)]
    rows += [rows[6], (6, "another text", *rows[0][2:]), (None, "one two", *rows[0][2:])]
    docs = spark.createDataFrame(rows, SCHEMA)
    short = docs.where("text is null or length(text) < 3000")
    for part in (short,) if frequent != 10 else (docs,):
        pairs = [(r.doc_id, r.text) for r in part.select("doc_id", "text").collect()]
        assert Counter(tuple(r) for r in alignment.align(part, A, B, frequent=frequent).collect()) == brute(pairs)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in alignment.align(docs, A, B, frequent=500).collect()) == brute(pairs)


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    assert [r.n_a for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [0]


def test_both_encoders_give_the_same_ids(spark):
    encode, _ = alignment.byte_level(A)
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    texts = [" " + t for t in HARD if t] + [" " + r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert encode(texts) == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_groups_are_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(np.append(rng.integers(1, 400, rng.integers(1, 120)), 400)) for _ in range(2))
        in_a, in_b = alignment.groups(a, b)
        cuts = np.intersect1d(a, b)
        assert in_a.tolist() == np.searchsorted(cuts, a).tolist() and in_b.tolist() == np.searchsorted(cuts, b).tolist()


def test_wide_groups_fold(monkeypatch):
    rng = np.random.default_rng(2)
    n_a, n_b = rng.integers(1, 6, 40), rng.integers(1, 6, 40)
    in_a, in_b = np.repeat(np.arange(40), n_a), np.repeat(np.arange(40), n_b)
    a, b, doc = rng.integers(0, 4, len(in_a)), rng.integers(0, 4, len(in_b)), np.sort(rng.integers(0, 3, 40))
    want = [v.tolist() for v in alignment.fold_links(doc, a, b, in_a, in_b, 40)]
    monkeypatch.setattr(alignment, "WIDE", 6)
    assert [v.tolist() for v in alignment.fold_links(doc, a, b, in_a, in_b, 40)] == want
