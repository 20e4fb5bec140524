"""Suffix sorting against plain sorting, and the removal of repeats against a brute-force table of windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("headwind.llm")
from headwind.llm import suffix_duplicates as sd
from headwind.llm.suffix_sort import common_prefixes, small_suffixes, suffix_order

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, ord int, first string, slice int, t string, n_bytes string"


def buffers():
    rng = np.random.default_rng(0)
    yield b"\0"
    yield b"banana\0"
    yield b"aaaaaaaaaa\0aaaa\0\0aab\0"
    yield b"ab" * 60 + b"\0" + b"ba" * 30 + b"\0"
    for size, letters in ((300, 2), (500, 4), (3_000, 20), (3_000, 250)):
        x = rng.integers(1, letters + 1, size).astype(np.uint8)
        x[rng.integers(0, size, size // 90)] = 0
        x[-1] = 0
        yield x.tobytes()
    line = bytes(rng.integers(97, 110, 80).astype(np.uint8))
    yield b"".join(line[int(a) :] + bytes(rng.integers(97, 110, 9).astype(np.uint8)) + b"\0" for a in rng.integers(0, 20, 40))


@pytest.mark.parametrize("depth", [8, 16, 50])
def test_suffix_order(depth):
    for data in buffers():
        x = np.frombuffer(data, np.uint8)
        cut = [data[i : i + depth].split(b"\0")[0] for i in range(len(data))]
        order = suffix_order(x, depth)
        assert sorted(order.tolist()) == list(range(len(data)))
        assert [cut[i] for i in order] == sorted(cut)
        full = [data[i : i + depth].ljust(depth, b"\0") for i in order]
        want = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(full, full[1:])]
        assert common_prefixes(x, order, depth).tolist() == want
        small = [data[i:] < data[i + 1 :] for i in range(len(data))]
        assert small_suffixes(x).tolist() == small


def brute(pairs, depth):
    least = {}
    coded = [(i, (t or "").encode()) for i, t in pairs]
    ids = [sd.LAST if i is None else i for i, _ in coded]
    for o, (_, b) in zip(ids, coded):
        for k in range(len(b) - depth + 1):
            w = b[k : k + depth]
            least[w] = min(o, least.get(w, sd.LAST + 1))
    out = Counter()
    for o, (i, b) in zip(ids, coded):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - depth + 1):
            if least[b[k : k + depth]] < o:
                gone[k : k + depth] = True
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def check(docs, **options):
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = Counter(tuple(r) for r in sd.remove_repeats(docs, **options).collect())
    assert found == brute(pairs, options.get("depth", sd.DEPTH))
    return found


def test_table(spark):
    found = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert any(0 < r[2] < r[1] for r in found)


def hard():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    line, other = word(90), word(49)
    rows = [(5, None), (6, ""), (7, "x" * 49), (8, "x" * 50), (9, "x" * 70_000), (3, "x" * 51 + "y"), (None, line), (None, line + "!"), (10, line)]
    rows += [(20 + k, word(20) + line[: 60 + k] + word(30)) for k in range(12)]
    rows += [(40, line + word(5) + line), (41, other + "q"), (42, other + "r"), (43, "é" * 40), (2, "a" + "é" * 40), (44, word(30) + line)]
    rows += [(44, word(30) + line), (20, "a second text of one id " + line), (60, line), (61, line), (1, word(10) + line[5:70]), (-3, word(400_000) + line[8:80])]
    rows += [rows[-1], (70, "<|endoftext|>" * 9), (71, "ab" * 300), (72, "ba" * 200), (73, word(3) + "▁  \n" * 20)]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 1, "slice_bytes": 2_000}, {"depth": 16}, {"depth": 20, "hot": 2, "slice_bytes": 500}])
def test_hard(spark, options):
    extra = ("d", 1, "f", 2, "t", "n")
    check(spark.createDataFrame([(*r, *extra) for r in hard()], SCHEMA), **options)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short")], [(2, "z" * 60), (1, "z" * 60)]])
def test_small(spark, rows):
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_many_slices(spark):
    """Slices far smaller than the corpus, and every common anchor dealt by windows, give the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check(docs, slice_bytes=20_000, hot=3)


def test_slices_are_not_shuffled_again(spark):
    texts = spark.createDataFrame([(k % 7, b"d", k, 1, b"b") for k in range(50)], sd.TEXTS)
    kept = sd.keep_bucketed(texts, "slice", 8)
    plan = kept.groupBy("slice").applyInArrow(lambda t: t, sd.TEXTS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
