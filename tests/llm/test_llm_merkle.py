"""The Merkle manifest against a plain rebuild, on the smallest table and on hard cases."""

import hashlib
import zlib

import pytest

pytest.importorskip("headwind.llm")
from headwind.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, tree int, path string, now string, i int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(hashes, arity):
    """The root, and for each leaf its steps (slot, siblings)."""
    paths, at = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        up, under = [], []
        for k in range(0, len(hashes), arity):
            run = hashes[k : k + arity]
            for slot in range(len(run)):
                for x in at[k + slot]:
                    paths[x].append((slot, run[:slot] + run[slot + 1 :]))
            up.append(sha("".join(run)))
            under.append([x for group in at[k : k + arity] for x in group])
        hashes, at = up, under
    return hashes[0], paths


def brute(rows, arity=2, tampering=True):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    done = []
    for name in order:
        mine = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done.append((mine, *tree([leaf(r) for r in mine], arity)))
    if not done:
        return []
    root, above = tree([d[1] for d in done], arity)
    out = []
    for (mine, sub, paths), rest in zip(done, above):
        for r, path in zip(mine, paths):
            steps = path + rest
            hit = tampering and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:3], r[3] + 1 if hit and r[3] is not None else r[3], r[4]))
            for slot, sibs in steps:
                h = sha("".join([*sibs[:slot], h, *sibs[slot:]]))
            out.append((r[0], leaf(r), sub, root, sha("".join(x for _, s in steps for x in s)), h, h == root))
    return sorted(out, key=str)


def check(docs, arity=2):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = sorted((tuple(r) for r in merkle.manifest(docs, arity, merkle.tampered_rows()).collect()), key=str)
    assert found == brute(rows, arity)
    return found


def test_table(spark):
    found = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert 0 < sum(not r[-1] for r in found) < len(found) / 4


HARD = [
    (1, "s", "en", 3, "abc"), (2, None, "en", None, None), (None, "s", None, 1, ""), (None, None, None, None, None), (7, "s", "é", 9, "1:2-3"),
    (7, "s", "é", 9, "1:2-3"), (7, "s", "é", 8, "other"), (5, "s", "", 2, "x" * 200_000), (-4, "s", "en", 2, "漢字"), (9, "s", "en", 5, "y"), (11, "s", "en", 5, "y"),
]


@pytest.mark.parametrize("arity", [2, 5])
def test_hard(spark, arity):
    extra = ("h", 1, "p", "n", 2)
    check(spark.createDataFrame([(*r, *extra) for r in HARD], SCHEMA), arity)


@pytest.mark.parametrize("rows", [[], HARD[:1], HARD[:2]])
def test_small(spark, rows):
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))


def test_untouched_rows_verify(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(r.verified for r in merkle.manifest(docs).collect())
