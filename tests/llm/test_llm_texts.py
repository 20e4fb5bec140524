"""The text operators against brute force: the whole smallest table, and a table of hard cases."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("headwind.llm")
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from headwind.llm import language_id, licenses, packing, pii, simhash, token_counts
from headwind.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, spans string, t string, id string, r int, fp string, n int, bin string"

HARD = [
    None, "", " ", "\n", "   ", "one", "one two", "One TWO three", "one two three four", "a  b   c    d", "trailing  ", "  leading", "x\n y\n \n z \n",
    "a\t\tb \x0b c\x1cd\x1e e", "<|endoftext|> in <|startoftext|>text <|endoftext|>", "it's we'll DON'T", "naïve ΑΣ İstanbul Straße ﬁ", "漢字 と かな 👍🏽 é",
    "no-break\xa0space line", "x" * 70_000, "wort " * 30_000, "1" * 3_000, "a.b@c.d@e.f x@y", "mail me.now+tag@mail-1.example.co.uk.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 then 555-7713 again, +12 345", "()[]<|im|>",
]


def frame(spark, values=HARD):
    rows = [(k, v, "en" if k % 2 else None, "s", len(v or ""), "x", "y", "z", "t", "i", 1, "f", 2, "b") for k, v in enumerate(values)]
    if len(rows) > 7:
        rows += [rows[7], (7, "another text of the same id", "en", *rows[7][3:]), (None, "null id, one two three", "de", *rows[7][3:])]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(spark, docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(params=["table", "hard", "empty"])
def docs(request, spark):
    if request.param == "table":
        return spark.read.parquet(f"{SF}/documents.parquet")
    return frame(spark, HARD if request.param == "hard" else [])


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_token_counts(spark, docs):
    tok = Tokenizer.from_file(BYTE)
    want = Counter((i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for i, t in pairs(spark, docs))
    assert rows_of(token_counts.count_tokens(docs, BYTE)) == want


def test_pieces_are_whole_pre_tokens():
    tok = Tokenizer.from_file(BYTE)
    for text in filter(None, HARD):
        cut = token_counts.pieces(text)
        assert " ".join(cut) == text
        if "<|" not in text:
            apart = [cut[0], *(f" {p}" for p in cut[1:])]
            assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in apart) == len(tok.encode(text, add_special_tokens=False).ids)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    """Labels by repeated minima over all pairs within three bits."""
    f = np.array(prints, dtype=np.uint64)
    label = np.arange(len(f))
    while True:
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
        fresh = np.where(near, label[None, :], len(f)).min(1)
        if (fresh == label).all():
            return label
        label = fresh


def test_simhash(spark, docs):
    found = pairs(spark, docs)
    prints = [brute_fingerprint(t) for _, t in found]
    label = brute_components(prints) if found else []
    want = Counter()
    for (i, _), p, c in zip(found, prints, label):
        ids = [j for (j, _), d in zip(found, label) if d == c and j is not None]
        want[i, f"{p:016x}", min(ids, default=None)] += 1
    assert rows_of(simhash.near_duplicates(docs)) == want


def test_simhash_dense_group(spark):
    """A thousand different fingerprints around one, and a chain, must be linked as by brute force, in small blocks too."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [int(base[0]) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))]
    chain = [int(base[1])]
    for _ in range(60):
        chain.append(chain[-1] ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    prints = sorted({*map(int, base), *flips, *chain})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")
    plan = simhash.make_plan(classes)
    label = brute_components(prints)
    for parts in (4, 2):
        plan.parts = parts
        for block in (1_024, 50):
            links = simhash.links(classes, plan, block).distinct().collect()
            at = {p: k for k, p in enumerate(signed)}
            own = np.arange(len(prints))
            for _ in range(len(prints)):
                before = own.copy()
                for u, v in links:
                    own[at[u]] = own[at[v]] = min(own[at[u]], own[at[v]])
                if (own == before).all():
                    break
            assert (own == label).all()


def test_thresholds_leave_no_gap(spark):
    prints = spark.createDataFrame([(int(x),) for x in np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 300)], "fp long")
    plan = simhash.make_plan(prints)
    cells = np.random.default_rng(3).integers(0, 1 << 16, (500, 4))
    for parts in (4, 2):
        plan.parts = parts
        limits, _ = plan.allot(cells)
        assert (limits.sum(1) == simhash.RADIUS - parts + 1).all() and limits.min() >= -1 and limits.max() <= 3


def test_language_id_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(found) == set(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_id_uses_nothing_but_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.Model(language_id.learn(docs))
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    moved = docs.selectExpr("doc_id", "text", "'xx' as lang", "'none' as source", "n_chars")
    assert plain == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(moved, model).collect()}


def brute_language(model_rows, text):
    """The decision for one text, word by word, from the learned counts."""
    langs = sorted({r[0] for r in model_rows if r[1] == -1})
    counts = {}
    for lang, kind, key, n in model_rows:
        if kind >= 0:
            counts.setdefault(kind, {}).setdefault(key, {})[lang] = n
    total = {k: {g: sum(c.get(g, 0) + 0.5 for c in t.values()) for g in langs} for k, t in counts.items()}
    log = lambda k, key: np.array([np.log(counts[k][key].get(g, 0) + 0.5) - np.log(total[k][g]) for g in langs])
    sums, n = np.zeros(len(langs)), 0
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        score = log(0, word) if word in counts.get(0, {}) else None
        size = 4
        while score is None and size:
            padded = f"<{word}>" if size > 1 else word
            known = [log(size, g) for g in (padded[i : i + size] for i in range(len(padded) - size + 1)) if g in counts.get(size, {})]
            score = sum(known) / len(known) if known else None
            size -= 1
        if score is not None:
            sums, n = sums + score, n + 1
    return langs[int(np.argmax(sums))] if n else None


def test_language_id_against_brute_force(spark):
    docs = frame(spark)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.learn(table)
    found = language_id.predict(docs, language_id.Model(rows)).collect()
    assert len(found) == docs.count()
    texts = {(i, t): brute_language(rows, t) for i, t in pairs(spark, docs) if any(map(str.isalpha, t))}
    for (i, t), lang in texts.items():
        if lang is not None and i != 7:
            assert [r["lang_pred"] for r in found if r["doc_id"] == i] == [lang]
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {i for i, t in pairs(spark, docs) if not any(map(str.isalpha, t))}
    assert all(r["score"] == 0.0 for r in found if r["lang_pred"] == "und")


def test_language_id_empty_and_unlabelled(spark):
    assert language_id.identify(frame(spark, [])).collect() == []
    found = language_id.identify(frame(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}


def brute_pieces(found):
    tok, out = Tokenizer.from_file(WORD), Counter()
    for i, t in found:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            out[i, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    return out


def assert_packed(rows, capacity=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs):
    rows = packing.pack_documents(docs, WORD).collect()
    assert Counter(tuple(r)[:5] for r in rows) == brute_pieces(pairs(spark, docs))
    used = assert_packed(rows)
    total = sum(r["length"] for r in rows)
    assert used <= total / 4096 * 1.02 + 2


def test_packing_merges_over_tasks(spark):
    """Many tasks with bins that fit together only across tasks: as few as best-fit over all at once, and all of it."""
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(1, 4097, 1_500), np.full(500, 2_048), np.full(300, 3_000), np.full(300, 1_096)])
    rng.shuffle(sizes)
    rows = [(k, 0, 0, int(s), 0) for k, s in enumerate(sizes)]
    pieces = spark.createDataFrame(rows, packing.PIECES).repartition(64)
    got = packing.pack(pieces).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(sizes)))
    used = assert_packed(got)
    best = int(packing.best_fit(sizes, 4096)[0].max()) + 1
    assert used <= best * 1.06 + 1  # bins of tasks with some forty pieces each, merged whole
    assert_packed(packing.pack(pieces, group=100).collect())


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


KINDS = ("email", "ip", "card", "phone")


def test_personal_data(spark, docs):
    got = pii.find(docs).collect()
    told = {i: brute_spans(t) for i, t in pairs(spark, docs) if i != 7}
    assert len(got) == len(pairs(spark, docs))
    for r in got:
        if r["doc_id"] == 7:
            continue
        base = told[r["doc_id"]]
        listed = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in KINDS] == [sum(k == c for _, k, _ in base) for c in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(spans)


TRICKY = ["a@b.c@d.e", "@@a@b.c", "x" * 2_000 + "@" + "y" * 50, "1.1.1.1.1.1.1.1", "9" * 3_000, "1-2-3-4-5-6-7-8-9-0-1-2-3-4", "+1 +2 +3 (((", "a.@b..c@d-.e-f.g", "1..2.3.4.5", "+1" + "." * 3_000]


@pytest.mark.parametrize("k", range(len(TRICKY)))
def test_base_spans(k):
    assert pii.base_spans(TRICKY[k]) == brute_spans(TRICKY[k])


def test_base_spans_random():
    rng = np.random.default_rng(4)
    for _ in range(3_000):
        text = "".join(rng.choice(list("ab1234567890.@+- ()\n"), rng.integers(1, 60)))
        assert pii.base_spans(text) == brute_spans(text), text


def brute_beliefs(unary, edges, potentials, kind):
    """Exact marginals by summing over all labellings."""
    n, labels = unary.shape
    out = np.zeros_like(unary)
    for code in range(labels**n):
        y = [code // labels**i % labels for i in range(n)]
        weight = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(potentials[k][y[a], y[b]] for (a, b), k in zip(edges, kind)))
        for i in range(n):
            out[i, y[i]] += weight
    return out / out.sum(1, keepdims=True)


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(6)
    unary, potentials = rng.normal(size=(5, 3)), rng.normal(size=(2, 3, 3))
    edges, kind = np.array([[0, 1], [1, 2], [1, 3], [3, 4]]), np.array([0, 1, 0, 1])
    assert np.allclose(pii.infer(unary, edges, potentials, kind, rounds=60), brute_beliefs(unary, edges, potentials, kind), atol=1e-6)


def test_skip_links_carry_a_label(spark):
    texts = [f"call +1 (0{k % 90 + 10}) 555-{1000 + k} or so and then the number 555-{1000 + k} again, not 12 or 3.4" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = pii.learn(docs)
    rows = pii.find(docs, weights).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        again = text.rindex("555-")
        assert f"phone:{again}:{again + 8}" in r["spans"].split(",")
        assert r["n_phone"] == 1 and len(r["spans"].split(",")) == 2


def test_redaction(spark):
    docs = frame(spark)
    out = pii.redact(docs).collect()
    assert pii.redact(docs).columns == docs.columns and len(out) == docs.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] not in (7, None)}
    assert by[0]["text"] is None and by[23]["text"] == "mail <EMAIL>."
    assert by[23]["n_chars"] == len("mail <EMAIL>.") and by[20]["text"] == HARD[20]


def test_licenses(spark, con):
    got = rows_of(licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")))
    cursor = con.execute(SQL["op1_license_scan"])
    assert got == Counter(cursor.fetchall())


def test_license_rules(spark):
    full = "\n".join(
        ['Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License.",
         "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0", "",
         "Unless required by applicable law or agreed to in writing, software",
         'distributed under the License is distributed on an "AS IS" BASIS,', "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
         "See the License for the specific language governing permissions and", "limitations under the License."]
    )
    cases = {
        full: ("Apache-2.0", ""), "x y z\nReleased under the  MIT license!\nmore": ("MIT", ""), "Licensed under CC BY-NC 4.0. Released under the MIT License.": ("CC-BY-NC-4.0,MIT", ""),
        "See the GNU General Public License for more details.": ("", "GplSee"), "no licence at all": ("", ""), "relicensed under cc by nc 4 0": ("", ""),
    }
    docs = frame(spark, list(cases))
    got = {r["doc_id"]: (r["licenses"], r["left_over"]) for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    hard = {r["doc_id"]: r for r in licenses.scan(frame(spark)).collect()}
    assert hard[0]["n_sentences"] == 0 and hard[0]["licenses"] == "" and licenses.scan(frame(spark, [])).collect() == []
    assert "Python" not in licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()


GPL = """This program is free software{a} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def notice(inner: str, version: str, subject: str = "program", end: str = "") -> str:
    end = end or f"either version {version} of the License, or (at your option) any later version."
    return f"""This {subject} is free software; you can redistribute it and/or
modify it under the terms of the GNU {inner}General Public
License as published by the Free Software Foundation; {end}"""


MIT_PARTS = [licenses.SENTENCES[k] for k in ("MitGrant", "MitNotice", "MitAsIs", "MitLiable")]
BSD_PARTS = [licenses.SENTENCES[k] for k in ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiable")]
NOTICE_CASES = {
    GPL.format(a=";", b=";", v=2): ("GPL-2.0-or-later", ""), GPL.format(a=":", b=",", v=3): ("GPL-3.0-or-later", ""), GPL.format(a=";", b=";", v=1): ("GPL-1.0-or-later", ""),
    "# " + GPL.format(a=";", b=";", v=2).replace("\n", "\n# "): ("GPL-2.0-or-later", ""),
    " * " + GPL.format(a=":", b=",", v=3).replace("\n", "\n * ").replace(" * \n", " *\n"): ("GPL-3.0-or-later", ""),
    GPL.format(a=";", b=";", v=2).split("\n\n")[0]: ("GPL-2.0-or-later", ""), GPL.format(a=":", b=",", v=3).split("\n\n")[0]: ("GPL-3.0-or-later", ""),
    GPL.format(a=";", b=";", v=2) + "\n\n" + GPL.format(a=":", b=",", v=3): ("GPL-2.0-or-later,GPL-3.0-or-later", ""),
    GPL.format(a=";", b=";", v=4): ("", "GplEven,GplHope,GplSee"), "This program is free software: take it.": ("", ""),
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy": ("MPL-2.0", ""),
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy": ("", ""), "Version 1. 2.0. End": ("", ""),
    notice("Lesser ", "2.1", "library"): ("LGPL-2.1-or-later", ""), notice("Lesser ", "3"): ("LGPL-3.0-or-later", ""), notice("Library ", "2", "library"): ("LGPL-2.0-or-later", ""),
    notice("Affero ", "3"): ("AGPL-3.0-or-later", ""), notice("", "2", end="version 2 of the License."): ("GPL-2.0-only", ""), notice("", "3", end="version 3 only."): ("GPL-3.0-only", ""),
    "\n\n".join(MIT_PARTS): ("MIT", ""), "MIT License\n\nCopyright (c) 2020 A. Body\n\n" + "\n\n".join(MIT_PARTS): ("MIT", ""),
    "\n\n".join([MIT_PARTS[0], *["Some other text stands here."] * 500, MIT_PARTS[1]]): ("", "MitGrant,MitNotice"),
    "\n\n".join([BSD_PARTS[0], *(f"{k}. {t}" for k, t in enumerate(BSD_PARTS[1:4], 1)), *BSD_PARTS[4:]]): ("BSD-3-Clause", ""),
    "\n".join([BSD_PARTS[0], *(f"  * {t}" for t in BSD_PARTS[1:3]), *BSD_PARTS[4:]]): ("BSD-2-Clause", ""),
    "\n".join([*BSD_PARTS[:3], "Neither the name of Some Firm nor the names of others may be used.", *BSD_PARTS[4:]]): ("BSD-3-Clause", ""),
    "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n Copyright (C) 1989": ("GPL-2.0", ""), "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": ("Apache-2.0", ""),
    "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": ("AGPL-3.0", ""), "\n".join(licenses.SENTENCES[k] for k in ("ZlibAsIs", "ZlibLiable", "ZlibGrant")): ("Zlib", ""),
    licenses.SENTENCES["EplTerms"]: ("EPL-2.0", ""), "Licensed under EUPL 1.2.\nReleased under the zlib License.": ("EUPL-1.2,Zlib", ""),
    "SPDX-License-Identifier: Apache-2.0": ("Apache-2.0", ""), "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;": ("LGPL-2.1-or-later", ""),
    "Apache-2.0": ("", ""), "SPDX-License-Identifier: text Apache-2.0": ("", ""),
    "1. \n a) \u0085 b\u2028": ("", ""), "<MitGrant><MitNotice> [MIT] | <?> <#3>": ("", ""), "MIT\x01License\x01SPDX-License-Identifier:\tMIT": ("MIT", ""),
}


def test_license_notices_in_columns_and_sql(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(NOTICE_CASES)] + [(None, None), (0, ""), (0, ""), (7, "MIT License " * 3000)], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    by = {r["doc_id"]: r for r in rows if r["n_sentences"] or r["joined_identifiers"]}
    assert {t: (by[k]["licenses"], by[k]["left_over"]) if k in by else ("", "") for k, t in enumerate(NOTICE_CASES)} == NOTICE_CASES
    assert by[0]["joined_identifiers"] == "Gpl2Free GplHope GplEven GplSee" and by[1]["joined_identifiers"] == "GplFree GplHope GplEven GplSee"
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert Counter(map(tuple, rows)) == Counter(con.execute(licenses.scan_sql()).fetchall())


def test_every_license_sentence_in_columns_and_sql(spark):
    """Each sentence of the catalogue alone, and the sentences of each rule one after another."""
    sentences, rules = licenses.catalogue()
    texts_ = list(sentences.values()) + ["\n\n".join(sentences[p] if p != licenses.OTHER else "Other words." for p in parts.split()) for _, parts in rules]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert Counter(map(tuple, rows)) == Counter(con.execute(licenses.scan_sql()).fetchall())
    by = {r["doc_id"]: r["licenses"].split(",") for r in rows}
    missed = [(licence, parts) for k, (licence, parts) in enumerate(rules, len(sentences)) if licence not in by[k]]
    assert missed == []


def test_license_sentences_of_one_form_are_refused(spark):
    with pytest.raises(ValueError, match="one normalised form"):
        licenses.scan(frame(spark), sentences={"A": "Some free: text.", "B": "some FREE; text"})


def test_texts_without_a_base_span_are_labelled():
    """A shape that patterns nearly always confirm is found in any text, whether or not another span is in it."""
    weights = pii.Weights({("shape", "+d1-d3-d4", "3"): 99, ("shape", "+d1-d3-d4", "4"): 1, ("shape", "d2", "4"): 900})
    texts = ["ring +1-555-1234 or so", "ring +1-555-1234 or so, a@b.cd knows", "ring 12 or 13", "nothing at all", ""]
    base = [pii.base_spans(t) for t in texts]
    assert base == [[], [(24, 0, 30)], [], [], []]
    assert pii.added_spans(texts, base, weights) == [[(5, 3, 16)], [(5, 3, 16)], [], [], []]


def test_labels_do_not_depend_on_what_is_labelled_together(monkeypatch):
    weights = pii.Weights({("shape", "+d1-d3-d4", "3"): 99, ("shape", "+d1-d3-d4", "4"): 1, ("chain", "3", "4"): 5, ("chain", "4", "4"): 50})
    texts = [f"call +1 (0{k + 10}) 555-{1000 + k}, x{k}@b.cd or 555-{1000 + k} and +1-555-{1000 + k} in {k}" for k in range(40)]
    base = [pii.base_spans(t) for t in texts]
    want = pii.added_spans(texts, base, weights)
    monkeypatch.setattr(pii, "TOGETHER", 1)
    assert any(want) and pii.added_spans(texts, base, weights) == want


def test_plain_words_get_the_tokenizers_own_ids(spark):
    """Every word of the table, and words put together at random, through the merge table and through the library."""
    tok = Tokenizer.from_file(WORD)
    rng = np.random.default_rng(4)
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for w in r.text.split()}
    letters = list("abcdefghijklmnopqrstuvwxyzéàüßñøœžÅÆ") + ["th", "ing", "er", "Re"]
    words |= {"".join(rng.choice(letters, n)) for n in rng.integers(1, 12, 4_000)}
    words |= {f"{a}{b}" for a in ("word", "Été", "x's", "don't", "a1", "1") for b in (".", "...", "$$$", "'", "_", "-x", "!?", "")}
    known, fresh = {}, dict.fromkeys(sorted(words))
    packing._learn(tok, packing.byte_lengths(tok), known, fresh, packing.PlainWords(tok))
    want = {w: np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words}
    assert fresh == want
    assert all(known[w] == np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in known)


def test_small_groups_pack_nearly_as_well(spark):
    """With groups far smaller than the number of bins, rounds over other groups bring the rest together."""
    rng = np.random.default_rng(9)
    sizes = rng.integers(200, 3_900, 1_500)
    pieces = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(sizes)], packing.PIECES).repartition(32)
    counts = []
    for group in (200_000, 150):
        got = packing.pack(pieces, group=group).collect()
        used = Counter()
        for r in got:
            used[r.sequence_id] += r.length
        assert len(got) == len(sizes) and max(used.values()) <= packing.CAPACITY
        counts.append(len(used))
    assert counts[1] <= counts[0] * 1.01
