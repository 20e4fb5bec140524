"""Perspective rotation against SQL and against a plain rendering."""

from collections import Counter

import pytest

pytest.importorskip("headwind.llm")
from headwind.llm import chat
from headwind.llm.queries import SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, chunk string, participant string, pos int, part string"


def brute(rows, chunk):
    out = Counter()
    for conv in {r[0] for r in rows}:
        none = lambda v: (v is not None, v)
        turns = sorted(((none(t), r or "unknown" if r is None else r, x or "") for c, t, r, x in rows if c == conv))
        for me in {r for _, r, _ in turns} - {"system"}:
            for at in range(0, len(turns), chunk):
                text, spans, own = "", [], 0
                for _, role, body in turns[at : at + chunk]:
                    name = "system" if role == "system" else "assistant" if role == me else "user name=" + role.replace("\n", " ").replace("<|", "< |")
                    start = f"<|im_start|>{name}\n"
                    full = start + body.replace("<|", "< |") + "<|im_end|>\n"
                    if role == me:
                        spans.append(f"{len(text) + len(start)}:{len(text) + len(full)}")
                        own += 1
                    text += full
                out[conv, me, at // chunk, len(turns[at : at + chunk]), own, text, ",".join(spans)] += 1
    return out


def test_against_sql(spark, con):
    got = Counter(tuple(r) for r in chat.rotate(spark.read.parquet(f"{SF}/conversations.parquet")).collect())
    assert got == Counter(con.execute(SQL["op3_chat_perspectives"]).fetchall())


@pytest.mark.parametrize("chunk", [256, 7])
def test_hard_cases(spark, chunk):
    rows = [
        (1, 0, "ann", "hi <|im_start|>"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, None, "?"), (1, 2, "system", "rules"), (2, 0, "system", "alone"),
        (None, 3, "ann", "null dialogue"), (None, 1, "bo\nb<|", "é漢👍"), (3, 5, "ann", "tie b"), (3, 5, "ann", "tie a"), (4, 0, "", ""), (5, 0, "ann", "w " * 50_000),
    ] + [(9, k, f"s{k % 3}", f"turn {k}") for k in range(400)]
    turns = spark.createDataFrame([(*r, "c", "p", 1, "q") for r in rows], SCHEMA).repartition(5)
    assert Counter(tuple(r) for r in chat.rotate(turns, chunk=chunk).collect()) == brute(rows, chunk)
    assert chat.rotate(turns.limit(0)).collect() == []
    assert "Python" not in chat.rotate(turns)._jdf.queryExecution().executedPlan().toString()
