import json

import pytest
from pyspark.sql import functions as F

from headwind.operators import annotate as an


def test_retry_only_on_timeouts():
    waits, calls = [], []

    def slow():
        calls.append(1)
        raise TimeoutError

    assert an.call_with_retry(slow, 3, 5.0, waits.append) == (False, "timed out on every try", None)
    assert len(calls) == 3 and waits == [5.0, 10.0]

    def broken():
        calls.append(1)
        raise OSError("no route")

    calls.clear()
    ok, error, answer = an.call_with_retry(broken, 3, 5.0, waits.append)
    assert (ok, answer, len(calls)) == (False, None, 1) and "no route" in error

    state = iter([TimeoutError(), "fine"])

    def second():
        v = next(state)
        if isinstance(v, Exception):
            raise v
        return v

    assert an.call_with_retry(second, 3, 0.0, waits.append) == (True, None, "fine")


def called(rows, answers):
    recs = [(1, "k1", "t", "x"), (2, "k2", "t", "x"), (3, "k3", "t", "x")]
    return rows([(i, recs, True, None, a) for i, a in enumerate(answers)], "batch bigint, records array<struct<slot:int,key:string,title:string,text:string>>, ok boolean, error string, answer string")


def test_answers(rows):
    got = {r.batch: r for r in an.parse_answers(called(rows, ['pre [{"record_id":1}] post', "none", "[bad", "[bad]", "[]"])).collect()}
    assert got[0].ok and got[0].results[0].record_id == 1
    assert not got[1].ok and got[1].error == "no JSON array in the answer"
    assert not got[2].ok and got[2].error == "no JSON array in the answer"
    assert not got[3].ok and got[3].error == "malformed JSON in the answer" and got[3].raw_answer == "[bad]"
    assert got[4].ok and got[4].results == []


def scattered(rows, results):
    good, _ = an.split_outcomes(an.parse_answers(called(rows, [json.dumps(results)])))
    return {r.key: r for r in an.scatter(good).collect()}


def test_scatter_rules(rows):
    got = scattered(rows, [{"record_id": 1, "title_tonality": "a"}, {"record_id": 3, "title_verbs": ["is"]}, {"record_id": 99}, {"title_tonality": "last"}])
    assert set(got) == {"k1", "k3"}
    assert got["k1"].title_tonality == "last"  # a missing id means 1, and the last one wins
    assert (got["k3"].title_verbs, got["k3"].title_adjectives, got["k3"].text_tonality) == ('["is"]', "[]", "unknown")


def test_scatter_counts_from_the_end(rows):
    assert set(scattered(rows, [{"record_id": 0}])) == {"k3"}
    assert set(scattered(rows, [{"record_id": -1}])) == {"k2"}
    assert scattered(rows, [{"record_id": -9}]) == {}


@pytest.fixture
def articles(rows):
    data = [(i, f"title {i}" if i != 4 else None, "the market is up" if i % 2 else "x" * 600) for i in range(23)]
    return rows(data, "id bigint, title string, text string")


def test_batches_and_prompts(articles):
    batches = an.make_batches(articles, "id", ["id"])
    sizes = {r.batch: r.n for r in batches.select("batch", F.size("records").alias("n")).collect()}
    assert sizes == {0: 9, 1: 10, 2: 3}  # the guard shortens batch 0
    prompt = batches.where("batch = 0").select(an.prompt_text(F.col("records"))).first()[0]
    assert prompt.startswith('RECORD 1:\nTitle: "title 0"\nText: "' + "x" * 500 + '"\n\nRECORD 2:\nTitle: "title 1"')
    assert 'RECORD 5:\nTitle: "title 5"' in prompt


def test_places_follow_the_shortened_batch(articles):
    answers = an.annotate(articles, lambda p, r: json.dumps([{"record_id": 5, "title_tonality": "hit"}]), "id", ["id"])
    got = {r.key for r in an.scatter(an.split_outcomes(answers)[0]).collect()}
    assert got == {5, 14}


def test_failures_are_values(articles):
    def fn(prompt, records):
        if any(r["title"] == "title 3" for r in records):
            raise ValueError("boom")
        return "[]"

    good, bad = an.split_outcomes(an.annotate(articles, fn, "id", ["id"], workers=2))
    assert sorted(r.batch for r in good.collect()) == [1, 2]
    assert [(r.batch, r.error) for r in bad.select("batch", "error").collect()] == [(0, "call failed: boom")]


def test_each_batch_is_asked_once(articles, tmp_path):
    seen = tmp_path / "calls"

    def fn(prompt, records):
        with open(seen, "a") as f:
            f.write(records[0]["title"] + "\n")
        return "[]" if records[0]["title"] == "title 0" else "no"

    good, bad = an.split_outcomes(an.annotate(articles, fn, "id", ["id"]))
    assert good.count() == 1 and bad.count() == 2 and good.collect() and bad.collect()
    assert sorted(seen.read_text().split()) == sorted("title 0 title 10 title 20".split())


def test_resume_goes_by_key(articles, tmp_path):
    seen = tmp_path / "calls"

    def fn(prompt, records):
        with open(seen, "a") as f:
            f.write("".join(r["title"] + "\n" for r in records))
        return json.dumps([{"record_id": i + 1, "title_tonality": "ok"} for i in range(len(records))])

    path = str(tmp_path / "done")
    assert an.resume(articles.where("id < 7 or id > 20"), path, fn, "id", ["id"]).count() == 8
    assert an.resume(articles, path, fn, "id", ["id"]).count() == 22
    titles = seen.read_text().split("\n")[:-1]
    assert len(titles) == len(set(titles)) == 22
    whole = an.write_back(articles, articles.sparkSession.read.parquet(path), "id")
    assert whole.where("title_tonality is null").count() == 1 and whole.count() == 23


def test_missing_columns_and_throughput(articles):
    assert "text_adjectives" in an.ensure_columns(articles).columns
    row = an.throughput(articles, 46.0).first()
    assert (row.n, row.seconds_per_row) == (23, 2.0)


def test_a_hanging_call_becomes_an_error_row(articles):
    import time

    def fn(prompt, records):
        if records[0]["title"] == "title 10":
            time.sleep(30)
        return "[]"

    began = time.time()
    asked = an.annotate(articles, fn, "id", ["id"], tries=2, pause=0.05, limit=0.5)
    good, bad = an.split_outcomes(asked)
    assert [(r.batch, r.error) for r in bad.collect()] == [(1, "timed out on every try")] and good.count() == 2
    assert time.time() - began < 25


def test_a_call_within_its_limit_keeps_its_answer_and_its_error():
    assert an.call_within(lambda: "x", 5) == "x" and an.call_within(lambda: "y", None) == "y"
    with pytest.raises(ValueError):
        an.call_within(lambda: int("z"), 5)


def test_a_pool_shortens_the_wait_and_keeps_the_order(spark):
    import time

    from pyspark.sql import Observation

    frame = spark.range(40).select("id", F.format_string("t%d", "id").alias("title"), F.lit("x").alias("text"))
    batches = an.make_batches(frame, "id", ["id"], size=2).coalesce(1)

    def fn(prompt, records):
        time.sleep(0.2)
        return records[0]["title"]

    taken = {}
    for pool in (1, 10):
        seen = Observation()
        rows = an.call_annotator(batches, fn, workers=1, pool=pool, measure=seen).collect()
        assert all(r.answer == r.records[0]["title"] for r in rows) and len(rows) == 20
        row = an.measured(spark, seen).first()
        assert (row.n, row.batches, row.failed) == (40, 20, 0) and row.call_seconds > 3.9
        taken[pool] = row.seconds
    assert taken[10] < taken[1] / 3
