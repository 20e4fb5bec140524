"""Batch annotation of articles by a user-supplied function: batches, prompts, calls, parsing, write-back, resume."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from headwind.functions import fixed_values as fixed
from headwind.functions.text import WORD
from headwind.operators.rows import number_batches
from headwind.session import cut

Annotator = Callable[[str, list[dict]], str]

INSTRUCTIONS = (
    "For every record above give one JSON object with the keys record_id, title_verbs, title_adjectives, title_tonality, "
    "text_verbs, text_adjectives and text_tonality. Tonality is positive, negative or neutral; the text lists hold at most "
    "ten words. Answer with a single JSON array and nothing else."
)


def make_batches(articles: DataFrame, key: str, order: list[str], size: int = 10, drop_tail: bool = False) -> DataFrame:
    """``batch, records``: up to ``size`` articles in row order, those without a title or a text left out.

    A batch keeps its place in the row order even when it is short; a batch without any usable article disappears. Only
    keys and order columns are sorted and numbered; ``key`` must be unique.
    """
    names = list(dict.fromkeys([key, *order]))
    numbers = number_batches(articles.select(*names), order, size, drop_tail).select(F.col(key).alias("_key"), "batch", "slot")
    usable = articles.where("title is not null and text is not null")
    placed = usable.join(numbers, F.col(key).eqNullSafe(F.col("_key")))
    record = F.struct("slot", F.col(key).alias("key"), "title", "text")
    # a batch never holds more than ``size`` rows
    return placed.groupBy("batch").agg(F.array_sort(F.collect_list(record)).alias("records"))


def prompt_text(records: Column, instructions: str = INSTRUCTIONS) -> Column:
    """Numbered records with their title and the first characters of their text, blank lines between, then the task."""
    blocks = F.transform(
        records,
        lambda r, i: F.concat(
            F.lit("RECORD "),
            (i + 1).cast("string"),
            F.lit(':\nTitle: "'),
            r["title"],
            F.lit('"\nText: "'),
            F.substring(r["text"], 1, fixed.PROMPT_TEXT_CHARS),
            F.lit('"'),
        ),
    )
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n\n" + instructions))


def call_with_retry(call: Callable[[], str], tries: int = 3, pause: float = 5.0, sleep=time.sleep) -> tuple[bool, str | None, str | None]:
    """``(ok, error, answer)``. Only time-outs are tried again, after 1, 2, … pauses; nothing is raised."""
    for attempt in range(1, tries + 1):
        try:
            return True, None, call()
        except TimeoutError:
            if attempt < tries:
                sleep(pause * attempt)
        except Exception as e:
            return False, f"call failed: {e}", None
    return False, "timed out on every try", None


def call_within(call: Callable[[], str], limit: float | None) -> str:
    """The call's answer, or a ``TimeoutError`` once ``limit`` seconds are over; the late call is left alone and its answer lost."""
    if limit is None:
        return call()
    box: dict[str, object] = {}
    done = threading.Event()

    def run() -> None:
        try:
            box["answer"] = call()
        except BaseException as e:  # handed to the waiting thread
            box["error"] = e
        finally:
            done.set()

    threading.Thread(target=run, daemon=True).start()  # a call that never ends does not keep the worker alive
    if not done.wait(limit):
        raise TimeoutError(f"no answer within {limit:g} s")
    if "error" in box:
        raise box["error"]
    return box["answer"]


def call_annotator(
    batches: DataFrame, annotator: Annotator, workers: int | None = None, tries: int = 3, pause: float = 5.0, limit: float | None = 60.0,
    pool: int = 1, measure: Observation | None = None,
) -> DataFrame:
    """Run the annotator on each batch inside Spark tasks; ``workers`` bounds how many tasks run at once.

    A task has up to ``pool`` calls under way at a time, and each try ends after ``limit`` seconds. Adds ``ok, error, answer``
    to ``batch, records``, in the order of the batches. A failing call is a value, never a failed task. The answers are kept
    in the shared folder, so reading successes and failures later does not call anything again. ``measure`` takes down, in
    the same run, the batches and records asked, the seconds spent in calls, and when the first began and the last ended.
    """
    asked = batches.select("batch", "records", prompt_text(F.col("records")).alias("prompt"))
    if workers:
        asked = asked.repartition(workers, "batch")

    def ask(task: tuple[str, list]) -> tuple:
        prompt, records = task
        plain = [{"title": r["title"], "text": r["text"]} for r in records]
        began = time.time()
        return *call_with_retry(lambda: call_within(lambda: annotator(prompt, plain), limit), tries, pause), began, time.time()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(pool) as threads:
            for part in parts:
                answers = list(threads.map(ask, zip(part["prompt"], part["records"])))
                out = part.drop(columns="prompt")
                out["ok"], out["error"], out["answer"], out["began"], out["ended"] = zip(*answers) if answers else ((),) * 5
                yield out

    schema = asked.drop("prompt").schema.add("ok", "boolean").add("error", "string").add("answer", "string").add("began", "double").add("ended", "double")
    answered = asked.mapInPandas(run, schema)
    if measure is not None:
        answered = answered.observe(
            measure, F.count("*").alias("batches"), F.sum(F.size("records")).alias("n"), F.sum(F.col("ended") - F.col("began")).alias("call_seconds"),
            (F.max("ended") - F.min("began")).alias("seconds"), F.count_if(~F.col("ok")).alias("failed"),
        )
    return cut(answered).drop("began", "ended")


def measured(spark: SparkSession, measure: Observation) -> DataFrame:
    """Throughput as the run itself took it down: one row; read it after the answers."""
    got = measure.get
    n, seconds = got["n"] or 0, got["seconds"]
    row = (n, got["batches"], got["failed"], seconds, got["call_seconds"], seconds / n if n else None)
    return spark.createDataFrame([row], "n long, batches long, failed long, seconds double, call_seconds double, seconds_per_row double")


def parse_answers(called: DataFrame) -> DataFrame:
    """The JSON array between the first ``[`` and the last ``]`` of each answer, as ``results``.

    Without one, or when it is malformed, the batch becomes an error row; malformed answers keep their first characters.
    """
    found = F.nullif(F.regexp_extract("answer", r"(?s)\[.*\]", 0), F.lit(""))
    parsed = F.from_json(found, f"array<struct<{_fields()}>>", {"mode": "PERMISSIVE"})
    out = called.withColumns({"_found": found, "results": parsed})
    broken = F.col("ok") & F.col("_found").isNotNull() & F.col("results").isNull()
    return out.select(
        *[c for c in called.columns if c not in ("ok", "error", "answer")],
        (F.col("ok") & F.col("results").isNotNull()).alias("ok"),
        F.when(~F.col("ok"), F.col("error"))
        .when(F.col("_found").isNull(), "no JSON array in the answer")
        .when(broken, "malformed JSON in the answer")
        .alias("error"),
        F.when(broken, F.substring("answer", 1, 500)).alias("raw_answer"),
        "results",
    )


def split_outcomes(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches with results, and batches with an error."""
    return parsed.where("ok").drop("error", "raw_answer"), parsed.where("not ok").drop("results")


def scatter(good: DataFrame, key: str = "key") -> DataFrame:
    """One row per annotated article, matched by the record's place in its batch.

    A missing id counts as 1, an id past the end is ignored, 0 and below count from the end, the last of several
    results for one place wins, and missing fields become [] or 'unknown'. All of it happens inside the batch row.
    """
    n = F.size("records")
    at = lambda r: F.coalesce(r["record_id"], F.lit(1))
    spot = lambda r: F.when(at(r) >= 1, at(r)).otherwise(n + at(r))
    placed = F.transform("results", lambda r: F.named_struct(F.lit("at"), spot(r), F.lit("r"), r))
    rows = good.select("batch", placed.alias("_p"), F.posexplode("records").alias("_i", "_rec"))
    mine = F.filter("_p", lambda p: p["at"] == F.col("_i") + 1)
    hit = rows.select(F.col("_rec.key").alias(key), F.try_element_at(mine, F.lit(-1)).alias("_h")).where("_h is not null")
    empty = F.array().cast("array<string>")
    return hit.select(
        key,
        *[F.to_json(F.coalesce(F.col(f"_h.r.{c}"), empty)).alias(c) for c in fixed.ANNOTATION_LISTS],
        *[F.coalesce(F.col(f"_h.r.{c}"), F.lit("unknown")).alias(c) for c in fixed.ANNOTATION_TONES],
    )


def ensure_columns(df: DataFrame) -> DataFrame:
    """Add the annotation columns that are not there yet."""
    absent = [c for c in fixed.ANNOTATION_LISTS + fixed.ANNOTATION_TONES if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df


def write_back(articles: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Articles with their annotations, matched by key; articles without one keep what they had."""
    cols = fixed.ANNOTATION_LISTS + fixed.ANNOTATION_TONES
    fresh = annotations.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = ensure_columns(articles).join(fresh, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in cols}).drop(*[f"_new_{c}" for c in cols])


def annotate(
    articles: DataFrame, annotator: Annotator, key: str, order: list[str], size: int = 10, drop_tail: bool = False,
    workers: int | None = None, **calls,
) -> DataFrame:
    """``batch, records, ok, error, raw_answer, results`` for every batch of the articles; ``calls`` goes to ``call_annotator``."""
    return parse_answers(call_annotator(make_batches(articles, key, order, size, drop_tail), annotator, workers, **calls))


def pending(articles: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Articles not annotated yet, by key."""
    return articles.join(done.select(key), key, "left_anti")


def resume(
    articles: DataFrame, done_path: str, annotator: Annotator, key: str, order: list[str], size: int = 10,
    drop_tail: bool = False,
) -> DataFrame:
    """Annotate what the table at ``done_path`` lacks and append it there; returns the whole table.

    Resuming goes by key, so it does not matter in which order batches finished. The tail is kept by default, or the
    last articles would never be reached.
    """
    spark = articles.sparkSession
    done = read_done(spark, done_path, key)
    todo = articles if done is None else pending(articles, done, key)
    good, _ = split_outcomes(annotate(todo, annotator, key, order, size, drop_tail))
    scatter(good, key).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def read_done(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select(key)
    except AnalysisException:  # first run: nothing there yet
        return None


def throughput(done: DataFrame, seconds: float) -> DataFrame:
    """Rows, total seconds and seconds per row."""
    s = F.lit(float(seconds))
    return done.agg(F.count("*").alias("n"), s.alias("seconds")).withColumn("seconds_per_row", F.try_divide("seconds", "n"))


def lexicon_annotator(verbs: set[str], adjectives: set[str], positive: set[str], negative: set[str]) -> Annotator:
    """A repeatable annotator: known words in text order, tone by the balance of known words."""
    word = re.compile(WORD.replace(r"\p{L}\p{N}_", r"\w"))

    def tone(words: list[str]) -> str:
        score = sum(w in positive for w in words) - sum(w in negative for w in words)
        return "positive" if score > 0 else "negative" if score < 0 else "neutral"

    def run(prompt: str, records: list[dict]) -> str:
        out = []
        for i, r in enumerate(records, 1):
            title, text = word.findall(r["title"].lower()), word.findall(r["text"].lower())
            out.append(
                {
                    "record_id": i,
                    "title_verbs": [w for w in title if w in verbs],
                    "title_adjectives": [w for w in title if w in adjectives],
                    "title_tonality": tone(title),
                    "text_verbs": [w for w in text if w in verbs][:10],
                    "text_adjectives": [w for w in text if w in adjectives][:10],
                    "text_tonality": tone(text),
                }
            )
        return json.dumps(out)

    return run


def _fields() -> str:
    return ", ".join(f.replace(" ", ":", 1) for f in fixed.ANNOTATION_SCHEMA.split(", "))
