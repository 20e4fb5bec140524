"""Word-first language identification.

A model holds, per learned language, log frequencies of whole words and of character n-grams of length 4 down to 1. A
known word is scored by its frequency in each language; an unknown word by its longest n-grams that are known, falling
back to shorter ones. It is fitted on a bounded sample of the labelled rows (``SAMPLE`` per language, those with the
smallest hash of the id), whole texts; prediction reads all rows and whole texts and nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when no row can be
learned from. A text whose letters are all unknown gets the language with most sample rows and the score 1 / languages.
Ties go to the smallest language name. Rows with a null or empty ``lang`` or a null id are not learned from; a null id
counts as not held out. Repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from headwind.llm.tables import fresh_name, keep, slices, texts

SAMPLE = 1_500  # rows learned from, per language
WORDS = 20_000  # words kept per language
GRAMS = 8_000  # n-grams kept per language and length
LONGEST = 4
SMOOTH = 0.5
CACHED_BYTES = 24 << 20  # of vectors in a worker's cache
LONG = 64  # longer chunks are scored but not remembered
SLICE = 128
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def remainder(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its edges; single characters without edges."""
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> list[tuple]:
    """Rows ``(lang, kind, key, n)``: kind 0 words, 1..4 n-grams by length, -1 the number of sample rows."""
    labelled = docs.where((F.length(lang_col) > 0) & F.col(id_col).isNotNull() & (remainder(id_col) != 1))
    ids = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    # at most ``sample`` ids for each language
    picked = keep(ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("id", "lang").distinct(), "lang-sample")
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    rows = rows.join(F.broadcast(picked), ["id", "lang"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Counter] = defaultdict(Counter)
        for batch in slices(batches, SLICE):
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                seen[lang, 0].update(_WORD.findall(text.lower()))
                seen[lang, -1][""] += 1
        for (lang, kind), counted in list(seen.items()):
            if kind == 0:
                for n in range(1, LONGEST + 1):
                    own = seen[lang, n]
                    for word, c in counted.items():
                        for g in grams(word, n):
                            own[g] += c
        for (lang, kind), counted in seen.items():
            keys = list(counted)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(keys), pa.string()), "kind": pa.array([kind] * len(keys), pa.int32()),
                    "key": pa.array(keys, pa.string()), "n": pa.array([counted[k] for k in keys], pa.int64()),
                }
            )

    counted = rows.select("lang", "t").mapInArrow(run, "lang string, kind int, key string, n long")
    total = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    most = F.when(F.col("kind") == 0, WORDS).otherwise(GRAMS)
    top = total.withColumn("r", F.row_number().over(best)).where(F.col("r") <= WORDS).where(F.col("r") <= most)
    return [(r["lang"], r["kind"], r["key"], r["n"]) for r in top.select("lang", "kind", "key", "n").collect()]


class Model:
    """Log frequencies of words and n-grams for each language, as plain arrays."""

    def __init__(self, rows: list[tuple]):
        self.langs = sorted({r[0] for r in rows if r[1] == -1})
        at = {lang: i for i, lang in enumerate(self.langs)}
        size = len(self.langs)
        self.sample = np.zeros(size)
        counts: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(size)) for _ in range(LONGEST + 1)]
        for lang, kind, key, n in rows:
            if kind == -1:
                self.sample[at[lang]] += n
            else:
                counts[kind][key][at[lang]] += n
        self.tables = []
        for table in counts:
            if not table:
                self.tables.append({})
                continue
            keys, matrix = list(table), np.array(list(table.values())) + SMOOTH
            logs = np.log(matrix) - np.log(matrix.sum(0))
            self.tables.append(dict(zip(keys, map(tuple, logs.tolist()))))
        self.default = int(np.argmax(self.sample)) if size else 0

    def word(self, word: str) -> tuple[float, ...] | None:
        """A log score for each language, or None when no part of the word is known."""
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            look = self.tables[n].get
            found = [v for v in map(look, grams(word, n)) if v is not None]
            if found:
                return tuple(sum(column) / len(found) for column in zip(*found))
        return None

    def chunk(self, chunk: str) -> list[float]:
        """Sums over the words of a chunk: log scores, words scored, and whether there is a letter."""
        letter = 1.0 if any(map(str.isalpha, chunk)) else 0.0
        scores = [score for score in map(self.word, _WORD.findall(chunk)) if score is not None] if self.langs else []
        if len(scores) == 1:
            return [*scores[0], 1.0, letter]
        sums = [sum(column) for column in zip(*scores)] if scores else [0.0] * len(self.langs)
        return [*sums, float(len(scores)), letter]

    def decide(self, sums: np.ndarray) -> tuple[str, float]:
        size = len(self.langs)
        if not size or sums[-1] == 0:
            return UNDETERMINED, 0.0
        if sums[size] == 0:
            return self.langs[self.default], 1.0 / size
        best = int(np.argmax(sums[:size]))
        # words of a text depend on each other: n words count as the square root of n
        chance = np.exp((sums[:size] - sums[best]) / np.sqrt(sums[size]))
        return self.langs[best], float(1.0 / chance.sum())


class _Cache:
    """Vectors of chunks seen by this worker, in one growing array that starts anew when it is full."""

    def __init__(self, model: Model):
        self.model, self.at, self.used = model, {}, 0
        width = len(model.langs) + 2
        self.most = max(1_000, min(500_000, CACHED_BYTES // (8 * width)))
        self.rows = np.zeros((4_096, width))

    def sums(self, chunked: list[list[str]]) -> list[np.ndarray]:
        if self.used >= self.most:
            self.at.clear()
            self.used = 0
        found = [list(map(self.at.get, t)) for t in chunked]
        gaps = [[(i, t[i]) for i, row in enumerate(f) if row is None] if None in f else [] for f, t in zip(found, chunked)]
        fresh = list({c for gap in gaps for _, c in gap})
        need = self.used + len(fresh)
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]))
            grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        if fresh:
            self.rows[self.used : need] = [self.model.chunk(c) for c in fresh]
        spot = dict(zip(fresh, range(self.used, need)))
        self.used = need
        for f, gap in zip(found, gaps):
            for i, c in gap:
                f[i] = spot[c]
        self.at.update((c, i) for c, i in spot.items() if len(c) <= LONG)
        return [self.rows[f].sum(0) if f else np.zeros(self.rows.shape[1]) for f in found]


_caches: dict[int, _Cache] = {}


def decided(rows: DataFrame, model: Model, text_col: str, lang_out: str, score_out: str) -> DataFrame:
    """All columns of ``rows`` and two more: the language and the score of the text in ``text_col``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS for each language

    at = rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if id(own) not in _caches:
            _caches.clear()
            _caches[id(own)] = _Cache(own)
        cache = _caches[id(own)]
        for batch in slices(batches, SLICE):
            found = [own.decide(s) for s in cache.sums([t.lower().split() for t in texts(batch.column(at))])]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, lang_out, score_out])

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    held = F.coalesce(remainder(id_col) == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).alias("t"))
    return decided(rows, model, "t", "lang_pred", "score").drop("t")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled rows that are not held out and predict all rows."""
    return predict(docs, Model(learn(docs, id_col, text_col, lang_col, sample)), id_col, text_col)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``_lang`` and ``_score`` (or names like them that ``docs`` lacks), learned from its own labelled rows."""
    return decided(docs, Model(learn(docs, id_col, text_col, lang_col)), text_col, fresh_name(docs, "_lang"), fresh_name(docs, "_score"))
