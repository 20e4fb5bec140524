"""Token counts by a two-tier lookup on the map side.

A text is cut before each single space that leads a word; such a piece is a whole number of the tokenizer's own
pre-tokens, so its length does not depend on its surroundings. Tier one is a broadcast table with the lengths of the
most frequent pieces (found by a first pass over all documents, bounded per task and in total). Tier two is a bounded
cache in each Python worker, filled by encoding the pieces that tier one lacks, many at a time. No piece is ever
shuffled; only the bounded summaries of the first pass are.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows (also of one id) each give a row; a null id
stays null; an empty table gives an empty result; extra columns are ignored, whatever their names; texts of any length
are counted whole. Texts with a special string or with runs of white space that cannot be cut safely take an exact way
of their own. Ties in frequency are broken by the piece, and only decide which tier holds it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm.tables import slices, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
LIMIT = 512
FREQUENT = 20_000  # pieces in the broadcast table
PER_TASK = 50_000  # pieces that one task reports in the first pass
CACHED = 1_000_000  # pieces in a worker's cache before it starts anew
SLICE = 128  # texts handled at a time
LONG = 64  # longer pieces are encoded but not cached

_WIDE = re.compile(r"\s \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_tokenizers: dict[str, object] = {}
_caches: dict[tuple, dict[str, int]] = {}


def tokenizer_of(path: str):
    """The tokenizer of a file, loaded once per worker."""
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per Spark task
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def pieces(text: str) -> list[str]:
    """The text cut at the spaces that lead a word; every piece but the first had one in front of it."""
    found = text.split(" ")
    if "" in found or _WIDE.search(text):
        return _CUT.split(text)
    return found


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def encode_apart(tokenizer, parts: list[str]) -> list[np.ndarray]:
    """The ids of each part, encoded in one call with a special token between them."""
    specials = tokenizer.get_added_tokens_decoder()
    plain = {i: t.content for i, t in specials.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)}
    if not plain or not parts:
        return [np.array(tokenizer.encode(p, add_special_tokens=False).ids, dtype=np.uint32) for p in parts]
    mark, sign = min(plain.items())
    ids = np.array(tokenizer.encode(sign.join(parts), add_special_tokens=False).ids, dtype=np.uint32)
    return np.split(ids, np.flatnonzero(ids == mark)) if len(parts) == 1 else [
        part[(k > 0):] for k, part in enumerate(np.split(ids, np.flatnonzero(ids == mark)))
    ]


def byte_lengths(tokenizer) -> np.ndarray:
    """The number of bytes that each id of a byte-level vocabulary stands for; 0 for special tokens."""
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    out = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token.removesuffix("</w>"))  # one character for each byte
    return out


def ends_at(sizes: np.ndarray, parts: list[int]) -> np.ndarray | None:
    """How many of the tokens end with each part, from the bytes of both; None if some part ends inside a token."""
    ends, wanted = np.cumsum(sizes), np.cumsum(parts)
    at = np.searchsorted(ends, wanted)
    if not len(ends) or at[-1] >= len(ends) or not np.array_equal(ends[at], wanted) or ends[-1] != wanted[-1]:
        return None
    return at + 1


def led_lengths(tokenizer, sizes: np.ndarray, parts: list[str]) -> list[int]:
    """The numbers of tokens of pieces with the space that leads each, none of which starts with white space.

    Put together, the pieces are a text that the tokenizer cuts at these spaces itself.
    """
    if not parts:
        return []
    ids = tokenizer.encode(" " + " ".join(parts), add_special_tokens=False).ids
    ends = ends_at(sizes[np.array(ids, dtype=np.int64)], [len(p.encode()) + 1 for p in parts])
    if ends is None:
        return [len(e) for e in encode_apart(tokenizer, [f" {p}" for p in parts])]
    return np.diff(ends, prepend=0).tolist()


def frequent_pieces(docs: DataFrame, text_col: str, most: int = FREQUENT) -> list[str]:
    """The most frequent pieces of all texts; each task reports a bounded summary of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches, SLICE):
            for text in texts(batch.column(0)):
                seen.update(pieces(text)[1:])
            if len(seen) > 8 * PER_TASK:
                seen = Counter(dict(seen.most_common(PER_TASK)))
        top = [(p, n) for p, n in seen.most_common(PER_TASK) if len(p) <= LONG]
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "piece string, n long")
    total = counted.groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in total.orderBy(F.desc("n"), "piece").limit(most).collect()]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, frequent: int = FREQUENT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""
    top = frequent_pieces(docs, text_col, frequent)
    tokenizer = tokenizer_of(tokenizer_path)
    specials = special_strings(tokenizer)
    top = [p for p in top if not any(s in f" {p}" for s in specials)]
    lengths = dict(zip(top, map(len, encode_apart(tokenizer, [f" {p}" for p in top])))) if top else {}
    shared = docs.sparkSession.sparkContext.broadcast(lengths)  # at most ``frequent`` short pieces

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, first = tokenizer_of(tokenizer_path), shared.value
        sizes = byte_lengths(tok)
        known = _caches.setdefault((tokenizer_path, id(first)), dict(first))

        def whole(text: str) -> int:
            return len(tok.encode(text, add_special_tokens=False).ids)

        for batch in slices(batches, SLICE):
            values = texts(batch.column(1))
            if len(known) > CACHED + len(first):
                known.clear()
                known.update(first)
            look, counts, heads, missed = known.get, [], [], []
            for text in values:
                if any(s in text for s in specials):
                    counts.append(whole(text))
                    missed.append([])
                    continue
                head, *tail = pieces(text)
                found = list(map(look, tail))
                missed.append([p for p, n in zip(tail, found) if n is None] if None in found else [])
                counts.append(sum(filter(None, found)))
                heads.append((len(counts) - 1, head))
            fresh = set(chain.from_iterable(missed))
            led = [p for p in fresh if not p[:1].isspace()]
            known.update(zip(led, led_lengths(tok, sizes, led)))
            apart = [p for p in fresh if p[:1].isspace()]
            known.update(zip(apart, map(len, encode_apart(tok, [f" {p}" for p in apart]))))
            for i, rest in enumerate(missed):
                counts[i] += sum(map(known.__getitem__, rest))
            for (i, _), ids in zip(heads, encode_apart(tok, [h for _, h in heads])):
                counts[i] += len(ids)
            for p in fresh:
                if len(p) > LONG:
                    del known[p]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_bytes": pa.array([len(t.encode()) for t in values], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "over_limit": pa.array([n > limit for n in counts], pa.bool_()),
                }
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA)
