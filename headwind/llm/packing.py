"""Hierarchical best-fit packing of tokenized documents into sequences.

Each task packs its own pieces best-fit, longest first. Bins that are (nearly) full are final. The underfull ones become
items themselves: groups of tasks are merged as a tree, eight to one, each group packing its underfull bins best-fit
again, until one group is left. A group holds about ``GROUP`` bins at most, so no task grows with the input; where more
bins are left than that, rounds over ever other groups go on until two in a row save no bin. Numbers and lengths travel,
never tokens.

Defined cases: a null or empty text is one piece that holds only the end id; repeated rows (also of one id) are packed
each on its own and keep the order of their pieces; an empty table gives an empty result; extra columns are ignored.
Texts of any length are cut into pieces of ``CAPACITY`` ids, the last of which may be shorter. Equal lengths are packed
in the order of the task's rows; a piece goes to the bin with the least room that still takes it, the newest of equals.
"""

from __future__ import annotations

import json
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm.alignment import printable_bytes
from headwind.llm.tables import keep, slices, texts
from headwind.llm.token_counts import byte_lengths, encode_apart, ends_at, special_strings, tokenizer_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CAPACITY = 4096
END_ID = 1
FULL = 8  # a bin with at most this much room is nearly full
FAN_IN = 8
GROUP = 200_000  # bins that meet in one task at most, on average
LOCAL = 50_000  # pieces that a task packs at a time
MARKS = "".join(c for c in string.punctuation if c != "'")  # an apostrophe may start a piece of its own
NEAR = 30_000  # words met first, and so the frequent ones, in a small table that stays
CACHED = 800_000  # other words that a worker remembers before it starts anew
SLICE = 128
LONG = 64

ODD = "\x1c\x1d\x1e\x1f"  # white space to Python, not to the tokenizer
_caches: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_plain: dict[str, PlainWords] = {}


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: ``doc_id, piece, start, length, ids_crc32``.

    The tokenizer drops white space and never joins over it, so words are encoded once per worker and looked up.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(tokenizer_path)
        apart = [*ODD, *special_strings(tok)]
        sizes = byte_lengths(tok)
        near, far = _caches.setdefault(tokenizer_path, ({}, {}))
        plain = _plain.get(tokenizer_path) or _plain.setdefault(tokenizer_path, PlainWords(tok))
        end = np.array([END_ID], dtype="<u4").tobytes()

        def whole(text: str) -> bytes:
            return np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        for batch in slices(batches, SLICE):
            values = texts(batch.column(1))
            if len(far) > CACHED:
                far.clear()
            cut, gaps, fresh = [], [], {}
            for text in values:
                gap: list[tuple[int, str]] = []
                if any(s in text for s in apart):
                    found = None
                else:
                    words = text.split()
                    found = list(map(near.get, words))
                    if None in found:
                        for i in [i for i, ids in enumerate(found) if ids is None]:
                            ids = found[i] = far.get(words[i])
                            if ids is None:
                                gap.append((i, words[i]))
                cut.append(found)
                gaps.append(gap)
                fresh.update(dict.fromkeys(w for _, w in gap))
            _learn(tok, sizes, far, fresh, plain)
            doc, piece, start, length, crc = [], [], [], [], []
            for key, text, found, gap in zip(batch.column(0).to_pylist(), values, cut, gaps):
                for i, w in gap:
                    found[i] = fresh[w]
                ids = (whole(text) if found is None else b"".join(found)) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    doc.append(key)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            for w, ids in fresh.items():
                if len(w) <= LONG:
                    (near if len(near) < NEAR else far)[w] = ids
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, PIECES)


_PLAIN = {*range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC2, 0xCA)}  # bytes of lower-case Latin letters
_LAST = bytes(b - 0x20 if 0x61 <= b <= 0x7A else b - 0x80 if 0x80 <= b < 0xC0 else b for b in range(256))


class PlainWords:
    """Ids of lower-case Latin words by a merge table over bytes.

    The vocabulary tells a word's last byte from the same byte inside a word. Here the last byte takes a code that such words
    do not use (a capital, or a control byte), so that a public byte-pair encoder can merge the word in one call. Ids of
    merged tokens ascend in the order of the merges, so they serve as ranks. Other vocabularies are left to their own library.
    """

    def __init__(self, tokenizer):
        import tiktoken

        model = json.loads(tokenizer.to_str())["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [vocab.get(x + y, -1) for x, y in merges]
        self.encode = None
        if not end or any(p >= q for p, q in zip(order, order[1:])):
            return
        to_byte, ranks = printable_bytes(), {}
        for token, i in vocab.items():
            word = token.removesuffix(end)
            if all(c in to_byte for c in word):
                data = bytes(map(to_byte.__getitem__, word))
                if data and _PLAIN.issuperset(data) and (word == token or data[-1] < 0xC2):  # no word ends in a first byte
                    ranks[data if word == token else data[:-1] + _LAST[data[-1] :][:1]] = i
        self.encode = tiktoken.Encoding("plain-words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, word: str) -> bytes:
        data = word.encode()
        return array("I", self.encode(data[:-1] + _LAST[data[-1] :][:1])).tobytes()


def _learn(tokenizer, sizes: np.ndarray, known: dict[str, bytes], fresh: dict[str, bytes], plain: PlainWords) -> None:
    """Fill in the ids of new words. Plain letters and the marks after them are put together from the two, in lower
    case, as the tokenizer itself takes them apart; other words are encoded as they stand."""
    wanted = {}
    for w in fresh:
        core = w.rstrip(MARKS)
        mark = w[len(core) :]
        low = core.lower()
        if plain.encode and low.isalpha() and (low.isascii() or (len(low) == len(core) and max(core) < "\u0250")):
            ids = known.get(low)
            if ids is None:
                ids = plain.ids(low)
                if len(low) <= LONG:
                    known[low] = ids
            if mark:
                after = known.get(mark)
                if after is None:
                    after = word_ids(tokenizer, sizes, [mark])[0]
                    if len(mark) <= LONG:
                        known[mark] = after
                ids += after
            fresh[w] = ids
        else:
            wanted[w] = None
    fresh.update(zip(wanted, word_ids(tokenizer, sizes, list(wanted))))


def word_ids(tokenizer, sizes: np.ndarray, words: list[str]) -> list[bytes]:
    """The ids of each word as bytes; encoded together, with a space between them, and cut by the bytes of their tokens."""
    if not words:
        return []
    joined = " ".join(words)
    parts = words if not tokenizer.normalizer else tokenizer.normalizer.normalize_str(joined).split(" ")
    ids = np.array(tokenizer.encode(joined, add_special_tokens=False).ids, dtype="<u4")
    ends = ends_at(sizes[ids], [len(p.encode()) for p in parts]) if len(parts) == len(words) else None
    if ends is None:
        return [own.astype("<u4").tobytes() for own in encode_apart(tokenizer, words)]
    raw = ids.tobytes()
    cuts = [0, *(4 * ends).tolist()]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item, longest first, each into the bin with the least room that takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms, count = 0, 0  # bit r: some bin has room r
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            own, room, count = count, capacity, count + 1
        bins[i], offsets[i] = own, capacity - room
        left = room - size
        if left:
            if not open_[left]:
                rooms |= 1 << left
            open_[left].append(own)
    return bins, offsets


def _pack_locally(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces with the bin they got in their task and their offset there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33  # a task rereads the same rows when it is repeated

        def packed(rows: pa.Table, base: int) -> tuple[pa.Table, int]:
            bins, offsets = best_fit(rows.column("length").to_numpy(), capacity)
            out = rows.append_column("bin", pa.array(bins + base)).append_column("at", pa.array(offsets))
            return out, base + (int(bins.max()) + 1 if len(bins) else 0)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LOCAL:
                out, first = packed(pa.Table.from_batches(held), first)
                held = []
                yield from out.to_batches()
        if held:
            yield from packed(pa.Table.from_batches(held), first)[0].to_batches()

    return pieces.mapInArrow(run, f"{PIECES}, bin long, at long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, full: int = FULL, group: int = GROUP) -> DataFrame:
    """Each piece with its ``sequence_id`` and its ``offset`` there."""
    placed = keep(_pack_locally(pieces, capacity), "packed")
    sizes = placed.groupBy("bin").agg(F.sum("length").alias("length"))
    underfull = keep(sizes.where(F.col("length") < capacity - full), "underfull")
    n = underfull.count()
    tasks = max(1, placed.rdd.getNumPartitions()) if n else 0
    where = underfull.select(F.col("bin").alias("bin0"), "bin", F.lit(0).cast("long").alias("shift"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "bin"], ascending=[False, True])
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity)
        lead = np.full(int(bins.max()) + 1, -1, np.int64)
        seen, at = np.unique(bins, return_index=True)
        lead[seen] = pdf["bin"].to_numpy()[at]  # a merged bin keeps the name of one of its bins
        return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "to": lead[bins], "by": offsets, "length": pdf["length"].to_numpy()})

    turn, idle = 0, 0
    while n > 1:
        tasks = max(-(-tasks // FAN_IN), -(-n // group))
        dealt = underfull.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(tasks)))
        moves = keep(dealt.groupBy("g").applyInPandas(merge, "bin long, to long, by long, length long"), "moves")
        where = where.join(moves.select("bin", "to", "by"), "bin", "left").select(
            "bin0", F.coalesce("to", "bin").alias("bin"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")
        )
        where = keep(where, "where")
        sizes = moves.groupBy(F.col("to").alias("bin")).agg(F.sum("length").alias("length"))
        underfull = keep(sizes.where(F.col("length") < capacity - full), "underfull")
        before, n = n, underfull.count()
        idle = idle + 1 if n == before else 0
        turn += 1
        if tasks == 1 or idle == 2:
            break
    out = placed.join(where.withColumnRenamed("bin", "to"), placed["bin"] == where["bin0"], "left")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack all of ``docs``."""
    return pack(keep(encoded(docs, tokenizer_path, id_col, text_col, capacity), "pieces"), capacity)
