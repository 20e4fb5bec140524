"""Alignment of two tokenizations of the same bytes, and how often their tokens meet over the corpus.

Tokens of both sides that overlap, directly or through others, form a group. Every token points to the overlapping token that
reaches farthest right: the token of the other side over its last byte, or itself where both sides end together and the
second side stands for both. Pointers are doubled (each takes its successor's successor, all at once in numpy) until nothing
changes; then every token points to the last token of its group, which labels it. Byte offsets run on over the texts of a
slice, so thousands of groups of many texts are labelled in the same few rounds.

Counts take two tiers. Pairs of ids are folded in each task to (pair, documents) before their shuffle. The most frequent
pairs (a bounded number) and the best count of each id of the first side (bounded by its vocabulary) are broadcast; what a
document holds besides is joined with the table of counts, and only that is shuffled by pair.

Defined cases: texts that are null, empty, or whose tokens do not spell a space and the text byte by byte have no tokens:
zeros, and an empty ``groups_sha256``. Repeated rows (also of one id) each count as a document and each give a row; a null id
stays null; an empty table gives an empty result; extra columns are ignored, whatever their names; texts of any length are
aligned whole. Ties for an id's highest count are all best. A group of many different ids on both sides holds as many pairs
as their product; they are folded by distinct ids, never dropped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm.tables import keep, slices

FREQUENT = 200_000  # pairs in the broadcast table
SLICE_BYTES = 1 << 20  # text aligned at a time
WIDE = 4_096  # links of a group from which its ids are folded first
FOLD = 4_000_000  # pairs that a task folds at a time
CODE = 24  # bits of the second id in a pair's code

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary"

# How the byte-level vocabulary cuts a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[tuple[str, str], tuple] = {}


# --- the two tokenizers ---------------------------------------------------------------------------------------------


def printable_bytes() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level(path: str):
    """(encode many texts, bytes of each id) for a byte-level BPE file.

    Where the file merges in the order of its ids and cuts by ``PATTERN``, its ids come from the faster of two public
    encoders of such vocabularies; else from the file's own library.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, to_byte = spec["model"]["vocab"], printable_bytes()
    spelled = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocab.items() if all(c in to_byte for c in t)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    before = spec.get("pre_tokenizer") or {}
    size = max(max(vocab.values()), *(t["id"] for t in spec.get("added_tokens", [])), 0) + 1
    table = [spelled.get(i, b"") for i in range(size)]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ordered = all(vocab.get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
    if ordered and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
        import tiktoken

        ranks = {spelled[i]: i for t, i in vocab.items() if i in spelled and t not in special}
        fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [fast.encode_ordinary(t) for t in texts], table
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)], table


def piece_level(path: str):
    """(encode many texts, bytes of each id) for a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), table


def both(a_path: str, b_path: str) -> tuple:
    """Encoders, byte tables, lengths and printed ids of both sides, loaded once a worker."""
    if (a_path, b_path) not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per Spark task
        (a, a_bytes), (b, b_bytes) = byte_level(a_path), piece_level(b_path)
        sizes = [np.array([len(x) for x in t]) for t in (a_bytes, b_bytes)]
        printed = [f"{i}{mark}" for n, marks in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for mark in marks for i in range(n)]
        _loaded[a_path, b_path] = (a, b, a_bytes, b_bytes, *sizes, printed)
    return _loaded[a_path, b_path]


# --- alignment of a slice -------------------------------------------------------------------------------------------


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, numbered from the left; the ends are byte offsets over the same bytes."""
    n = len(b_end)
    over = np.searchsorted(a_end, b_end)  # the first side's token over the last byte of each of the second's
    at_b = np.where(a_end[over] > b_end, n + over, np.arange(n)) if n else np.empty(0, np.int64)
    points = np.concatenate([at_b, np.searchsorted(b_end, a_end)])
    while True:
        further = points[points]
        if np.array_equal(further, points):
            break
        points = further
    last = points[:n] == np.arange(n)
    number = np.cumsum(last) - 1
    labels = number[points]
    return labels[n:], labels[:n]


def fold_links(doc: np.ndarray, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair code, links) for the distinct linked pairs of each document; ``doc`` is given by group."""
    n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE
    each = np.where(wide, 0, n_b)[in_a]
    left = np.repeat(np.arange(len(a)), each)
    nth = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    codes = a[left] << CODE | b[from_b[in_a[left]] + nth]
    owner, times = doc[in_a[left]], np.ones(len(left), np.int64)
    for g in np.flatnonzero(wide).tolist():
        x, nx = np.unique(a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
        y, ny = np.unique(b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
        codes = np.append(codes, (x[:, None] << CODE | y[None, :]).ravel())
        times = np.append(times, (nx[:, None] * ny[None, :]).ravel())
        owner = np.append(owner, np.full(len(x) * len(y), doc[g]))
    order = np.lexsort((codes, owner)) if wide.any() else np.argsort(owner << 48 | codes)
    codes, owner, times = codes[order], owner[order], times[order]
    first = np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])) if len(codes) else np.empty(0, bool)
    at = np.flatnonzero(first)
    return owner[at], codes[at], np.add.reduceat(times, at) if len(at) else times


def pack_pairs(codes: np.ndarray, times: np.ndarray) -> bytes:
    return pa.compress(np.diff(codes, prepend=0).astype("<i8").tobytes() + times.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def unpack_pairs(n: int, blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both_ = np.frombuffer(pa.decompress(blob, decompressed_size=16 * n, codec="zstd", asbytes=True), "<i8")
    return np.cumsum(both_[:n]), both_[n:]


def align_slice(texts: list[str], sides: tuple) -> list[tuple]:
    """For each text: tokens of both sides, groups, links, digest of the groups, and its distinct pairs, packed."""
    encode_a, encode_b, a_bytes, b_bytes, a_size, b_size, printed = sides
    led = [" " + t for t in texts]
    a_ids, b_ids = encode_a(led), encode_b(texts)
    usable = []
    for k, (text, x, y) in enumerate(zip(led, a_ids, b_ids)):
        data = text.encode()
        if len(data) > 1 and b"".join(map(a_bytes.__getitem__, x)) == data == b"".join(map(b_bytes.__getitem__, y)):
            usable.append(k)
    out: list[tuple] = [(0, 0, 0, 0, "", 0, None)] * len(texts)
    if not usable:
        return out
    per_a, per_b = (np.array([len(ids[k]) for k in usable]) for ids in (a_ids, b_ids))
    a, b = (np.concatenate([np.array(ids[k], np.int64) for k in usable]) for ids in (a_ids, b_ids))
    in_a, in_b = groups(np.cumsum(a_size[a]), np.cumsum(b_size[b]))
    n = int(in_b[-1]) + 1
    n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    doc = np.empty(n, np.int64)
    doc[in_b] = np.repeat(np.arange(len(usable)), per_b)
    n_groups = np.bincount(doc, minlength=len(usable))
    links = n_a * n_b
    n_links = np.add.reduceat(links, np.cumsum(n_groups) - n_groups)
    # printed order: the first side's tokens of a group, then the second's, each with the sign that follows it
    last_a, last_b = np.append(in_a[1:] != in_a[:-1], True), np.append(in_b[1:] != in_b[:-1], True)
    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[in_a]] = a + len(a_bytes) * last_a
    shown[np.arange(len(b)) + np.cumsum(n_a)[in_b]] = 2 * len(a_bytes) + b + len(b_bytes) * last_b
    owner, codes, times = fold_links(doc, a, b, in_a, in_b, n)
    cuts = np.searchsorted(owner, np.arange(len(usable) + 1))
    ends = np.cumsum(per_a + per_b)
    for j, k in enumerate(usable):
        text = "".join(map(printed.__getitem__, shown[ends[j] - per_a[j] - per_b[j] : ends[j]].tolist()))[:-1]
        mine = slice(cuts[j], cuts[j + 1])
        out[k] = (
            int(per_a[j]), int(per_b[j]), int(n_groups[j]), int(n_links[j]), hashlib.sha256(text.encode()).hexdigest(),
            int(cuts[j + 1] - cuts[j]), pack_pairs(codes[mine], times[mine]),
        )
    return out


# --- the operator ---------------------------------------------------------------------------------------------------


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = both(a_path, b_path)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        for batch in slices(batches, 512):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            rows, at = [], 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= SLICE_BYTES:
                    size += len(texts[end])
                    end += 1
                rows += align_slice(texts[at:end], sides)
                at = end
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, n, pair``: in how many documents each pair is linked, folded in each task before the shuffle."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def folded() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.append(unpack_pairs(n, blob)[0])
                size += n
                if size > FOLD:
                    yield folded()
                    waiting, size = [], 0
        if size:
            yield folded()

    parts = rows.where("n_pairs > 0").select("n_pairs", "pairs").mapInArrow(fold, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", CODE))


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``."""
    spark = docs.sparkSession
    rows = keep(aligned(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = keep(pair_counts(rows), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    top = best.collect()  # one row for each id of a vocabulary
    peaks = np.zeros(1 + max((r["a"] for r in top), default=0), np.int64)
    for r in top:
        peaks[r["a"]] = r["most"]
    known = counts.orderBy(F.desc("n"), "pair").limit(frequent).select("pair", "n").toArrow()
    pair, n = known["pair"].to_numpy(), known["n"].to_numpy()
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order], n[order], peaks))

    def resolve(n_pairs: int, blob: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, links and counts of a document's pairs; a count of zero is not in the broadcast table."""
        codes, times = unpack_pairs(n_pairs, blob)
        table, value, _ = shared.value
        if not len(codes) or not len(table):
            return codes, times, np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return codes, times, np.where(table[at] == codes, value[at], 0)

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for n_pairs, blob in zip(batch.column("n_pairs").to_pylist(), batch.column("pairs").to_pylist()):
                codes, times, found = resolve(n_pairs, blob)
                most = shared.value[2][codes >> CODE]
                sums.append((int(times[(found == most) & (found > 0)].sum()), int((times * found).sum())))
            best_, total = zip(*sums) if sums else ((), ())
            plain = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "best", "total"]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(best_, pa.int64()), pa.array(total, pa.int64())], names)

    def misses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n_pairs, blob in zip(batch.column("row").to_pylist(), batch.column("n_pairs").to_pylist(), batch.column("pairs").to_pylist()):
                codes, times, found = resolve(n_pairs, blob)
                left = found == 0
                if left.any():
                    k = int(left.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([row] * k, pa.int64()), pa.array(codes[left]), pa.array(times[left])], ["row", "pair", "times"])

    first = rows.mapInArrow(hits, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long")
    rare = rows.where("n_pairs > 0").select("row", "n_pairs", "pairs").mapInArrow(misses, "row long, pair long, times long")
    graded = counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    rest = rare.join(graded, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_total")
    )
    return first.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("rare_total", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
