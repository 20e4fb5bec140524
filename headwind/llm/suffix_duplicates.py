"""Passages that an earlier document already holds, found by sorting suffixes.

A byte goes if a string of ``depth`` bytes that covers it also starts in a document with a smaller id. Sorting every suffix
of the corpus in one order would shuffle each byte many times over, so only what can match is sorted, and in parts:

1. Texts that are equal as a whole are one text, under the smallest of their ids. Distinct texts are dealt into slices of a
   few MB and written once, bucketed by slice; later steps read them without a further shuffle.
2. Every window of ``depth`` bytes has an anchor, the least hash of the short strings inside it, so equal windows have equal
   anchors. A slice reports each anchor once; anchors of one document only are let go, with all their windows.
3. Neighbouring windows of one living anchor are cut out as one segment and sent to the anchor's part, each distinct segment
   once a slice (its other documents are covered whole). The windows of an anchor that lives in very many slices are dealt by
   their own hash instead, so no part grows with a common line.
4. Each part sorts the suffixes of its segments in two stages (``suffix_sort``), compares neighbours, and reads off for each
   class of equal windows the smallest id that holds it.
5. What is covered goes back to its slice, where spans are joined and the rest is hashed.

Defined cases: a null text is empty; texts shorter than ``depth`` lose nothing; a null id counts as larger than every other
and null ids do not count against each other, nor do rows of one id; repeated rows each give a row; an empty table gives an
empty result; extra columns are ignored, whatever their names. Hashes only choose what is sorted and where: equality is
decided on bytes (for whole texts by SHA-256). No row, window or partner is dropped at any size.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwind.llm.suffix_sort import common_prefixes, suffix_order
from headwind.llm.tables import keep
from headwind.session import scratch_path, shuffle_width

DEPTH = 50
ANCHOR = 24  # bytes of an anchor string, at most half the depth and a little
SLICE = 4 << 20  # bytes of text in a slice
BLOCK = 256 << 10  # bytes hashed at a time
PART = 3 << 20  # bytes of segments sorted at a time, about
SHARE = 8 << 20  # bytes of anchors compared at a time, about
RUN = 128  # windows in a segment at most
HOT = 4_096  # an anchor in more slices than this is dealt by windows
LAST = (1 << 63) - 1  # stands for a null id

TEXTS = "slice long, digest binary, ord long, n_bytes long, blob binary"
ANCHORS = "bucket long, slice long, once binary, many binary"
LIVING = "slice long, bucket long, common binary, hot binary"
SEGMENTS = "part long, slice long, text binary, length array<int>, doc array<int>, start array<long>, ord array<long>, c_doc array<int>, c_start array<long>, c_stop array<long>"
MARKS = "slice long, doc array<int>, start array<long>, stop array<long>"
REMOVED = "digest binary, ord long, n_removed long, n_spans long, kept_sha256 string"

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_UP = bytes(min(b + 1, 255) for b in range(256))  # UTF-8 has no byte 255, so zero is free for end marks


# --- windows and anchors of texts -----------------------------------------------------------------------------------


def anchor_width(depth: int) -> int:
    return max(8, min(ANCHOR, depth - 8))


def window_anchors(data: bytes, depth: int) -> np.ndarray:
    """For each window of ``depth`` bytes the least hash of its anchor strings."""
    k = anchor_width(depth)
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - k + 1
    h = np.zeros(n, np.uint64)
    for j, off in enumerate(sorted({*range(0, k - 7, 8), k - 8})):
        h = (h ^ word[off : off + n]) * _MIX[j % 4]
        h ^= h >> np.uint64(31)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    wide, span = depth - k + 1, 1
    while 2 * span <= wide:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = wide - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, start, windows) of all runs of neighbouring windows with one anchor; every text has a window."""
    found = []
    step = BLOCK - depth + 1

    def flush(pieces: list[tuple[int, int, bytes]]) -> None:
        sizes = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        least = window_anchors(b"".join(p for _, _, p in pieces), depth)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[starts] = True
        past = ends - depth + 1
        new[past[past < len(least)]] = True  # windows from here on reach into the next piece
        at = np.flatnonzero(new)
        size = np.diff(at, append=len(least))
        piece = np.searchsorted(starts, at, "right") - 1
        whole = at < past[piece]
        at, size, piece = at[whole], size[whole], piece[whole]
        owner = np.array([i for i, _, _ in pieces])[piece]
        start = at - starts[piece] + np.array([o for _, o, _ in pieces])[piece]
        anchor = least[at]
        if size.max() > RUN:
            times = -(-size // RUN)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            anchor, owner, start, size = (np.repeat(v, times) for v in (anchor, owner, start, size))
            start, size = start + nth * RUN, np.minimum(RUN, size - nth * RUN)
        found.append((anchor, owner, start, size))

    pieces, filled = [], 0
    for i, text in enumerate(texts):
        for off in range(0, max(1, len(text) - depth + 1), step):
            piece = text[off : off + BLOCK]
            pieces.append((i, off, piece))
            filled += len(piece)
            if filled >= BLOCK:
                flush(pieces)
                pieces, filled = [], 0
    if pieces:
        flush(pieces)
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(v) for v in zip(*found))


def anchor_codes(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (24 bits at most) over 40 bits of the hash."""
    return (anchor & np.uint64(0xFFFFFF)) % np.uint64(buckets) << np.uint64(40) | anchor >> np.uint64(24)


def five_bytes(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def codes_of(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


# --- steps over Arrow tables ----------------------------------------------------------------------------------------


def pack_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and compressed text; a text that this task has seen under the same or a smaller id is not sent again."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        rows = []
        for ordinal, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes()
            digest = hashlib.sha256(data).digest()
            if seen.get(digest, LAST + 1) > ordinal:
                seen[digest] = ordinal
                rows.append((digest, ordinal, len(data), pa.compress(data, codec="zstd", asbytes=True)))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "ord", "n_bytes", "blob"])


def chosen_texts(texts: pa.Table, chosen: pa.Table) -> pa.Table:
    """The texts of a slice whose id is the smallest of their digest, each once."""
    wanted = set(zip(chosen["digest"].to_pylist(), chosen["ord"].to_pylist()))
    rows = {}
    for at, key in enumerate(zip(texts["digest"].to_pylist(), texts["ord"].to_pylist())):
        if key in wanted:
            rows.setdefault(key, at)
    return texts.take(pa.array(rows.values(), pa.int64())).select(["slice", "digest", "ord", "n_bytes", "blob"])


def opened(table: pa.Table) -> tuple[list[bytes], list[int], list[bytes]]:
    """(digests, ids, texts) of a slice, in the order of ids and digests."""
    rows = sorted(zip(table["ord"].to_pylist(), table["digest"].to_pylist(), range(table.num_rows)))
    sizes, blobs = table["n_bytes"].to_pylist(), table["blob"].to_pylist()
    data = [pa.decompress(blobs[k], sizes[k], codec="zstd", asbytes=True) for _, _, k in rows]
    return [d for _, d, _ in rows], [o for o, _, _ in rows], data


def report_anchors(depth: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, data = opened(table)
        anchor, owner, _, _ = runs(data, depth)
        codes = anchor_codes(anchor, buckets)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        last = np.append(first[1:], len(codes)) - 1
        several, codes = owner[first] != owner[last], codes[first]
        held, cuts = np.unique(codes >> np.uint64(40), return_index=True)
        cuts = np.append(cuts, len(codes))
        parts = [(codes[a:b], several[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        n = len(held)
        return pa.table(
            {
                "bucket": pa.array(held.astype(np.int64)), "slice": pa.array([table["slice"][0].as_py()] * n, pa.int64()),
                "once": pa.array([five_bytes(c[~s]) for c, s in parts], pa.binary()),
                "many": pa.array([five_bytes(c[s]) for c, s in parts], pa.binary()),
            }
        )

    return run


def find_living(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """Anchors of a bucket that two documents have, sent back to the slices that hold them."""
        once = [codes_of(b) for b in table["once"].to_pylist()]
        many = [codes_of(b) for b in table["many"].to_pylist()]
        sizes = [len(o) + len(m) for o, m in zip(once, many)]
        codes = np.concatenate([v for pair in zip(once, many) for v in pair])
        several = np.concatenate([f for o, m in zip(once, many) for f in (np.zeros(len(o), bool), np.ones(len(m), bool))])
        _, group, times = np.unique(codes, return_inverse=True, return_counts=True)
        shared = np.bincount(group, weights=several, minlength=len(times)) > 0
        alive, burning = ((times > 1) | shared)[group], (times > hot)[group]
        ends = np.cumsum(sizes)
        out = []
        for s, b, lo, hi in zip(table["slice"].to_pylist(), table["bucket"].to_pylist(), ends - sizes, ends):
            c, a, h = codes[lo:hi], alive[lo:hi], burning[lo:hi]
            if a.any():
                out.append((s, b, five_bytes(c[a & ~h]), five_bytes(c[a & h])))
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["slice", "bucket", "common", "hot"])

    return run


def living_codes(table: pa.Table, column: str) -> np.ndarray:
    found = [codes_of(b) | np.uint64(k) << np.uint64(40) for k, b in zip(table["bucket"].to_pylist(), table[column].to_pylist())]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[at] == codes


def lists(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def cut_segments(depth: int, buckets: int, parts: int):
    def run(table: pa.Table, living: pa.Table) -> pa.Table:
        _, ids, data = opened(table)
        anchor, owner, start, size = runs(data, depth)
        codes = anchor_codes(anchor, buckets)
        hot = among(codes, living_codes(living, "hot"))
        alive = np.flatnonzero(hot | among(codes, living_codes(living, "common")))
        sent: dict[int, list] = {}
        copies: dict[int, list] = {}
        first: dict[bytes, int] = {}
        part_of = (codes % np.uint64(parts)).astype(np.int64)

        def send(part: int, i: int, at: int, text: bytes) -> None:
            known = first.setdefault(text, ids[i])
            if known < ids[i]:
                copies.setdefault(part, []).append((i, at, at + len(text)))
            else:
                sent.setdefault(part, []).append((i, at, text))

        for i, at, n, part, split in zip(owner[alive].tolist(), start[alive].tolist(), size[alive].tolist(), part_of[alive].tolist(), hot[alive].tolist()):
            text = data[i][at : at + n + depth - 1]
            if split:
                for k in range(n):
                    window = text[k : k + depth]
                    send(zlib.crc32(window) % parts, i, at + k, window)
            else:
                send(part, i, at, text)
        used = sorted({*sent, *copies})
        rows, others = [sent.get(p, []) for p in used], [copies.get(p, []) for p in used]
        return pa.table(
            {
                "part": pa.array(used, pa.int64()), "slice": pa.array([table["slice"][0].as_py()] * len(used) if used else [], pa.int64()),
                "text": pa.array([b"".join(t for _, _, t in r) for r in rows], pa.binary()),
                "length": lists([[len(t) for _, _, t in r] for r in rows], pa.int32()),
                "doc": lists([[i for i, _, _ in r] for r in rows], pa.int32()),
                "start": lists([[a for _, a, _ in r] for r in rows], pa.int64()),
                "ord": lists([[ids[i] for i, _, _ in r] for r in rows], pa.int64()),
                "c_doc": lists([[i for i, _, _ in r] for r in others], pa.int32()),
                "c_start": lists([[a for _, a, _ in r] for r in others], pa.int64()),
                "c_stop": lists([[b for _, _, b in r] for r in others], pa.int64()),
            }
        )

    return run


def covered(texts: list[bytes], least: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, stop) of what windows cover that a segment with a smaller id holds too.

    ``least`` is the smallest id of each of the distinct segments ``texts``.
    """
    sizes = np.array([len(t) for t in texts])
    x = np.frombuffer(b"\0".join(t.translate(_UP) for t in texts) + b"\0", np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    window = np.arange(len(x)) - begin[of] <= sizes[of] - depth
    order = suffix_order(x, depth)
    order = order[window[order]]
    first = np.append(True, common_prefixes(x, order, depth) < depth)
    holder = least[of[order]]
    smallest = np.minimum.reduceat(holder, np.flatnonzero(first))[np.cumsum(first) - 1]
    hit = np.zeros(len(x) + 1, bool)
    hit[order] = smallest < holder
    edges = np.flatnonzero(np.diff(np.append(False, hit).astype(np.int8)))
    at, end = edges[::2], edges[1::2]
    segment = of[at]
    return segment, at - begin[segment], end - begin[segment] + depth - 1


def sort_part(depth: int):
    def run(table: pa.Table) -> pa.Table:
        """What each slice loses by the segments of one part."""
        column = lambda name: [np.asarray(v, np.int64) for v in table[name].to_pylist()]
        known: dict[bytes, int] = {}
        texts, index = [], []
        for blob, sizes in zip(table["text"].to_pylist(), column("length")):
            at = 0
            for n in sizes.tolist():
                text = blob[at : at + n]
                k = known.setdefault(text, len(texts))
                if k == len(texts):
                    texts.append(text)
                index.append(k)
                at += n
        docs, starts, ids = (np.concatenate(column(c)) for c in ("doc", "start", "ord"))
        rows = np.repeat(np.arange(table.num_rows), [len(v) for v in table["length"].to_pylist()])
        found = []
        if texts:
            index, sizes = np.array(index), np.array([len(t) for t in texts])
            least = np.full(len(texts), LAST)
            np.minimum.at(least, index, ids)
            whole = np.flatnonzero(ids > least[index])
            found.append((rows[whole], docs[whole], starts[whole], starts[whole] + sizes[index[whole]]))
            if len(texts) > 1:
                segment, begin, end = covered(texts, least, depth)
                times = np.bincount(segment, minlength=len(texts))
                owners = np.flatnonzero(ids == least[index])
                each = times[index[owners]]
                owners = np.repeat(owners, each)
                nth = np.arange(len(owners)) - np.repeat(np.cumsum(each) - each, each)
                pick = (np.cumsum(times) - times)[index[owners]] + nth
                found.append((rows[owners], docs[owners], starts[owners] + begin[pick], starts[owners] + end[pick]))
        others = [column(c) for c in ("c_doc", "c_start", "c_stop")]
        found.append((np.repeat(np.arange(table.num_rows), [len(v) for v in others[0]]), *(np.concatenate(v) for v in others)))
        row, doc, start, stop = (np.concatenate(v) for v in zip(*found))
        order = np.argsort(row, kind="stable")
        row, doc, start, stop = row[order], doc[order], start[order], stop[order]
        held, cuts = np.unique(row, return_index=True)
        cuts = pa.array(np.append(cuts, len(row)).astype(np.int32))
        slices = np.array(table["slice"].to_pylist(), np.int64)
        listed = lambda v, kind: pa.ListArray.from_arrays(cuts, pa.array(v, kind))
        return pa.table({"slice": pa.array(slices[held]), "doc": listed(doc, pa.int32()), "start": listed(start, pa.int64()), "stop": listed(stop, pa.int64())})

    return run


def remove_marked(table: pa.Table, marks: pa.Table) -> pa.Table:
    """For each text of a slice with marks: bytes and spans removed, and the digest of the rest."""
    digests, ids, data = opened(table)
    flat = lambda name: np.concatenate([np.asarray(v, np.int64) for v in marks[name].to_pylist()] or [np.empty(0, np.int64)])
    doc, start, stop = flat("doc"), flat("start"), flat("stop")
    order = np.argsort(doc, kind="stable")
    doc, start, stop = doc[order], start[order], stop[order]
    held, cuts = np.unique(doc, return_index=True)
    out = []
    for i, a, b in zip(held.tolist(), cuts, np.append(cuts[1:], len(doc))):
        text = np.frombuffer(data[i], np.uint8)
        depth = np.bincount(start[a:b], minlength=len(text) + 1) - np.bincount(stop[a:b], minlength=len(text) + 1)
        gone = np.cumsum(depth)[:-1] > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((digests[i], ids[i], int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
    columns = list(zip(*out)) or [[]] * 5
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "ord", "n_removed", "n_spans", "kept_sha256"])


# --- the operator ---------------------------------------------------------------------------------------------------


def keep_bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets, so that groups by ``by`` need no further shuffle."""
    name = f"suffix_slices_{uuid.uuid4().hex}"
    path = scratch_path(df.sparkSession, "suffix-slices")
    df.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, by).saveAsTable(name)
    return df.sparkSession.table(name)


def slice_of(slices: int) -> Column:
    return F.pmod(F.xxhash64("digest", "ord"), F.lit(slices)).cast("long").alias("slice")


def repeated_spans(distinct: DataFrame, packed: DataFrame, total: int, depth: int, hot: int, slice_bytes: int) -> DataFrame:
    """``REMOVED`` rows for the texts that lose something; ``distinct`` has ``digest, ord`` of those to look at."""
    width = shuffle_width(distinct.sparkSession)
    slices = max(width, -(-total // slice_bytes))
    placed, wanted = packed.select(slice_of(slices), "*"), distinct.select(slice_of(slices), "digest", "ord")
    texts = placed.groupBy("slice").cogroup(wanted.groupBy("slice")).applyInArrow(chosen_texts, TEXTS)
    texts = keep_bucketed(texts, "slice", width)
    buckets = min(1 << 24, max(width, -(-total // (3 * SHARE))))
    reported = texts.groupBy("slice").applyInArrow(report_anchors(depth, buckets), ANCHORS)
    living = keep(reported.groupBy("bucket").applyInArrow(find_living(hot), LIVING), "suffix-anchors")
    count = living.agg(F.sum(F.octet_length("common") + depth * F.octet_length("hot"))).first()[0] or 0
    parts = max(width, count // 5 * (depth + 16) // PART)
    cut = texts.groupBy("slice").cogroup(living.groupBy("slice")).applyInArrow(cut_segments(depth, buckets, parts), SEGMENTS)
    marks = cut.groupBy("part").applyInArrow(sort_part(depth), MARKS)
    return texts.groupBy("slice").cogroup(marks.groupBy("slice")).applyInArrow(remove_marked, REMOVED)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, hot: int = HOT, slice_bytes: int = SLICE
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``; ``depth`` is at least 16."""
    if depth < 16:
        raise ValueError("depth must be at least 16 bytes")
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), data.alias("t"))
    rows = keep(named.select("doc_id", "ord", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes")), "suffix-rows")
    firsts = keep(rows.groupBy("digest", "n_bytes").agg(F.min("ord").alias("ord")), "suffix-firsts")
    long = firsts.where(F.col("n_bytes") >= depth)
    total = long.agg(F.sum("n_bytes")).first()[0]
    first = firsts.select("digest", "ord", F.lit(True).alias("first"))
    if total:
        packed = named.where(F.octet_length("t") >= depth).select("ord", "t").mapInArrow(pack_texts, "digest binary, ord long, n_bytes long, blob binary")
        first = first.join(repeated_spans(long, packed, total, depth, hot, slice_bytes), ["digest", "ord"], "left")
    else:
        first = first.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"))])
    joined = rows.join(first, ["digest", "ord"], "left")
    whole = F.col("first").isNull() & (F.col("n_bytes") >= depth)  # the same text stands in an earlier document
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
