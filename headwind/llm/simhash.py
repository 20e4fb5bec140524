"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint is the bitwise majority over the hashes of a text's word shingles. Fingerprints within three bits are
linked, and documents that links connect form a component.

The 64 bits are grouped so that correlated bits share a cell; cells form partitions. If the thresholds of ``m``
partitions sum to ``3 - m + 1``, two fingerprints within three bits are within the threshold of at least one partition
(-1 means that the partition is not probed). Every fingerprint has thresholds of its own, allotted by dynamic programming
on the candidates it would meet, estimated from exact histograms of all fingerprints over the four 16-bit cells (at most
4 x 65,536 counts, so the broadcast is bounded). A common cell is thus avoided where another way is cheaper. Whether the
cells serve one by one (four partitions) or two by two is decided by the same estimate.

Equal fingerprints are one class. Classes that meet under a key are compared in groups of at most about ``2 * BLOCK``:
crowded keys are cut into blocks, and each pair of blocks is a group. A group yields a star of links for each of its own
components, never all its pairs.

Defined cases: a null text or one without words has fingerprint zero and is linked like any other; fewer words than a
shingle give one shingle of all words; repeated rows each give a row; a null id takes part but never names a component
unless all ids of a component are null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm.components import components
from headwind.llm.tables import fresh_name, keep, slices, texts

SEED = 42
BITS = 64
RADIUS = 3
CELLS, CELL_BITS = 4, 16
BLOCK = 1_024
SLICE = 128
PROBE_COST, CANDIDATE_COST = 1.0, 0.05  # a shuffled row against a comparison inside a group


def fingerprint(text: str, words: int = 3) -> int:
    """Bit ``i`` is set if it is set in more than half of the shingles' hashes."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65_536):
        pairs = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in pairs], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""
    return marked(docs, id_col, text_col, words, "doc_id long, fp long")


def marked(docs: DataFrame, id_col: str, text_col: str, words: int, schema: str = "doc_id long, fp long, digest binary") -> DataFrame:
    """``doc_id, fp`` and, where the schema asks for it, ``digest``: the SHA-256 of the text."""
    digests = "digest" in schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            values = texts(batch.column(1))
            found = np.array([fingerprint(t, words) for t in values], dtype=np.uint64).view(np.int64)
            more = {"digest": pa.array([hashlib.sha256(t.encode()).digest() for t in values], pa.binary())} if digests else {}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(found), **more})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(classes: DataFrame) -> np.ndarray:
    """An order of the 64 bits in which each cell holds bits that are correlated over all classes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            together += bits.T @ bits
            n += len(bits)
        counts = np.append(together.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(counts))), "n": pa.array(counts)})

    # 4,097 counts for each task, folded before they are collected
    counts = np.zeros(BITS * BITS + 1)
    for row in classes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]
    n, both = counts[-1], counts[:-1].reshape(BITS, BITS)
    if n < 2:
        return np.arange(BITS)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, -1.0)
    left, order = set(range(BITS)), []
    for _ in range(CELLS):
        inside = sorted(left)
        lead = max(inside, key=lambda b: (max((tie[b, c] for c in inside), default=0.0), -b))
        cell = [lead]
        left.discard(lead)
        while len(cell) < CELL_BITS:
            best = max(sorted(left), key=lambda b: (tie[b, cell].mean(), -b))
            cell.append(best)
            left.discard(best)
        order += cell
    return np.array(order)


def reorder(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fingerprints with their bits in the given order, as unsigned longs."""
    return np.ascontiguousarray(np.packbits(bits_of(fp)[:, order], axis=1, bitorder="little")).view("<u8").ravel().astype(np.uint64)


def cell_values(moved: np.ndarray) -> np.ndarray:
    """The four cells of reordered fingerprints, one column each."""
    return np.stack([((moved >> np.uint64(CELL_BITS * c)) & np.uint64(0xFFFF)).astype(np.int64) for c in range(CELLS)], axis=1)


def masks(width: int, distance: int) -> np.ndarray:
    """All words of ``width`` bits with exactly ``distance`` bits set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), distance)], dtype=np.uint64)


class Plan:
    """How fingerprints are probed: the order of bits, the partitions and the expected candidates."""

    def __init__(self, order: np.ndarray, histogram: np.ndarray, n: int):
        self.order, self.n = order, n
        # near[c][d][v]: fingerprints whose cell c differs from v in exactly d bits
        near = np.zeros((CELLS, RADIUS + 1, 1 << CELL_BITS), dtype=np.float32)
        values = np.arange(1 << CELL_BITS, dtype=np.int64)
        for c in range(CELLS):
            for d in range(RADIUS + 1):
                for mask in masks(CELL_BITS, d):
                    near[c, d] += histogram[c][values ^ int(mask)]
        self.near = near
        costs = {}
        for parts in (4, 2):
            self.parts = parts
            # mean cost over a grid of the histogram's own values is what a random fingerprint would pay
            if n:
                seen = [np.repeat(values, np.minimum(histogram[c], 8).astype(np.int64))[:: max(1, int(np.minimum(histogram[c], 8).sum()) // 4_096)] for c in range(CELLS)]
                size = min(map(len, seen))
                cells = np.stack([s[:size] for s in seen], axis=1)
                costs[parts] = float(self.allot(cells)[1].mean()) if size else 0.0
            else:
                costs[parts] = 0.0
        self.parts = 4 if costs[4] <= costs[2] else 2

    @property
    def width(self) -> int:
        return BITS // self.parts

    def expected(self, cells: np.ndarray) -> np.ndarray:
        """Candidates within distance 0..3 in each partition: (rows, parts, 4)."""
        exact = np.stack([self.near[c][:, cells[:, c]].T for c in range(CELLS)], axis=1)
        if self.parts == CELLS:
            return np.cumsum(exact, axis=2)
        pairs = []
        for a, b in ((0, 1), (2, 3)):
            joint = np.zeros((len(cells), RADIUS + 1))
            for d in range(RADIUS + 1):
                for i in range(d + 1):
                    joint[:, d] += exact[:, a, i] * exact[:, b, d - i] / max(self.n, 1)
            pairs.append(np.cumsum(joint, axis=1))
        return np.stack(pairs, axis=1)

    def allot(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds from -1 to 3 for each partition, summing to ``RADIUS - parts + 1``, of least estimated cost."""
        probes = np.cumsum([len(masks(self.width, d)) for d in range(RADIUS + 1)])
        price = PROBE_COST * probes[None, None, :] + CANDIDATE_COST * self.expected(cells)
        price = np.concatenate([np.zeros((*price.shape[:2], 1)), price], axis=2)  # choice k stands for threshold k - 1
        goal = RADIUS + 1  # the choices sum to RADIUS - parts + 1 + parts
        best = np.full((len(cells), goal + 1), np.inf)
        best[:, 0] = 0.0
        picks = []
        for part in range(self.parts):
            fresh, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
            for total in range(goal + 1):
                for k in range(min(total, RADIUS + 1) + 1):
                    cost = best[:, total - k] + price[:, part, k]
                    better = cost < fresh[:, total]
                    fresh[better, total] = cost[better]
                    pick[better, total] = k
            best = fresh
            picks.append(pick)
        out, total = np.zeros((len(cells), self.parts), np.int64), np.full(len(cells), goal)
        for part in range(self.parts - 1, -1, -1):
            out[:, part] = picks[part][np.arange(len(cells)), total] - 1
            total = total - out[:, part] - 1
        return out, best[:, goal]


def make_plan(classes: DataFrame) -> Plan:
    order = grouped_bits(classes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((CELLS, 1 << CELL_BITS), np.int64)
        for batch in batches:
            cells = cell_values(reorder(batch.column(0).to_numpy().view(np.uint64), order))
            for c in range(CELLS):
                counts[c] += np.bincount(cells[:, c], minlength=1 << CELL_BITS)
        cell, value = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "value": pa.array(value), "n": pa.array(counts[cell, value])})

    histogram = np.zeros((CELLS, 1 << CELL_BITS))
    counted = classes.select("fp").mapInArrow(run, "cell long, value long, n long").groupBy("cell", "value").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most 4 x 65,536 counts
    histogram[found["cell"].to_numpy(), found["value"].to_numpy()] = found["n"].to_numpy()
    return Plan(order, histogram, int(histogram[0].sum()))


def probes(classes: DataFrame, plan: Plan) -> DataFrame:
    """``part, key, fp``: each class under its own key of every partition, and under the keys it probes."""
    shared = classes.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        width = plan.width
        field = np.uint64((1 << width) - 1)
        flips = [masks(width, d) for d in range(RADIUS + 1)]
        for batch in slices(batches, 4_096):
            fp = batch.column(0).to_numpy()
            moved = reorder(fp.view(np.uint64), plan.order)
            limits = plan.allot(cell_values(moved))[0]
            for part in range(plan.parts):
                own = (moved >> np.uint64(width * part)) & field
                for d in range(RADIUS + 1):
                    at = np.arange(len(fp)) if d == 0 else np.flatnonzero(limits[:, part] >= d)
                    if not len(at):
                        continue
                    for mask in np.array_split(flips[d], max(1, len(at) * len(flips[d]) // 200_000)):
                        key = (own[at][:, None] ^ mask[None, :]).ravel().view(np.int64)
                        yield pa.RecordBatch.from_pydict(
                            {"part": pa.array(np.full(len(key), part, np.int32)), "key": pa.array(key), "fp": pa.array(np.repeat(fp[at], len(mask)))}
                        )

    return classes.select("fp").mapInArrow(run, "part int, key long, fp long")


def group_links(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group: for each group, links from its members to the first member of their component in it."""
    n = len(fp)
    bits = fp.view(np.uint64)
    edge = np.flatnonzero(np.diff(group)) + 1
    starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    label = np.arange(n)
    small = np.repeat((stops - starts) <= 64, stops - starts)
    last = np.repeat(stops, stops - starts)
    left, right = [], []
    for d in range(1, 64):
        at = np.flatnonzero(small & (np.arange(n) + d < last))
        if not len(at):
            break
        hit = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= radius]
        left.append(hit)
        right.append(hit + d)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while len(a):
            low = np.minimum(label[a], label[b])
            if np.array_equal(low, label[a]) and np.array_equal(low, label[b]):
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
    for start, stop in zip(starts, stops):
        if stop - start > 64:
            own = bits[start:stop]
            near = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
            tag = np.arange(stop - start)
            while True:
                fresh = np.where(near, tag[None, :], len(tag)).min(1)
                fresh = fresh[fresh]
                if np.array_equal(fresh, tag):
                    break
                tag = fresh
            label[start:stop] = start + tag
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def links(classes: DataFrame, plan: Plan, block: int = BLOCK) -> DataFrame:
    """``u, v``: verified links that connect the same classes as all links would."""
    rows = probes(classes, plan)
    crowded = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    sized = rows.join(crowded, ["part", "key"], "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = sized.select("part", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keys = ["part", "key", "low", "high"]
    dealt = met.select("part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(arrays: list[np.ndarray]) -> pa.RecordBatch:
            change = np.zeros(len(arrays[0]), bool)
            for a in arrays[:4]:
                change[1:] |= a[1:] != a[:-1]
            u, v = group_links(np.cumsum(change), arrays[4])
            return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy() for k in range(5)])
            if sum(len(h[0]) for h in held) < 20_000:
                continue
            arrays = [np.concatenate(c) for c in zip(*held)]
            # the last group may go on in the next batch
            same = np.all([a == a[-1] for a in arrays[:4]], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield flush([a[:cut] for a in arrays])
            held = [[a[cut:] for a in arrays]]
        if held and len(held[0][0]):
            yield flush([np.concatenate(c) for c in zip(*held)])

    return dealt.mapInArrow(run, "u long, v long")


def class_components(classes: DataFrame) -> DataFrame:
    """``fp, c``: the component of each class of equal fingerprints, named by one of them."""
    named = components(links(classes, make_plan(classes)))
    joined = classes.join(named.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.select(*classes.columns, F.coalesce("component", "fp").alias("c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    prints = keep(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = keep(class_components(classes), "class-components")
    first = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = keep(joined.join(first, "c").select("fp", "component_id"), "class-ids")
    out = prints.join(ids, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row of each component: the one with the smallest id (known ids first), then the smallest digest of its text.

    Rows are told apart by id and text together, so another text of a repeated id is judged on its own, and rows without an
    id count like others. Rows that agree in both are one: the smallest of them stays. Texts are shuffled once.
    """
    prints = keep(marked(docs, id_col, text_col, words), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    classes = keep(prints.groupBy("fp").agg(F.min(row).alias("lead")), "classes")
    leads = class_components(classes).groupBy("c").agg(F.min("lead").alias("lead")).select("lead.doc_id", "lead.digest")
    again = prints.groupBy("doc_id", "digest").agg((F.count("*") > 1).alias("again"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    lead, digest, more, mine = (fresh_name(docs, n) for n in ("lead", "digest", "again", "mine"))
    leaders = leads.alias("a").join(again.alias("b"), same).select(
        F.col("a.doc_id").alias(lead), F.col("a.digest").alias(digest), F.col("again").alias(more)
    )
    leaders = keep(leaders, "leaders")
    own = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"), 256))
    keyed = docs.withColumn(mine, own)
    # a shuffle at every size: the rows that stay grow with the input, and so may not be sent to every task
    kept = keyed.join(leaders.hint("merge"), keyed[f"`{id_col}`"].cast("long").eqNullSafe(leaders[lead]) & (keyed[mine] == leaders[digest]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.where(~F.col(more)).select(*columns)
    twice = kept.where(F.col(more)).groupBy(lead, digest).agg(F.min(F.struct(*columns)).alias(mine)).select(f"{mine}.*")
    return once.unionByName(twice)
