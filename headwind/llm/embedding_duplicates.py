"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many orthonormal directions. Two vectors collide in a projection if each lies in the
window around the other; pairs that collide often enough are verified by their cosine in double precision. Window and
count are calibrated in closed form for a pair exactly at the threshold, the hardest one: its difference, projected, is
close to normal with a known spread, so the number of collisions is close to binomial, and the count asked for is the
largest that keeps the chance of being found at ``RECALL`` or more. Nothing is fitted to the data but the choice of the
projection to sort by: the one that spreads a bounded sample (``FIT`` classes) most.

Classes of equal vectors are cut into slices of about ``SLICE`` along that projection; slices whose ranges lie within a
window of each other meet, each pair in one task, where all projections are counted at once. A pair of slices yields, for
each of its vectors, a number of links and one link that keeps its component together, never the pairs. A crowded range
of values only means more slices.

Defined cases: vectors that take no part (see ``vectors.packed``), among them null ones, get 0 links and a component of
their own; vectors of different lengths never meet; copies count as links; repeated rows each give a row; a null id
names no component unless it is alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from collections.abc import Iterable, Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm.components import components
from headwind.llm.tables import keep
from headwind.llm.vectors import classes_of, component_kind, matrix, packed

THRESHOLD = 0.95
PROJECTIONS = 16
REACH = 2.5  # half a window, in spreads of a projected difference at the threshold
RECALL = 0.999
LEAD = 1.25  # how much wider the leading window is: a pair that misses it is not met at all
SLICE = 4_096
FIT = 2_000
SEED = 7


def directions(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    """Orthonormal directions, one column each."""
    square = np.random.default_rng([SEED, dim]).standard_normal((dim, dim))
    return np.linalg.qr(square)[0][:, : min(dim, count)]


def calibrated(dim: int, threshold: float, count: int = PROJECTIONS) -> tuple[float, int]:
    """Half the window and the least number of collisions that a pair at the threshold reaches with chance ``RECALL``."""
    m = min(dim, count)
    half = REACH * sqrt(max(0.0, 2 - 2 * threshold) / dim) + 1e-9
    hit = erf(REACH / sqrt(2))
    least, sure = m, hit**m
    while sure < RECALL and least > 0:
        least -= 1
        sure += comb(m, least) * hit**least * (1 - hit) ** (m - least)
    return half, least


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _labels(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a bipartite link matrix: a label for each row and each column, shared where linked."""
    n, m = near.shape
    rows, cols = np.arange(n), np.arange(n, n + m)
    while True:
        fresh_cols, fresh_rows = cols.copy(), rows.copy()
        for at in range(0, n, 64):
            part = near[at : at + 64]
            if part.any():
                fresh_rows[at : at + 64] = np.minimum(rows[at : at + 64], np.where(part, cols[None, :], n + m).min(1))
        for at in range(0, n, 64):
            part = near[at : at + 64]
            if part.any():
                np.minimum(fresh_cols, np.where(part, fresh_rows[at : at + 64, None], n + m).min(0), out=fresh_cols)
        if np.array_equal(fresh_rows, rows) and np.array_equal(fresh_cols, cols):
            return rows, cols
        rows, cols = fresh_rows, fresh_cols


def slice_links(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, lead: int) -> np.ndarray:
    """Which vectors of two slices are linked, as a boolean matrix; ``lead`` is the projection to sort by."""
    dim = a.shape[1]
    dirs = directions(dim)
    half, least = calibrated(dim, threshold)
    pa_, pb = (a @ dirs).astype(np.float32), (b @ dirs).astype(np.float32)
    half32 = np.float32(half * (1 + 1e-5) + 1e-6)
    order_a, order_b = np.argsort(pa_[:, lead], kind="stable"), np.argsort(pb[:, lead], kind="stable")
    sorted_b = pb[order_b, lead]
    others = [j for j in range(dirs.shape[1]) if j != lead]
    cols = [np.ascontiguousarray(pb[order_b, j]) for j in others]
    out = np.zeros((len(a), len(b)), bool)
    # only pairs within the widened window of the leading projection are met
    wide = half32 * np.float32(LEAD)
    for at in range(0, len(a), 64):
        rows = order_a[at : at + 64]
        values = pa_[rows, lead]
        lo, hi = np.searchsorted(sorted_b, values.min() - wide), np.searchsorted(sorted_b, values.max() + wide, side="right")
        if hi <= lo:
            continue
        count = (np.abs(values[:, None] - sorted_b[None, lo:hi]) <= half32).view(np.uint8).copy()
        for j, col in zip(others, cols):
            count += (np.abs(pa_[rows, j][:, None] - col[None, lo:hi]) <= half32).view(np.uint8)
        i, k = np.nonzero(count >= least)
        i, k = rows[i], order_b[lo:hi][k]
        for cut in range(0, len(i), 20_000):
            x, y = i[cut : cut + 20_000], k[cut : cut + 20_000]
            out[x, y] = (a[x] * b[y]).sum(1) >= threshold
    if same:
        np.fill_diagonal(out, False)
        out |= out.T
    return out


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, slice_rows: int = SLICE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    kind = component_kind(rows, vec_col)
    vectors = keep(packed(rows, id_col, vec_col), "vectors")
    classes = classes_of(vectors)
    spark = rows.sparkSession
    plans: dict[int, tuple[int, float, np.ndarray]] = {}
    for row in classes.groupBy("dim").agg(F.count("*").alias("n")).collect():  # one row for each vector length
        dim, n = row["dim"], row["n"]
        own = classes.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("vec"), "node").limit(FIT).toArrow()
        seen = unit(matrix(sample["vec"], kind)) @ directions(dim)
        lead = int(np.argmax(seen.std(0)))
        slices = -(-n // slice_rows)
        half = calibrated(dim, threshold)[0]
        bounds = np.zeros(0)
        if slices > 1:
            projected = own.select("vec").mapInArrow(_projector(kind, dim, lead), "p double")
            bounds = np.array(projected.approxQuantile("p", [k / slices for k in range(1, slices)], 0.05 / slices))
        plans[dim] = (lead, half, bounds)
    shared = spark.sparkContext.broadcast(plans)  # one bound for each SLICE rows

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("dim", "low", "high", "second", "node", "n", "vec")}
            for dim, node, n, vec in zip(*(batch.column(k).to_pylist() for k in range(4))):
                lead, half, bounds = shared.value[dim]
                p = float(unit(np.frombuffer(vec, dtype=kind)[None, :])[0] @ directions_of(dim)[:, lead])
                first, last = np.searchsorted(bounds, p, side="left"), np.searchsorted(bounds, p, side="right")
                own = int(first + node % (last - first + 1))  # equal values are spread over their slices
                wide = LEAD * half + 1e-5
                reach = range(int(np.searchsorted(bounds, p - wide, side="left")), int(np.searchsorted(bounds, p + wide, side="right")) + 1)
                for other in reach:
                    for key, value in zip(out, (dim, min(own, other), max(own, other), own > other, node, n, vec)):
                        out[key].append(value)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        second = table["second"].to_numpy()
        a = table.filter(pa.array(~second))
        b = a if low == high else table.filter(pa.array(second))
        out = {"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)}
        if a.num_rows and b.num_rows:
            lead = shared.value[key[0].as_py()][0]
            near = slice_links(unit(matrix(a["vec"], kind)), unit(matrix(b["vec"], kind)), low == high, threshold, lead)
            ids_a, ids_b = a["node"].to_numpy(), b["node"].to_numpy()
            links_a = near @ b["n"].to_numpy()
            links_b = near.T @ a["n"].to_numpy()
            label_a, label_b = _labels(near)
            ids = np.concatenate([ids_a, ids_b])
            hit_a, hit_b = links_a > 0, links_b > 0
            if low == high:
                links_b[:] = 0  # counted once; a vector's two labels, as a row and as a column, are both needed
            out = {
                "node": np.concatenate([ids_a[hit_a], ids_b[hit_b]]), "links": np.concatenate([links_a[hit_a], links_b[hit_b]]).astype(np.int64),
                "to": np.concatenate([ids[label_a[hit_a]], ids[label_b[hit_b]]]),
            }
        return pa.table({k: pa.array(v) for k, v in out.items()})

    dealt = classes.select("dim", "node", "n", "vec").mapInArrow(deal, "dim int, low int, high int, second boolean, node long, n long, vec binary")
    found = keep(dealt.groupBy("dim", "low", "high").applyInArrow(meet, "node long, links long, to long"), "slice-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    told = classes.select("node", "least", "n", "dim", "vec").join(counts, "node", "left").join(named, "node", "left")
    told = keep(told.withColumn("c", F.coalesce("component", "node")), "vector-components")
    first = told.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = told.join(first, "c").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = vectors.where("vec is not null").join(ids, "vec").select("vec_id", "n_links", "component_id")
    alone = vectors.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


_directions: dict[int, np.ndarray] = {}


def directions_of(dim: int) -> np.ndarray:
    if dim not in _directions:
        _directions[dim] = directions(dim)
    return _directions[dim]


def _projector(kind: str, dim: int, lead: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(0), kind)) @ directions_of(dim)[:, lead] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"p": pa.array(x, pa.float64())})

    return run
