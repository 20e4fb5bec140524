"""The embedding operators against brute force."""

import numpy as np
import pytest

pytest.importorskip("headwind.llm")
from headwind.llm import components, embedding_duplicates, neighbours

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, node long, n int, score string, dim int, kept string"


def made(seed=0, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    rows = [c + rng.normal(size=dim) * s for c in centres for s in (0.02, 0.1, 0.2, 0.3)]
    rows += [centres[0] + rng.normal(size=dim) * 0.05 for _ in range(150)]  # a crowded place
    rows += [rows[5]] * 40 + [3 * rows[6], -rows[7]] + list(rng.normal(size=(300, dim)))
    return [r.astype(np.float32).tolist() for r in rows]


ODD = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [1.0, 2.0], [2.0, 1.0], [1e-30] * 24, [1e30] * 24]


@pytest.fixture(scope="module", params=["made", "table", "empty"])
def vectors(request, spark):
    if request.param == "table":
        return spark.read.parquet(f"{SF}/embeddings.parquet")
    values = made() + ODD if request.param == "made" else []
    return spark.createDataFrame([(7 * k % 9_973, v, 0, 1, 1, "s", 3, "k") for k, v in enumerate(values)], SCHEMA)


def usable(vector):
    if not vector or any(x is None for x in vector):
        return None
    x = np.array(vector, dtype=np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def test_near_duplicates(spark, vectors):
    rows = [(r["vec_id"], usable(r["embedding"])) for r in vectors.collect()]
    ids = [i for i, _ in rows]
    unit = [None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) for _, x in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]):
                near[i, j] = near[j, i] = float(unit[i] @ unit[j]) >= 0.95
    label = np.array(ids)
    while n:
        fresh = np.minimum(label, np.where(near, label[None, :], 1 << 40).min(1))
        if (fresh == label).all():
            break
        label = fresh
    want = {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
    got = {}
    for slice_rows in (4_096, 64):
        found = embedding_duplicates.near_duplicates(vectors, slice_rows=slice_rows).collect()
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
        assert len(found) == n and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
        links, all_links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
        assert links <= all_links and links >= 0.99 * all_links
        assert all(got[i][0] <= want[i][0] for i in want)
        assert n == 0 or np.mean([got[i] == want[i] for i in want]) >= 0.98


def test_calibration():
    for dim in (2, 24, 64, 768):
        half, least = embedding_duplicates.calibrated(dim, 0.95)
        assert half > 0 and 0 < least <= min(dim, embedding_duplicates.PROJECTIONS)


def test_nearest(spark, vectors):
    rows = [(r["vec_id"], usable(r["embedding"])) for r in vectors.collect()]
    rows = [(i, x) for i, x in rows if x is not None]
    got = {}
    for r in neighbours.nearest(vectors).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i, x in rows if i % 20 == 0 and sum(len(y) == len(x) for _, y in rows) > 1}
    hit = total = 0
    for i, own in got.items():
        x = dict(rows)[i]
        score = {j: float((y * x).sum()) for j, y in rows if j != i and len(y) == len(x)}
        best = sorted(score, key=lambda j: (-score[j], j))[:20]
        own = sorted(own, key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], rel=1e-12) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hit, total = hit + len({r["vec_id"] for r in own} & set(best)), total + len(best)
    assert hit >= 0.9 * total


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)] + [(1_000, k) for k in range(900, 1_000)]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long")).collect())
    label = {x: x for pair in links for x in pair}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in alone}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("noise", [0.3, 1e-4])
def test_nearest_finds_separate_groups(spark, noise):
    """Hundreds of groups, each of more members than a query asks for, in one shard."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, 32))
    x = np.concatenate([c / np.linalg.norm(c) + noise * rng.normal(size=(24, 32)) / np.sqrt(32) for c in centres])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(len(x))]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(rows).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(got) == list(range(0, len(x), 20))
    hit = 0
    for i, own in got.items():
        score = (x.astype(np.float64) * x[i].astype(np.float64)).sum(1)
        best = [j for j in np.lexsort((np.arange(len(x)), -score)).tolist() if j != i][:20]
        assert len(own) == 20
        hit += len(set(own.values()) & set(best))
    assert hit >= 0.98 * 20 * len(got)


def test_nearest_by_length_too(spark):
    """Vectors of very different lengths: the largest inner products belong to long vectors far away."""
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(3_000, 16)) * rng.lognormal(0, 1, (3_000, 1))).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(rows).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for i, own in got.items():
        score = (x.astype(np.float64) * x[i].astype(np.float64)).sum(1)
        hit += len(own & set([j for j in np.argsort(-score, kind="stable").tolist() if j != i][:20]))
    assert len(got) == 150 and hit >= 0.9 * 20 * len(got)


def test_neighbour_graph_settles(spark):
    """The graph itself is close to the exact one."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(2_500, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(k, 12, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, grp long, g binary")
    edges = {}
    for r in neighbours.descend(points, neighbours.cut_cells(points)[0], 10).collect():
        edges.setdefault(r.u, set()).add(r.v)
    near = x @ x.T
    np.fill_diagonal(near, -9)
    exact = np.argsort(-near, axis=1)[:, :10]
    assert all(len(edges[k]) == 10 for k in range(len(x)))
    assert np.mean([len(edges[k] & set(exact[k].tolist())) for k in range(len(x))]) >= 9
