import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from headwind.operators import naming
from headwind.operators import clustering, decomposition, density, features, pairs, quality, reduction


def cloud(seed=0, copies=0, n=120, d=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(scale=6, size=(4, d))
    x = np.concatenate([centers[i % 4] + rng.normal(size=d) for i in range(n)]).reshape(n, d)
    if copies:
        x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    return x


def points(spark, x, label=None):
    label = label if label is not None else np.zeros(len(x), int)
    data = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(data, "id bigint, x array<double>, cluster int").repartition(4)


def brute_dbscan(x, eps, m):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if label[j] != -1:
                continue
            label[j] = number
            if core[j]:
                stack.extend(k for k in np.nonzero(near[j])[0] if label[k] == -1)
        number += 1
    return label


@pytest.mark.parametrize("seed,copies,eps,m,dims,block", [(0, 0, 1.2, 5, 2, 1024), (1, 60, 0.9, 4, 3, 16), (2, 0, 0.2, 3, 1, 32), (3, 40, 2.5, 5, 2, 8)])
def test_dbscan_equals_brute_force(spark, monkeypatch, seed, copies, eps, m, dims, block):
    for fn in (density.neighbour_counts, density.links):
        monkeypatch.setattr(fn, "__defaults__", (2, block, "grid"))
    x = cloud(seed, copies)
    got = {r.id: r.cluster for r in density.dbscan(points(spark, x), "id", "x", eps, m, dims).collect()}
    assert [got[i] for i in range(len(x))] == list(brute_dbscan(x, eps, m))


@pytest.mark.parametrize("seed,copies,eps,m,d", [(0, 0, 1.2, 5, 3), (1, 60, 0.9, 4, 3), (3, 40, 2.5, 5, 9), (4, 0, 6.0, 5, 30), (5, 0, 0.01, 1, 2)])
def test_dbscan_by_pivots_equals_brute_force(spark, monkeypatch, seed, copies, eps, m, d):
    for fn in (density.neighbour_counts, density.links):
        monkeypatch.setattr(fn, "__defaults__", (2, 24, "grid"))
    x = cloud(seed, copies, d=d)
    got = {r.id: r.cluster for r in density.dbscan(points(spark, x), "id", "x", eps, m, partition="pivots").collect()}
    assert [got[i] for i in range(len(x))] == list(brute_dbscan(x, eps, m))


def test_pivots_meet_few_pairs(spark):
    """Separate groups in forty dimensions: two grid coordinates cannot tell them apart, pivots can."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 40)) * 3
    x = np.concatenate([c + rng.normal(size=(100, 40)) * 0.15 for c in centers])
    assert density.pairs_met(points(spark, x), "id", "x", 1.5) < 0.25


@pytest.mark.parametrize("error", [0.1, 0.3])
def test_sampled_silhouette_is_close(spark, error):
    x = cloud(7, n=900, d=4)
    c = np.arange(len(x)) % 4
    c[3] = 9
    got = quality.silhouette_sampled(points(spark, x, c), "id", "x", "cluster", error)
    assert abs(got - brute_silhouette(x, c)) <= min(4 * error / (1 - error), 0.05)


def test_dbscan_on_grid_ties(spark):
    x = np.array(list(itertools.product(range(6), range(6))), dtype=float)  # many distances equal eps exactly
    got = {r.id: r.cluster for r in density.dbscan(points(spark, x), "id", "x", 1.0, 5).collect()}
    assert [got[i] for i in range(36)] == list(brute_dbscan(x, 1.0, 5))


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 164)]
    hub = [(0, i) for i in range(1, 60)]
    edges = spark.createDataFrame(chain + hub + [(500, 499)], "u bigint, v bigint")
    got = {r.node: r.root for r in density.connected_components(edges).collect()}
    assert {n for n, r in got.items() if r == 100} == set(range(100, 165))
    assert {n for n, r in got.items() if r == 0} == set(range(60)) and got[500] == got[499] == 499


def brute_silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("copies,block", [(0, 1024), (50, 16)])
def test_silhouette_equals_brute_force(spark, copies, block):
    x = cloud(5, copies)
    c = np.arange(len(x)) % 4
    c[3] = 9  # a cluster of one
    got = quality.silhouette(points(spark, x, c), "id", "x", "cluster", block).first()[0]
    assert math.isclose(got, brute_silhouette(x, c), rel_tol=1e-9)


def test_labelings_share_one_pass(spark):
    x = cloud(6)
    df = points(spark, x, np.arange(len(x)) % 4).withColumn("other", F.pmod(F.col("id"), F.lit(3)))
    got = {r.labeling: r.silhouette for r in quality.silhouettes(df, "id", "x", ["cluster", "other"], 32).collect()}
    assert math.isclose(got["cluster"], brute_silhouette(x, np.arange(len(x)) % 4), rel_tol=1e-9)
    assert math.isclose(got["other"], brute_silhouette(x, np.arange(len(x)) % 3), rel_tol=1e-9)


def test_block_pairs_meet_once_and_stay_bounded(spark):
    x = np.zeros((300, 2)) + np.arange(300)[:, None] * 1e-3  # one crowded cell
    folded = pairs.fold_copies(points(spark, x), "id", "x")
    import pandas as pd

    def kernel(a, b, d2, same):
        return pd.DataFrame({"met": [len(a) * (len(a) - 1) // 2 if same else len(a) * len(b)], "rows": [max(len(a), len(b))]})

    got = pairs.map_block_pairs(folded, kernel, "met long, rows long", F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), 2, 32)
    row = got.agg(F.sum("met").alias("met"), F.max("rows").alias("rows"), F.count("*").alias("groups")).first()
    assert row.met == 300 * 299 // 2 and row.rows < 100 and row.groups == 55


def test_kmeans_numbers_are_stable(spark):
    x = cloud(7)
    df = points(spark, x).withColumn("features", array_to_vector("x"))
    a = clustering.fit_kmeans(df, "features", 4, n_init=3)
    b = clustering.fit_kmeans(df.repartition(2), "features", 4, n_init=3)
    assert a.sizes == sorted(a.sizes, reverse=True) and sum(a.sizes) == 120
    assert [round(v, 6) for c in a.centers for v in c] == [round(v, 6) for c in b.centers for v in c]
    counted = {r.cluster: r.n for r in a.label(df).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert [counted[i] for i in range(4)] == a.sizes
    assigned = clustering.assign(points(spark, x), "x", a.centers)
    assert math.isclose(assigned.agg(F.sum("d2")).first()[0], a.cost, rel_tol=1e-9)


def test_cost_falls_and_the_right_k_wins(spark):
    df = points(spark, cloud(8)).withColumn("features", array_to_vector("x"))
    costs = [r.cost for r in clustering.elbow(df, "features", range(2, 6), n_init=3).orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)
    k, table, best = clustering.best_k(df, "id", "features", 5, "silhouette", n_init=3)
    assert k == 4 and table.count() == 4 and len(best.centers) == 4
    with pytest.raises(ValueError):
        clustering.best_k(df, "id", "features", 2, "guess", n_init=1)


def test_merge_order(spark):
    got = [tuple(r) for r in clustering.merge_order(spark, [[0.0], [1.0], [10.0]]).collect()]
    assert got[0] == (1, 0, 1, 1.0, 2)
    assert got[1][1:3] == (2, 3) and math.isclose(got[1][3], math.sqrt(2 * 2 / 3) * 9.5) and got[1][4] == 3


def test_pca_is_centred_with_fixed_signs(spark):
    x = cloud(9) + 100.0
    df = points(spark, x).withColumn("features", array_to_vector("x"))
    got = np.array([r.components for r in decomposition.pca(df, "features", 2).orderBy("id").collect()])
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    basis = vt[:2].T
    basis = basis * np.where(basis[np.abs(basis).argmax(0), [0, 1]] < 0, -1, 1)
    assert np.allclose(got, centred @ basis, atol=1e-8)


def test_truncated_svd_is_not_centred(spark):
    x = cloud(10) + 5.0
    df = points(spark, x).withColumn("features", array_to_vector("x"))
    svd = decomposition.truncated_svd(df, "features", 50)
    _, s, _ = np.linalg.svd(x)
    assert np.allclose(svd.singular_values, s[:2])
    norms = svd.rows.select(F.aggregate(vector_to_array("reduced"), F.lit(0.0), lambda a, v: a + v * v).alias("n")).agg(F.sum("n")).first()[0]
    assert math.isclose(norms, (s[:2] ** 2).sum(), rel_tol=1e-9)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_factors_stay_positive_and_loss_falls(spark, monkeypatch, limit):
    monkeypatch.setattr(decomposition, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(1)
    x = rng.poisson(rng.random((30, 2)) @ rng.random((2, 12)) * 4)
    data = [(i, f"t{j}", int(x[i, j])) for i in range(30) for j in range(12) if x[i, j]]
    got = decomposition.nmf(spark.createDataFrame(data, "id bigint, term string, tf bigint"), "id", "term", "tf", 2, rounds=4)
    assert all(a >= b for a, b in zip(got.losses, got.losses[1:])) and len(got.losses) == 4
    w = np.array([[r.w0, r.w1] for r in got.rows.orderBy("id").collect()])
    terms = got.terms.collect()
    h = np.array([[r.h0, r.h1] for r in sorted(terms, key=lambda r: int(r.term[1:]))]).T
    assert (w >= 0).all() and (h >= 0).all()
    assert math.isclose(((x[x.sum(1) > 0] - w @ h) ** 2).sum(), got.losses[-1], rel_tol=1e-6)


@pytest.mark.parametrize("solver,start", [("cd", "svd"), ("mu", "hash")])
def test_factors_with_fewer_rows_than_terms(spark, monkeypatch, solver, start):
    """Where the term factor is too large to send but the row factor is not, the rounds are the same and join nothing."""
    rng = np.random.default_rng(2)
    x = rng.poisson(rng.random((12, 2)) @ rng.random((2, 40)) * 3)
    cells = spark.createDataFrame([(i, f"t{j}", int(x[i, j])) for i in range(12) for j in range(40) if x[i, j]], "id bigint, term string, tf bigint")
    ways = []
    for limit in (64 << 20, 12 * 8 * 2):
        monkeypatch.setattr(decomposition, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(decomposition, "_nmf_by_joins", lambda *_: pytest.fail("the cells were joined"))
        got = decomposition.nmf(cells, "id", "term", "tf", 2, rounds=7, tol=0, solver=solver, start=start)
        w = np.array([r[1:] for r in got.rows.select("id", "w0", "w1").orderBy("id").collect()])
        h = np.array([r[1:] for r in got.terms.select("term", "h0", "h1").orderBy("term").collect()])
        ways.append((got.losses, w, h))
    assert len(ways[0][0]) == 7 and all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(*ways))


@pytest.mark.parametrize("solver,start", [("cd", "hash"), ("mu", "hash")])
def test_factors_as_tables_meet_the_cells_in_blocks(spark, monkeypatch, solver, start):
    """Where neither factor may be held: the same factors, and a round sends a line for each term of a block, not one a cell."""
    rng = np.random.default_rng(4)
    x = rng.poisson(rng.random((50, 2)) @ rng.random((2, 20)) * 3)
    cells = spark.createDataFrame([(i, f"t{j}", int(x[i, j])) for i in range(50) for j in range(20) if x[i, j]], "id bigint, term string, tf bigint")
    monkeypatch.setattr(reduction, "BLOCK_CELLS", 150)
    met, ways = [], []
    meet = reduction.Blocks.meet
    monkeypatch.setattr(reduction.Blocks, "meet", lambda self, *a, **b: met.append(self.rows.select("block").distinct().count()) or meet(self, *a, **b))
    for limit in (64 << 20, 0):
        monkeypatch.setattr(decomposition, "BROADCAST_BYTES", limit)
        got = decomposition.nmf(cells, "id", "term", "tf", 2, rounds=3, tol=0, solver=solver, start=start)
        w = np.array([r[1:] for r in got.rows.select("id", "w0", "w1").orderBy("id").collect()])
        h = np.array([r[1:] for r in got.terms.select("term", "h0", "h1").orderBy("term").collect()])
        ways.append((got.losses, w, h))
    assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(*ways)) and len(met) == 3 and met[0] > 1


def test_scaling(rows):
    df = rows([(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "a double, b double")
    got = features.standardize(df, ["a", "b"]).orderBy("a").collect()
    assert [round(r.a_z, 4) for r in got] == [-1.2247, 0.0, 1.2247] and [r.b_z for r in got] == [0.0] * 3


def test_one_hot_and_bounds(rows):
    df = rows([("b",), ("a",), (None,)], "s string")
    out, labels = features.one_hot(df, "s", "v")
    assert [tuple(r) for r in labels.orderBy("slot").collect()] == [("a", 0), ("b", 1), ("unknown", 2)]
    out = out.orderBy(F.col("s").desc_nulls_last())
    assert [list(r[0]) for r in out.select(vector_to_array("v")).collect()] == [[0, 1, 0], [1, 0, 0], [0, 0, 1]]
    docs = rows([(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, ["a", "c"])], "id int, t array<string>")
    assert {tuple(r) for r in features.vocabulary(docs, "t", min_df=2, max_df=0.95).collect()} == {("c", 2, 2)}
    assert [r.term for r in features.vocabulary(docs, "t", 2).collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        features.TermSpace.fit(docs, "t", features.VECTOR_TERMS + 1)


@pytest.mark.parametrize("limit", [10_000, 4])
def test_pairs_come_from_frequent_words(rows, monkeypatch, limit):
    """The same terms and counts as from all pairs, while pairs with a rare word are never made; ties stay in term order."""
    monkeypatch.setattr(features, "FREQUENT_WORDS", limit)
    lists = [["a", "b", "a", "b", "x"], ["a", "b", "c", "a"], ["c", "b", "y"], [], None, ["z", "c"]]
    words = rows([(w,) for w in lists], "w array<string>")
    whole = rows([(None if w is None else w + [f"{p} {q}" for p, q in zip(w, w[1:])],) for w in lists], "t array<string>")
    made, plain = [], features.vocabulary

    def watched(docs, terms, *options):
        made.append({t for r in docs.collect() for t in r[0] or []})
        return plain(docs, terms, *options)

    monkeypatch.setattr(features, "vocabulary", watched)
    for k in (1, 2, 3, 4, 50):
        assert features.pair_vocabulary(words, "w", k).collect() == plain(whole, "t", k).collect()
    assert limit == 4 or "b y" not in made[2] and "a b" in made[2]


def named(rows, expr, schema, *values):
    return rows([values], schema).select(expr).first()[0]


def test_tone_names(rows):
    name = naming.tone_name(F.col("p"), F.col("s"), F.col("subject"), F.col("source"))
    schema = "p double, s double, subject string, source string"
    assert named(rows, name, schema, 0.21, 0.51, "bitcoin", "Wire") == "Subjective Strongly Positive Bitcoin (Wire)"
    assert named(rows, name, schema, 0.0, 0.3, None, None) == "Neutral General (various)"
    assert named(rows, name, schema, -0.01, 0.1, "nft", "Wire") == "Objective Negative Nft (Wire)"
    assert named(rows, name, schema, 0.2, 0.5, "x", "y") == "Positive X (y)"
    assert named(rows, name, schema, -0.2, 0.2, "x", "y") == "Negative X (y)"


def test_topic_names_are_cut(rows):
    name = naming.topic_name(F.col("p"), F.col("s"), F.lit("altcoin"), F.lit("Wire"), F.col("a"), F.col("v"))
    schema = "p double, s double, a array<string>, v array<string>"
    assert named(rows, name, schema, 0.1, 0.1, ["new", "big", "old"], ["is", "has"]) == "Objective Positive Altcoin (Wire) - new/big is/has"
    assert named(rows, name, schema, 0.1, 0.3, [], ["is"]) == "Positive Altcoin (Wire)"
    long = named(rows, name, schema, 0.3, 0.6, ["decentralized", "unprecedented"], ["is", "has"])
    assert len(long) == 60 and long.endswith("...")


@pytest.mark.parametrize("a,b,expected", [(10, 7, "A & B"), (10, 6, "A"), (10, 0, "A")])
def test_category_names(rows, a, b, expected):
    df = rows([(1, "A")] * a + [(1, "B")] * b, "c int, crypto_category string")
    assert naming.category_names(df, "c").first().name == expected


@pytest.mark.parametrize(
    "counts,expected",
    [
        ({"x": 5}, "x"), ({"x": 8, "y": 2}, "x Group"), ({"reuters": 5, "cnn": 4}, "Mainstream Media"), ({"reuters": 5, "z": 4}, "Mixed Media"),
        ({"coindesk": 5, "cointelegraph": 4}, "Crypto Media"), ({"y": 5, "z": 4}, "y & z"), ({}, "Source Cluster 1"),
        ({"x": 7, "y": 2, "z": 1}, "x & y"),
    ],
)
def test_outlet_names(rows, counts, expected):
    data = [(1, s) for s, n in counts.items() for _ in range(n)] or [(1, None)]
    assert naming.outlet_names(rows(data, "c int, source string"), "c").first().name == expected


def test_polarity_order(rows):
    df = rows([(0, 0.5), (1, -0.5), (2, 0.0)], "c int, p double")
    got = clustering.order_by_polarity(df, "c", "p", ["Negative", "Neutral", "Positive"]).collect()
    assert {(r.c, r.label) for r in got} == {(1, "Negative"), (2, "Neutral"), (0, "Positive")}


def test_too_many_sentiment_clusters(spark):
    from headwind.plans import clusters

    with pytest.raises(ValueError):
        clusters.sentiment_clusters(spark.range(3), k=4)


def test_silhouette_with_many_clusters_and_repeated_keys(spark):
    """the sums of a point travel side by side, in several lines beyond SLOTS clusters; points of one key stay apart."""
    x = cloud(3)
    c = np.arange(len(x)) % 40
    df = points(spark, x, c)
    assert math.isclose(quality.silhouette(df, "id", "x", "cluster").first()[0], brute_silhouette(x, c), rel_tol=1e-9)
    repeated = df.withColumn("id", F.floor(F.col("id") / 2))
    assert math.isclose(quality.silhouette(repeated, "id", "x", "cluster", 16).first()[0], brute_silhouette(x, c), rel_tol=1e-9)


def test_points_go_to_a_bounded_number_of_tiles(spark):
    """a point used to be sent once for each block of ``block_rows`` points; now to TILES tiles or so."""
    folded = pairs.fold_copies(points(spark, np.arange(4000.0)[:, None]), "id", "x")
    sent = pairs.map_tile_pairs(folded, lambda a, b, same: {"n": [len(a["id"]) + (0 if same else len(b["id"]))]}, "n long", block_rows=16)
    assert sent.agg(F.sum("n")).first()[0] <= 1.2 * pairs.TILES * 4000


def test_boxes_hold_every_near_pair_once():
    """only boxes that are close meet, and all pairs within reach are in them."""
    x = cloud(4, n=300, d=3)
    seen = np.zeros((300, 300), int)
    for i, j, own in pairs.close_blocks(x, x, True, 0.5, 32):
        seen[np.ix_(i, j)] += 1
        if not own:
            seen[np.ix_(j, i)] += 1
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.5
    assert (seen[near] == 1).all() and seen.max() == 1 and seen.sum() < 300 * 300


def test_sums_of_a_pass_are_added_before_the_driver(spark, monkeypatch):
    """many tasks used to send all their sums to the driver in every pass."""
    import pyspark.sql.classic.dataframe as frames

    rows_sent = []
    whole = frames.DataFrame.toArrow

    def counted(self):
        out = whole(self)
        rows_sent.append(out.num_rows)
        return out

    monkeypatch.setattr(frames.DataFrame, "toArrow", counted)
    x = np.tile(cloud(2, n=200, d=4), (1, 64))
    held = points(spark, x).select("x").repartition(40)
    fits = [x[:20] + j for j in range(8)]
    got = clustering._visit(held, x.shape[1], fits, 40)
    assert rows_sent == [160] and [int(c.sum()) for c in got.counts] == [len(x)] * 8
    assert all(np.allclose(s.sum(0), x.sum(0)) for s in got.sums)


def test_features_are_fitted_on_a_kept_table(spark, monkeypatch):
    """Vocabularies and means come from a kept table, so that no fit prepares the articles again."""
    from headwind.operators import features
    from headwind.plans import clusters

    plans, fit = [], features.TermSpace.fit.__func__
    seen = lambda docs: plans.append(docs._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(features.TermSpace, "fit", classmethod(lambda cls, docs, *a: seen(docs) or fit(cls, docs, *a)))
    numbers = {c: F.col("id").cast("double") for c in clusters.NUMBER_FEATURES}
    words = {c: F.concat(F.lit("word other"), F.col("id").cast("string")) for c in ("title", "all_linguistic_features", "crypto_category")}
    df = spark.range(6).withColumns(numbers | words)
    assert clusters.general_features(df).count() == clusters.subject_features(df).count() == 6
    assert len(plans) == 3 and all(p.startswith("LogicalRDD") for p in plans)


def test_a_filter_on_clusters_runs_the_labels_once(spark):
    """A task has one Python worker for the labels, also where rows without a cluster are left out."""
    df = points(spark, cloud()).select("id", array_to_vector("x").alias("features"))
    found = clustering.Clusters("features", [[0.0, 0.0, 0.0], [3.0, 3.0, 3.0]], [0, 0], 0.0)
    labelled = found.label(df)
    kept = labelled.where("cluster is not null")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert kept.count() == 120 and {r.cluster for r in kept.collect()} <= {0, 1}


def test_a_block_of_distances_is_held_once():
    rng = np.random.default_rng(0)
    x, centers = rng.normal(size=(4000, 3)), rng.normal(size=(250, 3))
    tracemalloc.start()
    try:
        d2 = clustering.gaps(x, centers)
        assert tracemalloc.get_traced_memory()[1] < 1.5 * d2.nbytes
    finally:
        tracemalloc.stop()
    assert (d2 == np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ centers.T) + (centers * centers).sum(1), 0.0)).all()


def test_drawn_rows_are_the_smallest_keys_of_all_batches(spark):
    """Three batches a task; every start draws as many different rows as it is asked for, the same ones each time."""
    x = cloud(3)
    held = points(spark, x).coalesce(1).select("x", F.xxhash64("x").alias("h"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    drawn = []
    for size in ("50", "10000"):
        before = spark.conf.get(name)
        spark.conf.set(name, size)
        try:
            drawn.append(clustering._draw(held, 3, [x[:2], np.empty((0, 3))], [7, 8], 9, 1))
        finally:
            spark.conf.set(name, before)
    for some, whole in zip(*drawn):
        assert some.shape == (9, 3) and (some == whole).all() and len({tuple(r) for r in some}) == 9
