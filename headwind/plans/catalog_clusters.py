"""Queries on features and clusterings: assignment, scores, density, factors, names, whole clusterings, reports."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwind.operators import naming
from headwind.functions.text import terms
from headwind.operators import clustering, decomposition, density, features, pairs, quality, reports
from headwind.operators import aggregate as agg
from headwind.plans import clusters
from headwind.plans.catalog_articles import _STOP, prepared
from headwind.plans.catalog_market import r6
from headwind.plans.fixtures import ARTICLES, VECTORS, articles, table, vectors
from headwind.plans.registry import query
from headwind.session import cut

_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def d2(a, b):
    return _D2.format(a=a, b=b)


_CENTERS = f"""{VECTORS}, cells as (select cluster, generate_subscripts(x, 1) as i, unnest(x) as v from pts),
  means as (select cluster, i, avg(v) as m from cells group by all),
  centers as (select cluster, list(m order by i) as c from means group by cluster),
  sizes as (select cluster, count(*) as size from pts group by cluster)"""


def _label_centers(points):
    rows = quality.centroids(points, "x", "cluster").orderBy("cluster").collect()  # one row per label
    return [r["center"] for r in rows], [r["cluster"] for r in rows]


# --- assignment and scores ------------------------------------------------------------------------------------------


@query(
    "i12_centroids",
    f"with {_CENTERS} select cluster, size, cast(i as integer) as i, round(m, 6) + 0.0 as v from means join sizes using (cluster)",
)
def _(spark, sf):
    out = quality.centroids(vectors(spark, sf), "x", "cluster")
    long = out.select("cluster", "size", F.posexplode("center").alias("i", "v"))
    return long.select("cluster", "size", (F.col("i") + 1).alias("i"), r6("v"))


@query(
    "i1_assign_to_centers",
    f"""with {_CENTERS}, d as (select id, k.cluster, {d2('x', 'c')} as d2 from pts p, centers k)
    select id, cast(arg_min(cluster, d2) as integer) as assigned, round(min(d2), 6) + 0.0 as d2 from d group by id""",
)
def _(spark, sf):
    points = vectors(spark, sf)
    centers, labels = _label_centers(points)
    out = clustering.assign(points, "x", centers)
    names = F.array(*[F.lit(v) for v in labels])
    return out.select("id", F.get(names, F.col("assigned")).alias("assigned"), r6("d2"))


@query(
    "i1_cost",
    f"with {_CENTERS} select count(*) as n, round(sum({d2('x', 'c')}), 6) as cost from pts join centers using (cluster)",
)
def _(spark, sf):
    points = vectors(spark, sf)
    centers = quality.centroids(points, "x", "cluster").select("cluster", "center")
    gaps = points.join(centers, "cluster").select(quality.squared_gap(F.col("x"), F.col("center")).alias("g"))
    return gaps.agg(F.count("*").alias("n"), r6(F.sum("g"), "cost"))


_SILHOUETTE = f"""with {VECTORS}, sizes as (select cluster, count(*) as size from pts group by cluster),
  t as (select p.id, p.cluster as own, q.cluster as other, sum({{dist}}) as total from pts p, pts q group by all),
  ab as (select id, own, max(s.size) filter (own = other) as size, max(total / nullif(s.size - 1, 0)) filter (own = other) as a,
         min(total / s.size) filter (own <> other) as b from t join sizes s on s.cluster = t.other group by id, own),
  sil as (select id, own as cluster, case when size = 1 then 0.0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end as s from ab)"""
_EXACT = _SILHOUETTE.format(dist="sqrt(" + d2("p.x", "q.x") + ")")


@query("i4_silhouette", f"{_EXACT} select round(avg(s), 6) + 0.0 as silhouette from sil")
def _(spark, sf):
    return quality.silhouette(vectors(spark, sf), "id", "x", "cluster").select(r6("silhouette"))


@query("i4_d8_silhouette_points", f"{_EXACT} select id, cluster, round(s, 6) + 0.0 as s from sil")
def _(spark, sf):
    points = quality.silhouette_points(vectors(spark, sf), "id", "x", ["cluster"], block_rows=256)
    return points.select("id", "cluster", r6("s"))


@query("i4_silhouette_sampled", f"{_EXACT} select true as within_bound from sil having count(*) > 0")
def _(spark, sf):
    """The estimate from drawn points lies within its stated bound of the exact score."""
    points, error = vectors(spark, sf), 0.1
    guess = quality.silhouette_sampled(points, "id", "x", "cluster", error)
    exact = quality.silhouette(points, "id", "x", "cluster")
    return exact.select((F.abs(F.col("silhouette") - guess) <= 4 * error / (1 - error)).alias("within_bound"))


@query(
    "i4_silhouette_squared",
    f"{_SILHOUETTE.format(dist=d2('p.x', 'q.x'))} select round(avg(s), 6) + 0.0 as silhouette from sil",
)
def _(spark, sf):
    points = clusters.to_vector(vectors(spark, sf), "x").withColumn("cluster", F.col("cluster").cast("double"))
    value = quality.silhouette_squared(points, "features", "cluster")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query(
    "i5_calinski_harabasz",
    f"""with {_CENTERS}, mid as (select list(m order by i) as g from (select i, avg(v) as m from cells group by i)),
    w as (select sum({d2('x', 'c')}) as within, count(*) as n from pts join centers using (cluster)),
    b as (select sum(size * {d2('c', 'g')}) as between_, count(*) as k from centers join sizes using (cluster), mid)
    select k as clusters, n, round((between_ / (k - 1)) / (within / (n - k)), 6) as score from w, b""",
)
def _(spark, sf):
    return quality.calinski_harabasz(vectors(spark, sf), "x", "cluster").select("clusters", "n", r6("score"))


# --- density --------------------------------------------------------------------------------------------------------

EPS, MIN_SAMPLES = 1.16, 5
_NEAR = f"""near as (select p.id as a, q.id as b from pts p, pts q where sqrt({d2('p.x', 'q.x')}) <= {EPS}),
  cnt as (select a as id, count(*) as n from near group by a)"""


@query("i6_neighbour_counts", f"with {VECTORS}, {_NEAR} select id, n, n >= {MIN_SAMPLES} as core from cnt")
def _(spark, sf):
    return density.core_points(vectors(spark, sf), "id", "x", EPS, MIN_SAMPLES).select("id", "n", "core")


_DBSCAN_SQL = f"""with recursive {VECTORS}, {_NEAR}, core as (select id from cnt where n >= {MIN_SAMPLES}),
    link as (select a, b from near where a in (select id from core) and b in (select id from core)),
    reach(id, root) as (select id, id from core union select l.b, r.root from reach r join link l on l.a = r.id),
    comp as (select id, min(root) as root from reach group by id),
    num as (select root, dense_rank() over (order by root) - 1 as c from (select distinct root from comp)),
    lab as (select id, c from comp join num using (root)
      union all select n.a, min(num.c) from near n join comp on comp.id = n.b join num using (root)
      where n.a not in (select id from core) group by n.a)
    select p.id, cast(coalesce(c, -1) as integer) as cluster from pts p left join lab using (id)"""


@query("i6_dbscan", _DBSCAN_SQL)
def _(spark, sf):
    return density.dbscan(vectors(spark, sf), "id", "x", EPS, MIN_SAMPLES)


@query("i6_dbscan_pivots", _DBSCAN_SQL)
def _(spark, sf):
    return density.dbscan(vectors(spark, sf), "id", "x", EPS, MIN_SAMPLES, partition="pivots")


# --- K-means, sweeps, reductions ------------------------------------------------------------------------------------


@query("i1_kmeans")
def _(spark, sf):
    points = clusters.to_vector(vectors(spark, sf), "x")
    found = clustering.fit_kmeans(points, "features", 5)
    return found.label(points, "group").groupBy("group").agg(F.count("*").alias("n"))


@query(
    "i1_kmeans_facts",
    "select count(*) as n, 5 as clusters, count(*) as placed, 0::bigint as misplaced, true as cost_matches from embeddings",
)
def _(spark, sf):
    """Every row has its nearest centre, the sizes sum up, and the cost is the sum of the gaps."""
    points = vectors(spark, sf)
    found = clustering.fit_kmeans(clusters.to_vector(points, "x"), "features", 5)
    labelled = found.label(clusters.to_vector(points, "x"), "group").select("id", "x", "group")
    near = clustering.assign(labelled, "x", found.centers)
    cost = F.abs(F.sum("d2") - F.lit(found.cost)) <= 1e-6 * found.cost
    return near.agg(
        F.count("*").alias("n"), F.count_distinct("group").cast("int").alias("clusters"), F.lit(sum(found.sizes)).cast("long").alias("placed"),
        F.count_if(F.col("assigned") != F.col("group")).alias("misplaced"), cost.alias("cost_matches"),
    )


@query("i2_elbow")
def _(spark, sf):
    return clustering.elbow(clusters.to_vector(vectors(spark, sf), "x"), "features", range(2, 15))


@query("i3_best_k")
def _(spark, sf):
    points = clusters.to_vector(vectors(spark, sf), "x")
    return clustering.best_k(points, "id", "features", 8, "silhouette")[1]


@query(
    "i7_covariance",
    f"""with {VECTORS}, cells as (select id, generate_subscripts(x, 1) - 1 as i, unnest(x) as v from pts)
    select cast(p.i as integer) as i, cast(q.i as integer) as j, round(covar_samp(p.v, q.v), 6) + 0.0 as value
    from cells p join cells q using (id) group by p.i, q.i""",
)
def _(spark, sf):
    matrix = decomposition.covariance(clusters.to_vector(vectors(spark, sf), "x"), "features")
    return decomposition.square_table(spark, matrix).select("i", "j", r6("value"))


@query("i7_pca")
def _(spark, sf):
    out = decomposition.pca(clusters.to_vector(vectors(spark, sf), "x"), "features", 3)
    return out.select("id", *[F.get("components", F.lit(i)).alias(f"pc{i + 1}") for i in range(3)])


@query(
    "i7_pca_facts",
    f"""with {VECTORS}, cells as (select generate_subscripts(x, 1) as i, unnest(x) as v from pts), t as (select sum(v) as s from (select var_samp(v) as v from cells group by i))
    select i::integer as i, j::integer as j, 0.0::double as value from range(1, 4) a(i), range(1, 4) b(j) where i < j
    union all select i::integer, 0, 0.0::double from range(1, 4) a(i) union all select 0, 0, round(s, 6) from t""",
)
def _(spark, sf):
    """Components are centred and uncorrelated; with all of them the total variance stays (line 0, 0)."""
    points = clusters.to_vector(vectors(spark, sf), "x")
    width = len(points.first()["x"])
    rows = decomposition.pca(points, "features", width).select("components")
    pcs = [F.get("components", F.lit(i)) for i in range(3)]
    lines = [(i + 1, j + 1, F.covar_samp(pcs[i], pcs[j])) for i in range(3) for j in range(i + 1, 3)] + [(i + 1, 0, F.avg(pcs[i])) for i in range(3)]
    total = F.aggregate(F.array(*[F.var_samp(F.get("components", F.lit(i))) for i in range(width)]), F.lit(0.0), lambda a, v: a + v)
    facts = rows.agg(F.array(*[v for *_, v in lines], total).alias("v"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j, _ in [*lines, (0, 0, None)]])
    long = facts.select(F.explode(F.arrays_zip(names.alias("at"), F.col("v").alias("v"))).alias("r"))
    return long.select("r.at.i", "r.at.j", r6("r.v", "value"))


@query("i8_truncated_svd")
def _(spark, sf):
    svd = decomposition.truncated_svd(clusters.to_vector(vectors(spark, sf), "x"), "features", 50)
    return svd.rows.select("id", F.get(vector_to_array("reduced"), F.lit(0)).alias("first"))


@query(
    "i8_svd_facts",
    f"""with {VECTORS}, cells as (select unnest(x) as v from pts)
    select count(distinct id) as n, (select round(sum(v * v), 4) from cells) as sum_squares, true as same_values from pts""",
)
def _(spark, sf):
    """With as many values as columns their squares add up to those of the cells; both ways find the same 50."""
    points = clusters.to_vector(vectors(spark, sf), "x")
    width = len(points.first()["x"])
    every = decomposition.wide_svd(points, "features", width)
    ours, gram = (way(points, "features", 50).singular_values for way in (decomposition.wide_svd, decomposition.truncated_svd))
    same = all(abs(a - b) <= 1e-6 * b for a, b in zip(ours, gram, strict=True))
    total = sum(v * v for v in every.singular_values)
    return every.rows.agg(F.count_distinct("id").alias("n"), F.lit(round(total, 4)).alias("sum_squares"), F.lit(same).alias("same_values"))


@query("i8_wide_svd")
def _(spark, sf):
    """Unit TF-IDF rows of every document over the whole vocabulary of words and pairs, reduced to 20 directions."""
    docs = table(spark, sf, "documents").select("doc_id", terms(F.col("text"), _STOP, (1, 2)).alias("terms"))
    folded = features.fold_by_term(docs, "doc_id", "terms")
    n_docs = table(spark, sf, "documents").agg(F.count("*").alias("n")).scalar()
    return decomposition.svd_of_cells(
        features.tfidf_long(folded, "doc_id", features.vocabulary_of(folded, min_df=2), n_docs), "doc_id", "term", "weight", 20
    )


@query(
    "i11_top_features",
    f"""with {_CENTERS}, r as (select cluster, 'f' || (i - 1) as feature, m, row_number() over (partition by cluster order by m desc, 'f' || (i - 1)) as rank from means)
    select cast(dense_rank() over (order by cluster) - 1 as integer) as cluster, cast(rank as integer) as rank, feature, round(m, 6) + 0.0 as value from r where rank <= 10""",
)
def _(spark, sf):
    centers = quality.centroids(vectors(spark, sf), "x", "cluster")
    out = clustering.top_coordinates(centers, "cluster", "center")
    numbered = centers.select("cluster", (F.dense_rank().over(W.orderBy("cluster")) - 1).alias("no"))  # a row per cluster
    named = out.join(numbered, "cluster").withColumn("feature", F.concat(F.lit("f"), "i"))
    return named.select(F.col("no").alias("cluster"), "rank", "feature", r6("value"))


@query("i12_merge_order")
def _(spark, sf):
    return clustering.merge_order(spark, _label_centers(vectors(spark, sf))[0])


@query(
    "e10_group_topics",
    f"""with {_CENTERS} select * from (select cluster, cast(i - 1 as integer) as topic, round(m, 6) + 0.0 as weight,
      cast(row_number() over (partition by cluster order by m desc, i) as integer) as rank from means) where rank <= 3""",
)
def _(spark, sf):
    return decomposition.group_topics(vectors(spark, sf), "cluster", "x").select("cluster", "topic", r6("weight"), "rank")


# --- non-negative factors -------------------------------------------------------------------------------------------

TOPICS = 12


def _counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", terms(F.col("text"), _STOP).alias("terms"))
    folded = features.fold_by_term(docs, "doc_id", "terms")
    n_docs = table(spark, sf, "documents").agg(F.count("*").alias("n")).scalar()
    return features.term_counts(folded, "doc_id", features.vocabulary_of(folded, min_df=2, max_df=0.95, n_docs=n_docs))


def _start_sql(key, j, seed):
    return f"(cast(('0x' || md5(cast({key} as varchar) || ':{seed}:{j}')[1:8]) as bigint) + 1) / 4294967297.0 * (select scale from f)"


def _nmf_sql() -> str:
    ks = range(TOPICS)
    dot = lambda side, g, j: " + ".join(f"{side}{i} * {g}{min(i, j)}{max(i, j)}" for i in ks)
    gram = lambda side, g: ", ".join(f"sum({side}{i} * {side}{j}) as {g}{i}{j}" for i in ks for j in ks if i <= j)
    words = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: x not in [" + ", ".join(f"'{w}'" for w in _STOP) + "])"
    return f"""with t as (select doc_id, unnest({words}) as term from documents),
    v as (select term from t group by term having count(distinct doc_id) >= 2
          and count(distinct doc_id) <= 0.95 * (select count(*) from documents)),
    x as (select doc_id, term, cast(count(*) as double) as x from t where term in (select term from v) group by all),
    f as (select sqrt(sum(x) / (count(distinct term) * count(distinct doc_id)) / {TOPICS}) as scale from x),
    h as (select term, {', '.join(f"{_start_sql('term', j, 42)} as h{j}" for j in ks)} from (select distinct term from x)),
    w as (select doc_id, {', '.join(f"{_start_sql('doc_id', j, 43)} as w{j}" for j in ks)} from (select distinct doc_id from x)),
    hh as (select {gram('h', 'g')} from h),
    pw as (select doc_id, {', '.join(f'sum(x * h{j}) as p{j}' for j in ks)} from x join h using (term) group by doc_id),
    w1 as (select doc_id, {', '.join(f"w{j} * p{j} / ({dot('w', 'g', j)} + 1e-12) as w{j}" for j in ks)} from w join pw using (doc_id), hh),
    ww as (select {gram('w', 'g')} from w1),
    ph as (select term, {', '.join(f'sum(x * w{j}) as p{j}' for j in ks)} from x join w1 using (doc_id) group by term),
    h1 as (select term, {', '.join(f"h{j} * p{j} / ({dot('h', 'g', j)} + 1e-12) as h{j}" for j in ks)} from h join ph using (term), ww)"""


@query("i9_factor_round_rows", f"{_nmf_sql()} select doc_id, {', '.join(f'round(w{j}, 6) as w{j}' for j in range(TOPICS))} from w1")
def _(spark, sf):
    out = decomposition.nmf(_counts(spark, sf), "doc_id", "term", "tf", TOPICS, rounds=1, solver="mu", start="hash").rows
    return out.select("doc_id", *[r6(f"w{j}") for j in range(TOPICS)])


@query(
    "i10_topic_words",
    f"""{_nmf_sql()}, l as ({' union all '.join(f'select {j} as topic, term, h{j} as weight from h1' for j in range(TOPICS))})
    select * from (select topic, term, round(weight, 6) as weight, cast(row_number() over (partition by topic order by weight desc, term) as integer) as rank from l) where rank <= 15""",
)
def _(spark, sf):
    out = decomposition.nmf(_counts(spark, sf), "doc_id", "term", "tf", TOPICS, rounds=1, solver="mu", start="hash").terms
    return decomposition.topic_words(out, "term", TOPICS).select("topic", "term", r6("weight"), "rank")


@query("i9_factor_facts", "select 0::bigint as negative, true as falling, true as loss_matches")
def _(spark, sf):
    """Factors are not negative, the loss never grows, and the last one is the squared error worked out from W and H."""
    counts = cut(_counts(spark, sf))
    got = decomposition.nmf(counts, "doc_id", "term", "tf", TOPICS, rounds=6)
    ws, hs = [f"w{j}" for j in range(TOPICS)], [f"h{j}" for j in range(TOPICS)]
    fit = sum((F.col(w) * F.col(h) for w, h in zip(ws, hs)), F.lit(0.0))
    at_cells = counts.join(got.rows, "doc_id").join(got.terms, "term").agg(F.sum(F.col("tf") * F.col("tf") - 2 * F.col("tf") * fit)).first()[0]
    (ww, _), (hh, _) = decomposition._gram(got.rows, ws), decomposition._gram(got.terms, hs)
    error = at_cells + float((ww * hh).sum())
    negative = got.rows.where(F.least(*ws) < 0).count() + got.terms.where(F.least(*hs) < 0).count()
    falling = all(a >= b for a, b in zip(got.losses, got.losses[1:]))
    return spark.createDataFrame([(negative, falling, abs(error - got.losses[-1]) <= 1e-6 * abs(error))], "negative long, falling boolean, loss_matches boolean")


@query("i10_topic_words_converged")
def _(spark, sf):
    """The words of each topic after the factors have settled."""
    out = decomposition.nmf(_counts(spark, sf), "doc_id", "term", "tf", TOPICS).terms
    return decomposition.topic_words(out, "term", TOPICS)


@query("i9_factor_losses")
def _(spark, sf):
    losses = decomposition.nmf(_counts(spark, sf), "doc_id", "term", "tf", TOPICS, rounds=50).losses
    return spark.createDataFrame(list(enumerate(losses, 1)), "round int, loss double")


# --- names ----------------------------------------------------------------------------------------------------------


@query(
    "i13_order_by_polarity",
    f"""with {ARTICLES}, g as (select *, cluster % 3 as grp from articles), m as (select grp, avg(polarity) as avg_polarity from g group by grp)
    select grp, round(avg_polarity, 6) + 0.0 as avg_polarity, list_extract(['Negative', 'Neutral', 'Positive'], row_number() over (order by avg_polarity, grp)) as label from m""",
)
def _(spark, sf):
    rows = prepared(spark, sf).withColumn("grp", F.pmod("cluster", F.lit(3)))
    out = clustering.order_by_polarity(rows, "grp", "sentiment_polarity", ["Negative", "Neutral", "Positive"])
    return out.select("grp", r6("avg_polarity"), "label")


_BAND = """case when s > 0.5 then 'Subjective ' when s < 0.2 then 'Objective ' else '' end
  || case when p > 0.2 then 'Strongly Positive' when p > 0 then 'Positive' when p < -0.2 then 'Strongly Negative' when p < 0 then 'Negative' else 'Neutral' end"""


def _leaders_sql(by: str, value: str, name: str, k: int) -> str:
    return f"""{name} as (select {by}, list(v order by rn) as v, list(n order by rn) as n from (select {by}, {value} as v, count(*) as n,
      row_number() over (partition by {by} order by count(*) desc, {value}) as rn from articles where {value} is not null group by {by}, {value})
      where rn <= {k} group by {by})"""


_FACTS = "m as (select {by}, avg(polarity) as p, avg(subjectivity) as s from articles group by {by})"


_BY_WEEKDAY = ARTICLES.replace("select *, case", "select *, dayofweek(date) as wd, case")


@query(
    "i14_tone_names",
    f"""with {_BY_WEEKDAY}, {_FACTS.format(by='wd')}, {_leaders_sql('wd', 'subject', 'ls', 1)}, {_leaders_sql('wd', 'source', 'lo', 1)}
    select wd, {_BAND} || ' ' || upper(ls.v[1][1:1]) || lower(ls.v[1][2:]) || ' (' || lo.v[1] || ')' as name
    from m join ls using (wd) join lo using (wd)""",
)
def _(spark, sf):
    rows = prepared(spark, sf).withColumn("wd", (F.dayofweek("date") - 1).cast("long"))
    return naming.tone_names(rows, "wd")


@query(
    "i15_topic_names",
    f"""with {ARTICLES}, {_FACTS.format(by='cluster')}, {_leaders_sql('cluster', 'subject', 'ls', 1)}, {_leaders_sql('cluster', 'source', 'lo', 1)},
    vw as (select cluster, unnest(title_verbs) as w from articles),
    a as (select cluster, list(w order by n desc, w) as v from (select cluster, w, count(*) as n from vw group by all) group by cluster),
    xw as (select cluster, unnest(text_verbs) as w from articles),
    b as (select cluster, list(w order by n desc, w) as v from (select cluster, w, count(*) as n from xw group by all) group by cluster)
    select cluster, case when length(name) > 60 then name[1:57] || '...' else name end as name from (
      select m.cluster, {_BAND} || ' ' || array_to_string(list_transform(string_split(ls.v[1], ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')
        || ' (' || lo.v[1] || ') - ' || a.v[1] || '/' || a.v[2] || ' ' || b.v[1] || '/' || b.v[2] as name
      from m join ls using (cluster) join lo using (cluster) join a using (cluster) join b using (cluster))""",
)
def _(spark, sf):
    rows = prepared(spark, sf)

    def words(column):
        top = agg.element_counts(rows, ["cluster"], column, 15)
        listed = top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("l"))  # 15 per cluster
        return listed.select("cluster", F.transform("l", lambda r: r["item"]).alias("words"))

    return naming.topic_names(rows, "cluster", adjectives=words("title_verbs_parsed"), verbs=words("text_verbs_parsed"))


@query(
    "i16_category_names",
    f"""with {ARTICLES}, {_leaders_sql('source', 'crypto_category', 'l', 2)}
    select source, case when len(v) > 1 and n[2] > 0.6 * n[1] then v[1] || ' & ' || v[2] else v[1] end as name from l""",
)
def _(spark, sf):
    return naming.category_names(prepared(spark, sf), "source")


_OUTLETS = ["reuters", "CNN", "CoinDesk", "CoinTelegraph", "The Block", "Daily Token"]
_OUTLET_SQL = "[" + ", ".join(f"'{o}'" for o in _OUTLETS) + "]"


@query(
    "i17_outlet_names",
    f"""with {ARTICLES.replace('l.quality, l.toxic,', f"l.quality, l.toxic, list_extract({_OUTLET_SQL}, (d.n_chars % 6) * (d.n_chars % 4) % 6 + 1) as outlet, d.doc_id % 24 as grp,")},
    {_leaders_sql('grp', 'outlet', 'l', 3)}, k as (select *, list_transform(v, lambda o: lower(o)) as low from l),
    q as (select *, ['reuters', 'bloomberg', 'cnbc', 'forbes', 'wsj', 'cnn', 'bbc'] as main, ['coindesk', 'cointelegraph', 'bitcoin.com', 'crypto news', 'the block'] as crypto from k)
    select grp, case when len(v) = 1 then v[1] when n[1] > 0.7 * list_sum(n) then v[1] || ' Group'
      when len(list_filter(low, lambda o: list_contains(main, o))) = len(v) then 'Mainstream Media'
      when len(list_filter(low, lambda o: list_contains(main, o))) > 0 then 'Mixed Media'
      when len(list_filter(low, lambda o: list_contains(crypto, o))) = len(v) then 'Crypto Media'
      else v[1] || ' & ' || v[2] end as name from q""",
)
def _(spark, sf):
    chars = F.col("n_chars")
    slot = F.pmod(F.pmod(chars, F.lit(6)) * F.pmod(chars, F.lit(4)), F.lit(6)) + 1
    outlets = F.array(*[F.lit(o) for o in _OUTLETS])
    rows = table(spark, sf, "documents").select(
        F.pmod("doc_id", F.lit(24)).alias("grp"), F.element_at(outlets, slot.cast("int")).alias("outlet")
    )
    return naming.outlet_names(rows, "grp", "outlet")


def _filled(df):
    """How many cells of each feature vector are filled, and its length."""
    cells = vector_to_array("features")
    return df.select("row_id", F.size(cells).alias("width"), F.size(F.filter(cells, lambda v: v != 0)).alias("filled"))


@query("h10_general_features")
def _(spark, sf):
    return _filled(clusters.general_features(prepared(spark, sf)))


@query("h10_subject_features")
def _(spark, sf):
    return _filled(clusters.subject_features(prepared(spark, sf)))


@query("h10_source_features")
def _(spark, sf):
    return _filled(clusters.source_features(prepared(spark, sf)))


# --- whole clusterings ----------------------------------------------------------------------------------------------


@query("i18_sentiment_clusters")
def _(spark, sf):
    rows = clusters.sentiment_clusters(prepared(spark, sf))
    return rows.groupBy("sentiment_cluster", "sentiment_cluster_label").agg(
        F.count("*").alias("n"), F.avg("sentiment_polarity").alias("avg_polarity")
    )


@query("i19_subject_clusters")
def _(spark, sf):
    rows, _scores = clusters.subject_clusters(prepared(spark, sf), "row_id")
    return agg.crosstab(rows, "crypto_cluster_label", "crypto_category")


@query("i20_source_clusters")
def _(spark, sf):
    rows, _scores = clusters.source_clusters(prepared(spark, sf), "row_id")
    return agg.crosstab(rows, "source_cluster_label", "source")


@query("i21_topic_clusters")
def _(spark, sf):
    found = clusters.topic_clusters(prepared(spark, sf), "row_id")
    return found.rows.groupBy("topic_cluster", "cluster_name").agg(F.count("*").alias("n"))


@query("i22_general_clusters")
def _(spark, sf):
    rows = clusters.general_clusters(prepared(spark, sf))
    return rows.groupBy("cluster", "cluster_label").agg(F.count("*").alias("n"))


@query("i22_general_density")
def _(spark, sf):
    ready = clusters.general_features(prepared(spark, sf))
    found = clusters.general_density(ready.withColumn("row_id", F.col("row_id").cast("long")), "row_id")
    return found.groupBy("cluster").agg(F.count("*").alias("n"))


# --- reports --------------------------------------------------------------------------------------------------------


def _summary_sql() -> str:
    lab = f"{ARTICLES}, g as (select *, upper(sentiment_class[1:1]) || sentiment_class[2:] as lab from articles), t as (select count(*) as t from g)"

    def shares(col, section):
        return f"""select '{section}' as section, row_number() over (order by count(*) desc, {col}) as ord, {col} as key, count(*) as n,
          round(count(*) * 100.0 / (select t from t), 6) as value from g group by {col}"""

    def focus(value, section):
        return f"""select '{section}', ord, key, n, null from (select row_number() over (order by count(*) desc, crypto_category) as ord,
          crypto_category as key, count(*) as n from g where lab = '{value}' group by crypto_category) where ord <= 2"""

    def extremes(col, section):
        m = f"(select {col} as k, avg(polarity) as m from g group by 1)"
        return f"""select '{section}', 1, (select k from {m} order by m desc, k limit 1), null, (select round(max(m), 6) + 0.0 from {m})
          union all select '{section}', 2, (select k from {m} order by m, k limit 1), null, (select round(min(m), 6) + 0.0 from {m})"""

    prefer = """select 'source focus', ord, source || ' > ' || c, n, null from (select source, crypto_category as c, count(*) as n,
      row_number() over (partition by source order by count(*) desc, crypto_category) as rn from g group by 1, 2)
      join (select source, row_number() over (order by count(*) desc, source) as ord from g group by 1) using (source) where rn = 1 and ord <= 3"""
    body = " union all ".join(
        [
            shares("lab", "sentiment"), "select 'total', 1, null, count(*), null from g", focus("Positive", "positive focus"),
            focus("Negative", "negative focus"), shares("subject", "subject"), shares("source", "source"),
            extremes("subject", "subject polarity"), extremes("source", "source polarity"), prefer,
        ]
    )
    return f"with {lab} select section, cast(ord as bigint) as ord, key, n, value from ({body})"


def _summary(spark, sf):
    rows = prepared(spark, sf).withColumn("lab", F.initcap("sentiment_class"))
    return reports.summary_rows(rows, "lab", "subject", "source", "crypto_category", "sentiment_polarity")


@query("e27_a16_summary", _summary_sql())
def _(spark, sf):
    return _summary(spark, sf).select("section", "ord", "key", "n", r6("value"))


@query("a16_summary_lines")
def _(spark, sf):
    return reports.summary_lines(_summary(spark, sf))


def _cluster_lines(spark, sf):
    rows = prepared(spark, sf)
    profile = agg.profile(
        rows, "cluster", ["sentiment_polarity", "sentiment_subjectivity"], {"crypto_category": 5, "source": 5}
    )
    headings = {
        "avg_sentiment_polarity": "Average Polarity", "avg_sentiment_subjectivity": "Average Subjectivity",
        "crypto_category": "Top Crypto Subjects", "source": "Top Sources",
    }
    lines = reports.profile_lines(profile, "cluster", headings, names=naming.tone_names(rows, "cluster"))
    titles = reports.sample_title_lines(rows, "cluster", "row_id", "title")
    return lines.select("grp", "sec", "pos", "line").unionByName(titles)


@query("a16_cluster_report")
def _(spark, sf):
    return _cluster_lines(spark, sf)


@query("a17_html_report")
def _(spark, sf):
    return reports.html_lines(_cluster_lines(spark, sf), "News Topic Cluster Analysis")
