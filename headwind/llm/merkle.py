"""A Merkle manifest of a table: leaves, one tree for each language, a root over them, and an inclusion proof per row.

Nodes of a level are rows ``(tree, i, h, n)``: the tree's number, the place in its level, the digest, the level's width.
A level is one self-join: every node meets its siblings at computed places (``i XOR 1`` for two, shifted slots inside the
run of ``arity`` otherwise), then the rows of slot zero emit the parents. Keys of these joins are unique, so a language
that holds most rows is as even as any other. Each level is written to the shared folder; all levels together hold less
than twice the leaves. On the way back every node takes its parent's path and puts its own siblings before it, so proofs
also cost one join a level.

Defined cases: null columns hash as ``-``; a null language is a tree of its own and comes first; null ids come before all
others and are never tampered with; rows of one id are ordered by their leaves, equal rows stand next to each other and
each have a proof; an empty table gives an empty result; a single leaf is its own subroot and root; extra columns are
ignored, whatever their names; texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwind.llm.tables import keep
from headwind.operators.rows import with_row_index

ARITY = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
STEP = "array<struct<slot:int,sibs:array<string>>>"
CUT_EVERY = 6  # levels on the way down between two written tables


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def framed(value: Column) -> Column:
    """A field as it is hashed: its length in bytes, a colon and the value, or ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return digest(F.concat(*[framed(values[c]) for c in FIELDS]))


def with_siblings(level: DataFrame, arity: int) -> DataFrame:
    """Every node of a level next to its siblings, by self-joins on computed places: ``sibs`` holds (slot, digest) in order."""
    slot = F.pmod("i", F.lit(arity)).cast("int")
    out, found = level.withColumn("slot", slot), []
    for shift in range(1, arity):
        there = F.col("i").bitwiseXOR(1) if arity == 2 else F.col("i") - F.col("slot") + F.pmod(F.col("slot") + shift, F.lit(arity))
        other = level.where("n > 1").select(F.col("tree").alias("_t"), F.col("i").alias("_i"), F.col("h").alias(f"_h{shift}"), F.col("i").alias(f"_p{shift}"))
        out = out.withColumn("_there", there)
        out = out.join(other, (F.col("tree") == F.col("_t")) & (F.col("_there") == F.col("_i")), "left").drop("_t", "_i", "_there")
        found.append(F.when(F.col(f"_h{shift}").isNotNull(), F.struct(F.pmod(f"_p{shift}", F.lit(arity)).cast("int").alias("slot"), F.col(f"_h{shift}").alias("h"))))
    ordered = F.array_sort(F.array_compact(F.array(*found)))
    return out.withColumn("sibs", F.transform(ordered, lambda s: s["h"])).drop(*[f"_{x}{s}" for x in "hp" for s in range(1, arity)])


def parents(joined: DataFrame, arity: int) -> DataFrame:
    """The next level: the rows of slot zero hash their run."""
    runs = joined.where("n > 1 and slot = 0")
    return runs.select(
        "tree", F.floor(F.col("i") / arity).cast("long").alias("i"),
        digest(F.concat(F.col("h"), F.array_join("sibs", ""))).alias("h"),
        F.ceil(F.col("n") / arity).cast("long").alias("n"),
    )


def grow(nodes: DataFrame, widest: int, arity: int) -> list[DataFrame]:
    """All levels from the leaves up, each with siblings and written once; the widest tree gives their number."""
    levels, level = [], nodes
    while True:
        levels.append(keep(with_siblings(level, arity), "merkle-level"))
        if widest <= 1:
            return levels
        level, widest = parents(levels[-1], arity), -(-widest // arity)


def tops(levels: list[DataFrame]) -> DataFrame:
    """``(tree, h)``: what remains of every tree."""
    out = None
    for level in levels:
        here = level.where("n = 1").select("tree", "h")
        out = here if out is None else out.unionByName(here)
    return out


def descend(levels: list[DataFrame], crowns: DataFrame, arity: int) -> DataFrame:
    """The leaves with ``path`` (steps from the leaf to the root) and ``subroot``; ``crowns`` has both for each tree's top."""
    own = F.array(F.struct(F.col("slot"), F.col("sibs")))
    below = None
    for at, level in reversed(list(enumerate(levels))):
        done = level.where("n = 1").join(crowns.withColumnRenamed("path", "up"), "tree").withColumn("path", F.col("up").cast(STEP)).drop("up")
        if below is not None:
            above = below.select("tree", F.col("i").alias("_i"), F.col("path").alias("_up"), "subroot")
            children = level.where("n > 1").withColumn("_i", F.floor(F.col("i") / arity).cast("long"))
            met = children.join(above, ["tree", "_i"]).withColumn("path", F.concat(own, "_up").cast(STEP)).drop("_i", "_up")
            done = done.unionByName(met)
        below = keep(done, "merkle-path") if at and at % CUT_EVERY == 0 else done
    return below


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def step(acc: Column, s: Column) -> Column:
        left = F.array_join(F.slice(s["sibs"], F.lit(1), s["slot"]), "")
        right = F.array_join(F.filter(s["sibs"], lambda _, k: k >= s["slot"]), "")
        return digest(F.concat(left, acc, right))

    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, arity: int = ARITY, tampered: Column | None = None) -> DataFrame:
    """One row per document: leaf, subroot, root, proof digest, and whether the leaf as it is now still leads to the root.

    ``tampered`` says in which rows ``n_chars`` was raised by one after the manifest was made (default: none).
    """
    spark = docs.sparkSession
    values = {c: F.col(c) for c in FIELDS}
    changed = leaf(values | {"n_chars": F.col("n_chars") + 1})
    now = F.col("leaf") if tampered is None else F.when(tampered, changed).otherwise(F.col("leaf"))
    hashed = docs.select(*FIELDS).withColumn("leaf", leaf(values)).select("doc_id", "lang", "leaf", now.alias("now"))
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("_row").asc()]
    placed = with_row_index(hashed.withColumn("_row", F.monotonically_increasing_id()), order, "_at").drop("_row")
    trees = keep(placed.groupBy("lang").agg(F.min("_at").alias("tree"), F.count("*").alias("n")), "merkle-trees")
    widest = trees.agg(F.max("n")).first()[0]
    if widest is None:
        return spark.createDataFrame([], SCHEMA)
    named = trees.withColumnRenamed("lang", "_lang")
    nodes = placed.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "tree", (F.col("_at") - F.col("tree")).alias("i"), F.col("leaf").alias("h"), "n", "doc_id", "now"
    )
    levels = grow(nodes, widest, arity)
    subroots = with_row_index(tops(levels).withColumnRenamed("tree", "of"), ["of"], "i")
    width = subroots.count()
    ring = subroots.select(F.lit(0).cast("long").alias("tree"), "i", "h", F.lit(width).cast("long").alias("n"), "of")
    upper = grow(ring, width, arity)
    root = tops(upper).first()["h"]
    end = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast(STEP).alias("path"), F.lit(root).alias("subroot"))
    crowns = descend(upper, end, arity).select(F.col("of").alias("tree"), "path", F.col("h").alias("subroot"))
    crowns = keep(crowns, "merkle-crowns")
    leaves = descend(levels, crowns, arity)
    proof = F.array_join(F.flatten(F.transform("path", lambda s: s["sibs"])), "")
    return leaves.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root).alias("root"), digest(proof).alias("proof_sha256"),
        fold(F.col("now"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_rows() -> Column:
    """The rows whose ``n_chars`` the registered query raises."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, F.lit(False))


def manifest_sql() -> str:
    """The same rows in DuckDB SQL, for two children a node."""
    fields = " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')" for c in FIELDS)
    changed = fields.replace("n_chars::varchar", "(n_chars + 1)::varchar")
    table = "[" + ", ".join(str(_crc_nibble(k)) for k in range(16)) + "]"
    half = lambda c: f"xor({c} >> 4, {table}[(({c}) & 15) + 1])"
    crc = (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]), "
        f"lambda c, b: {half(half('xor(c, b)'))}))"
    )
    return f"""
with recursive base as (
    select doc_id, lang, sha256({fields}) as leaf, case when {crc} % 7 = 0 then sha256({changed}) end as changed from documents
), placed as (
    select doc_id, leaf, coalesce(changed, leaf) as now, dense_rank() over (order by lang nulls first) - 1 as tree,
        row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n
    from base
), nodes as (
    select tree, 0 as lvl, i, leaf as h, n from placed
    union all
    select tree, lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from nodes where n > 1 group by tree, lvl, i // 2, n
), subroots as (
    select tree, h, lvl as height, count(*) over () as width from nodes where n = 1
), ring as (
    select 0 as lvl, tree as i, h, width as n from subroots
    union all
    select lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from ring where n > 1 group by lvl, i // 2, n
), tip as (
    select h as root, lvl as top from ring where n = 1
), steps as (
    select p.tree, p.i, s.lvl as pos, (p.i >> s.lvl) % 2 as slot, o.h as sib
    from placed p join subroots r using (tree) join (select distinct lvl from nodes) s on s.lvl < r.height
    left join nodes o on o.tree = p.tree and o.lvl = s.lvl and o.i = xor(p.i >> s.lvl, 1)
    union all
    select p.tree, p.i, r.height + s.lvl, (p.tree >> s.lvl) % 2, o.h
    from placed p join subroots r using (tree) join (select distinct lvl from ring) s on s.lvl < (select top from tip)
    left join ring o on o.lvl = s.lvl and o.i = xor(p.tree >> s.lvl, 1)
), folded as (
    select tree, i, 0 as pos, now as h from placed
    union all
    select f.tree, f.i, f.pos + 1, sha256(case when s.slot = 1 then coalesce(s.sib, '') || f.h else f.h || coalesce(s.sib, '') end)
    from folded f join steps s on s.tree = f.tree and s.i = f.i and s.pos = f.pos
), proofs as (
    select tree, i, sha256(coalesce(string_agg(sib, '' order by pos), '')) as proof, count(*) as length from steps group by tree, i
)
select p.doc_id, p.leaf, r.h as subroot, t.root, coalesce(q.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = t.root as verified
from placed p join subroots r using (tree) cross join tip t left join proofs q on q.tree = p.tree and q.i = p.i
join folded f on f.tree = p.tree and f.i = p.i and f.pos = coalesce(q.length, 0)
"""


def _crc_nibble(k: int) -> int:
    for _ in range(4):
        k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
    return k
