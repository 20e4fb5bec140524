"""Queries on fetched pages and annotated articles: ingest, parsing, counts, profiles, annotation, text features."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from headwind.functions import parse
from headwind.functions.text import terms, tokens
from headwind.operators import aggregate as agg
from headwind.operators import annotate, features, ingest, rows
from headwind.plans.catalog_market import r6
from headwind.plans.fixtures import ARTICLES, NEWS, PAGES, articles, news, pages_of_events, table
from headwind.plans.registry import query
from headwind.session import cut


def prepared(spark, sf):
    return parse.preprocess(articles(spark, sf))


def items(spark, sf):
    return ingest.flatten_pages(pages_of_events(spark, sf), ("page",))


def plain_time(df):
    """Instants as zone-less UTC times, the way the tables hold them."""
    return df.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


# --- ingest ---------------------------------------------------------------------------------------------------------

_ITEM = "page, pos, title, published_at, sentiment, url, array_to_string(string_split(currencies, ','), ' ') as currencies, source"


@query("a4_b14_b15_b16_flatten_pages", f"with {PAGES} select {_ITEM} from items")
def _(spark, sf):
    return plain_time(items(spark, sf).withColumn("currencies", F.array_join("currencies", " ")))


@query(
    "a5_time_range",
    f"""with {PAGES} select url, published_at from items
    where published_at >= timestamp '2024-01-10 00:00:00' and published_at <= timestamp '2024-01-20 12:00:00'""",
)
def _(spark, sf):
    ts = F.col("published_at")
    lo, hi = F.lit("2024-01-10T00:00:00Z").cast("timestamp"), F.lit("2024-01-20T12:00:00Z").cast("timestamp")
    return plain_time(items(spark, sf).where(ingest.in_range(ts, lo, hi)).select("url", "published_at"))


@query(
    "a5_last_thirty_days",
    f"""with {PAGES}, n as (select max(published_at) as now from items) select url from items, n
    where published_at >= now - interval 30 day and published_at <= now""",
)
def _(spark, sf):
    all_items = items(spark, sf)
    lo, hi = ingest.last_days(all_items.agg(F.max("published_at").alias("now")).scalar(), 30)
    return all_items.where(ingest.in_range(F.col("published_at"), lo, hi)).select("url")


@query(
    "a6_stop_early_compat",
    f"""with {PAGES} select url, page from items
    where page < (select min(page) from items where published_at < timestamp '2024-01-12 00:00:00')""",
)
def _(spark, sf):
    start = F.lit("2024-01-12T00:00:00Z").cast("timestamp")
    return ingest.stop_early(items(spark, sf), "published_at", start, mode="compat").select("url", "page")


@query("a6_stop_early_filter", f"with {PAGES} select url, page from items where published_at >= timestamp '2024-01-12 00:00:00'")
def _(spark, sf):
    start = F.lit("2024-01-12T00:00:00Z").cast("timestamp")
    return ingest.stop_early(items(spark, sf), "published_at", start).select("url", "page")


@query(
    "a7_page_cap",
    f"""with {PAGES}, k as (select * from items where page <= 5 and published_at >= timestamp '2024-01-29 00:00:00'),
    p as (select p.page, (select count(*) from k where k.page = p.page) as n from range(1, 6) p(page))
    select url, page from k where page < coalesce((select min(page) from p where n = 0), 6)""",
)
def _(spark, sf):
    start = F.lit("2024-01-29T00:00:00Z").cast("timestamp")
    return ingest.limit_pages(items(spark, sf), "published_at", start, None, 5).select("url", "page")


@query(
    "a8_mentions_any",
    f"with {PAGES} select url from items where list_has_any(string_split(currencies, ','), ['BTC', 'XRP'])",
)
def _(spark, sf):
    return items(spark, sf).where(ingest.mentions_any(F.col("currencies"), ["BTC", "XRP"])).select("url")


@query(
    "a9_date_pairs",
    """with b as (select cast(min(ts) as date) as lo, cast(max(ts) as date) as hi from events),
    d as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as range_start, hi from b)
    select range_start, least(range_start + 1, hi) as range_end from d""",
)
def _(spark, sf):
    bounds = table(spark, sf, "events").agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    return ingest.split_range(bounds, "lo", "hi")


@query(
    "a10_backfill_half_open",
    """select cast(ts as date) as range_start, count(*) as n, min(event_id) as first_id from events
    where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-25 00:00:00' group by 1""",
)
def _(spark, sf):
    lo, hi = F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date")
    tagged = ingest.backfill(table(spark, sf, "events"), "ts", lo, hi)
    return tagged.groupBy("range_start").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "a10_backfill_compat",
    """with d as (select cast(unnest(generate_series(date '1996-01-01', date '1999-01-01', interval 1 day)) as date) as s),
    p as (select s as range_start, least(s + 1, date '1999-01-01') as e from d)
    select range_start, count(*) as n, sum(o_orderkey)::bigint as keys from p join orders
      on o_orderdate >= range_start and o_orderdate <= e group by range_start""",
)
def _(spark, sf):
    # order dates are all midnights: every order falls into two ranges
    lo, hi = F.lit("1996-01-01").cast("date"), F.lit("1999-01-01").cast("date")
    tagged = ingest.backfill(table(spark, sf, "orders"), "o_orderdate", lo, hi, mode="compat")
    return tagged.groupBy("range_start").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("a11_deduplicate", "select text, min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by text")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return rows.deduplicate(docs, ["text"], ["doc_id"])


@query(
    "a12_exact_sample",
    """select doc_id from (select doc_id, row_number() over (order by md5(cast(doc_id as varchar) || ':42'), doc_id) as rn,
      count(*) over () as n from documents) where rn <= floor(n * 0.25)""",
)
def _(spark, sf):
    return rows.exact_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.25)


@query(
    "f10_latest_items",
    f"with {PAGES} select url, published_at from items order by published_at desc, url limit 5",
)
def _(spark, sf):
    return plain_time(rows.latest(items(spark, sf), [F.desc("published_at"), F.asc("url")]).select("url", "published_at"))


@query(
    "k4_union_all",
    "select lang, count(*) as n from (select lang from documents union all select role from conversations) group by lang",
)
def _(spark, sf):
    both = table(spark, sf, "documents").select("lang").unionByName(
        table(spark, sf, "conversations").select(F.col("role").alias("lang"))
    )
    return both.groupBy("lang").agg(F.count("*").alias("n"))


# --- parsing --------------------------------------------------------------------------------------------------------


@query(
    "b1_sentiment_defaults",
    f"with {ARTICLES} select row_id, sentiment_class, polarity as sentiment_polarity, subjectivity as sentiment_subjectivity from articles",
)
def _(spark, sf):
    return prepared(spark, sf).select("row_id", "sentiment_class", "sentiment_polarity", "sentiment_subjectivity")


@query(
    "b2_sentiment_literal",
    f"""with {ARTICLES} select row_id, case when quality is null then null else sentiment_class end as class,
      case when quality = 1 then polarity end as polarity, case when quality is not null then subjectivity end as subjectivity from articles""",
)
def _(spark, sf):
    # unlabelled articles lose their sentiment cell, low-quality ones their polarity
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    cell = F.when(F.col("quality") == 1, F.col("sentiment")).when(
        F.col("quality") == 0, F.regexp_replace("sentiment", r"'polarity': [^,]+", "'polarity': None")
    )
    raw = articles(spark, sf).join(labelled, "row_id", "left")
    parsed = raw.select("row_id", parse.parse_sentiment(cell, defaults=False).alias("s"))
    return parsed.select("row_id", "s.class", "s.polarity", "s.subjectivity")


@query(
    "b3_b4_b5_list_cells",
    f"""with {ARTICLES} select row_id, len(title_verbs) as title_verbs_count, array_to_string(title_verbs, ' ') as title_verbs_text,
      len(title_adjectives) as title_adjectives_count, array_to_string(title_adjectives, ' ') as title_adjectives_text from articles""",
)
def _(spark, sf):
    p = prepared(spark, sf)
    counts = [F.col(c).cast("long").alias(c) for c in ("title_verbs_count", "title_adjectives_count")]
    return p.select("row_id", *counts, "title_verbs_text", "title_adjectives_text")


@query(
    "b6_tone_scores",
    f"""with {ARTICLES} select row_id, case title_tonality when 'positive' then 1 when 'negative' then -1 else 0 end as title_tonality_score,
      case text_tonality when 'positive' then 1 when 'negative' then -1 else 0 end as text_tonality_score from articles""",
)
def _(spark, sf):
    return prepared(spark, sf).select("row_id", "title_tonality_score", "text_tonality_score")


@query(
    "b7_b8_joined_texts",
    f"""with {ARTICLES}, t as (select row_id, array_to_string(title_verbs, ' ') as tv, array_to_string(title_adjectives, ' ') as ta,
      array_to_string(text_verbs, ' ') as xv, array_to_string(text_adjectives, ' ') as xa from articles)
    select row_id, tv || ' ' || ta || ' ' || xv || ' ' || xa as all_linguistic_features,
      concat_ws(' ', nullif(tv, ''), nullif(xv, '')) as all_verbs, concat_ws(' ', nullif(ta, ''), nullif(xa, '')) as all_adjectives from t""",
)
def _(spark, sf):
    return prepared(spark, sf).select("row_id", "all_linguistic_features", "all_verbs", "all_adjectives")


@query("b9_categories", f"with {ARTICLES} select row_id, subject, crypto_category from articles")
def _(spark, sf):
    return prepared(spark, sf).select("row_id", "subject", "crypto_category")


@query(
    "b17_b18_usable_prefixes",
    f"""with {ARTICLES} select row_id, length(text[1:500]) as n, md5(text[1:500]) as digest from articles
    where title is not null and text is not null""",
)
def _(spark, sf):
    cut = F.substring("text", 1, 500)
    usable = articles(spark, sf).where("title is not null and text is not null")
    return usable.select("row_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("digest"))


@query(
    "b19_fill_missing",
    """select d.doc_id, coalesce(cast(l.quality as varchar), 'unknown') as quality, coalesce(l.toxic, 0) as toxic
    from documents d left join labels l using (doc_id)""",
)
def _(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    texts = joined.withColumn("quality", F.col("quality").cast("string"))
    return parse.fill_missing(texts, numbers=["toxic"], named={"quality": "unknown"})


@query(
    "b22_name_texts",
    """select p_partkey, upper(p_name) as upper_name,
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as title_name,
      upper(p_type[1:1]) || lower(p_type[2:]) as capital_type,
      case when length(p_name || ' - ' || p_brand || ' - ' || p_type || ' - ' || p_name || ' - ' || p_name) > 60
           then (p_name || ' - ' || p_brand || ' - ' || p_type || ' - ' || p_name || ' - ' || p_name)[1:57] || '...'
           else p_name || ' - ' || p_brand || ' - ' || p_type || ' - ' || p_name || ' - ' || p_name end as short_name from part""",
)
def _(spark, sf):
    long_name = F.concat_ws(" - ", "p_name", "p_brand", "p_type", "p_name", "p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.upper("p_name").alias("upper_name"),
        parse.title_case(F.col("p_name")).alias("title_name"),
        parse.capitalize(F.col("p_type")).alias("capital_type"),
        parse.shorten(long_name).alias("short_name"),
    )


# --- counts, cross-tabs and profiles -------------------------------------------------------------------------------


@query(
    "e7_value_counts_top3",
    f"""with {ARTICLES} select cluster, source, n, rank from (select cluster, source, count(*) as n,
      cast(row_number() over (partition by cluster order by count(*) desc, source) as integer) as rank from articles group by cluster, source) where rank <= 3""",
)
def _(spark, sf):
    return agg.value_counts(articles(spark, sf), "source", ["cluster"], 3)


@query(
    "e7_f9_value_counts_global",
    f"""with {ARTICLES} select title_tonality, count(*) as n, cast(row_number() over (order by count(*) desc, title_tonality) as integer) as rank
    from articles where title_tonality is not null group by 1 order by n desc limit 2""",
)
def _(spark, sf):
    return agg.value_counts(articles(spark, sf), "title_tonality", k=2)


@query(
    "e8_shares",
    f"""with {PAGES} select sentiment, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from items group by 1""",
)
def _(spark, sf):
    return agg.shares(items(spark, sf), "sentiment").select("sentiment", "n", r6("pct"))


@query("e2_e3_crosstab", f"with {ARTICLES} select cluster, title_tonality, count(*) as n from articles where title_tonality is not null group by all")
def _(spark, sf):
    return agg.crosstab(articles(spark, sf), "cluster", "title_tonality")


@query(
    "e4_b21_crosstab_pct",
    f"""with {ARTICLES} select cluster, crypto_category, count(*) as n,
      round(count(*) * 100.0 / sum(count(*)) over (partition by cluster), 6) as pct from articles group by cluster, crypto_category""",
)
def _(spark, sf):
    return agg.crosstab_pct(prepared(spark, sf), "cluster", "crypto_category").select("cluster", "crypto_category", "n", r6("pct"))


_PAIR = """select '{a}|{b}' as pair, cast({a} as varchar) as a, cast({b} as varchar) as b, count(*) as n,
  round(count(*) * 100.0 / sum(count(*)) over (partition by {a}), 6) as pct from articles group by {a}, {b}"""


@query(
    "e5_pairwise_tables",
    f"with {ARTICLES} "
    + " union all ".join(_PAIR.format(a=a, b=b) for a, b in [("cluster", "subject"), ("cluster", "source"), ("subject", "source")]),
)
def _(spark, sf):
    out = agg.pairwise_tables(articles(spark, sf), ["cluster", "subject", "source"])
    return out.select("pair", "a", "b", F.col("n"), r6("pct"))


@query(
    "e6_k1_top_columns",
    f"""with {ARTICLES}, c as (select cluster, source, count(*) as n, count(*) * 100.0 / sum(count(*)) over (partition by cluster) as pct
      from articles group by cluster, source), t as (select source from articles group by 1 order by count(*) desc, source limit 10)
    select cluster, source, n, round(pct, 6) as pct from c where source in (select source from t)""",
)
def _(spark, sf):
    return agg.top_columns(articles(spark, sf), "cluster", "source", 10).select("cluster", "source", "n", r6("pct"))


def _profile_sql(by: str, means: list[str], dists: dict[str, int | None]) -> str:
    parts = [f"select {by}, 'size' as section, 0 as ord, null as key, count(*) as n, null as value from articles group by {by}"]
    parts += [f"select {by}, 'avg_sentiment_{m}', 0, null, null, round(avg({m}), 6) + 0.0 from articles group by {by}" for m in means]
    for c, k in dists.items():
        parts.append(
            f"""select {by}, section, ord, key, n, round(n * 100.0 / size, 6) from (select {by}, '{c}' as section,
            row_number() over (partition by {by} order by count(*) desc, {c}) as ord, {c} as key, count(*) as n
            from articles where {c} is not null group by {by}, {c}) join (select {by}, count(*) as size from articles group by {by}) using ({by})
            {f'where ord <= {k}' if k else ''}"""
        )
    return " union all ".join(parts)


def _profile_query(name: str, by: str, means: list[str], dists: dict[str, int | None]) -> None:
    body = _profile_sql(by, means, dists)
    sql = f"with {ARTICLES} select {by}, section, cast(ord as bigint) as ord, key, n, value from ({body})"

    @query(name, sql)
    def _(spark, sf):
        out = agg.profile(prepared(spark, sf), by, [f"sentiment_{m}" for m in means], dists)
        return out.select(by, "section", "ord", "key", "n", r6("value"))


_BOTH = ["polarity", "subjectivity"]
_profile_query(
    "e9_cluster_profile", "cluster", _BOTH,
    {"sentiment_class": None, "subject": 3, "source": 3, "title_tonality": None, "text_tonality": None},
)
_profile_query(
    "e11_sentiment_profile", "cluster", _BOTH, {"title_tonality": 1, "text_tonality": 1, "crypto_category": 5, "source": 5}
)
_profile_query("e12_subject_profile", "subject", ["polarity"], {"crypto_category": None, "sentiment_class": None, "source": 3})
_profile_query("e14_source_profile", "source", _BOTH, {"source": 5, "crypto_category": 3})


@query(
    "e13_list_elements",
    f"""with {ARTICLES}, x as (select cluster, unnest(title_verbs) as item from articles)
    select * from (select cluster, item, count(*) as n, cast(row_number() over (partition by cluster order by count(*) desc, item) as integer) as rank
      from x group by cluster, item) where rank <= 5""",
)
def _(spark, sf):
    return agg.element_counts(prepared(spark, sf), ["cluster"], "title_verbs_parsed")


@query(
    "e15_group_means",
    f"""with {ARTICLES} select source, count(*) as size, round(avg(polarity), 6) + 0.0 as avg_sentiment_polarity,
      round(avg(subjectivity), 6) + 0.0 as avg_sentiment_subjectivity from articles group by 1""",
)
def _(spark, sf):
    out = agg.group_means(prepared(spark, sf), "source", ["sentiment_polarity", "sentiment_subjectivity"])
    return out.select("source", "size", r6("avg_sentiment_polarity"), r6("avg_sentiment_subjectivity"))


@query(
    "e16_best_and_worst",
    f"""with {NEWS}, m as (select source, avg(polarity) as m from news group by 1)
    select (select source from m order by m desc, source limit 1) as best, round((select max(m) from m), 6) + 0.0 as best_mean,
      (select source from m order by m, source limit 1) as worst, round((select min(m) from m), 6) + 0.0 as worst_mean""",
)
def _(spark, sf):
    out = agg.best_and_worst(news(spark, sf), "source", "polarity")
    return out.select("best", r6("best_mean"), "worst", r6("worst_mean"))


@query("e25_distinct_clusters", f"with {ARTICLES} select distinct cluster from articles")
def _(spark, sf):
    return articles(spark, sf).select("cluster").distinct()


@query(
    "f11_sample_titles",
    f"""with {ARTICLES} select cluster, row_id, rank from (select cluster, row_id,
      cast(row_number() over (partition by cluster order by md5(cast(row_id as varchar) || ':42'), row_id) as integer) as rank from articles) where rank <= 5""",
)
def _(spark, sf):
    return rows.sample_per_group(articles(spark, sf).select("cluster", "row_id"), ["cluster"], "row_id")


@query("d7_label_lookup", "select n_nationkey, n_name, r_name from nation left join region on n_regionkey = r_regionkey")
def _(spark, sf):
    names = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf, "nation").join(names, "n_regionkey", "left").select("n_nationkey", "n_name", "r_name")


# --- annotation -----------------------------------------------------------------------------------------------------

_TALK = """talk as (select conv_id * 1000 + turn as key, split_part(text, chr(10), 1) as title, text, cast(row_number() over (order by conv_id, turn) - 1 as bigint) as i,
  count(*) over () as total from conversations),
placed as (select *, i // 10 as batch, i % 10 as slot from talk)"""


def talk_of(conversations):
    return conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", "conv_id", "turn"
    )


def _talk(spark, sf):
    return talk_of(table(spark, sf, "conversations"))


_VERBS = ["is", "and", "the", "und", "der", "la", "le", "el"]
_ADJECTIVES = ["re", "on", "en", "de"]


def _annotator():
    return annotate.lexicon_annotator(set(_VERBS), set(_ADJECTIVES), {"the", "la", "en"}, {"is", "der", "de"})


@query("c1_batches", f"with {_TALK} select batch, cast(min(key) as bigint) as first_key, count(*) as n from placed where i < total - total % 10 and title is not null and text is not null group by batch")
def _(spark, sf):
    batches = annotate.make_batches(_talk(spark, sf), "key", ["conv_id", "turn"], drop_tail=True)
    return batches.select(
        "batch", F.array_min(F.transform("records", lambda r: r["key"])).alias("first_key"), F.size("records").cast("long").alias("n")
    )


@query(
    "c2_prompts",
    f"""with {_TALK} select batch, md5(string_agg('RECORD ' || (slot + 1) || ':' || chr(10) || 'Title: "' || title || '"' || chr(10) || 'Text: "' || text[1:500] || '"',
      chr(10) || chr(10) order by slot) || chr(10) || chr(10) || '{annotate.INSTRUCTIONS}') as digest from placed group by batch""",
)
def _(spark, sf):
    batches = annotate.make_batches(_talk(spark, sf), "key", ["conv_id", "turn"])
    return batches.select("batch", F.md5(annotate.prompt_text(F.col("records"))).alias("digest"))


def _in(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def lexicon_sql(rows: str) -> str:
    return f"""with {_TALK}, w as (select key, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]{{2,}}') as tw,
  regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as xw from {rows}),
s as (select key, list_filter(tw, lambda x: x in {_in(_VERBS)}) as tv, list_filter(tw, lambda x: x in {_in(_ADJECTIVES)}) as ta,
  list_filter(xw, lambda x: x in {_in(_VERBS)})[1:10] as xv, list_filter(xw, lambda x: x in {_in(_ADJECTIVES)})[1:10] as xa,
  len(list_filter(tw, lambda x: x in ['the', 'la', 'en'])) - len(list_filter(tw, lambda x: x in ['is', 'der', 'de'])) as ts,
  len(list_filter(xw, lambda x: x in ['the', 'la', 'en'])) - len(list_filter(xw, lambda x: x in ['is', 'der', 'de'])) as xs from w)"""


_LEXICON_SQL = lexicon_sql("placed")
_TONE = "case when {0} > 0 then 'positive' when {0} < 0 then 'negative' else 'neutral' end"
_LEXICON_OUT = f"""array_to_string(tv, ' ') as title_verbs, array_to_string(ta, ' ') as title_adjectives, array_to_string(xv, ' ') as text_verbs,
  array_to_string(xa, ' ') as text_adjectives, {_TONE.format('ts')} as title_tonality, {_TONE.format('xs')} as text_tonality"""


def _readable(df):
    lists = [F.array_join(parse.parse_list(c), " ").alias(c) for c in ("title_verbs", "title_adjectives", "text_verbs", "text_adjectives")]
    return df.select("key", *lists, "title_tonality", "text_tonality")


@query("c3_c5_c6_c7_annotate", f"{_LEXICON_SQL} select key, {_LEXICON_OUT} from s")
def _(spark, sf):
    answered = annotate.annotate(_talk(spark, sf), _annotator(), "key", ["conv_id", "turn"])
    good, _ = annotate.split_outcomes(answered)
    return _readable(annotate.scatter(good))


@query(
    "c4_c6_failed_batches",
    f"with {_TALK} select batch, count(*) as n, 'no JSON array in the answer' as error from placed group by batch having count(*) filter (role_like) > 0".replace(
        "role_like", "text like '%ß%'"
    ),
)
def _(spark, sf):
    # an annotator that answers in prose whenever a record holds a certain letter
    plain = _annotator()

    def moody(prompt, records):
        return "I would rather not." if any("ß" in r["text"] for r in records) else plain(prompt, records)

    answered = annotate.annotate(_talk(spark, sf), moody, "key", ["conv_id", "turn"])
    _, bad = annotate.split_outcomes(answered)
    return bad.select("batch", F.size("records").cast("long").alias("n"), "error")


@query("c4_calls_in_time", f"{_LEXICON_SQL} select key, {_LEXICON_OUT} from s where key not in (select key from placed where batch in (select batch from placed where text like '%ß%'))")
def _(spark, sf):
    """Several calls at once in a task, each with a time limit; batches whose calls never answer are left out, the others kept."""
    import threading

    plain = _annotator()

    def stuck(prompt, records):
        if any("ß" in r["text"] for r in records):
            threading.Event().wait(20)
        return plain(prompt, records)

    answered = annotate.annotate(_talk(spark, sf), stuck, "key", ["conv_id", "turn"], tries=1, limit=3.0, pool=32)
    return _readable(annotate.scatter(annotate.split_outcomes(answered)[0]))


@query("c11_throughput", f"with {_TALK} select count(*) as n, count(distinct batch) as batches, 0::bigint as failed, true as timed from placed where title is not null and text is not null")
def _(spark, sf):
    """Rows, batches and seconds as the annotating job itself counted them."""
    seen = Observation()
    annotate.annotate(_talk(spark, sf), _annotator(), "key", ["conv_id", "turn"], measure=seen)
    row = annotate.measured(spark, seen)
    timed = (F.col("seconds") > 0) & (F.col("call_seconds") > 0) & (F.abs(F.col("seconds_per_row") * F.col("n") - F.col("seconds")) < 1e-6)
    return row.select("n", "batches", "failed", timed.alias("timed"))


@query(
    "c9_pending_after_resume",
    f"""with {_TALK} select key from talk where i >= total - total % 10""",
)
def _(spark, sf):
    # a first run that leaves the short last batch for later
    talk = _talk(spark, sf)
    good, _ = annotate.split_outcomes(annotate.annotate(talk, _annotator(), "key", ["conv_id", "turn"], drop_tail=True))
    return annotate.pending(talk, annotate.scatter(good), "key").select("key")


@query("c8_c10_write_back", f"{_LEXICON_SQL} select t.key, coalesce(title_tonality, 'none') as title_tonality from talk t left join (select key, {_LEXICON_OUT} from s) using (key)")
def _(spark, sf):
    talk = _talk(spark, sf)
    good, _ = annotate.split_outcomes(annotate.annotate(talk, _annotator(), "key", ["conv_id", "turn"]))
    whole = annotate.write_back(talk, annotate.scatter(good), "key")
    return whole.select("key", F.coalesce("title_tonality", F.lit("none")).alias("title_tonality"))


# --- text features --------------------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_STOP = ["the", "and", "is", "of", "le", "la", "de", "der", "die", "und", "el"]
_NO_STOP = f"list_filter({_WORDS}, lambda x: x not in {_in(_STOP)})"
_TERMS = f"doc_words as (select doc_id, {_NO_STOP} as w from documents), doc_terms as (select doc_id, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as t from doc_words)"


def _docs(spark, sf, ngrams=(1, 2)):
    return table(spark, sf, "documents").select("doc_id", terms(F.col("text"), _STOP, ngrams).alias("terms"))


@query("h1_token_counts", f"select doc_id, len({_WORDS}) as n, md5(array_to_string({_WORDS}, ' ')) as digest from documents")
def _(spark, sf):
    t = tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest")
    )


@query("h2_h3_terms", f"with {_TERMS} select doc_id, len(t) as n, md5(array_to_string(t, ' ')) as digest from doc_terms")
def _(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", " ")).alias("digest")
    )


_VOCAB = """x as (select doc_id, unnest(t) as term from doc_terms), v as (select term, count(*) as n, count(distinct doc_id) as df
  from x group by term order by n desc, term limit 100)"""


@query("h4_vocabulary", f"with {_TERMS}, {_VOCAB} select * from v")
def _(spark, sf):
    return features.pair_vocabulary(_docs(spark, sf, (1, 1)), "terms", 100)


@query(
    "h5_bounded_vocabulary",
    f"""with {_TERMS}, x as (select doc_id, unnest(w) as term from doc_words)
    select term, count(*) as n, count(distinct doc_id) as df from x group by term
    having count(distinct doc_id) >= 2 and count(distinct doc_id) <= 0.3 * (select count(*) from documents)""",
)
def _(spark, sf):
    return features.vocabulary(_docs(spark, sf, (1, 1)), "terms", min_df=2, max_df=0.3)


@query(
    "h6_term_counts",
    f"with {_TERMS}, {_VOCAB} select doc_id, term, count(*) as tf from x where term in (select term from v) group by all",
)
def _(spark, sf):
    docs = _docs(spark, sf)
    folded = cut(features.fold_terms(docs, "doc_id", "terms", features.frequent_terms(docs, "terms", 100)))
    return features.term_counts(folded, "doc_id", features.vocabulary_of(folded, 100))


_TFIDF = f"""with {_TERMS}, {_VOCAB}, c as (select doc_id, term, count(*) as tf from x where term in (select term from v) group by all),
  r as (select doc_id, term, tf * (ln((1.0 + (select count(*) from documents)) / (1 + df)) + 1) as w from c join v using (term))
  select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from r"""


@query("h7_tfidf_long", _TFIDF)
def _(spark, sf):
    docs = _docs(spark, sf)
    folded = cut(features.fold_terms(docs, "doc_id", "terms", features.frequent_terms(docs, "terms", 100)))
    n_docs = table(spark, sf, "documents").agg(F.count("*").alias("n")).scalar()
    out = features.tfidf_long(folded, "doc_id", features.vocabulary_of(folded, 100), n_docs)
    return out.select("doc_id", "term", r6("weight"))


@query("h7_tfidf_vectors", _TFIDF)
def _(spark, sf):
    docs = _docs(spark, sf)
    space = features.TermSpace.fit(docs, "terms", 100)
    vectors = space.tfidf(docs, "terms", "v").select("doc_id", F.posexplode(vector_to_array("v")).alias("i", "weight"))
    word = F.element_at(F.array(*[F.lit(w) for w in space.words]), F.col("i") + 1)
    return vectors.where("weight > 0").select("doc_id", word.alias("term"), r6("weight"))


@query(
    "h8_one_hot",
    """with s as (select doc_id, coalesce(case when quality = 1 then source end, 'unknown') as source from documents left join labels using (doc_id)),
    l as (select source, row_number() over (order by source) - 1 as slot from (select distinct source from s)) select doc_id, slot from s join l using (source)""",
)
def _(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    some = labelled.select("doc_id", F.when(F.col("quality") == 1, F.col("source")).alias("source"))
    encoded, _ = features.one_hot(some, "source", "v")
    slot = F.array_position(vector_to_array("v"), F.lit(1.0)) - 1
    return encoded.select("doc_id", slot.alias("slot"))


@query(
    "h9_z_scores",
    f"""with {ARTICLES}, s as (select row_id, polarity, subjectivity, case when 1 = 1 then 3.0 end as flat from articles)
    select row_id, round((polarity - avg(polarity) over ()) / stddev_pop(polarity) over (), 6) + 0.0 as polarity_z,
      round((subjectivity - avg(subjectivity) over ()) / stddev_pop(subjectivity) over (), 6) + 0.0 as subjectivity_z, 0.0::double as flat_z from s""",
)
def _(spark, sf):
    base = prepared(spark, sf).select(
        "row_id", F.col("sentiment_polarity").alias("polarity"), F.col("sentiment_subjectivity").alias("subjectivity"), F.lit(3.0).alias("flat")
    )
    out = features.standardize(base, ["polarity", "subjectivity", "flat"])
    return out.select("row_id", r6("polarity_z"), r6("subjectivity_z"), r6("flat_z"))
