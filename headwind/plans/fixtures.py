"""Adapters that give the driver tables the shapes of the article and price tables.

Each adapter exists twice, as a DataFrame and as a SQL common table expression, so a query and its SQL twin start from
the same rows. Measures are eighths of whole numbers: their sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind.functions.text import tokens

SUBJECTS = ["bitcoin", "altcoin", "Ethereum", "blockchain", "nft", "security law", "trading", "XRP army", "method", "sports"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dated articles with sentiment."""
    discount, tax = F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("subject"),
        F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(20)).cast("string")).alias("source"),
        ((discount - 5) / 8).alias("polarity"),
        (tax / 8).alias("subjectivity"),
        F.when(discount > 5, "positive").when(discount < 5, "negative").otherwise("neutral").alias("sentiment_class"),
    )


NEWS = """news as (
  select cast(l_shipdate as date) as date, l_returnflag as subject, 'S' || cast(l_suppkey % 20 as varchar) as source,
         (round(l_discount * 100) - 5) / 8 as polarity, round(l_tax * 100) / 8 as subjectivity,
         case when round(l_discount * 100) > 5 then 'positive' when round(l_discount * 100) < 5 then 'negative'
              else 'neutral' end as sentiment_class
  from lineitem)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one price row per day."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("close"), F.sum("o_totalprice").alias("volume"))
    )


PRICES = """price as (
  select cast(o_orderdate as date) as date, avg(o_totalprice) as close, sum(o_totalprice) as volume
  from orders group by 1)"""

CHANGES = """change as (
  select date, close, pc as price_change, case when pc > 0 then 'increase' else 'decrease' end as price_change_direction,
         case when pc > 0 then 1 when pc < 0 then -1 else 0 end as price_direction,
         lead(pc) over (order by date) as next_day_price_change
  from (select date, close, (close / lag(close) over (order by date) - 1) * 100 as pc from price))"""

DAILY = """daily as (
  select date, avg(polarity) as polarity, avg(subjectivity) as subjectivity,
         count(*) filter (sentiment_class = 'positive') as positive,
         count(*) filter (sentiment_class = 'negative') as negative,
         count(*) filter (sentiment_class = 'neutral') as neutral
  from news group by date)"""

JOINED = f"{NEWS}, {PRICES}, {CHANGES}, {DAILY}, joined as (select c.*, d.* exclude (date) from change c left join daily d using (date))"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their labels as annotated articles, cells still raw text."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    polarity = ((F.pmod("n_chars", F.lit(17)) - 8) / 8).cast("double")
    subjectivity = (F.pmod("n_chars", F.lit(9)) / 8).cast("double")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    # words by length stand in for the annotator's verbs and adjectives
    heading, body = tokens(title), tokens(F.col("text"))
    cls = F.when(polarity > 0, "positive").when(polarity < 0, "negative").otherwise("neutral")
    tone = (
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "Neutral")
    )
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(97)).cast("int")).alias("date"),
        F.format_string("{'class': '%s', 'polarity': %s, 'subjectivity': %s}", cls, polarity, subjectivity).alias(
            "sentiment"
        ),
        "source",
        F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), (F.pmod("doc_id", F.lit(10)) + 1).cast("int")).alias(
            "subject"
        ),
        title.alias("title"),
        "text",
        tone.alias("title_tonality"),
        F.when(F.col("toxic").isNotNull(), cls).alias("text_tonality"),
        F.to_json(F.filter(heading, lambda w: F.length(w) >= 6)).alias("title_verbs"),
        F.when(F.col("quality") == 1, F.to_json(F.filter(heading, lambda w: F.length(w) == 5))).alias("title_adjectives"),
        F.to_json(F.filter(body, lambda w: F.length(w) >= 12)).alias("text_verbs"),
        F.when(F.col("toxic") == 0, F.to_json(F.filter(body, lambda w: F.length(w) == 11))).alias("text_adjectives"),
        F.pmod("n_chars", F.lit(5)).cast("int").alias("cluster"),
    )


_SUBJECT_LIST = "[" + ", ".join(f"'{s}'" for s in SUBJECTS) + "]"

ARTICLES = f"""raw_articles as (
  select d.doc_id as row_id, date '2024-01-01' + cast(d.doc_id % 97 as integer) as date, d.source,
         list_extract({_SUBJECT_LIST}, d.doc_id % 10 + 1) as subject, split_part(d.text, chr(10), 1) as title, d.text,
         ((d.n_chars % 17) - 8) / 8 as polarity, (d.n_chars % 9) / 8 as subjectivity,
         regexp_extract_all(lower(split_part(d.text, chr(10), 1)), '[\\p{{L}}\\p{{N}}_]{{2,}}') as words,
         regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as body,
         l.quality, l.toxic, cast(d.n_chars % 5 as integer) as cluster
  from documents d left join labels l on d.doc_id = l.doc_id),
articles as (
  select *, case when polarity > 0 then 'positive' when polarity < 0 then 'negative' else 'neutral' end as sentiment_class,
         case when toxic = 1 then 'negative' when quality = 1 then 'positive' when quality = 0 then 'Neutral' end as title_tonality,
         case when toxic is null then null when polarity > 0 then 'positive' when polarity < 0 then 'negative'
              else 'neutral' end as text_tonality,
         list_filter(words, lambda w: length(w) >= 6) as title_verbs,
         case when quality = 1 then list_filter(words, lambda w: length(w) = 5) else [] end as title_adjectives,
         list_filter(body, lambda w: length(w) >= 12) as text_verbs,
         case when toxic = 0 then list_filter(body, lambda w: length(w) = 11) else [] end as text_adjectives,
         case subject when 'bitcoin' then 'Bitcoin' when 'altcoin' then 'Litecoin' when 'Ethereum' then 'Ethereum'
              when 'blockchain' then 'Blockchain Tech' when 'nft' then 'Blockchain Tech' when 'security law' then 'Regulation'
              when 'trading' then 'Markets & Exchanges' when 'XRP army' then 'Ripple' when 'method' then 'Ethereum'
              else 'Other Crypto' end as crypto_category
  from raw_articles)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points with a given assignment."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("cluster")
    )


VECTORS = "pts as (select vec_id as id, cast(embedding as double[]) as x, label as cluster from embeddings)"


def pages_of_events(spark: SparkSession, sf_dir: str, per_page: int = 50) -> DataFrame:
    """Events as fetched API pages, newest first: ``page, results, next`` with the nested fields of the remote answer."""
    ev = table(spark, sf_dir, "events")
    total = ev.agg(F.max("event_id").alias("m")).scalar()
    k = F.from_json("props", "k int")["k"]
    place = total - F.col("event_id")
    item = F.struct(
        F.concat(F.lit("Item "), F.col("event_id").cast("string")).alias("title"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("published_at"),
        F.struct(F.when(F.col("event_type") != "view", F.col("event_type")).alias("sentiment")).alias("votes"),
        F.concat(F.lit("https://news.example/"), F.col("event_id").cast("string")).alias("url"),
        F.transform(
            F.split(F.when(k % 3 == 0, "BTC,BTC").when(k % 3 == 1, "ETH").otherwise("S,XRP"), ","),
            lambda c: F.struct(c.alias("code")),
        ).alias("currencies"),
        F.struct(F.concat(F.lit("U"), F.pmod("user_id", F.lit(7)).cast("string")).alias("title")).alias("source"),
    )
    placed = ev.select((F.floor(place / per_page) + 1).cast("long").alias("page"), F.struct(place.alias("o"), item.alias("i")).alias("e"))
    return placed.groupBy("page").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["i"]).alias("results"))


PAGES = """items as (
  select cast(floor((m - event_id) / 50) + 1 as bigint) as page, cast((m - event_id) % 50 as integer) as pos,
         'Item ' || event_id as title, ts as published_at,
         case when event_type = 'view' then 'neutral' else event_type end as sentiment,
         'https://news.example/' || event_id as url,
         case cast(json_extract(props, '$.k') as integer) % 3 when 0 then 'BTC,BTC' when 1 then 'ETH' else 'S,XRP' end as currencies,
         'U' || (user_id % 7) as source, event_id
  from events, (select max(event_id) as m from events))"""
