"""Chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered with that speaker as the assistant and all others as named
users; the mask lists the character spans that the assistant wrote (content and closing mark), which training scores.
Rows of a narrator role (``system``) are context in every view and no participant.

Turns are numbered by a range partitioning (no window over a dialogue) and rendered in chunks of ``CHUNK`` turns, so a
dialogue of any length, even one that holds a third of all rows, is spread over tasks; dialogues of up to that length are
one row for each participant. Offsets count from the start of the chunk.

Defined cases: turns are ordered by turn (nulls first), role, text; a null role is the speaker ``unknown``; a null text
is empty; rows with a null dialogue id form one dialogue; repeated rows are repeated turns; a dialogue without a
participant gives no row; an empty table gives an empty result; extra columns are ignored; markers inside texts are
broken up so that they cannot be taken for markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwind.llm.tables import keep
from headwind.session import shuffle_width

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
NARRATOR = "system"
UNKNOWN = "unknown"
CHUNK = 256
_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def numbered(turns: DataFrame) -> DataFrame:
    """``conv, role, text, pos``: the position of each turn in its dialogue."""
    order = ["conv", "turn", "role", "text"]
    dealt = turns.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    placed = keep(dealt.withColumn("place", F.monotonically_increasing_id()).drop("turn"), "turns")
    placed = placed.withColumn("part", F.shiftrightunsigned("place", _BITS))
    own = keep(placed.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count("*").alias("n")), "turn-runs")
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each shuffle partition at most
    runs = own.select(F.col("conv").alias("c"), F.col("part").alias("p"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    joined = placed.join(runs, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select("conv", "role", "text", (F.col("place") - F.col("first") + F.col("ahead")).alias("pos"))


def harmless(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """``conv_id, participant, chunk, n_turns, n_own, rendered, mask`` for every participant and chunk of each dialogue.

    ``mask`` lists the scored spans as ``start:end``, in code points of ``rendered``, comma-joined.
    """
    named = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    placed = numbered(named).withColumn("chunk", F.floor(F.col("pos") / chunk).cast("int"))
    # at most ``chunk`` turns in a list
    chunks = placed.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    speakers = named.where(F.col("role") != NARRATOR).select(F.col("conv").alias("c"), F.col("role").alias("participant")).distinct()
    views = chunks.join(speakers, F.col("conv").eqNullSafe(F.col("c")))

    def head(role: Column) -> Column:
        name = F.when(role == NARRATOR, F.lit(NARRATOR)).when(role == F.col("participant"), F.lit("assistant"))
        return F.concat(F.lit(OPEN), name.otherwise(F.concat(F.lit("user name="), harmless(F.translate(role, "\n", " ")))), F.lit("\n"))

    def segment(t: Column) -> Column:
        start = head(t["role"])
        whole = F.concat(start, harmless(t["text"]), F.lit(CLOSE))
        return F.struct((t["role"] == F.col("participant")).alias("own"), F.char_length(start).alias("skip"), F.char_length(whole).alias("size"), whole.alias("text"))

    cut = views.select("conv", "chunk", "participant", F.transform("turns", segment).alias("s"))
    ends = F.aggregate("s", F.array(F.lit(0)), lambda done, t: F.concat(done, F.array(F.element_at(done, -1) + t["size"])))
    placed_spans = F.zip_with(
        "s", F.slice("ends", F.lit(1), F.size("s")),
        lambda t, at: F.when(t["own"], F.concat_ws(":", at + t["skip"], at + t["size"])),
    )
    return cut.withColumn("ends", ends).select(
        F.col("conv").alias("conv_id"), "participant", "chunk", F.size("s").cast("long").alias("n_turns"),
        F.size(F.filter("s", lambda t: t["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("s", lambda t: t["text"]), "").alias("rendered"),
        F.array_join(F.array_compact(placed_spans), ",").alias("mask"),
    )


def rotate_sql(chunk: int = CHUNK) -> str:
    """The same in SQL for ``conversations``."""
    return f"""
with t as (select conv_id, coalesce(role, '{UNKNOWN}') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '{UNKNOWN}'), coalesce(text, '')) - 1 as pos from conversations),
p as (select distinct conv_id as c, role as participant from t where role <> '{NARRATOR}'),
h as (select conv_id, participant, (pos // {chunk})::integer as chunk, pos, role = participant as own,
    '{OPEN}' || case when role = '{NARRATOR}' then '{NARRATOR}' when role = participant then 'assistant'
      else 'user name=' || replace(replace(role, chr(10), ' '), '<|', '< |') end || chr(10) as head,
    replace(text, '<|', '< |') || '{CLOSE.strip()}' || chr(10) as body
  from t join p on t.conv_id is not distinct from p.c),
s as (select *, length(head) as skip, length(head) + length(body) as size,
    sum(length(head) + length(body)) over (partition by conv_id, participant, chunk order by pos) as done from h)
select conv_id, participant, chunk, count(*) as n_turns, count(*) filter (where own) as n_own,
  string_agg(head || body, '' order by pos) as rendered,
  coalesce(string_agg((done - size + skip)::varchar || ':' || done::varchar, ',' order by pos) filter (where own), '') as mask
from s group by conv_id, participant, chunk"""
