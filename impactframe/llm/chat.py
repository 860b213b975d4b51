"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Loggers often store a conversation again after each turn. Rolling hashes of turn prefixes
find conversations that are a prefix of a longer one; an anti-join drops them, and one of
several equal ones stays, before the rest is rendered.

Rows without conv_id belong to no known conversation: each is one of its own, of one turn,
so nothing gathers them.

Scale: hashing and joins work on narrow rows (a turn's digest, not its text). Prefixes are
made distinct with map-side partial aggregation, so a first turn shared by most
conversations is one row. Text is shuffled once, for the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable

UNKNOWN_ROLE = "unknown"


def _turns(conversations: DataFrame) -> DataFrame:
    c = conversations
    return c.select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"], F.lit(UNKNOWN_ROLE)).alias("role"),
        F.coalesce(c["text"], F.lit("")).alias("text"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, p1, p2): 128-bit hash of the first k of n turns. A prefix's hash is
    the running xor of its turns' hashes salted with their places."""
    narrow = turns.where("conv_id is not null").select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_last(), "role", "digest")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e1, e2 = turn_hashes(F.col("k"), F.col("role"), F.col("digest"))
    placed = narrow.withColumn("k", F.row_number().over(order)).withColumns({"e1": e1, "e2": e2})
    named = placed.select(
        "conv_id",
        "k",
        F.count("*").over(whole).cast("int").alias("n"),
        F.expr("bit_xor(e1)").over(running).alias("p1"),
        F.expr("bit_xor(e2)").over(running).alias("p2"),
    )
    one = F.lit(1)
    e1, e2 = turn_hashes(one, F.col("role"), F.md5("text"))
    alone = turns.where("conv_id is null").select("conv_id", one.alias("k"), one.alias("n"), e1.alias("p1"), e2.alias("p2"))
    return named.unionByName(alone)


def turn_hashes(k: Column, role: Column, digest: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at place ``k``."""
    return F.xxhash64(k, role, digest), F.xxhash64(digest, F.lit("#"), role, k)


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, p1, p2) of conversations that are no prefix of a longer one; of equal ones the
    smallest id (an id that is null counts as largest)."""
    hashed = durable(prefix_hashes(_turns(conversations)))
    full = hashed.where("k = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = hashed.where("k < n").select(F.col("k").alias("n"), "p1", "p2").distinct()
    return full.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id", "p1", "p2")


def render_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): the maximal conversations in a turn template.

    Turns are in order of turn (null last), role and text digest; a null role is
    ``unknown``, a null text empty; repeated rows are repeated turns; a row without conv_id
    is a conversation of one turn, of equal ones one stays; an empty table gives no rows;
    other columns are ignored."""
    keep = durable(maximal_conversations(conversations))
    turns = _turns(conversations)
    stay = turns.join(keep.where("conv_id is not null"), "conv_id", "left_semi")
    template = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>"))
    e1, e2 = turn_hashes(F.lit(1), F.col("role"), F.md5("text"))
    alone = turns.where("conv_id is null").withColumns({"p1": e1, "p2": e2}).join(keep.where("conv_id is null").drop("conv_id"), ["p1", "p2"], "left_semi")
    # equal rows give equal lines, so one of them is made distinct by its own hash
    alone = alone.groupBy("p1", "p2").agg(F.min(template).alias("rendered"))
    entry = F.struct(
        F.col("turn").isNull().alias("last"),
        "turn",
        "role",
        F.md5("text").alias("digest"),
        template.alias("shown"),
    )
    named = (
        stay.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join("turns.shown", "\n").alias("rendered"),
        )
    )
    return named.unionByName(alone.select(F.lit(None).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), "rendered"))


ORACLE = f"""
with t as (select conv_id, turn, coalesce(role, '{UNKNOWN_ROLE}') as role, coalesce(text, '') as text,
                  case when conv_id is null then row_number() over () end as alone from conversations),
c as (select conv_id, count(*) n,
             list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' order by turn nulls last, role, md5(text)) ts
      from t group by conv_id, alone),
u as (select min(conv_id) conv_id, n, ts from c group by n, ts),
p as (select distinct ts[:k] ts from (select ts, unnest(range(1, n)) k from c))
select conv_id, n::bigint n_turns, array_to_string(ts, chr(10)) rendered
from u where ts not in (select ts from p)"""
