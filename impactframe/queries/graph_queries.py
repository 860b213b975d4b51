"""Graph and snapshot operators: parts that follow one another in orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diff, graph
from ..session import dealt, durable
from . import registry

EDGES = """e as (select distinct src, dst from (select l_partkey src, lead(l_partkey) over (partition by l_orderkey
  order by l_linenumber, l_partkey, l_suppkey, l_quantity) dst from lineitem) where dst is not null and src <> dst)"""


def part_edges(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    n = items.count()
    pairs = dealt(items, n, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return dealt(pairs.where("dst is not null and src <> dst"), n, "src", "dst").distinct()


def seeds(t, *values: int):
    return t("part").sparkSession.createDataFrame([(v,) for v in values], "seed long")


@registry.add(f"""with recursive {EDGES}, r(seed, node) as (select x, x from (values (0::bigint), (1), (2)) v(x)
  union select r.seed, e.src from r join e on r.node = e.dst) select seed, node from r""")
def reverse_closure(t):
    return graph.reverse_closure(part_edges(t), seeds(t, 0, 1, 2))


@registry.add(f"""with recursive {EDGES}, r(node, lvl) as (select 0::bigint, 0 union select e.dst, r.lvl + 1 from r join e on r.node = e.src
  where r.lvl < 16) select node, min(lvl) as level from r group by 1""")
def bfs_levels(t):
    return graph.bfs_levels(part_edges(t), seeds(t, 0)).select("node", "level")


@registry.add(f"""with recursive {EDGES}, r(node) as (select 0::bigint union select e.src from r join e on r.node = e.dst)
select src, dst from e where src in (select node from r) and dst in (select node from r)""")
def induced_edges(t):
    edges = durable(part_edges(t))
    return graph.induced_edges(edges, graph.reverse_closure(edges, seeds(t, 0))).select("src", "dst")


@registry.add("""with recursive e as (select p_partkey src, p_partkey // 2 dst from part where p_partkey > 0),
a(node) as (select x from (values (3::bigint), (5)) v(x) union select e.src from a join e on a.node = e.dst),
b(node) as (select x from (values (6::bigint), (11)) v(x) union select e.src from b join e on b.node = e.dst)
select node from a where node not in (select node from b) and node not in (3, 5)""")
def closure_difference(t):
    """Every part depends on the part of half its number."""
    edges = t("part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return graph.closure_difference(edges, seeds(t, 3, 5), seeds(t, 6, 11))


SNAPSHOTS = """b as (select o_orderkey k, o_totalprice v from orders where o_orderkey % 10 <> 0),
a as (select o_orderkey k, case when o_orderkey % 7 = 0 then -1.0 else o_totalprice end v from orders where o_orderkey % 10 <> 1)"""


def order_snapshots(t):
    orders = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    before = orders.where("k % 10 <> 0")
    after = orders.where("k % 10 <> 1").withColumn("v", F.when(F.col("k") % 7 == 0, -1.0).otherwise(F.col("v")))
    return before, after


@registry.add(f"""with {SNAPSHOTS} select coalesce(a.k, b.k) k, case when b.k is null then 'added' when a.k is null then 'removed'
  when b.v <> a.v then 'modified' else 'unchanged' end status from b full join a on a.k = b.k""")
def snapshot_diff(t):
    return diff.snapshot_diff(*order_snapshots(t), ["k"], "v")


LAST = "(select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc) rn from lineitem)"


@registry.add(f"""with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey from {LAST} where rn = 1),
b as (select * from x where l_orderkey % 5 <> 0),
a as (select l_orderkey, l_linenumber, case when l_linenumber = 2 then -l_partkey else l_partkey end l_partkey, l_suppkey from x where l_orderkey % 5 <> 1)
select coalesce(a.l_orderkey, b.l_orderkey) l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) l_linenumber,
  case when b.l_orderkey is null then 'added' when a.l_orderkey is null then 'removed' else 'modified' end status
from b full join a on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber
where b.l_orderkey is null or a.l_orderkey is null or a.l_partkey <> b.l_partkey""")
def keyed_diff(t):
    items = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct("l_partkey", "l_suppkey", "l_quantity").alias("place")
    )
    before = items.where("l_orderkey % 5 <> 0")
    flipped = F.when(F.col("l_linenumber") == 2, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    after = items.where("l_orderkey % 5 <> 1").withColumn("l_partkey", flipped)
    return diff.keyed_diff(before, after, ["l_orderkey", "l_linenumber"], "place", ["l_partkey", "l_suppkey"])


@registry.add(f"""with {SNAPSHOTS} select a.k, coalesce(b.v, 0.0) old from a left join b on a.k = b.k""")
def left_join_default(t):
    before, after = order_snapshots(t)
    return diff.left_join_default(after.select("k"), before.withColumnRenamed("v", "old"), ["k"], "old", F.lit(0.0))


@registry.add("""with cur as (select doc_id, 'd' || doc_id path, case when doc_id % 5 = 0 then 'new' else md5(text) end hash from documents where doc_id % 11 <> 0),
prev as (select 'd' || doc_id path, md5(text) hash from documents where doc_id % 13 <> 0)
select c.path, case when p.path is not null and c.doc_id % 3 <> 0 then 'trusted' when p.hash = c.hash then 'reused' else 'reparsed' end decision
from cur c left join prev p on p.path = c.path
union all select path, 'removed' from prev where path not in (select path from cur)""")
def incremental_reuse(t):
    docs = t("documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.md5("text").alias("hash"))
    current = docs.where("doc_id % 11 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("hash")))
    changed = docs.where("doc_id % 3 = 0")
    return diff.incremental_reuse(current, docs.where("doc_id % 13 <> 0"), changed, True, True)
