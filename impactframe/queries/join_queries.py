"""Join and lookup operators on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups, joins
from . import registry
from .text_queries import PAGES, page_paths


@registry.add(f"""with {PAGES}, roots as (select distinct host || case when lang = '' or lang = 'en' then '' else '/' || lang end root
    from (select split_part(p, '/', 1) host, split_part(p, '/', 2) lang from pg)),
m as (select page_id, p, root, row_number() over (partition by page_id order by length(root) desc) rn
      from pg join roots on p = root or starts_with(p, root || '/'))
select page_id, m.root owner from pg left join m using (page_id) where rn = 1 or rn is null""")
def longest_prefix_join(t):
    pages = page_paths(t)
    host, lang = F.split_part("p", F.lit("/"), F.lit(1)), F.split_part("p", F.lit("/"), F.lit(2))
    root = F.when(lang.isin("", "en"), host).otherwise(F.concat(host, F.lit("/"), lang))
    roots = pages.select(root.alias("owner")).distinct()
    return joins.longest_prefix_join(pages, "p", roots, "owner", "owner").select("page_id", "owner")


@registry.add(f"""with {PAGES} select page_id, p from pg where split_part(p, '/', 2) not in ('en', 'fr')""")
def anti_prefix_join(t):
    pages = page_paths(t)
    host, lang = F.split_part("p", F.lit("/"), F.lit(1)), F.split_part("p", F.lit("/"), F.lit(2))
    roots = pages.where(lang.isin("en", "fr")).select(F.concat(host, F.lit("/"), lang).alias("root")).distinct()
    return joins.anti_prefix_join(pages, "p", roots, "root")


SPANS = """sp as (select user_id, date_trunc('day', ts) st, date_trunc('day', ts) + interval 1 day en, 'day' nm from events
  union select user_id, date_trunc('hour', ts), date_trunc('hour', ts) + interval 1 hour, 'day::hour' from events where event_type = 'error')"""


def _spans(t):
    e = t("events")
    start = lambda unit: F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    day = e.select("user_id", start("day").alias("st"), F.lit("day").alias("nm"), F.expr("interval 1 day").alias("w"))
    hour = e.where("event_type = 'error'").select(
        "user_id", start("hour").alias("st"), F.lit("day::hour").alias("nm"), F.expr("interval 1 hour").alias("w")
    )
    both = day.select("user_id", "st", "nm", (F.col("st") + F.expr("interval 1 day")).alias("en"))
    both = both.unionByName(hour.select("user_id", "st", "nm", (F.col("st") + F.expr("interval 1 hour")).alias("en")))
    return both.distinct()


@registry.add(f"""with {SPANS}, m as (select event_id, nm, row_number() over (partition by event_id order by length(nm) desc) rn
  from events e join sp s on e.user_id = s.user_id and s.st <= ts and s.en >= ts)
select event_id, nm from m where rn = 1""")
def interval_containment_join(t):
    points = t("events").select("event_id", "user_id", "ts")
    pairs = joins.containing_spans(points, _spans(t), ["user_id"], "ts", "ts", "st", "en")
    return joins.innermost(pairs, ["event_id"], "nm")


@registry.add(f"""with {SPANS} select event_id, nm, count(*)::bigint n from events e join sp s on e.user_id = s.user_id
  and s.st <= e.ts + interval 30 minute and s.en >= e.ts group by 1, 2""")
def interval_overlap_join(t):
    points = t("events").select(
        "event_id", "user_id", "ts", (F.col("ts") + F.expr("interval 30 minutes")).alias("te")
    )
    pairs = joins.overlapping_spans(points, _spans(t), ["user_id"], "ts", "te", "st", "en")
    return pairs.groupBy("event_id", "nm").agg(F.count("*").alias("n"))


@registry.add("""with o as (select l_orderkey, list(distinct l_partkey) parts from lineitem group by 1)
select o_orderkey from orders join o on o_orderkey = l_orderkey where list_contains(parts, o_custkey)""")
def array_contains_join(t):
    parts = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))
    joined = t("orders").select("o_orderkey", "o_custkey").join(parts, "o_orderkey")
    return joined.where(F.array_contains("parts", F.col("o_custkey"))).select("o_orderkey")


@registry.add("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def semi_join(t):
    urgent = t("orders").where("o_orderpriority like '1%'")
    return t("customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@registry.add("select s_suppkey from supplier where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49 and l_discount > 0.09)")
def anti_join(t):
    big = t("lineitem").where("l_quantity > 49 and l_discount > 0.09")
    return t("supplier").join(big, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")


@registry.add("""with x as (select c_custkey k from customer where c_custkey % 3 = 0 union select 900000 + c_custkey from customer where c_custkey < 5)
select o_custkey k, o_orderkey from orders where o_custkey in (select k from x)
union all select k, null from x where k not in (select o_custkey from orders)""")
def semi_restrict(t):
    c = t("customer")
    listed = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k")).union(
        c.where("c_custkey < 5").select((F.col("c_custkey") + 900000).alias("k"))
    )
    return joins.semi_restrict(t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), listed, "k")


@registry.add("""with o as (select l_orderkey, unnest(list_distinct(list(l_partkey))) p from lineitem group by 1)
select l_orderkey, p_partkey, p_brand from o join part on p = p_partkey where p_size < 10""")
def explode_join(t):
    arrays = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    small = t("part").where("p_size < 10").select("p_partkey", "p_brand")
    return joins.explode_join(arrays, "parts", small, "p_partkey").select("l_orderkey", "p_partkey", "p_brand")


@registry.add("""select o_orderkey, coalesce(n.n_name, 's' || s.s_nationkey) found from orders
left join (select n_nationkey, n_name from nation where n_nationkey % 2 = 0) n on n.n_nationkey = o_orderkey % 30
left join (select * from supplier where s_suppkey < 25) s on s.s_suppkey = o_orderkey % 30""")
def coalesce_two_lookups(t):
    first = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    second = t("supplier").where("s_suppkey < 25").select("s_suppkey", F.concat(F.lit("s"), "s_nationkey").alias("v"))
    keyed = t("orders").select("o_orderkey", (F.col("o_orderkey") % 30).alias("k"))
    return joins.coalesce_lookups(keyed, "k", first, second, "found").select("o_orderkey", "found")


@registry.add("""select o_orderkey, n_name, n_nationkey is not null is_known from orders left join nation on n_nationkey = o_orderkey % 40""")
def validated_lookup(t):
    wanted = t("orders").select("o_orderkey", (F.col("o_orderkey") % 40).cast("int").alias("n_nationkey"))
    return joins.validated_lookup(wanted, t("nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select(
        "o_orderkey", "n_name", "is_known"
    )


@registry.add("""with d as (select distinct l_partkey target, l_orderkey source from lineitem)
select p_partkey, string_agg(distinct source::varchar, ',' order by source::varchar) users from part join d on target = p_partkey
group by 1""")
def reverse_lookup(t):
    used = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").cast("string").alias("u"))
    joined = t("part").select("p_partkey").join(used, "p_partkey")
    return joined.groupBy("p_partkey").agg(F.array_join(groups.collect_sorted(F.col("u")), ",").alias("users"))


@registry.add("""with a as (select l_partkey k, l_suppkey s, count(*)::bigint n from lineitem group by 1, 2),
b as (select l_partkey k, l_suppkey s, max(l_quantity) q from lineitem where l_returnflag = 'R' group by 1, 2)
select k, s, n, q from a join b using (k, s)""")
def multikey_join(t):
    items = t("lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), "l_quantity", "l_returnflag")
    a = items.groupBy("k", "s").agg(F.count("*").alias("n"))
    b = items.where("l_returnflag = 'R'").groupBy("k", "s").agg(F.max("l_quantity").alias("q"))
    return a.join(b, ["k", "s"])


@registry.add("""select l_orderkey, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey
  order by l_linenumber, l_partkey, l_suppkey, l_quantity) rn from lineitem) where rn = 1""")
def dedupe_by_key(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    first = groups.dedupe(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return first.select("l_orderkey", "l_partkey", "l_suppkey")


FINISHED = "o_orderstatus = 'F'"


@registry.add(f"""select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and {FINISHED})
  and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '5%') is_test from customer""")
def semi_anti_classify(t):
    done, low = t("orders").where(FINISHED), t("orders").where("o_orderpriority like '5%'")
    return joins.classify_by_lookups(
        t("customer").select("c_custkey"), "c_custkey", done.select("o_custkey"), low.select("o_custkey"), "is_test"
    )


@registry.add(f"""select distinct o_custkey from orders where {FINISHED}
  and not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0)""")
def anti_classify(t):
    debt = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").where(FINISHED).select("o_custkey").join(debt, "o_custkey", "left_anti").distinct()
