"""Grouping, ordering and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups
from ..sources import changes
from . import registry


def ranges_of(t, where: str = "true"):
    start = F.floor("value").cast("int")
    span = F.struct(start.alias("start_line"), (start + (F.col("event_id") % 4).cast("int") - 1).alias("end_line"))
    return t("events").where(where).select(F.concat(F.lit("u"), "user_id").alias("path"), F.array(span).alias("ranges"))


def shown(ranges: str):
    return F.array_join(
        F.transform(ranges, lambda x: F.concat_ws("-", x["start_line"].cast("string"), x["end_line"].cast("string"))), ","
    )


RANGES = """r as (select 'u' || user_id path, floor(value)::int s, (floor(value)::int + event_id % 4 - 1)::int e from events {where}),
g as (select path, list(distinct {{'s': s, 'e': e}}) filter (where s > 0 and e >= s) rs from r group by 1)
select path, coalesce(array_to_string(list_transform(list_sort(rs), lambda x: x.s || '-' || x.e), ','), '') ranges from g"""


@registry.add("with " + RANGES.format(where=""))
def group_collect_set(t):
    return groups.merge_ranges(ranges_of(t)).select("path", shown("ranges").alias("ranges"))


@registry.add("with " + RANGES.format(where=""))
def union_merge(t):
    both = changes.combine(ranges_of(t, "event_type in ('click', 'view')"), ranges_of(t, "event_type <> 'click'"))
    return both.select("path", shown("ranges").alias("ranges"))


@registry.add("""select c_nationkey, string_agg('-p ' || m, ' ' order by m) args from (select distinct c_nationkey, c_mktsegment m from customer) group by 1""")
def group_concat_sorted(t):
    out = groups.grouped_arguments(t("customer"), ["c_nationkey"], "c_mktsegment")
    return out.select("c_nationkey", F.array_join("args", " ").alias("args"))


@registry.add("""select o_orderstatus, o_orderpriority, c_mktsegment, count(*)::bigint n, string_agg(distinct c_nationkey::varchar, ',' order by c_nationkey::varchar) nations
from orders join customer on o_custkey = c_custkey group by 1, 2, 3""")
def group_multi(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    nations = F.array_join(groups.collect_sorted(F.col("c_nationkey").cast("string")), ",")
    return joined.groupBy("o_orderstatus", "o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), nations.alias("nations"))


@registry.add("""select 'whole' part, c_mktsegment, string_agg(distinct c_nationkey::varchar, ',' order by c_nationkey::varchar) nations from customer group by 2""")
def group_all_or_none(t):
    c = t("customer").select("c_mktsegment", "c_nationkey", F.col("c_nationkey").cast("string").alias("nations"))
    whole = groups.all_or_none(c, ["c_mktsegment"], "c_nationkey", "nations").withColumn("part", F.lit("whole"))
    holed = c.withColumn("c_nationkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")))
    none = groups.all_or_none(holed, ["c_mktsegment"], "c_nationkey", "nations").withColumn("part", F.lit("holed"))
    return whole.unionByName(none).select("part", "c_mktsegment", F.array_join("nations", ",").alias("nations"))


@registry.add("select c_nationkey, c_mktsegment, bool_or(c_acctbal > 9900) direct from customer group by 1, 2")
def group_bool_or(t):
    rows = t("customer").withColumn("direct", F.col("c_acctbal") > 9900)
    return groups.flag_merge(rows, ["c_nationkey", "c_mktsegment"], "direct")


@registry.add("""select count(*)::bigint n, count(*) filter (where source = 'src0')::bigint n_src0, sum(strlen(text))::bigint bytes,
  count(distinct lang)::bigint langs, max(len(string_split(text, chr(10))))::bigint most_lines from documents""")
def summary_counts(t):
    return t("documents").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("source") == "src0").alias("n_src0"),
        F.sum(F.octet_length("text")).cast("long").alias("bytes"),
        F.count_distinct("lang").alias("langs"),
        F.max(F.size(F.split("text", "\n"))).cast("long").alias("most_lines"),
    )


@registry.add("""select c_custkey, coalesce(bool_and(o_totalprice > 1000), true) all_large, coalesce(bool_or(o_orderstatus = 'P'), false) any_partial
from customer left join orders on o_custkey = c_custkey group by 1""")
def quantifiers(t):
    joined = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(
        groups.every(F.col("o_totalprice") > 1000).alias("all_large"), groups.some(F.col("o_orderstatus") == "P").alias("any_partial")
    )


@registry.add("select s_suppkey, row_number() over (order by s_nationkey, s_acctbal desc, s_suppkey)::bigint place from supplier")
def multi_key_sort(t):
    from ..plans.ordering import total_order

    return total_order(t("supplier"), [F.col("s_nationkey"), F.col("s_acctbal").desc(), F.col("s_suppkey")], "place").select("s_suppkey", "place")


@registry.add("select n_name, arg_max(c_name, (c_acctbal, c_custkey)) top from customer join nation on c_nationkey = n_nationkey group by 1")
def argmax_group(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return groups.argmax(joined.withColumnRenamed("c_name", "top"), ["n_name"], "top", F.col("c_acctbal"), F.col("c_custkey"))


@registry.add("select distinct s_nationkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def distinct_sorted(t):
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_nationkey", "n_name").distinct().orderBy("s_nationkey", "n_name")


@registry.add("""with u as (select c_nationkey k, c_name v, 0 src, c_custkey o from customer where c_nationkey % 2 = 0
  union all select s_nationkey, s_name, 1, s_suppkey from supplier)
select k, v from (select *, row_number() over (partition by k order by src, o) rn from u) where rn = 1""")
def first_by_priority(t):
    left = t("customer").where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("o"))
    right = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"), F.col("s_suppkey").alias("o"))
    return groups.first_by_priority([left, right], ["k"], ["o"]).select("k", "v")


@registry.add("select c_custkey k from customer where c_acctbal > 0 intersect select o_custkey from orders where o_orderstatus = 'F'")
def set_intersect(t):
    a = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.intersect(t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@registry.add("select c_custkey k from customer where c_acctbal > 0 except select o_custkey from orders where o_orderstatus = 'F'")
def set_except(t):
    a = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.subtract(t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@registry.add("""select c_nationkey k, c_name v from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)
union all select n_nationkey, 'all of ' || n_name from nation where n_regionkey = 1""")
def replace_partition(t):
    rows = t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"))
    wide = t("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), "n_name")
    return groups.replace_partition(rows, wide, "k", wide.select("k", F.concat(F.lit("all of "), "n_name").alias("v")))
