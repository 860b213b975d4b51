"""Decision operators on customers, orders and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, graph
from ..session import durable
from . import registry
from .graph_queries import EDGES, part_edges, seeds


@registry.add("""select r_name, count(*)::bigint n_expected, count(*) filter (where o)::bigint n_selected, count(*) filter (where not o)::bigint n_missing,
  case when bool_and(o) then 'ok' else 'widened' end result
from (select r_name, c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') o
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal > 0) group by 1""")
def self_check(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    expected = t("customer").where("c_acctbal > 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "c_custkey")
    selected = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return decisions.self_check(expected, selected, ["r_name"], ["c_custkey"])


@registry.add("""select o_orderstatus, count(*)::bigint n_commands, count(distinct o_custkey)::bigint n_packages,
  count(*) > 8 * greatest(1, count(distinct o_custkey)) over_cap from orders group by 1""")
def cap_fallback(t):
    return decisions.capped(t("orders"), "o_custkey", keys=["o_orderstatus"])


@registry.add("""with c as (select c_custkey, case c_custkey % 3 when 0 then 'package' else 'module' end m, case when c_custkey % 4 <> 1 then c_name end p from customer),
n as (select o_custkey, count(*)::bigint n from orders where o_orderpriority like '1%' group by 1)
select c_custkey, p package, coalesce(n, 0)::bigint n_matched, case when m = 'module' and n is null then case when p is null then 'workspace_wide' else 'package' end else m end "mode"
from c left join n on o_custkey = c_custkey""")
def validate_widen(t):
    commands = t("customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, "package").otherwise("module").alias("mode"),
        F.when(F.col("c_custkey") % 4 != 1, F.col("c_name")).alias("package"),
    )
    matches = t("orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return decisions.widen_unmatched(commands, matches, ["c_custkey"])


@registry.add("""with f as (select c_nationkey, bool_and(c_acctbal > -990) a, bool_or(c_mktsegment = 'BUILDING') b, count(*) > 55 c from customer group by 1)
select c_nationkey, case when a and c then 'module' when b and not c then 'test_target' when a then 'package' else 'closure' end strategy from f""")
def strategy_pick(t):
    flags = t("customer").groupBy("c_nationkey").agg(
        F.bool_and(F.col("c_acctbal") > -990).alias("a"), F.bool_or(F.col("c_mktsegment") == "BUILDING").alias("b"), (F.count("*") > 55).alias("c")
    )
    strategy = decisions.ladder(
        (F.col("a") & F.col("c"), "module"), (F.col("b") & ~F.col("c"), "test_target"), (F.col("a"), "package"), otherwise="closure"
    )
    return flags.select("c_nationkey", strategy.alias("strategy"))


@registry.add("""select n_name, s_suppkey is not null is_selected, case when s_suppkey is null then 'owned but not reported' when s_acctbal < 0 then 'failed wide' else 'selected' end reason
from nation left join (select s_nationkey, arg_min(s_suppkey, s_suppkey) s_suppkey, min(s_acctbal) s_acctbal from supplier where s_suppkey % 3 = 0 group by 1) on s_nationkey = n_nationkey""")
def left_join_case(t):
    selected = t("supplier").where("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_acctbal").alias("low"))
    joined = t("nation").join(selected.withColumn("is_selected", F.lit(True)), "n_nationkey", "left")
    reason = F.when(F.col("low").isNull(), "owned but not reported").when(F.col("low") < 0, "failed wide").otherwise("selected")
    return joined.select("n_name", F.coalesce("is_selected", F.lit(False)).alias("is_selected"), reason.alias("reason"))


@registry.add("""select n_name workspace, 'workspace_wide' as "mode", 'unmapped change' reason from nation
where exists (select 1 from customer where c_acctbal < -900)""")
def fail_wide(t):
    failed = t("customer").agg((F.count_if(F.col("c_acctbal") < -900) > 0).alias("failed"))
    return decisions.fail_wide(t("nation").select(F.col("n_name").alias("workspace")), "unmapped change", failed)


@registry.add(f"""with recursive {EDGES}, r(node) as (select 0::bigint union select e.src from r join e on r.node = e.dst)
select src::varchar as "from", 'direct dependent' relationship, '0' as "to" from e where dst = 0
union select src::varchar, 'reverse dependency', dst::varchar from e where src in (select node from r) and dst in (select node from r)
union select distinct node::varchar, 'selected by', p_brand from r join part on p_partkey = node""")
def explain_path(t):
    from ..plans.explain import chains

    edges = durable(part_edges(t))
    closure = graph.reverse_closure(edges, seeds(t, 0))
    commands = t("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("command"))
    return chains(edges, closure, commands)
