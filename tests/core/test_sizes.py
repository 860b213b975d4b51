"""Steps whose intermediate rows, tasks or broadcast sides must not outgrow the input."""

from pyspark.sql import functions as F


def plan_nodes(df):
    """Every node of the plan that ran, those of its stages included."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        found.append(node)
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def most_rows(df):
    """Rows of the node that made most."""
    df.collect()
    counts = [n.metrics().get("numOutputRows") for n in plan_nodes(df)]
    return max(c.get().value() for c in counts if c.isDefined())


def test_equal_roots_are_joined_once(spark):
    from impactframe.operators import joins

    roots = spark.range(400).select(F.lit("w").alias("root"), F.col("id").alias("owner"))
    paths = spark.range(300).select(F.concat(F.lit("w/a/"), "id").alias("path"))
    out = joins.longest_prefix_join(paths, "path", roots, "root", "owner")
    assert most_rows(out) <= 2000
    assert {r["owner"] for r in out.collect()} == {399}


def test_prefixes_equal_brute_force_whatever_the_crowd(spark, monkeypatch):
    import random

    from impactframe.operators import joins

    rng = random.Random(1)
    path = lambda: "/".join(rng.choice(["a", "b", "ab", ""]) for _ in range(rng.randint(1, 4)))
    paths = [(i, path()) for i in range(150)] + [(900, None), (901, ""), (902, "a\n/b\n")]
    roots = [(path(), k) for k in range(12)] + [(None, 99), ("a\n", 3)]
    for crowd in (3, 100_000):
        for more in ([], [(".", 70), ("", 71)]):
            known = roots + more
            if not more:
                known = [r for r in known if r[0] != ""]
            monkeypatch.setattr(joins, "CROWD", crowd)
            out = joins.longest_prefix_join(
                spark.createDataFrame(paths, "i int, p string"), "p", spark.createDataFrame(known, "root string, k int"), "root", "k"
            )
            want = {}
            for i, p in paths:
                fits = [
                    (len("" if r == "." else r), k) for r, k in known
                    if r is not None and p is not None and (r in ("", ".", p) or p.startswith(r + "/"))
                ]
                want[i] = max(fits)[1] if fits else None
            assert {r["i"]: r["k"] for r in out.collect()} == want


def customers(spark, n):
    return lambda name: spark.range(n).select(F.col("id").alias("c_custkey")).coalesce(1)


def test_items_are_joined_to_nothing(spark):
    from impactframe.queries import plan_queries

    out = plan_queries.rust_items(customers(spark, 50))
    assert len(out.collect()) == 300
    assert not [n for n in plan_nodes(out) if "Join" in n.getClass().getSimpleName()]


def test_sources_are_parsed_once_in_several_tasks(spark):
    from impactframe.queries import plan_queries

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = plan_queries.rust_sources(customers(spark, 50))
        assert len(out.collect()) == 150
        names = [n.getClass().getSimpleName() for n in plan_nodes(out)]
        assert names.count("MapInArrowExec") == 1
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_names_of_parents_are_those_of_their_ids():
    from impactframe.plans.index import file_rows

    items = file_rows("a.rs", "mod a { impl X { fn f() {} } mod b { const C: u8 = 1; } }\nfn g() {}\n")["items"]
    names = {i["item_id"]: i["name"] for i in items}
    assert [i["parent_name"] for i in items] == [names.get(i["parent_item_id"]) for i in items]
    assert len({i["parent_name"] for i in items}) == 4


def test_json_levels_share_a_pass(spark, monkeypatch):
    import json

    from impactframe.sources import changes

    written = []
    monkeypatch.setattr(changes, "durable", lambda df, f=changes.durable: written.append(1) or f(df))
    texts = ["[" * 12 + '"p", {"files": [[{"path": "q"}]]}' + "]" * 12, '{"path": 7, "files": ["z", {"path": {"a": 1}, "items": "y"}]}', "[" * 40 + '"d"' + "]" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = sorted((k, p) for k, t in enumerate(texts) for p, _ in changes.json_paths(json.loads(t)))
    assert sorted((r["k"], r["path"]) for r in changes.json_path_rows(df, "k", "t").collect()) == want
    assert len(written) == 3


def test_classes_are_found_without_a_closure(spark, monkeypatch):
    from impactframe.operators import graph
    from impactframe.queries import plan_queries

    monkeypatch.delattr(graph, "reverse_closure")
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    assert plan_queries.explained_inputs(read).count() > 0


def test_reached_pairs_are_not_shuffled_by_pair(spark):
    from impactframe.plans import affected as plan

    packages = [(f"p{i}", f"p{i}", "w", "w", f"w/p{i}/Cargo.toml", f"w/p{i}") for i in range(40)]
    names = "id string, name string, workspace string, workspace_path string, manifest_path string, root_path string"
    needs = [(f"p{i}", f"p{i - 1}", "n", None, "normal", None) for i in range(1, 40)]
    kinds = "package_id string, depends_on_package_id string, name string, depends_on_path string, kind string, target string"
    index = plan.Index(spark, {"packages": spark.createDataFrame(packages, names), "package_dependencies": spark.createDataFrame(needs, kinds)})
    changes = spark.createDataFrame([(f"w/p{i % 2}/x{i}.bin",) for i in range(100)], "path string")
    rules = spark.createDataFrame([(0, "rule", "packages", "x0.bin", [], ["p38", "p0"])], "rule_index int, source string, selection string, regex string, workspaces array<string>, packages array<string>")
    _, reached = plan.explain_inputs(index, changes, rules)
    rows = reached.collect()
    assert len(rows) == len({(r["path"], r["package_id"]) for r in rows}) == 50 * 40 + 50 * 39
    assert {r["package_id"] for r in rows if r["is_direct"] and r["path"] == "w/p0/x0.bin"} == {"p38", "p0"}
    dealt = [n.metrics().get("shuffleRecordsWritten") for n in plan_nodes(reached) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert max([d.get().value() for d in dealt if d.isDefined()], default=0) < 1000


def test_large_graphs_are_dealt_by_their_size(spark, monkeypatch):
    from impactframe import session
    from impactframe.operators import graph
    from impactframe.plans.explain import chains

    monkeypatch.setattr(session, "ROWS", 10)
    edges = [(i, i // 2) for i in range(1, 200)] + [(5, 9), (9, 5)]
    table = spark.createDataFrame(edges, "src long, dst long")
    closure = graph.reverse_closure(table, spark.createDataFrame([(1,), (2,)], "seed long"))
    inner = graph.induced_edges(table, closure)
    inside = {s: {r["node"] for r in closure.where(f"seed = {s}").collect()} for s in (1, 2)}
    want = {(s, a, b) for s in (1, 2) for a, b in edges if {a, b} <= inside[s]}
    assert sorted(map(tuple, inner.collect())) == sorted(want)
    tasks = [n.outputPartitioning().numPartitions() for n in plan_nodes(inner) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert max(tasks) >= 20
    commands = table.select(F.col("src").alias("node"), F.lit("c").alias("command"))
    shown = [tuple(r) for r in chains(table, closure, commands).collect()]
    assert len(shown) == len(set(shown)) and {x for x in shown if x[1] == "reverse dependency"} == {(str(a), "reverse dependency", str(b)) for _, a, b in want}
