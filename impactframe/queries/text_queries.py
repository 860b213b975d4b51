"""Paths, lines, JSON and classes on documents, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes, paths, text
from ..operators import decisions, groups, joins
from ..sources import changes, scan
from . import registry

ALL = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"
PAGES = f"pg as (select page_id, {ALL} p from pages)"


def page_paths(t) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return t("pages").select("page_id", bare.alias("p"))


@registry.add(f"with {PAGES} select page_id, p from pg where not list_has_any(string_split(p, '/'), ['fr', 'de'])")
def scan_filter_paths(t):
    return scan.keep_paths(page_paths(t), "p", ["fr", "de"])


@registry.add("select doc_id, sha256(text) hash, strlen(text)::bigint byte_len from documents")
def content_hash(t):
    return scan.hashed(t("documents"), "text").select("doc_id", "hash", "byte_len")


@registry.add(r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') ls from documents)
select doc_id, len(ls)::bigint n_lines, md5(array_to_string(ls, chr(10))) lines_md5 from l""")
def parse_lines(t):
    kept = t("documents").select("doc_id", changes.trimmed_lines(F.col("text")).alias("ls"))
    return kept.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.md5(F.array_join("ls", "\n")).alias("lines_md5"))


@registry.add("""with e as (select event_id, json_extract_string(props, '$.k') k from events)
select event_id, 'a/' || k path from e union all select event_id, 'b/' || k from e
union all select event_id, 'c/' || k from e union all select event_id, 'd/' || k from e""")
def json_extract(t):
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"files":[{"path":"a/'), k, F.lit('","items":["no"]},"b/'), k, F.lit('"],"other":["no"],"items":{"values":["c/'), k,
        F.lit('",' + '[{"files":' * 6 + '"d/'), k, F.lit('"' + "}]" * 6 + "]}}"),
    )
    return changes.json_path_rows(t("events").select("event_id", body.alias("body")), "event_id", "body")


@registry.add("select event_id, cast(json_extract_string(props, '$.k') as bigint) as start from events")
def json_coalesce_keys(t):
    return t("events").select("event_id", text.coalesce_keys(F.col("props"), "start_line", "start", "k").alias("start"))


@registry.add("select event_id, props block from events")
def json_block_extract(t):
    noisy = F.concat(F.lit("log: starting\n"), "props", F.lit("\ndone"))
    return t("events").select("event_id", text.json_block(noisy).alias("block"))


@registry.add("""select o_orderkey, 'f' || o_orderkey path, (o_orderkey % 50 + 1)::int start_line,
  (o_orderkey % 50 + greatest(o_orderkey % 4, 1))::int end_line from orders
union all select o_orderkey, 'g' || o_orderkey, null, null from orders""")
def diff_text_ranges(t):
    k = F.col("o_orderkey").cast("string")
    diff = F.concat(
        F.lit("--- a/f"), k, F.lit("\n+++ b/f"), k, F.lit("\n@@ -1,0 +"), (F.col("o_orderkey") % 50 + 1).cast("string"),
        F.lit(","), (F.col("o_orderkey") % 4).cast("string"), F.lit(" @@ fn\n+x\n--- a/g"), k,
        F.lit("\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n"),
    )
    return changes.diff_ranges(t("orders").select("o_orderkey", diff.alias("diff")), "diff", "o_orderkey")


@registry.add("""select distinct case when o_orderkey % 3 = 0 then 'renamed' when o_orderkey % 3 = 1 then 'deleted' else 'modified' end status,
  unnest(case o_orderkey % 3 when 0 then ['a' || o_custkey, 'b' || o_custkey] when 1 then ['a' || o_custkey] else ['b' || o_custkey] end) path
from orders""")
def explode_old_new(t):
    status = F.when(F.col("o_orderkey") % 3 == 0, "renamed").when(F.col("o_orderkey") % 3 == 1, "deleted").otherwise("modified")
    deltas = t("orders").select(
        F.concat(F.lit("a"), "o_custkey").alias("old"), F.concat(F.lit("b"), "o_custkey").alias("new"), status.alias("status")
    )
    return changes.delta_paths(deltas)


@registry.add("""select n_nationkey, 's' || n_nationkey as suite, unnest(case when n_nationkey % 2 = 0 then ['t1', 't3'] else ['t1'] end) as test
from nation""")
def nested_map_filter(t):
    k = F.col("n_nationkey").cast("string")
    case = lambda name, status: F.concat(F.lit(f'"{name}":{{"filter-match":{{"status":"'), status, F.lit('"}}'))
    third = F.when(F.col("n_nationkey") % 2 == 0, "matches").otherwise("mismatch")
    listing = F.concat(
        F.lit('{"rust-suites":{"s'), k, F.lit('":{"testcases":{'), case("t1", F.lit("matches")), F.lit(","),
        case("t2", F.lit("mismatch")), F.lit(","), case("t3", third), F.lit("}}}}"),
    )
    from ..sources.listings import matching_tests

    return matching_tests(t("nation").select("n_nationkey", listing.alias("listing")), "listing", "n_nationkey")


@registry.add("""select c_custkey, r_name || '::' || n_name || '::' || c_name path from customer
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def hier_path_concat(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.concat_ws("::", "r_name", "n_name", "c_name").alias("path"))


@registry.add("""with h as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href from pages)
select page_id, href, count(*)::bigint n from h group by all""")
def regex_extract_rows(t):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t("pages").select("page_id", F.explode(found).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@registry.add(f"with {PAGES} select page_id, regexp_replace(regexp_replace(p, '/+$', ''), '/[^/]*$', '') || '/z' normal from pg")
def path_normalize(t):
    dotted = F.concat(F.lit("./x/../"), F.regexp_replace("p", "/+$", ""), F.lit("/./y/../../z"))
    return page_paths(t).select("page_id", paths.normalize(dotted).alias("normal"))


@registry.add(f"with {PAGES} select page_id, regexp_replace(p, '/+$', '') path from pg")
def path_clean(t):
    raw = F.concat(F.lit(" ././"), F.replace(F.col("p"), F.lit("/"), F.lit("\\")), F.lit("// "))
    return page_paths(t).select("page_id", paths.clean(raw).alias("path"))


@registry.add(f"""with {PAGES}, h as (select page_id, p, split_part(p, '/', 1) host from pg)
select page_id, p = host || '/en' or starts_with(p, host || '/en/') under_en from h""")
def prefix_predicate(t):
    root = F.concat(F.substring_index("p", "/", 1), F.lit("/en"))
    return page_paths(t).select("page_id", paths.is_under(F.col("p"), root).alias("under_en"))


@registry.add(f"with {PAGES} select page_id, case when contains(p, '/') then substr(p, strpos(p, '/') + 1) end rel from pg")
def strip_prefix(t):
    return page_paths(t).select("page_id", paths.relative_to(F.col("p"), F.substring_index("p", "/", 1)).alias("rel"))


@registry.add(f"""with {PAGES}, x as (select page_id, p || '/Read.Me.TXT' q, p from pg)
select page_id, p parent, 'Read.Me.TXT' as name, 'txt' ext from x""")
def path_parts(t):
    q = F.concat("p", F.lit("/Read.Me.TXT"))
    return page_paths(t).select("page_id", paths.parent(q).alias("parent"), paths.basename(q).alias("name"), paths.extension(q).alias("ext"))


@registry.add(f"""with {PAGES} select page_id, case when ends_with(p, '0') then 'zero' when ends_with(p, '25') then 'quarter'
  when p = '5' or ends_with(p, '/5') then 'five' end kind from pg""")
def case_suffix_class(t):
    kind = classes.suffix_class(F.col("p"), [("0", "zero"), ("25", "quarter")], [("5", "five")])
    return page_paths(t).select("page_id", kind.alias("kind"))


NAMES = [".github/x.yml", "Dockerfile.dev", "CODEOWNERS", "a.PNG", "b.tsx", "LICENSE-MIT", "license.rs", "main.rs", "notice.txt"]
EXPECTED = ["metadata_directory", "container_recipe", "metadata_file", "document_or_media", "script_source", "legal_or_community", None, None, "legal_or_community"]


@registry.add(f"""with {PAGES} select page_id, ([{', '.join('null' if e is None else f"'{e}'" for e in EXPECTED)}])[page_id % 9 + 1] reason from pg""")
def case_inert_class(t):
    path = F.concat("p", F.lit("/"), F.get(F.lit(NAMES), (F.col("page_id") % 9).cast("int")))
    return page_paths(t).select("page_id", classes.inert_class(path).alias("reason"))


PLACES = ["target", "target/x", "x/target/y", "x/out/y", "out/y", "targets/x"]


@registry.add("select page_id, page_id % 6 < 4 generated from pages")
def like_any(t):
    path = F.get(F.lit(PLACES), (F.col("page_id") % 6).cast("int"))
    return t("pages").select("page_id", classes.is_generated(path).alias("generated"))


@registry.add(f"""with {PAGES}, r as (select * from (values (0, '(^|/)en/'), (1, '^[^\\n]*/fr/8'), (2, '^th.*/(de|es)/[0-4]'), (3, '^.*/..$')) v(rule_index, re))
select page_id, rule_index from pg, r where regexp_matches(p, re)""")
def glob_join(t):
    from ..functions.globs import any_glob

    spark = t("pages").sparkSession
    globs = [["**/en/**"], ["*/fr/8*"], ["th*/{de,es}/[0-4]*"], ["**/??"]]
    rules = spark.createDataFrame([(i, any_glob(g)) for i, g in enumerate(globs)], "rule_index int, regex string")
    return joins.rule_matches(page_paths(t), "p", rules, "regex").select("page_id", "rule_index")


@registry.add("""with r as (select * from (values (0, 'ignore', 'spam'), (1, 'packages', '/en/'), (2, 'ignore', 'blog'), (3, 'ignore', '/fr/')) v(i, sel, pat))
select page_id, bool_and(sel = 'ignore') is_inert, count(*)::bigint n_rules from pages, r where regexp_matches(url, pat) group by 1""")
def rule_precedence(t):
    pages = t("pages").select("page_id", "url")
    rules = pages.sparkSession.createDataFrame(
        [(0, "ignore", "spam"), (1, "packages", "/en/"), (2, "ignore", "blog"), (3, "ignore", "/fr/")], "i int, sel string, pat string"
    )
    return decisions.rule_precedence(joins.rule_matches(pages, "url", rules, "pat"), "page_id", "sel")


@registry.add(f"""with {PAGES} select page_id, case when regexp_matches(p, '/en/.*0$') then 'configured' when ends_with(p, '5') then 'build_input'
  when contains(p, '/fr/') then 'indexed' when contains(p, '/out/') then 'generated' when contains(p, '/de/') then 'package_input' else 'uncertain' end kind from pg""")
def priority_classify(t):
    p = F.col("p")
    kind = decisions.ladder(
        (p.rlike("/en/.*0$"), "configured"),
        (F.endswith(p, F.lit("5")), "build_input"),
        (F.contains(p, F.lit("/fr/")), "indexed"),
        (classes.is_generated(p), "generated"),
        (F.when(F.contains(p, F.lit("/de/")), True), "package_input"),
        otherwise="uncertain",
    )
    return page_paths(t).select("page_id", kind.alias("kind"))


@registry.add("""with l as (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
s as (select doc_id, last_value(case when length(l) < 40 then i end ignore nulls) over (partition by doc_id order by i) sec from l
      where not (l = '' and i = (select max(i) from l m where m.doc_id = l.doc_id)))
select doc_id, count(distinct sec)::bigint n_sections, max(sec)::bigint last_section from s group by 1""")
def carry_forward_section(t):
    lines = text.numbered_lines(t("documents"), "text", "doc_id")
    carried = text.carry_forward(lines, F.when(F.length("line") < 40, F.col("line_no")), "sec", "doc_id")
    return carried.groupBy("doc_id").agg(
        F.count_distinct("sec").alias("n_sections"), F.max("sec").cast("long").alias("last_section")
    )


@registry.add("""with l as (select doc_id, unnest(string_split(text, chr(10))) l from documents)
select doc_id, bool_and(l = '' or length(l) < 400) short, bool_or(contains(l, '***')) marked from l group by 1""")
def bool_and_group(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        groups.every((F.col("line") == "") | (F.length("line") < 400)).alias("short"),
        groups.some(F.contains("line", F.lit("***"))).alias("marked"),
    )


@registry.add("select coalesce(bool_or(toxic = 1), false) any_toxic, coalesce(bool_or(quality > 1), false) any_high, coalesce(bool_or(toxic = 5) filter (where false), false) any_of_none from labels")
def bool_or_global(t):
    return t("labels").agg(
        groups.some(F.col("toxic") == 1).alias("any_toxic"),
        groups.some(F.col("quality") > 1).alias("any_high"),
        groups.some(F.when(F.lit(False), F.col("toxic") == 5)).alias("any_of_none"),
    )


@registry.add("""select page_id, case page_id % 5 when 0 then 'tests' when 1 then 'p' || page_id || '::tests' when 2 then 'a::p' || page_id || '::tests'
  when 3 then 'tests' else 'a::b::tests' end module_filter from pages""")
def string_rewrite(t):
    k = F.col("page_id")
    path = (
        F.when(k % 5 == 0, "src/lib.rs")
        .when(k % 5 == 1, F.concat(F.lit("src/p"), k, F.lit(".rs")))
        .when(k % 5 == 2, F.concat(F.lit("src/a/p"), k, F.lit("/mod.rs")))
        .when(k % 5 == 3, "tests/x.rs")
        .otherwise("src/a/b/lib.rs")
    )
    return t("pages").select("page_id", paths.module_filter(path, F.lit("tests")).alias("module_filter"))


@registry.add("""with w as (select doc_id, string_split(text, ' ') ws from documents)
select doc_id, case when list_position(ws, 'the') > 0 then ws[list_position(ws, 'the') + 1] end next_word from w""")
def array_lookup(t):
    words = t("documents").select("doc_id", F.split("text", " ").alias("ws"))
    at = F.array_position("ws", F.lit("the"))
    return words.select("doc_id", F.when(at > 0, F.get("ws", at.cast("int"))).alias("next_word"))


@registry.add("""with r as (select event_id, event_id % 7 a, (event_id * 3) % 11 b from events)
select event_id, case when a > 0 and b >= a then a || '-' || b || case when b + 5 > 0 then ',' else '' end else '' end || (b + 3) || '-' || (b + 5) ranges from r""")
def range_normalize(t):
    a, b = F.col("event_id") % 7, (F.col("event_id") * 3) % 11
    span = lambda x, y: F.struct(x.alias("start_line"), y.alias("end_line"))
    ranges = F.array(span(b + 3, b + 5), span(a, b), span(F.lit(0).cast("long"), b), span(b + 3, b + 5), span(b + 9, b + 8))
    kept = t("events").select("event_id", text.normalize_ranges(ranges).alias("r"))
    shown = F.transform("r", lambda x: F.concat_ws("-", x["start_line"].cast("string"), x["end_line"].cast("string")))
    return kept.select("event_id", F.array_join(shown, ",").alias("ranges"))


@registry.add("select o_orderpriority, sha256(string_agg(cast(o_orderkey as varchar), '|' order by cast(o_orderkey as varchar))) digest from orders group by 1")
def set_fingerprint(t):
    return t("orders").groupBy("o_orderpriority").agg(text.fingerprint(F.col("o_orderkey").cast("string"), separator="|").alias("digest"))


