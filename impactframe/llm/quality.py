"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, digits and white space folded) and hashed; for each
host the distinct document texts that hold a line are counted, so exact copies count once.
A line in more than ``max(min_docs, doc_share * distinct texts of the host)`` of them is
boilerplate: it is removed, and a document of which too little is left is rejected.

Scale: lines are counted with map-side partial sums on (host, hash), so a hot host is
spread over its lines. A host's boilerplate lines number at most its mean lines a document
divided by ``doc_share``; the table of them is broadcast after its size has been checked,
else joined on host and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, barrier, durable, partitions

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20
DOC_SHARE = 0.05
MAX_REMOVED_PERCENT = 50
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def line_key(line: Column) -> Column:
    """Hash of a normalised line; null for a line without a word."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), BLANK, " ")
    return F.when(F.length(F.trim(folded)) > 0, F.xxhash64(F.trim(folded)))


def _repeat_words(grams: Column) -> Column:
    """Words covered by three-word windows that come at least twice, from the windows'
    hashes in order: sort (hash, place), keep places with an equal neighbour, and add up
    the gaps between them, each three at most."""
    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        """Places whose hash equals that of the neighbour before or after."""
        return F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]
                ),
            ),
            lambda p: p.isNotNull(),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = lambda places: F.aggregate(
        F.array_sort(places),
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    # bind the sorted array once: transform over a one-element array of it
    return F.get(F.transform(F.array(ordered), lambda s: covered(twice(s))), F.lit(0))


def with_metrics(docs: DataFrame) -> DataFrame:
    """The five counts and ``base_failed``, from ``_text`` (never null)."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.withColumns({"_words": split_words(text), "_full": lines})
    n = F.size("_words")
    grams = F.when(
        n >= 4,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(
                F.get(F.col("_words"), i), F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)
            ),
        ),
    )
    b = a.withColumns(
        {
            "_grams": grams,
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        }
    ).drop("_words", "_full")
    repeats = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), _repeat_words(F.col("_grams")))
    return b.withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0)).cast("long")).drop("_grams").withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, doc_share: float = DOC_SHARE) -> DataFrame:
    """(host, lines): hashes of the lines above the limit, from ``_host`` and ``_text``."""
    keys = F.array_distinct(F.array_compact(F.transform(F.split("_text", "\n"), line_key)))
    texts = (
        docs.select("_host", F.xxhash64("_text").alias("t1"), F.md5("_text").alias("t2"), keys.alias("keys"))
        .dropDuplicates(["_host", "t1", "t2"])
        .select("_host", "keys")
    )
    counted = texts.select("_host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("line"))
    # the null line stands for the document itself, so one pass counts lines and texts
    counts = durable(
        counted.groupBy("_host", "line").agg(F.count("*").alias("n")).where(
            F.col("line").isNull() | (F.col("n") > min_docs)
        )
    )
    hosts = counts.where("line is null").select("_host", F.col("n").alias("texts"))
    return (
        counts.where("line is not null")
        .join(hosts, "_host")
        .where(F.col("n") > F.greatest(F.lit(float(min_docs)), F.lit(doc_share) * F.col("texts")))
        .groupBy("_host")
        .agg(F.collect_set("line").alias("_lines"))
    )


def score_documents(
    docs: DataFrame, min_docs: int = MIN_DOCS, doc_share: float = DOC_SHARE, max_removed: int = MAX_REMOVED_PERCENT
) -> DataFrame:
    """``docs`` with the metrics, ``base_failed``, ``n_removed_words``, ``kept`` and
    ``clean_text`` (without boilerplate lines) added; a column of one of these names is
    replaced. The host of a document is its ``source``.

    Null text counts as empty and fails; a null source is a host of its own; repeated rows
    are judged alike and each is returned; an empty table gives no rows."""
    spark = docs.sparkSession
    made = [*METRICS, "base_failed", "n_removed_words", "kept", "clean_text"]
    named = [c for c in docs.columns if c not in made]
    host = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    # the table's own columns go by number, so that none can clash with those made here
    own = docs.select(
        *[docs[c].alias(f"_d{i}") for i, c in enumerate(named)],
        F.coalesce(docs["text"], F.lit("")).alias("_text"),
        F.coalesce(host, F.lit("\x00")).alias("_host"),
    )
    frequent = durable(frequent_lines(own.select("_host", "_text"), min_docs, doc_share))
    weight = frequent.agg(F.sum(F.size("_lines") + 1)).first()[0] or 0
    if weight <= BROADCAST_ROWS:
        joined = own.join(F.broadcast(frequent), "_host", "left")
    else:
        salts = 4 * partitions(spark)
        spread = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = (
            own.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(salts)).cast("int"))
            .join(spread, ["_host", "_salt"], "left")
            .drop("_salt")
        )
    scored = with_metrics(joined)
    lines = F.split("_text", "\n")
    is_frequent = lambda line: F.coalesce(F.array_contains(F.col("_lines"), line_key(line)), F.lit(False))
    removed = F.when(F.col("_lines").isNotNull(), F.filter(lines, is_frequent))
    scored = scored.withColumn("_removed", removed)
    n_removed = F.aggregate(
        F.coalesce("_removed", F.array().cast("array<string>")),
        F.lit(0),
        lambda n, line: n + F.size(split_words(line)),
    )
    clean = F.when(
        F.size("_removed") > 0,
        F.array_join(F.filter(lines, lambda line: ~F.array_contains(F.col("_removed"), line)), "\n"),
    ).otherwise(F.col("_text"))
    scored = scored.withColumns(
        {"n_removed_words": n_removed.cast("long"), "clean_text": clean, "_row": barrier()}
    )
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < MIN_WORDS) | (100 * F.col("n_removed_words") > max_removed * F.col("n_words"))
    kept = ~F.col("base_failed") & ~depleted & (F.col("_row") >= 0)
    return scored.withColumn("kept", kept).select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(named)], *made)


def oracle(min_docs: int = MIN_DOCS, doc_share: float = DOC_SHARE, max_removed: int = MAX_REMOVED_PERCENT) -> str:
    blank = r"[\x20\x09-\x0D]+"
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(source, chr(1)) host, coalesce(text, '') t from documents),
w as (select rid, regexp_extract_all(t, '{word}') ws from d),
g as (select rid, unnest(range(1, len(ws) - 1)) i, ws from w where len(ws) >= 4),
h as (select rid, i, [ws[i], ws[i + 1], ws[i + 2]] gram from g),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) c from h) where c > 1),
rep as (select rid, sum(least(3, i - coalesce(prev, i - 3))) n
        from (select rid, i, lag(i) over (partition by rid order by i) prev from r) group by rid),
l as (select rid, host, t, unnest(string_split(t, chr(10))) line from d),
ln as (select rid, host, t, line, len(regexp_extract_all(line, '{word}')) nw,
              trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{blank}', ' ', 'g')) k from l),
dup as (select rid, count(*) - count(distinct line) n from ln where nw > 0 group by rid),
hosts as (select host, count(distinct t) texts from d group by host),
freq as (select ln.host, k from ln join hosts using (host) where nw > 0 group by ln.host, k, texts
         having count(distinct t) > greatest({min_docs}, {doc_share} * texts)),
rem as (select rid, sum(nw) n from ln join freq using (host, k) group by rid),
m as (select d.doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars,
             length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) n_symbols,
             coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(rem.n, 0) n_removed_words
      from d join w using (rid) left join rep using (rid) left join dup using (rid) left join rem using (rid)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from m)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols,
       n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
       not base_failed and n_words - n_removed_words >= {MIN_WORDS}
         and 100 * n_removed_words <= {max_removed} * n_words kept,
       n_removed_words::bigint n_removed_words
from f"""
