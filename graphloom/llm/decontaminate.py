"""Benchmark decontamination: a positional inverted index over the training words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SEPARATORS, Scratch, lower_ascii, small, table

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Share of a window's words in place that makes a proximity match.
NEAR = 0.8


def _split(text: Column) -> Column:
    """Words in order; the last may be empty."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + SEPARATORS, ""), SEPARATORS)


def _words(rows: DataFrame, text: str) -> DataFrame:
    """Adds words: array of lower-cased words, none for null."""
    rows = rows.withColumn("_w", _split(lower_ascii(F.col(text))))
    return rows.withColumn("words", F.filter("_w", lambda w: w != "")).drop("_w")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """Find the windows of benchmark items that stand in the documents.

    A window is ``window`` consecutive words of an item, or all of a shorter one.
    The benchmark words' frequencies over all documents give each window's two rarest
    words, whose places in all documents are stored as postings; a window's two
    posting lists, moved by the words' places in the window, are intersected. What
    remains is compared word for word with the text: exact phrases make hits, and
    those with ``near`` of the words in place make proximity matches.

    Plan: a scan that counts benchmark words (broadcast hash join, shuffled beyond
    BROADCAST_BYTES), a scan that keeps the postings of the rare ones, a join of these
    by (document, place), and one join of candidates with their documents' texts.
    Only documents with candidates are shuffled with their text.

    A document is a row: null ids, repeated ids and repeated rows each keep their
    row (rows with the same id and text have the same result). Null and empty texts
    have no words; items without words have no windows; items with the same id
    count once, a null id as an empty one. Equal frequencies are ordered by term, which
    changes no result. A very long text is one array of words, only where it has
    candidates beside them. An empty benchmark leaves every document clean; an empty
    table gives no rows. Other columns take no part.

    Returns ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated, n_near
    (proximity matches), items (sorted ids) and hits: array of (start, length).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))

    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    items = _words(items, "text").filter(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    wins = items.select("item", "n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("at"))
    wins = wins.select("item", F.slice("words", F.col("at") + 1, F.col("n")).alias("win"))
    member = scratch.save(wins.distinct(), "members")
    wins = scratch.save(member.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    member = member.join(wins, "win").select("wid", "item")

    terms = wins.select(F.explode("win").alias("w")).distinct().withColumn("term", F.monotonically_increasing_id())
    terms = scratch.save(terms, "terms")
    # the corpus frequencies of the benchmark's words, then the postings of each window's two rarest alone
    seen = rows.select(F.explode(_split(F.col("text"))).alias("w")).withColumn("w", lower_ascii(F.col("w")))
    counts = scratch.save(seen.join(small(terms), "w").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")

    placed = wins.select("wid", F.posexplode("win").alias("k", "w")).join(terms, "w").join(counts, "term", "left")
    order = W.partitionBy("wid").orderBy(F.coalesce("n", F.lit(0)), "term", "k")
    placed = placed.withColumn("r", F.row_number().over(order)).filter("r <= 2")
    two = placed.groupBy("wid").agg(
        F.max(F.when(F.col("r") == 1, F.struct("term", "k"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("term", "k"))).alias("b")
    )
    two = scratch.save(two.select("wid", F.col("a.term").alias("term"), F.col("a.k").alias("k"), F.col("b.term").alias("term2"), F.col("b.k").alias("k2")), "rarest")
    rare = two.select(F.explode(F.array("term", "term2")).alias("term")).dropna().distinct().join(terms, "term")
    posts = rows.select("id", "h", F.posexplode(_split(F.col("text"))).alias("p", "w")).withColumn("w", lower_ascii(F.col("w")))
    posts = scratch.save(posts.join(small(rare), "w").select("term", "id", "h", "p"), "postings")

    found = posts.join(small(two), "term").select("id", "h", "wid", (F.col("p") - F.col("k")).alias("start"), "term2", "k2").filter("start >= 0")
    single = found.filter(F.col("term2").isNull()).select("id", "h", "wid", "start")
    second = small(two.select(F.col("term2").alias("term")).dropna().distinct())
    second = posts.join(second, "term", "left_semi").select(F.col("term").alias("t"), F.col("id").alias("i"), F.col("h").alias("g"), "p")
    both = found.filter(F.col("term2").isNotNull()).join(
        second,
        (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("term2") == F.col("t")) & (F.col("start") + F.col("k2") == F.col("p")),
        "left_semi",
    )
    found = both.select("id", "h", "wid", "start").unionByName(single).distinct()
    found = found.join(small(wins), "wid").groupBy("id", "h").agg(F.collect_list(F.struct("wid", "start", "win")).alias("found"))
    found = scratch.save(found, "found")  # an array for each document with candidates, bounded by its words and the windows

    ids = small(found.select(F.col("id").alias("i"), F.col("h").alias("g")))
    same = (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i"))
    texts = rows.join(ids, same, "left_semi").dropDuplicates(["id", "h"])
    met = _words(texts, "text").join(found.withColumnsRenamed({"id": "i", "h": "g"}), same)
    in_place = lambda c: F.size(F.filter(F.sequence(F.lit(0), F.size(c["win"]) - 1), lambda k: F.get(F.col("words"), c["start"] + k) == F.get(c["win"], k)))
    met = met.select("id", "h", F.transform("found", lambda c: F.struct(c["wid"], c["start"].cast("long").alias("start"), F.size(c["win"]).cast("long").alias("length"), in_place(c).alias("got"))).alias("found"))
    exact = F.filter("found", lambda c: c["got"] == c["length"])
    met = met.select("id", "h", exact.alias("hits"), F.size(F.filter("found", lambda c: (c["got"] < c["length"]) & (c["got"] >= near * c["length"]))).alias("n_near"))
    met = scratch.save(met.filter((F.size("hits") > 0) | (F.col("n_near") > 0)), "met")

    wid_items = met.select("id", "h", F.explode(F.array_distinct(F.transform("hits", lambda c: c["wid"]))).alias("wid")).join(member, "wid")
    wid_items = wid_items.groupBy("id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1)))))
    hits = met.select(F.col("id").alias("i"), F.col("h").alias("g"), covered.cast("long").alias("n_hit"), "n_near", F.transform("hits", lambda c: F.struct(c["start"], c["length"])).alias("hits"))
    wid_items = wid_items.select(F.col("id").alias("i2"), F.col("h").alias("g2"), "items")
    hits = hits.join(wid_items, (F.col("g") == F.col("g2")) & F.col("i").eqNullSafe(F.col("i2")), "left").drop("i2", "g2")

    base = rows.select("id", "h", _split(F.col("text")).alias("w"))
    base = base.select("id", "h", (F.size("w") - F.when(F.element_at("w", -1) == "", 1).otherwise(0)).cast("long").alias("n_words"))
    out = base.join(hits, same, "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        listed.alias("items"),
        "hits",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hits", "n_near")


QUERIES = {"op10_decontaminate": op10_decontaminate}

_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
SQL = {
    "op10_decontaminate": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w[s:s + least(10, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM bw),
wins AS (SELECT DISTINCT win, len(win) AS l FROM bw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, s, l, w[s:s + l - 1] AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens)),
hits AS (SELECT doc_id, s, dw.l, win FROM dw JOIN wins USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN bw USING (win)) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
