"""URL filters: host-suffix and path-prefix rules found through short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, small, table

#: (host, path, action) of the rules that op3 applies.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Hex digits of the hash prefix that is joined on.
PREFIX_HEX = 8
#: The verdict of a url that no rule fits.
DEFAULT = "allow"


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Judge every row's url by the longest rule (host, path, action) that fits it.

    A rule fits its host and all subdomains where the url's path starts with the
    rule's path. Each url is expanded into the host-suffix and path-prefix
    expressions of the shapes (labels, path length) that occur in the rules; the
    expressions meet the rules in an equi-join on a short prefix of their SHA-256
    digest, then full digests are compared. The longest rule wins; of equally long
    ones that with the longer host; of one expression with both actions, block.

    Plan: scan -> expand -> join (broadcast while the rules take at most
    BROADCAST_BYTES, else shuffled) -> one aggregation by row. The partial
    aggregation leaves one record a row before the shuffle, whatever the hosts.

    Null ids and urls, empty urls, repeated rows and repeated ids are judged row by
    row; rules with a null part are ignored; without rules or rows the verdict is
    ``default`` or the result empty. A very long url has as many expressions as the
    rules have shapes. Other columns of either input take no part.

    Returns ``id_col``, host, path, rule (null if none fits), verdict.
    """
    spark = pages.sparkSession
    r = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.col("action").alias("ra")).dropna()
    r = r.withColumn("rh", lower_ascii(F.col("rh"))).distinct()
    shapes = sorted({(x["k"], x["m"]) for x in r.select(F.size(F.split("rh", r"\.")).alias("k"), F.length("rp").alias("m")).distinct().collect()})
    digest = F.sha2(_expression(F.col("rh"), F.col("rp")), 256)
    r = r.select(
        digest.alias("r_digest"),
        F.substring(digest, 1, PREFIX_HEX).alias("prefix"),
        F.struct(
            (F.length("rh") + F.length("rp")).alias("n"),
            F.length("rh").alias("nh"),
            (F.col("ra") == "block").alias("blocks"),
            F.concat("rh", "rp").alias("rule"),
            F.col("ra").alias("action"),
        ).alias("r_hit"),
    )
    r = small(r)
    host, path = url_host_path(F.col("_url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"))
    rows = rows.select("_id", F.monotonically_increasing_id().alias("_row"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    expressions = [
        F.when(
            (F.size(labels) >= k) & (F.length("path") >= m),
            F.sha2(_expression(F.concat_ws(".", F.slice(labels, -k, k)), F.substring("path", 1, m)), 256),
        )
        for k, m in shapes
    ]
    rows = rows.withColumn("digest", F.explode(F.array(*expressions, F.lit(None).cast("string"))))
    rows = rows.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    met = rows.join(r, "prefix", "left")
    hit = F.when(F.col("digest") == F.col("r_digest"), F.col("r_hit"))
    best = met.groupBy("_row", "_id", "host", "path").agg(F.max(hit).alias("hit"))
    return best.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.action"), F.lit(default)).alias("verdict"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


QUERIES = {"op3_url_filters": op3_url_filters}

SQL = {
    "op3_url_filters": """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h0 FROM a),
c AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM d
""",
}
