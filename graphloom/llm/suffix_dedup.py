"""Suffix-array dedup: longest previous factors from previous and next smaller places in suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .repeats import Kind, apply_removal, covered, find_repeats, gram_anchors
from .wordhash import BYTE_VALUE

#: Bytes of the gram whose least hash is a window's key: long enough that few are shared by chance.
GRAM = 40


class Bytes(Kind):
    def __init__(self, width: int):
        if width <= GRAM:
            raise ValueError(f"width must be above {GRAM}")
        self.width = width
        self.splits = tuple(g for g in (2 * GRAM, 4 * GRAM) if g < width) + (width,)

    def values(self, text: bytes) -> np.ndarray:
        return BYTE_VALUE[np.frombuffer(text, np.uint8)]

    def anchors(self, texts: list[bytes]) -> Iterator[tuple]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        values = self.values(b"".join(texts) + bytes(GRAM))
        for t, x in zip(texts, gram_anchors(values, np.cumsum(size) - size, size, self.width, GRAM), strict=True):
            yield len(t), hashlib.sha256(t).hexdigest(), *x

    def split(self, text: bytes) -> bytes:
        return text

    def context(self, parts: bytes, start: int, end: int) -> bytes:
        return parts[start:end]

    def tokens(self, contexts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(c, np.uint8).astype(np.int64) for c in contexts]


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, keep: str = "none") -> DataFrame:
    """Remove the bytes covered by a ``width``-byte string that also starts elsewhere.

    keep="none" removes every copy, keep="first" all but the first by (id, place).
    Texts are UTF-8 bytes; matches never cross documents. Suffixes are spread by the
    least gram in their first ``width`` bytes, so equal strings meet; ranges of
    equal bytes around one gram are one context. A suffix array over the contexts of
    each gram gives each suffix's longest previous factor: the longer of its common
    prefixes with the nearest suffixes before and after it in order that have a
    smaller place. It was seen earlier if that is ``width`` bytes. A gram of more than
    GROUP contexts is split by longer grams, up to the strings themselves, so that
    every group gets a suffix array and none grows with the input. See ``repeats``.

    Null and short texts lose nothing (null has no bytes). With keep="first" null
    ids neither lose nor cause removals, and ties of id and place (repeated rows) are
    broken by row. Equal ids are different documents. A very long text is scanned
    whole, with its anchors in one row. Kept bytes need not be whole characters, so
    kept_bytes is binary. Ids of any type go through unchanged; an empty table gives
    no rows; other columns take no part.

    Returns ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, kept_bytes (null where nothing was removed).
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = docs.withColumns({"k": F.xxhash64("id"), "h": F.xxhash64("text")})
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows, removed = find_repeats(docs, scratch, Bytes(width), keep)

    def cut(text: bytes, s, e) -> tuple:
        gone = covered(s, e, len(text), width)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept

    out = apply_removal(docs, rows, removed, cut, "n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        "kept_bytes",
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents")).drop("kept_bytes")


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}

SQL = {
    "op6_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS s FROM (SELECT r, x, unnest(range(strlen(x) // 2 - 199)) AS i FROM d WHERE strlen(x) >= 400)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
run AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY r, g),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS upto FROM span),
part AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS t FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(strlen(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE t || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN part USING (r)
""",
}
