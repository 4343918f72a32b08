"""Substring dedup by recompression: words, runs and pairs are named until symbols span several words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .repeats import Kind, anchors_of, apply_removal, covered, find_repeats
from .wordhash import U, Words, mix, prefix_hash

#: Runs of one word up to so many are named; the most words of a symbol after each pair round.
RUN, CAPS = 4, (2, 4, 6)
#: Words at either end of a window in which naming can depend on what lies outside.
EDGE = RUN - 1 + sum(c - 1 for c in CAPS)


def recompress(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, starts, spans) of the symbols after the run and the pair rounds.

    A name is a fixed function of what it names, so every task gives the same string
    the same name without a table of names. Runs of up to RUN equal words become one
    symbol. In each pair round a bit of its name puts a symbol left or right; a left
    one joins a right one after it, if both are of one document and together within
    the round's cap. Whether two symbols join depends on these two alone, so equal
    strings get equal symbols but for EDGE words at either end.
    """
    start, span = np.arange(len(name)), np.ones(len(name), np.int64)
    with np.errstate(over="ignore"):
        if len(name):
            new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]))
            size = np.diff(np.append(new, len(name)))
            joined = (size > 1) & (size <= RUN)
            keep = np.ones(len(name), bool)
            keep[np.flatnonzero(np.repeat(joined, size))] = False
            keep[new] = True
            name = name.copy()
            name[new[joined]] = mix(name[new[joined]] * U(3) + size[joined].astype(np.uint64))
            span[new[joined]] = size[joined]
            name, start, span, doc = name[keep], start[keep], span[keep], doc[keep]
        for k, cap in enumerate(CAPS):
            right = (mix(name ^ U(0x1F123BB5 * (k + 1))) & U(1)).astype(bool)
            pair = np.flatnonzero(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]) & (span[1:] + span[:-1] <= cap)) if len(name) else np.zeros(0, np.int64)
            name = name.copy()
            name[pair] = mix(name[pair] * U(0x9E3779B97F4A7C15) + mix(name[pair + 1]) + U(k + 7))
            span = span.copy()
            span[pair] += span[pair + 1]
            keep = np.ones(len(name), bool)
            keep[pair + 1] = False
            name, start, span, doc = name[keep], start[keep], span[keep], doc[keep]
    return name, start, span


class WordKind(Kind):
    def __init__(self, width: int):
        self.width, self.reach = width, width - 2 * EDGE - CAPS[-1] + 1
        if self.reach < CAPS[-1]:
            raise ValueError(f"a window needs at least {2 * EDGE + 2 * CAPS[-1] - 1} words")
        self.splits = tuple(g for g in (2 * CAPS[-1], 4 * CAPS[-1]) if g < width) + (width,)

    def values(self, text: bytes) -> np.ndarray:
        return Words([text]).hash

    def anchors(self, texts: list[bytes]) -> Iterator[tuple]:
        words = Words(texts)
        size = np.diff(words.first)
        name, start, span = recompress(words.hash, np.repeat(np.arange(len(texts)), size))
        symbol = np.zeros(len(words.hash), np.uint64)
        symbol[start] = mix(name + span.astype(np.uint64))
        order = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
        # long symbols first, then by name; the place in the low bits makes the leftmost win
        order[start] = ((CAPS[-1] - np.minimum(span, CAPS[-1])).astype(np.uint64) << U(60)) | (symbol[start] >> U(36) << U(32)) | start.astype(np.uint64)
        found = anchors_of(order, symbol, prefix_hash(words.hash), words.first[:-1], size, self.width, EDGE, self.reach)
        for k, x in enumerate(found):
            yield int(size[k]), hashlib.sha256(b" ".join(texts[k].split())).hexdigest(), *x

    def split(self, text: bytes) -> list[bytes]:
        return text.split()

    def context(self, parts: list[bytes], start: int, end: int) -> bytes:
        return b" ".join(parts[start:end])

    def tokens(self, contexts: list[bytes]) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        return [np.array([number.setdefault(w, len(number)) for w in c.split()], np.int64) for c in contexts]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """Remove the words covered by a window of ``width`` words that also starts in a document with a smaller id.

    Words are runs of what is not white space. Recompression names runs and pairs of
    symbols the same way in all documents; each window's key is its highest-level
    symbol (then the least name) away from its edges, so shared keys reveal shared
    windows, and hashes of whole ranges and windows (96 bits) verify them; see
    ``repeats``. Windows are judged on the input.

    Null, empty and short texts keep their words; null ids neither lose nor cause
    removals; equal ids do not remove from each other; repeated rows give the same
    result each. Other columns take no part.

    Returns ``id_col``, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space), kept_text (null where nothing was removed).
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = docs.withColumns({"k": F.xxhash64("id"), "h": F.xxhash64("text")})
    scratch = Scratch(docs.sparkSession, "substrings")
    rows, removed = find_repeats(docs, scratch, WordKind(width), "document")

    def cut(text: bytes, s, e) -> tuple:
        words = text.split()
        gone = covered(s, e, len(words), width)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        return int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")

    out = apply_removal(docs, rows, removed, cut, "n_removed long, kept_sha256 string, kept_text string")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        "kept_text",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}

SQL = {
    "op5_substring_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i + 1:i + 50], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
hit AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM win JOIN f USING (s) WHERE least < doc_id),
gone AS (SELECT r, unnest(range(i, i + least(50, coalesce(next - i, 50)))) AS p FROM hit),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r),
many AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN many USING (r)
""",
}
