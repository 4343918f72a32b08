"""Best-fit packing by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 4096, 1
#: Words whose ids a Python worker remembers; beyond it, the memory is emptied. No result depends on it.
REMEMBERED = 400_000

_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizer's own split, for lower-cased text of code points below 256.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
#: Texts with any of these go to the tokenizer whole: other alphabets, special tokens, separators on which Python differs.
_OTHER = re.compile("[^\x00-\x1b\x20-\xff]|<\\|")


def _byte_alphabet() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    White space and piece borders are where the tokenizer cannot merge, so a text
    below code point 256 is split into words, each word is encoded once by the
    library's model, and the bytes are joined. All other texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model, alphabet = self.tokenizer.model, _byte_alphabet()

        class Memory(dict):
            def __init__(self, make):
                super().__init__()
                self.make = make

            def __missing__(self, word):
                if len(self) >= REMEMBERED:
                    self.clear()
                got = self[word] = self.make(word)
                return got

        def of_piece(piece: str) -> bytes:
            ids = [t.id for t in model.tokenize("".join(map(alphabet.__getitem__, piece.encode())))]
            return struct.pack(f"<{len(ids)}I", *ids)

        pieces = Memory(of_piece).__getitem__
        self.words = Memory(lambda word: b"".join(map(pieces, _PIECES.findall(word)))).__getitem__

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words, text.lower().split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, as workers are used again."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 and, if asked for, ids as bytes."""
    end = struct.pack("<I", end_id)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]):
        encode = encoder(path)
        for batch in batches:
            take, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    take.append(row)
                    out.append((k, at // 4, len(one) // 4, zlib.crc32(one)) + ((one,) if keep_ids else ()))
            if out:
                yield batch, np.array(take, np.int64), dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    return map_arrow(rows, ["doc"], "piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids, cut)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (times, {length: copies}) by minimum bin slack.

    Each bin starts with the longest length left; a bitset subset-sum over the
    lengths left, with as many copies as there are, finds the fullest feasible
    rest. That bin stays the fullest while its lengths last, so it is taken as
    often as they do; the number of steps follows the number of different lengths,
    not of documents.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    bins = []
    while left:
        first = next(iter(left))
        room = capacity - first
        reach, trail = 1, []
        mask = (1 << (room + 1)) - 1
        for n, c in left.items():
            c = min(c - (n == first), room // n)
            m = 1
            while c > 0 and not reach >> room & 1:
                m = min(m, c)
                trail.append((reach, n, m))
                reach |= (reach << n * m) & mask
                c -= m
                m *= 2
            if reach >> room & 1:
                break
        goal = reach.bit_length() - 1
        took = {first: 1}
        for before, n, m in reversed(trail):
            if not before >> goal & 1:
                took[n] = took.get(n, 0) + m
                goal -= n * m
        times = min(left[n] // m for n, m in took.items())
        bins.append((times, took))
        for n, m in took.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return bins


def _intervals(bins) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies in a bin, first bin, offset in the bin) by rank."""
    ranks: dict[int, int] = {}
    out: dict[int, list] = {}
    bin_id = 0
    for times, took in bins:
        offset = 0
        for n, m in took.items():
            out.setdefault(n, []).append((ranks.get(n, 0), m, bin_id, offset))
            ranks[n] = ranks.get(n, 0) + m * times
            offset += m * n
        bin_id += times
    return {n: np.array(x, np.int64) for n, x in out.items()}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack whole tokenised documents into as few sequences of ``capacity`` tokens as it can.

    A document is its ids and ``end_id``; a longer one is cut into pieces of
    ``capacity``, the last may be shorter. The pieces' lengths are counted (at most
    ``capacity`` counts reach the driver), ``plan_bins`` turns them into bins, and
    each piece takes the place of its rank among the pieces of its length. Ranks
    come from ``sqrt(pieces)`` hash chunks: a rank within its chunk plus the pieces
    of that length in earlier chunks, so that a length that a third of all pieces
    share is still dealt out evenly.

    Null and empty texts are the end id alone; null and repeated ids and repeated
    rows are pieces of their own, and ids of any type go through unchanged. Pieces of
    one length are interchangeable: ties are dealt out by row. A very long text is
    encoded whole and cut into pieces. An empty table gives no rows; other columns
    take no part.

    Returns ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, and
    ids (bytes) with ``keep_ids``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = tokenize_pieces(docs, path, id_col, text_col, capacity, end_id, keep_ids)
    pieces = scratch.save(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    chunks = max(1, math.isqrt(pieces.count()))
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    counted = scratch.save(pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")), "counted")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_intervals(plan_bins(histogram, capacity)))  # follows the different lengths only
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.withColumn("rank", F.row_number().over(W.partitionBy("length", "chunk").orderBy("row")) - 1)
    ranked = ranked.join(counted.select("length", "chunk", before.alias("before")), ["length", "chunk"])
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("row", "chunk")], (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sequence, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rank", "length"))
            for n in np.unique(length):
                at, table_ = length == n, places.value[int(n)]
                first, copies, bin_id, start = table_[np.searchsorted(table_[:, 0], rank[at], "right") - 1].T
                sequence[at] = bin_id + (rank[at] - first) // copies
                offset[at] = start + (rank[at] - first) % copies * n
            yield batch, None, {"sequence_id": sequence, "offset": offset}

    keep = [c for c in ranked.columns if c != "rank"]
    return map_arrow(ranked, keep, "sequence_id long, offset long", place, rows=1 << 16).withColumnRenamed("doc", id_col)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
