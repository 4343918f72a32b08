"""Exact top-k search by inner product: no-random-access aggregation over blocks of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Rows whose lists are sorted together, and queries that read them together.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 512
#: Queries, and vectors, of a cell of the grid at most, about.
CELL_QUERIES, CELL_ROWS = 4096, 16_384
#: Shares of each sorted list after which bounds are taken; what is open after the last is resolved.
DEPTHS = (0.5, 0.75, 0.875, 0.9375)
SCALE = 256


def quantised(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors, and floor(SCALE * x) of each component as double."""
    at, out = [], []
    for k, v in enumerate(column):
        if not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        v = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(v).all():
            at.append(k)
            out.append(np.floor(SCALE * v))
    return np.array(at, np.int64), out


def _kind(x: np.ndarray, q: np.ndarray) -> type:
    """The cheapest type in which all sums are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] * 2
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class Block:
    """One sorted list for each dimension over some rows, read in step by many queries.

    ``pairs`` counts (query, row) pairs, ``closed`` those that bounds ruled out before
    all lists were read, ``resolved`` those whose final score was needed, ``stopped``
    the queries that ended with no row left.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        by = np.argsort(-self.x, axis=0, kind="stable")
        self.rank = np.empty_like(by)
        np.put_along_axis(self.rank, by, np.arange(len(by))[:, None], axis=0)
        self.sorted = np.take_along_axis(self.x, by, axis=0)
        self.pairs = self.closed = self.resolved = self.stopped = 0

    def bounds(self, q: np.ndarray, depth: int, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of the rows, having read ``depth`` entries of each list.

        Lists are read from their large end for positive weights, else from the
        small end; what is unread lies between the last entry read and the list's end.
        Only entries read are looked at.
        """
        n, s, kind, x, rank = len(self.x), self.sorted, q.dtype, self.x[rows], self.rank[rows]
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
        high, low = rank < depth, rank >= n - depth
        lower = np.where(high, x, s[-1]).astype(kind) @ up + np.where(low, x, s[0]).astype(kind) @ down
        upper = np.where(high, x, s[depth - 1]).astype(kind) @ up + np.where(low, x, s[n - depth]).astype(kind) @ down
        return lower, upper

    def top(self, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, scores): each row that can be in the query's top k given ``floor``, the k-th score known.

        After each depth the k-th lower bound of a query raises its floor, and rows
        whose upper bound stays below it are closed for the query; a query without
        rows left stops, and rows that no query needs are read no further.
        """
        kind = _kind(self.x, q)
        n, q, floor = len(self.ids), q.astype(kind), floor.copy()
        own = np.searchsorted(self.ids, qids, "left"), np.searchsorted(self.ids, qids, "right")
        open_ = np.ones((n, len(qids)), bool)
        for g in np.flatnonzero(own[0] < own[1]):
            open_[own[0][g] : own[1][g], g] = False
        self.pairs += int(open_.sum())
        if kind is not object and n > k:
            for depth in sorted({max(1, int(share * n)) for share in DEPTHS}):
                rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                if not len(rows):
                    break
                lower, upper = self.bounds(q[cols], depth, rows)
                here = open_[np.ix_(rows, cols)]
                lower[~here] = -np.inf
                if len(rows) >= k:
                    floor[cols] = np.maximum(floor[cols], np.partition(lower, len(rows) - k, axis=0)[len(rows) - k])
                open_[np.ix_(rows, cols)] = here & (upper >= floor[cols])
        left = open_.sum(axis=0)
        self.resolved += int(left.sum())
        self.closed = self.pairs - self.resolved
        self.stopped += int((left == 0).sum())
        for g in np.flatnonzero(left):
            take = np.flatnonzero(open_[:, g])
            s = self.x[take].astype(kind) @ q[g]
            if len(take) > k:
                best = np.argsort(-s, kind="stable")[:k]  # ids ascend, so ties go to the smaller
                take, s = take[best], s[best]
            yield int(g), self.ids[take], s


def _cells(k: int):
    """The best k of each query within its cell; a cell's queries come before its vectors."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, asked, held, best = None, {}, {}, {}

        def work(d: int) -> None:
            ids, rows = zip(*held[d], strict=True)
            held[d] = []
            keys, qids, q, floors = asked[d]
            block = Block(np.array(ids, np.int64), np.stack(rows))
            for at in range(0, len(qids), BLOCK_QUERIES):
                part = slice(at, at + BLOCK_QUERIES)
                for g, i, s in block.top(qids[part], q[part], k, floors[part]):
                    if (d, at + g) in best:
                        i, s = np.concatenate([best[d, at + g][0], i]), np.concatenate([best[d, at + g][1], s])
                    keep = np.lexsort((i, -s))[:k]
                    best[d, at + g] = i[keep], s[keep]
                    if len(keep) == k:
                        floors[at + g] = float(s[keep[-1]])

        def done():
            for d in [d for d in held if held[d]]:
                work(d)
            if best:
                yield None, None, {
                    "query": [x for (d, g), b in best.items() for x in [asked[d][0][g]] * len(b[0])],
                    "query_id": [x for (d, g), b in best.items() for x in [int(asked[d][1][g])] * len(b[0])],
                    "vec_id": [int(x) for b in best.values() for x in b[0]],
                    "score": [int(x) for b in best.values() for x in b[1]],
                }

        gathered: dict[int, list] = {}
        for batch in batches:
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("row", "col", "role", "id", "h", "v")}
            where, role, ids, keys = np.stack([col["row"].to_numpy(), col["col"].to_numpy()], axis=1), col["role"].to_numpy(), col["id"].to_numpy(), col["h"].to_numpy()
            at, rows = quantised(col["v"])
            for p, v in zip(at, rows, strict=True):
                if now != (here := tuple(where[p])):
                    yield from done()
                    now, asked, held, best, gathered = here, {}, {}, {}, {}
                if role[p] == 0:
                    gathered.setdefault(len(v), []).append((int(keys[p]), int(ids[p]), v))
                    continue
                if gathered:
                    for d, x in gathered.items():
                        asked[d] = [y[0] for y in x], np.array([y[1] for y in x], np.int64), np.stack([y[2] for y in x]), np.full(len(x), -np.inf)
                        held[d] = []
                    gathered = {}
                if len(v) in held:
                    held[len(v)].append((ids[p], v))
                    if len(held[len(v)]) == BLOCK_ROWS:
                        work(len(v))
        yield from done()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """The k highest integer inner products of each query vector with all other vectors.

    Components become floor(256 * x). Vectors and queries are dealt by hash onto a
    grid of cells of about CELL_ROWS vectors and CELL_QUERIES queries; each vector
    goes to the cells of its row, each query to those of its column, so nothing is
    broadcast or collected, and both tables are scanned once. A cell reads its vectors
    in blocks of BLOCK_ROWS: a list sorted for each dimension, read in step to the
    DEPTHS for all queries at once, with a lower and an upper bound of each row's
    score. Rows that cannot reach the k-th lower bound (or the k-th score of earlier
    blocks) are closed; a query with no rows left stops; final scores are computed for
    the rows left alone. A ranking by query merges the cells.

    Ties go to the smaller id. Vectors that are null or empty or hold null or
    non-finite components, and null ids, take no part; a query meets only vectors of
    its own length; rows that share a query's id are its own and are left out;
    repeated rows are candidates each, and a query asked twice answers once. Queries
    of one id with different vectors are ranked each on their own. Long vectors make
    wide blocks; a block is bounded by its rows. An empty table gives no rows. Other
    columns take no part. Scores beyond a long are an error.

    Returns query_id, rank (from 1), vec_id, score.
    """
    usable = "id IS NOT NULL AND v IS NOT NULL"
    take = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(usable).withColumn("h", F.xxhash64("id", "v"))
    source, asked = take(vectors), take(queries).dropDuplicates(["id", "h"])
    rows, cols = max(1, -(-source.count() // CELL_ROWS)), max(1, -(-asked.count() // CELL_QUERIES))
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.col("h"), F.lit(n)).cast("int")
    grid = asked.select(line(rows).alias("row"), mine(cols).alias("col"), F.lit(0).alias("role"), "id", "h", "v")
    grid = grid.unionByName(source.select(mine(rows).alias("row"), line(cols).alias("col"), F.lit(1).alias("role"), "id", "h", "v"))
    grid = grid.repartition("row", "col").sortWithinPartitions("row", "col", "role")
    out = map_arrow(grid, [], "query long, query_id long, vec_id long, score long", _cells(k), rows=1024)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES = {"op1_topk_search": op1_topk_search}

SQL = {
    "op1_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
""",
}
