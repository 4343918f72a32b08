"""Transitive closure of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.cluster import written

#: Edge tables up to so many rows are closed on the driver, if their closure has no more than so many pairs.
DRIVER_EDGES, DRIVER_PATHS = 2_000, 100_000


class CycleError(ValueError):
    """The hierarchy has a cycle and cycles were not allowed."""


def _close(edges: set[tuple[str, str]], most: int) -> list[tuple[str, str]] | None:
    """The closure, or None as soon as it has more than ``most`` pairs."""
    up: dict[str, set[str]] = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = []
    for a in up:
        seen, todo = set(), list(up[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo.extend(up.get(b, ()))
                if len(out) + len(seen) > most:
                    return None
        out += [(a, b) for b in seen]
    return sorted(out)


def transitive_closure(edges: DataFrame, on_cycle: str = "close", driver_edges: int = DRIVER_EDGES, driver_paths: int = DRIVER_PATHS) -> DataFrame:
    """All (sub, sup) reachable over ``edges`` (sub, sup), cycles included.

    A table of at most ``driver_edges`` rows whose closure has at most
    ``driver_paths`` pairs is closed in memory and comes back as a local relation,
    which Catalyst broadcasts by its size. Others are closed by path doubling: each
    round extends the paths that the last round found by all paths known, so the
    rounds follow the logarithm of the depth and old pairs are not joined again; each
    round is written, so lineage stays short. on_cycle="error" raises CycleError where
    a node reaches itself over others or by a cycle of its own.
    """
    if on_cycle not in ("close", "error"):
        raise ValueError(f"on_cycle {on_cycle!r}: close or error")
    spark = edges.sparkSession
    edges = edges.select("sub", "sup").dropna().distinct()
    some = edges.limit(driver_edges + 1).collect()
    paths = _close({(r["sub"], r["sup"]) for r in some}, driver_paths) if len(some) <= driver_edges else None
    if paths is not None:
        if on_cycle == "error" and any(a == b for a, b in paths):
            raise CycleError("the hierarchy has a cycle")
        return spark.createDataFrame(paths, "sub string, sup string")
    total = new = written(edges)
    while True:
        # a path twice as long as those known begins or ends with one found in the last round
        step = lambda x, y: x.alias("x").join(y.alias("y"), F.col("x.sup") == F.col("y.sub")).select(F.col("x.sub").alias("sub"), F.col("y.sup").alias("sup"))
        found = step(new, total).unionByName(step(total, new)).distinct()
        new = written(found.join(total, ["sub", "sup"], "left_anti"))
        if new.isEmpty():
            break
        total = written(total.unionByName(new))
    if on_cycle == "error" and not total.filter("sub = sup").isEmpty():
        raise CycleError("the hierarchy has a cycle")
    return total
