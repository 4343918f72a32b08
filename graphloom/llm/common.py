"""What the operators share: tables in the shared folder, reading, Arrow batches that carry columns untouched."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.cluster import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters, digits and non-ASCII characters, before lower-casing: A-Z are word characters there.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, UPPER, LOWER)


#: Rows of an Arrow batch while a table is written: a row may be a long text, and buffers grow with a batch.
BATCH_ROWS = 256


class Scratch:
    """Tables written in the shared folder, so that no lineage runs through them.

    ``drop`` removes tables that no later result reads. What the returned frame
    still reads stays until the application ends, as it is read lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _path(self, path: str):
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _end(self) -> None:
        try:
            fs, p = self._path(self.at)
            fs.delete(p, True)
        except Exception:  # the session is gone, and with it the way to the folder
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        conf, key = self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        rows = int(conf.get(key))
        conf.set(key, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(key, rows)
        # Spark removes shuffle files once the driver's JVM finds them unreachable; a hint lets it look
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def size(self, name: str) -> int:
        """Bytes of a saved table."""
        fs, p = self._path(f"{self.at}/{name}")
        return fs.getContentSummary(p).getLength()

    def drop(self, *names: str) -> None:
        for n in names:
            fs, p = self._path(f"{self.at}/{n}")
            fs.delete(p, True)


def free_executors(spark: SparkSession) -> None:
    """Executors collect their garbage and give the memory back to the system.

    A JVM left alone keeps its heap as large as it has ever been, with the buffers
    outside it that garbage still holds, beside the next stage's Python workers. The
    tasks, one for each core, reach every executor while none is busy; one that they
    miss only stays larger.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


#: Bytes that one broadcast may take, by the rows' types and the lengths of their texts and arrays.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its rows take at most ``most`` bytes; a larger table is shuffled.

    Rows are counted with the bytes of their texts and arrays, and no further than
    the limit allows.
    """

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            held = F.octet_length(F.array_join(c, "")) + 24 * F.size(c) if isinstance(kind.elementType, T.StringType) else 8 * F.size(c)
            return F.greatest(F.coalesce(held, F.lit(0)), F.lit(0)) + 24
        if isinstance(kind, T.StructType):
            return sum((width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        return F.lit(8)

    one = F.lit(16)
    for f in df.schema.fields:
        one = one + width(F.col(f"`{f.name}`"), f.dataType)
    # no row takes less than 24 bytes, so more rows than this are too many whatever they hold
    got = df.select(one.cast("long").alias("b")).limit(most // 24 + 1).agg(F.sum("b")).first()[0] or 0
    return F.broadcast(df) if got <= most else df


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    """A column of arrays of numbers."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _give_back() -> None:
    """Freed memory back to the system: a Python worker lives on and would keep it beside its next stage's."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, keep: list[str], ddl: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], rows: int = 256) -> DataFrame:
    """``df`` through Arrow batches of at most ``rows`` rows.

    ``run`` takes the batches of a partition and yields (batch, take, columns): the
    columns ``keep`` of the batch's rows ``take`` (None: all) go through as they are,
    whatever their type and nulls, so ids are never changed; ``columns`` (name to
    values) are those of ``ddl``.
    """
    made = T.StructType.fromDDL(ddl)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in made.fields}
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keep], *made.fields])

    def small_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, take, cols in run(small_parts(batches)):
            held = [] if batch is None else [batch.column(batch.schema.get_field_index(k)) for k in keep]
            if take is not None:
                held = [c.take(pa.array(take)) for c in held]
            new = [cols[n] if isinstance(cols[n], pa.Array) else pa.array(cols[n], kind) for n, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*held, *new], names=[*keep, *kinds])
        _give_back()

    return df.mapInArrow(go, schema)


def runs_by_bytes(texts: list[bytes], limit: int = 1 << 21) -> list[slice]:
    """Consecutive texts of at most ``limit`` bytes together; a longer text is alone."""
    out, at, size = [], 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > limit:
            out.append(slice(at, k))
            at, size = k, 0
        size += len(t) + 1
    return [*out, slice(at, len(texts))] if texts else []
