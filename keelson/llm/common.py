"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='keelson-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty tables of materialize whose last reader is done; nothing that is still to run may read them."""
    for df in tables:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df.stored_at)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of finished, unreferenced steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then what its task has freed goes back to the system: workers live from task to task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending split points of an integer key, from a scan of that column alone.

    The quantile sketch has a fixed relative error, so the driver holds a number of values
    that depends on parts only.
    """
    probs = [i / parts for i in range(1, parts)]
    if not probs:
        return []
    found = df.select(F.col(key).cast("double").alias("k")).na.drop().approxQuantile("k", probs, 0.25 / parts)
    return sorted({int(x) for x in found})


def bucket_of(key: Column, bounds: Sequence[int]) -> Column:
    """Number of bounds below or equal to key, as a balanced CASE tree; null is in bucket 0."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(bounds))).cast("int")


ARROW = {
    "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(),
    "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us"),
}


def arrow_type(name: str) -> pa.DataType:
    if name.startswith("decimal("):
        return pa.decimal128(*map(int, name[8:-1].split(",")))
    return pa.list_(arrow_type(name[6:-1])) if name.startswith("array<") else ARROW[name]


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow's form of "name type, name type", for use on executors."""
    return pa.schema([(name, arrow_type(kind)) for name, kind in (x.split() for x in schema.split(", "))])


class Rows:
    """Collects output columns and hands out Arrow batches of bounded size."""

    def __init__(self, schema: str, limit: int = 20_000, limit_bytes: int = 16 << 20):
        self.schema, self.limit, self.limit_bytes = arrow_schema(schema), limit, limit_bytes
        self.columns: list[list] = [[] for _ in self.schema]
        self.size = 0

    def add(self, *values: object, size: int = 0) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.size += size

    def full(self) -> bool:
        return len(self.columns[0]) >= self.limit or self.size >= self.limit_bytes

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema
        )
        self.columns, self.size = [[] for _ in self.schema], 0
        return batch

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Bounded pieces of a batch, so that Python holds few long texts at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
