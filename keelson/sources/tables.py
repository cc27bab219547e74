"""Keyed tables: open, read by key or prefix, append, replace without some keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.digests import sha3
from keelson.operators.retention import latest


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Through Spark's committer, which makes a write whole or not at all."""
    df.write.mode("append").partitionBy(*(by or [])).parquet(path)


def point(table: DataFrame, **keys: object) -> DataFrame:
    """Rows of a key; equality filters that reach the scan."""
    for name, value in keys.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def current(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key of an append-only table of upserts."""
    return latest(table, keys, order, order)


def shard_states(table: DataFrame, cid: object) -> DataFrame:
    """Current states of a blob's shards by index."""
    return current(point(table, blob_cid=cid), ["blob_cid", "shard_index"], "seq").orderBy("shard_index")


def without(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys, on, "left_anti")


def overlays(table: DataFrame, owner: object, domain: str | None = None) -> DataFrame:
    """An owner's private records, or the one of a domain in any case."""
    mine = table.where(F.col("owner") == F.lit(owner))
    return mine if domain is None else mine.where(F.lower("domain") == domain.lower())


def to_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def intact(shards: DataFrame, data: str = "data", digest: str = "hash") -> DataFrame:
    """Rows whose digest is that of their data."""
    return shards.where(sha3(F.col(data)) == F.col(digest))


def blob_range(data: Column, offset: Column, most: Column) -> Column:
    return F.substr(data, offset + 1, most)
