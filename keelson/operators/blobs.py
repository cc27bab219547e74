"""Erasure-coded blobs: encoding, reconstruction, roots and sampled audits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.digests import _sha3, content_id, merkle_path, path_root, sampled_block, shard_root
from keelson.functions.gf256 import Code

BLOCK = 4096


def encode(blobs: DataFrame, k: int = 10, m: int = 4, shard_length: int | None = None) -> DataFrame:
    """blob_id, length, shard_index, shard of (blob_id, payload): k + m rows for each payload that isn't empty."""
    kind = blobs.schema["blob_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(k, m)
        for rows in batches:
            for at in range(0, len(rows), 64):  # bounded pieces: the output is 1.4 times the input
                out = [
                    (b, len(p), i, s)
                    for b, p in rows.iloc[at : at + 64].itertuples(index=False) if p
                    for i, s in enumerate(code.encode(bytes(p), shard_length))
                ]
                yield pd.DataFrame(out, columns=["blob_id", "length", "shard_index", "shard"])

    return blobs.select("blob_id", "payload").mapInPandas(run, f"blob_id {kind}, length bigint, shard_index int, shard binary")


def decode(shards: DataFrame, k: int = 10, m: int = 4) -> DataFrame:
    """blob_id, payload, error of (blob_id, length, shard_index, shard): from the first k present by index.

    A blob has k + m shards at most, which one aggregation brings together in order; blobs are then
    decoded a batch at a time.
    """
    kind = shards.schema["blob_id"].dataType.simpleString()
    present = F.slice(F.sort_array(F.collect_list(F.struct("shard_index", "shard"))), 1, k)
    chosen = shards.groupBy("blob_id").agg(F.first("length").alias("length"), present.alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(k, m)
        for big in batches:
            for at in range(0, big.num_rows, 64):
                batch, payloads, errors = big.slice(at, 64), [], []
                for length, index, parts in zip(*(batch[i].to_pylist() for i in (1, 2, 3)), strict=True):
                    try:
                        payloads.append(code.decode(list(zip(index, parts, strict=True)), length))
                        errors.append(None)
                    except ValueError as e:
                        payloads.append(None)
                        errors.append(str(e))
                columns = [batch[0], pa.array(payloads, pa.binary()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["blob_id", "payload", "error"])

    return chosen.select("blob_id", "length", "s.shard_index", "s.shard").mapInArrow(run, f"blob_id {kind}, payload binary, error string")


def manifests(blobs: DataFrame, shards: DataFrame) -> DataFrame:
    """blob_id, cid, length, shard_roots in order of the index."""
    roots = shards.select("blob_id", "shard_index", shard_root(F.col("shard")).alias("root")).groupBy("blob_id").agg(
        F.sort_array(F.collect_list(F.struct("shard_index", "root"))).alias("r"))
    return blobs.select("blob_id", content_id(F.col("payload")).alias("cid"), F.octet_length("payload").cast("bigint").alias("length")).join(
        roots.select("blob_id", F.transform("r", lambda x: x["root"]).alias("shard_roots")), "blob_id")


def stored(shards: DataFrame, content: Column) -> DataFrame:
    """Content-addressed: one row for each digest."""
    return shards.withColumn("hash", content).dropDuplicates(["hash"])


def challenges(audits: DataFrame) -> DataFrame:
    """audits (seed, shard_index, ...) with the block that each samples."""
    return audits.withColumn("block", sampled_block(F.col("seed"), F.col("shard_index")))


def respond(audits: DataFrame, shards: DataFrame) -> DataFrame:
    """audits with the sampled block and its path to the shard's root; block counts wrap at the shard's own."""
    joined = audits.join(shards.select("blob_id", "shard_index", "shard"), ["blob_id", "shard_index"])

    @F.pandas_udf("data binary, path array<struct<hash binary, position string>>")
    def prove(shard: pd.Series, block: pd.Series) -> pd.DataFrame:
        out = []
        for s, b in zip(shard, block, strict=True):
            parts = [bytes(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] or [b""]
            at = int(b) % len(parts)
            out.append((parts[at], [{"hash": h, "position": p} for h, p in merkle_path([_sha3(x) for x in parts], at)]))
        return pd.DataFrame(out, columns=["data", "path"])

    return joined.withColumn("proof", prove("shard", "block")).select(*audits.columns, "proof.data", "proof.path")


def verify(responses: DataFrame, roots: DataFrame) -> DataFrame:
    """responses with verified, against (blob_id, shard_index, root)."""

    @F.pandas_udf("binary")
    def lead(data: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([path_root(_sha3(bytes(d)), [(bytes(p["hash"]), p["position"]) for p in steps]) for d, steps in zip(data, path, strict=True)])

    joined = responses.join(roots, ["blob_id", "shard_index"], "left")
    return joined.withColumn("verified", F.coalesce(lead("data", "path") == F.col("root"), F.lit(False))).drop("root")
