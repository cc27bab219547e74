"""Operator 4: canonical exact digests of documents.

A text is normalised (NFKC), case-folded, normalised again, and its white space is folded; equal
canonical texts have equal 128-bit xxHash digests. Grouping compares the canonical bytes inside equal
buckets: rows are aggregated by digest and bytes, first where they are read, so that a large bucket of
copies is one row for each task, and a collision would part a group and not join it. Digests are exact:
two fingerprints are alike (1.0) or not (0.0), and likeness too is confirmed on the bytes.

Edge cases: a null text counts as empty; null ids sort first and pass through, and a group without any
id has group null; repeated ids are ordered by text and grouped by their own texts; a single document is
its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, bucket_of, id_bounds, materialize, partitions, slices


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split()).encode()
    return " ".join(text.lower().split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text; no shuffle."""
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    out.add(key, digest(canonical(text)))
                yield out.take()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def several(prints: DataFrame) -> DataFrame:
    """fingerprint of buckets with more than one row."""
    return materialize(prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "buckets")


def grouped(rows: DataFrame) -> DataFrame:
    """rows (with doc_id, fingerprint, body) without body and with group_id: the smallest id with the same bytes.

    Digest and bytes are the key of one aggregation. Where all rows of a digest have the same bytes, as
    they do short of a collision, the digest then stands for them; else the bytes are joined as well.
    Rows without body are alone.
    """
    known = rows.where(F.col("body").isNotNull())
    found = known.groupBy("fingerprint", "body").agg(F.min("doc_id").alias("least")).groupBy("fingerprint").agg(F.count("*").alias("kinds"), F.min("least").alias("least"))
    found = materialize(found, "groups")
    columns = [c for c in rows.columns if c != "body"]
    out = rows.join(found, "fingerprint", "left")
    plain = out.where("kinds is null or kinds = 1").select(*columns, F.coalesce("least", "doc_id").alias("group_id"))
    collided = found.where("kinds > 1").select("fingerprint")
    if not collided.limit(1).count():
        return plain
    parted = known.join(collided, "fingerprint", "left_semi").groupBy("fingerprint", "body").agg(F.min("doc_id").alias("group_id"))
    return plain.unionByName(known.join(parted, ["fingerprint", "body"]).select(*columns, "group_id"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id: the smallest id with the same canonical bytes.

    Digests are counted first; only texts of buckets with several rows keep their bytes for the comparison.
    """
    base = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, fingerprint string, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    body = canonical(text)
                    out.add(key, digest(body), body, size=len(body))
                    if out.full():
                        yield out.take()
        yield from out.rest()

    marked = several(materialize(fingerprints(base), "digests")).withColumn("marked", F.lit(True))
    bodies = base.mapInArrow(run, schema).join(marked, "fingerprint", "left").select("doc_id", "fingerprint", F.when(F.col("marked"), F.col("body")).alias("body"))
    return grouped(materialize(bodies, "bodies"))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of what follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_successor(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id.

    Documents are dealt to id ranges, and the first document of each range also goes to the range
    before it, so each task streams its range in order and needs no other. The driver holds one id
    for each range. Which ids are of buckets with several rows travels with them, so that the canonical
    bytes of those alone are kept for the grouping; texts are shuffled once.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = id_bounds(docs, "doc_id", partitions(spark))
    bucket = bucket_of(F.col("doc_id"), bounds)
    keys = docs.select("doc_id", bucket.alias("bucket"))
    heads = sorted((r["bucket"], r["nulls"], r["head"]) for r in keys.groupBy("bucket").agg(
        F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect())
    # the head of a range also stands at the end of the range before it; of several rows with that id, the first in order counts
    to = {(None if nulls else head): heads[i - 1][0] for i, (_, nulls, head) in enumerate(heads)}
    known = [k for k in to if k is not None]
    extra = F.lit(None).cast("int")
    if known:
        target = F.element_at(F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*[F.lit(to[k]) for k in known])), F.col("doc_id"))
        extra = F.when(F.col("doc_id").isin(known), target)
    if None in to:
        extra = F.when(F.col("doc_id").isNull(), F.lit(to[None])).otherwise(extra)
    places = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("tail")), F.when(extra.isNotNull(), F.struct(extra.alias("bucket"), F.lit(1).alias("tail")))))
    dealt = docs.select("doc_id", "text", F.explode(places).alias("at")).select("at.bucket", "at.tail", "doc_id", "text", F.lit(None).cast("string").alias("mark"))
    prints = materialize(fingerprints(docs), "digests")
    marked = prints.join(several(prints), "fingerprint").select(bucket.alias("bucket"), F.lit(0).alias("tail"), "doc_id", F.lit(None).cast("string").alias("text"), F.col("fingerprint").alias("mark"))
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, body binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks of an id stand before its texts."""
        out = Rows(schema)
        now, key, text, mark, body, keep = None, None, None, None, None, False
        marks_of, marks = None, set()
        for big in batches:
            for batch in slices(big):
                for b, tail, k, t, m in zip(*(batch[i].to_pylist() for i in range(5)), strict=True):
                    if m is not None:
                        if marks_of != (b, k):
                            marks_of, marks = (b, k), set()
                        marks.add(m)
                        continue
                    bytes_of = canonical(t)
                    following = digest(bytes_of)
                    if b == now and text is not None:
                        new = edited(text, t)
                        other = canonical(new)
                        changed = digest(other)
                        out.add(
                            key, len(text), hashlib.sha256(new.encode()).hexdigest(), mark, changed, float(mark == changed and body == other),
                            float(mark == following and body == bytes_of), body if keep else None, size=len(body) * keep,
                        )
                    now, key, text, mark, body = b, k, (None if tail else t), following, bytes_of
                    keep = marks_of == (b, k) and following in marks
                    if out.full():
                        yield out.take()
        yield from out.rest()

    rows = (
        dealt.unionByName(marked).repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "tail", "doc_id", F.col("mark").isNull(), "text")
        .mapInArrow(run, schema)
    )
    return grouped(materialize(rows, "successors"))
