"""Binary frames: a fixed header of 64 bytes before an encoded record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER, LARGEST_RECORD, LARGEST_PAYLOAD = 64, 64 * 1024, 60 * 1024  # fixed values


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def frame_problem(frame: Column, magic: bytes, version: Column | None = None) -> Column:
    """The first rule that a frame breaks; null if none."""
    out = F.when(F.octet_length(frame) < HEADER, "short").when(F.substring(frame, 1, len(magic)) != F.lit(magic), "magic")
    out = out if version is None else out.when(version != 1, "version")
    return out.when(F.octet_length(frame) > HEADER + LARGEST_RECORD, "size")


def header(frame: Column) -> Column:
    """Only the header: a projection of its bytes."""
    return F.substring(frame, 1, HEADER)


def field(frame: Column, offset: int, length: int) -> Column:
    """Unsigned little-endian number in a header."""
    return F.conv(_swapped(frame, offset, length), 16, 10).cast("bigint")


def _swapped(frame: Column, offset: int, length: int) -> Column:
    return F.concat(*[F.hex(F.substring(frame, offset + i + 1, 1)) for i in reversed(range(length))])


def body(frame: Column) -> Column:
    return F.substring(frame, HEADER + 1, LARGEST_RECORD)


def encode(head: Column, record: Column) -> Column:
    """Null where the header has another length or the record is too large."""
    return F.when((F.octet_length(head) == HEADER) & (F.octet_length(record) <= LARGEST_RECORD), F.concat(head, record))


def payload_ok(payload: Column, record: Column) -> Column:
    return (F.octet_length(payload) <= LARGEST_PAYLOAD) & (F.octet_length(record) <= LARGEST_RECORD)


def split(frames: DataFrame, magic: bytes, frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Good frames with header and body, and the rest with a reason."""
    judged = frames.withColumn("problem", frame_problem(F.col(frame), magic))
    good = judged.where("problem is null").drop("problem").withColumns({"header": header(F.col(frame)), "body": body(F.col(frame))})
    return good, judged.where("problem is not null")


def claim_payload(payload: Column) -> Column:
    """Struct peer, addrs, key of: 32 bytes, a length of four, JSON addresses, the rest. Bad JSON gives no address."""
    n = F.conv(F.hex(F.substring(payload, 33, 4)), 16, 10).cast("int")
    addrs = F.from_json(F.substr(payload, F.lit(37), n).cast("string"), "array<string>")
    return F.struct(F.substring(payload, 1, 32).alias("peer"), F.coalesce(addrs, F.array().cast("array<string>")).alias("addrs"), F.substr(payload, n + 37, F.octet_length(payload)).alias("key"))
