"""Records in the Protobuf wire format, and their fixed header, to typed columns and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import field

# Numbers of the fields of a record and of a tag.
BYTES = {1: "magic", 2: "header", 3: "sender_id", 4: "recipient_id", 5: "payload", 6: "signature"}
NUMBERS = {7: "core_tag_mask", 9: "timestamp"}
TAGS, TAG_TYPE, TAG_VALUE = 8, 1, 2
SCHEMA = (
    ", ".join(f"{c} binary" for c in BYTES.values()) + ", core_tag_mask decimal(20,0), timestamp decimal(20,0), "
    "tags array<struct<tag_type:bigint,tag_value:binary>>, error string"
)
HEADER = struct.Struct("<IHHII16s16sQ8s")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad number")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            n, at = varint(data, at) if kind == 2 else ({1: 8, 5: 4}.get(kind, -1), at)
            if n < 0 or at + n > len(data):
                raise ValueError("bad field")
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def parse(data: bytes, magic: bytes) -> dict:
    out: dict = dict.fromkeys(BYTES.values(), b"") | dict.fromkeys(NUMBERS.values(), 0) | {"tags": []}
    for number, value in fields(data):
        if number in BYTES and isinstance(value, bytes):
            out[BYTES[number]] = value
        elif number in NUMBERS and isinstance(value, int):
            out[NUMBERS[number]] = value
        elif number == TAGS and isinstance(value, bytes):
            tag = dict(fields(value))
            out["tags"].append({"tag_type": tag.get(TAG_TYPE, 0), "tag_value": tag.get(TAG_VALUE, b"")})
    if out["magic"] != magic:
        raise ValueError("magic")
    return out


def number_bytes(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def build(record: dict) -> bytes:
    """The bytes of a record; fields at their default are left out."""
    part = lambda n, b: number_bytes(n << 3 | 2) + number_bytes(len(b)) + b
    count = lambda n, v: number_bytes(n << 3) + number_bytes(v) if v else b""
    out = [part(n, record[c]) for n, c in BYTES.items() if record[c]]
    out.append(count(7, int(record["core_tag_mask"])))
    for t in record["tags"]:
        out.append(part(TAGS, count(TAG_TYPE, int(t["tag_type"])) + (part(TAG_VALUE, t["tag_value"]) if t["tag_value"] else b"")))
    return b"".join([*out, count(9, int(record["timestamp"]))])


def decoded(frames: DataFrame, magic: bytes, body: str = "body") -> DataFrame:
    """Typed columns of encoded records, with an error (null if none)."""
    from decimal import Decimal

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    empty = dict.fromkeys(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for raw in rows.iloc[:, 0]:
                try:
                    found = parse(bytes(raw), magic) | {"error": None}
                    out.append(found | {c: Decimal(found[c]) for c in NUMBERS.values()})
                except (ValueError, TypeError) as e:
                    out.append(empty | {"error": str(e)})
            yield pd.DataFrame(out, columns=names)

    return frames.select(body).mapInPandas(run, SCHEMA)


def header_fields(header: Column) -> Column:
    """Struct of a header of 64 bytes; null for any other length."""
    return F.when(F.octet_length(header) == HEADER.size, F.struct(
        field(header, 0, 4).alias("magic"), field(header, 4, 2).alias("version"), field(header, 6, 2).alias("flags"), field(header, 8, 4).alias("envelope_len"),
        field(header, 12, 4).alias("fast_tag"), F.substring(header, 17, 16).alias("sender_key_id"), F.substring(header, 33, 16).alias("recipient_key_id"),
        F.conv(F.concat(*[F.hex(F.substring(header, 49 + i, 1)) for i in reversed(range(8))]), 16, 10).cast("decimal(20,0)").alias("sequence_nonce"),
    ))


def header_bytes(magic: int, version: int, flags: int, length: int, tag: int, sender: bytes, recipient: bytes, nonce: int) -> bytes:
    return HEADER.pack(magic, version, flags, length, tag, sender, recipient, nonce, bytes(8))


def header_valid(header: Column, magic: int) -> Column:
    h = header_fields(header)
    return (h["magic"] == magic) & (h["version"] == 1)
