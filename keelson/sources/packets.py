"""IP packets and DNS messages as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUMPS = 16  # most compression pointers of a name


def number(data: Column, at: Column | int, length: int) -> Column:
    """Unsigned big-endian number of some bytes, from a zero-based place."""
    start = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    return F.conv(F.hex(F.substr(data, start, F.lit(length))), 16, 10).cast("bigint")


def packet_info(packet: Column) -> Column:
    """Struct proto, dst_port of an IPv4 or IPv6 packet; null where it is cut short. Only TCP and UDP have a port."""
    size, first = F.octet_length(packet), number(packet, 0, 1)
    version, words = F.shiftright(first, 4), first.bitwiseAND(15) * 4
    four, six = (version == 4) & (size >= 20) & (size >= words), (version == 6) & (size >= 40)
    proto = F.when(four, number(packet, 9, 1)).when(six, number(packet, 6, 1))
    start = F.when(four, words.cast("int")).otherwise(F.lit(40))
    port = F.when(proto.isin(6, 17) & (size >= start + 4), number(packet, start + 2, 2))
    return F.when(four | six, F.struct(proto.cast("int").alias("proto"), port.cast("int").alias("dst_port")))


def dns_header(message: Column) -> Column:
    """Struct of the twelve bytes of a header; null if there are fewer."""
    flags = number(message, 2, 2)
    bit = lambda n: F.shiftright(flags, n).bitwiseAND(1) == 1
    return F.when(F.octet_length(message) >= 12, F.struct(
        number(message, 0, 2).alias("id"), bit(15).alias("is_response"), F.shiftright(flags, 11).bitwiseAND(15).alias("opcode"), bit(10).alias("authoritative"),
        bit(9).alias("truncated"), bit(8).alias("recursion_desired"), bit(7).alias("recursion_available"), flags.bitwiseAND(15).alias("rcode"),
        *[number(message, 4 + 2 * i, 2).alias(c) for i, c in enumerate(("questions", "answers", "authorities", "additionals"))],
    ))


def dns_name(data: bytes, at: int) -> tuple[str, int]:
    """A name and the place after it; ValueError for one that is broken or points in circles."""
    labels, end, jumps = [], None, 0
    while True:
        n = data[at] if at < len(data) else -1
        if n >= 0xC0:
            if at + 1 >= len(data) or jumps == JUMPS:
                raise ValueError("bad pointer")
            end, at, jumps = at + 2 if end is None else end, (n & 0x3F) << 8 | data[at + 1], jumps + 1
        elif n == 0:
            return ".".join(labels), at + 1 if end is None else end
        elif 0 < n < 64 and at + n < len(data):
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1").lower())
            at += n + 1
        else:
            raise ValueError("bad label")


def questions(messages: DataFrame, message: str = "message") -> DataFrame:
    """messages with questions (array of name, type, class) and an error, null where all could be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found, errors = [], []
            for raw in rows[message]:
                out, error = [], None
                try:
                    data, at = bytes(raw), 12
                    if len(data) < 12:
                        raise ValueError("short")
                    for _ in range(int.from_bytes(data[4:6], "big")):
                        name, at = dns_name(data, at)
                        if at + 4 > len(data):
                            raise ValueError("short")
                        out.append({"name": name, "type": int.from_bytes(data[at : at + 2], "big"), "class": int.from_bytes(data[at + 2 : at + 4], "big")})
                        at += 4
                except (ValueError, TypeError) as e:
                    out, error = [], str(e)
                found.append(out)
                errors.append(error)
            yield rows.assign(questions=found, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    return messages.mapInPandas(run, f"{schema}, questions array<struct<name:string,type:int,class:int>>, error string")


def name_bytes(name: Column) -> Column:
    """A name as labels with their lengths, and a zero."""
    labels = F.filter(F.split(name, "\\."), lambda x: x != "")
    spelled = F.transform(labels, lambda x: F.concat(F.unhex(F.lpad(F.hex(F.length(x).cast("bigint")), 2, "0")), x.cast("binary")))
    return F.concat(F.aggregate(spelled, F.lit(b""), lambda a, b: F.concat(a, b)), F.lit(b"\0"))
