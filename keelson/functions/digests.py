"""SHA3 digests and what is derived from them, as Arrow-batched UDFs (Spark has SHA-2 only).

Domain-separation prefixes are parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sha3(data: bytes) -> bytes:
    return hashlib.sha3_256(data).digest()


def on_binary(of: Callable[[bytes], object], kind: str) -> Callable[[Column], Column]:
    """A pandas UDF from a function of bytes; null stays null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else of(bytes(x)))

    return run


def sha3(data: Column) -> Column:
    return on_binary(_sha3, "binary")(data)


def key_level(key: Column) -> Column:
    """Trailing zero bits of the digest (byte by byte, lowest bit first), a level for every four."""
    return on_binary(level_of, "int")(key)


def level_of(key: bytes) -> int:
    zeros = 0
    for byte in _sha3(key):
        n = 8 if byte == 0 else (byte & -byte).bit_length() - 1
        zeros += n
        if n < 8:
            break
    return zeros // 4


def u32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 8, "0"))


def u64(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0"))


def canonical_id(magic: Column, header: Column, sender: Column, recipient: Column, payload: Column, mask: Column, ts: Column) -> Column:
    """Digest over all but tags and signature."""
    return sha3(F.concat(magic, header, sender, recipient, payload, u64(mask), u64(ts)))


def counted(x: Column) -> Column:
    """Length as four bytes, then the bytes."""
    raw = x.cast("binary")
    return F.concat(u32(F.octet_length(raw)), raw)


def record_digest(domain: bytes, fqdn: Column, owner: Column, target: Column, addrs: Column, expires: Column, grace: Column, epoch: Column, key: Column) -> Column:
    """Digest of a routing record with length-prefixed fields."""
    listed = F.aggregate(addrs, F.lit(b""), lambda acc, a: F.concat(acc, counted(a)))
    flag = F.when(grace, F.lit(b"\1")).otherwise(F.lit(b"\0"))
    return sha3(F.concat(F.lit(domain), counted(fqdn), owner, target, u32(F.size(addrs)), listed, u64(expires), flag, u64(epoch), counted(key)))


def identity(prefix: bytes, public_key: Column) -> Column:
    return sha3(F.concat(F.lit(prefix), public_key))


def sampled_block(seed: Column, shard: Column) -> Column:
    """Index of one of 256 blocks: the first eight bytes as a number, mod 256, so the eighth byte."""
    return F.conv(F.hex(F.substring(sha3(F.concat(seed, u32(shard))), 8, 1)), 16, 10).cast("int")


def addresses(domain: bytes, node: Column) -> Column:
    """Struct (ipv6 hex, ipv4 as number): fd00 and 14 bytes; 100.64/10 and 22 bits of the next three."""
    hashed = sha3(F.concat(F.lit(domain), node))
    host = F.conv(F.hex(F.substring(hashed, 15, 3)), 16, 10).cast("bigint").bitwiseAND(0x3FFFFF)
    return F.struct(
        F.lower(F.concat(F.lit("fd00"), F.hex(F.substring(hashed, 1, 14)))).alias("ipv6"), (host + (100 << 24) + (64 << 16)).alias("ipv4")
    )


def leading_zero_bits(digest: Column) -> Column:
    """By the run of zero digits in hex and the one after it."""
    text = F.hex(digest)
    run = F.length(F.regexp_extract(text, "^0*", 0))
    after = F.conv(F.substr(text, run + 1, F.lit(1)), 16, 10).cast("int")
    return run * 4 + F.coalesce(F.when(after >= 8, 0).when(after >= 4, 1).when(after >= 2, 2).when(after >= 1, 3), F.lit(0))


def checksum16(data: bytes) -> int:
    """Ones' complement of the ones' complement sum of 16-bit words."""
    data += b"\0" * (len(data) % 2)
    total = sum(int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed; an odd last node moves up as it is; no leaf gives the digest of nothing."""
    if not leaves:
        return _sha3(b"")
    while len(leaves) > 1:
        paired = [_sha3(a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = paired + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


def chunk_root(data: bytes, chunk: int = 64 * 1024) -> bytes:
    return merkle_root([_sha3(data[i : i + chunk]) for i in range(0, len(data), chunk)])


def merkle_path(leaves: list[bytes], at: int) -> list[tuple[bytes, str]]:
    """Siblings from a leaf up, each with the side on which it stands; none where a node moved up alone."""
    path = []
    while len(leaves) > 1:
        other = at ^ 1
        if other < len(leaves):
            path.append((leaves[other], "left" if other < at else "right"))
        paired = [_sha3(a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves, at = paired + leaves[len(leaves) - len(leaves) % 2 :], at // 2
    return path


def path_root(leaf: bytes, path: list[tuple[bytes, str]]) -> bytes:
    for sibling, side in path:
        leaf = _sha3(sibling + leaf) if side == "left" else _sha3(leaf + sibling)
    return leaf


def content_id(data: Column) -> Column:
    return on_binary(chunk_root, "binary")(data)


def shard_root(data: Column) -> Column:
    return on_binary(lambda x: chunk_root(x, 4096), "binary")(data)
