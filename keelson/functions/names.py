"""Names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def canonical_name(name: Column, suffix: str) -> Column:
    """Trimmed and lower-cased, or null unless labels of 1 to 63 letters, digits and inner hyphens
    stand before the suffix and at most 253 characters are used in all."""
    low = F.lower(F.trim(name))
    shape = f"^{LABEL}(?:\\.{LABEL})*{suffix.replace('.', chr(92) + '.')}$"
    return F.when(low.rlike(shape) & (F.octet_length(low) <= 253), low)


def name_problem(name: Column, suffix: str) -> Column:
    """The first rule that a name breaks; null if none."""
    low = F.lower(F.trim(name))
    head = F.substr(low, F.lit(1), F.length(low) - len(suffix))
    labels = F.split(head, "\\.")
    return (
        F.when(~low.endswith(suffix), "suffix").when(F.octet_length(low) > 253, "length").when(head == "", "empty")
        .when(F.exists(labels, lambda x: x == ""), "empty label").when(F.exists(labels, lambda x: F.length(x) > 63), "label length")
        .when(F.exists(labels, lambda x: x.startswith("-") | x.endswith("-")), "hyphen").when(F.exists(labels, lambda x: ~x.rlike("^[a-z0-9-]*$")), "character")
    )


def name_of_key(name: Column, prefix: str, suffix: str) -> Column:
    low = F.lower(name)
    return low.startswith(prefix) & low.endswith(suffix)


IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def ipv4_of(address: Column) -> Column:
    """From a plain address or a path with /ip4/."""
    inner = F.when(address.startswith("/"), F.regexp_extract(address, "/ip4/([^/]+)", 1)).otherwise(address)
    return F.when(inner.rlike(f"^{IPV4}$"), inner)


def ipv6_of(address: Column) -> Column:
    inner = F.lower(F.when(address.startswith("/"), F.regexp_extract(address, "/ip6/([^/]+)", 1)).otherwise(address))
    return F.when(inner.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$"), inner)


def answers(kind: Column, addrs: Column, peer: Column, owner: Column, expires: Column, key: Column) -> Column:
    """Answers of a record by type: A, AAAA or TXT."""
    text = F.array_compact(F.array(
        F.concat(F.lit("peer="), F.lower(F.hex(peer))), F.concat(F.lit("owner="), F.lower(F.hex(owner))),
        F.when(F.octet_length(key) > 0, F.concat(F.lit("ech="), F.lower(F.hex(key)))), F.concat(F.lit("expires_at="), expires.cast("string")),
    ))
    return F.when(kind == "A", F.array_compact(F.transform(addrs, ipv4_of))).when(kind == "AAAA", F.array_compact(F.transform(addrs, ipv6_of))).when(kind == "TXT", text)


def cron_task_id(job: Column, ts: Column) -> Column:
    return F.concat_ws("-", F.lit("cron"), job, ts.cast("string"))


def job_of_task(task: Column) -> Column:
    """The job of cron-<job>-<ts>: up to the last dash."""
    found = F.regexp_extract(task, "^cron-(.*)-[^-]*$", 1)
    return F.when(found != "", found)


CHARSET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"  # fixed value of BIP 173


def _polymod(values: list[int]) -> int:
    generator = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)  # fixed values of BIP 173
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(generator):
            check ^= g if top >> i & 1 else 0
    return check


def bech32(prefix: str, data: bytes) -> str:
    bits = int.from_bytes(data, "big") << -len(data) * 8 % 5
    n = -(-len(data) * 8 // 5)
    fives = [bits >> 5 * (n - 1 - i) & 31 for i in range(n)]
    spread = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    sum_ = _polymod(spread + fives + [0] * 6) ^ 1
    return prefix + "1" + "".join(CHARSET[v] for v in fives + [sum_ >> 5 * (5 - i) & 31 for i in range(6)])


def from_bech32(prefix: str, text: str) -> bytes | None:
    head, _, tail = text.lower().rpartition("1")
    if head != prefix or len(tail) < 6 or any(c not in CHARSET for c in tail):
        return None
    values = [CHARSET.index(c) for c in tail]
    spread = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    if _polymod(spread + values) != 1:
        return None
    number, n = 0, len(values) - 6
    for v in values[:-6]:
        number = number << 5 | v
    rest = n * 5 % 8
    return None if rest >= 5 or number & (1 << rest) - 1 else (number >> rest).to_bytes(n * 5 // 8, "big")
