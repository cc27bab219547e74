"""Order-invariant digests of keyed sets: Merkle search tree, prefix trie and binary tree.

A root is inherently of one namespace; namespaces are the unit of distribution.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.digests import _sha3, level_of, merkle_root

NONE = bytes(32)


def search_tree_root(entries: list[tuple[bytes, bytes, int, bool]]) -> tuple[bytes, int]:
    """Root digest and height of sorted, distinct (key, id, ts, tombstone). Empty: zeros and 0.

    The shape depends on the keys alone: the entries of the highest level of a range make its node,
    and the ranges between them its children.
    """
    levels = [level_of(e[0]) for e in entries]

    def build(lo: int, hi: int) -> tuple[bytes, int]:
        if lo == hi:
            return NONE, 0
        top = max(levels[lo:hi])
        own = [i for i in range(lo, hi) if levels[i] == top]
        out = [top.to_bytes(4, "big"), len(own).to_bytes(4, "big")]
        height, at = 0, lo
        for i in own:
            child, h = build(at, i)
            height = max(height, h)
            key, name, ts, dead = entries[i]
            out += [child, len(key).to_bytes(4, "big"), key, name, ts.to_bytes(8, "big"), bytes([dead])]
            at = i + 1
        child, h = build(at, hi)
        return _sha3(b"".join([*out, child])), max(height, h) + 1

    return build(0, len(entries))


def search_tree_roots(index: DataFrame) -> DataFrame:
    """ns, root, height of (ns, key, envelope_id, ts, is_tombstone), one row for each key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = sorted((bytes(k), bytes(e), int(t), bool(d)) for k, e, t, d in zip(rows.key, rows.envelope_id, rows.ts, rows.is_tombstone, strict=True))
        root, height = search_tree_root(found)
        return pd.DataFrame({"ns": [rows.ns.iloc[0]], "root": [root], "height": [height]})

    return index.groupBy("ns").applyInPandas(run, "ns string, root binary, height int")


@dataclass
class TrieNode:
    prefix: bytes
    value: bytes | None = None
    children: list = field(default_factory=list)

    def digest(self, domain: bytes) -> bytes:
        below = sorted(c.digest(domain) for c in self.children)
        mark = b"\0" if self.value is None else b"\1" + self.value
        return _sha3(b"".join([domain, len(self.prefix).to_bytes(2, "big"), self.prefix, mark, len(below).to_bytes(2, "big"), *below]))


def trie(entries: list[tuple[bytes, bytes]], cut: int = 0, root: bool = True) -> TrieNode:
    """Path-compressed trie of sorted, distinct (name, record digest); the root has an empty prefix."""
    node = TrieNode(b"")
    if not root:
        common = os.path.commonprefix([entries[0][0], entries[-1][0]])
        node.prefix, cut = common[cut:], len(common)
    if entries and len(entries[0][0]) == cut:
        node.value, entries = entries[0][1], entries[1:]
    lo = 0
    for hi in range(1, len(entries) + 1):
        if hi == len(entries) or entries[hi][0][cut] != entries[lo][0][cut]:
            node.children.append(trie(entries[lo:hi], cut, False))
            lo = hi
    return node


def trie_proof(node: TrieNode, name: bytes, domain: bytes) -> list[tuple[bytes, bytes | None, list[bytes]]] | None:
    """From the root to the record: prefix, record digest above it, digests of the other children."""
    path, rest = [], name
    while rest:
        step = next((c for c in node.children if rest.startswith(c.prefix)), None)
        if step is None:
            return None
        path.append((node.prefix, node.value, sorted(c.digest(domain) for c in node.children if c is not step)))
        node, rest = step, rest[len(step.prefix) :]
    return None if node.value is None else [*path, (node.prefix, node.value, sorted(c.digest(domain) for c in node.children))]


def trie_proof_root(proof: list[tuple[bytes, bytes | None, list[bytes]]], domain: bytes) -> bytes:
    """The root that a proof leads to."""
    below: bytes | None = None
    for prefix, value, others in reversed(proof):
        kids = sorted([*others, *([] if below is None else [below])])
        mark = b"\0" if value is None else b"\1" + value
        below = _sha3(b"".join([domain, len(prefix).to_bytes(2, "big"), prefix, mark, len(kids).to_bytes(2, "big"), *kids]))
    return below or b""


def trie_roots(records: DataFrame, domain: bytes) -> DataFrame:
    """ns, root of (ns, name, digest)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = sorted((n.encode(), bytes(d)) for n, d in zip(rows.name, rows.digest, strict=True))
        return pd.DataFrame({"ns": [rows.ns.iloc[0]], "root": [trie(found).digest(domain)]})

    return records.select("ns", "name", "digest").groupBy("ns").applyInPandas(run, "ns string, root binary")


def binary_roots(leaves: DataFrame) -> DataFrame:
    """ns, root of (ns, pos, leaf) in order of pos. Rows stream through in order; a namespace's digests (32 bytes each) are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        now = None
        for rows in batches:
            out = []
            for ns, leaf in zip(rows.ns, rows.leaf, strict=True):
                if ns != now and held:
                    out.append((now, merkle_root(held)))
                    held = []
                now = ns
                held.append(bytes(leaf))
            yield pd.DataFrame(out, columns=["ns", "root"])
        if held:
            yield pd.DataFrame([(now, merkle_root(held))], columns=["ns", "root"])

    return leaves.select("ns", "pos", "leaf").repartition(F.col("ns")).sortWithinPartitions("ns", "pos").mapInPandas(run, "ns string, root binary")
