"""Operator 1: byte-level BPE encoding and decoding over rank files.

Every pre-token is merged with a hierarchical-bitmap rank queue: a bucket for each merge rank
holds the linked-list positions whose pair has that rank, a two-level bitmap finds the lowest
rank that has a bucket, and entries whose pair has changed since are skipped. The work for a
pre-token of n bytes is O(n log n), so a text without any break is no special case.

Words repeat, so each worker keeps the codes of recent chunks (a word with its leading space and
trailing punctuation). The cache is bounded, is only a shortcut, and is never sampled from.

Edge cases: a null text is encoded as the empty text (no ids); the empty text has no ids; null
document ids pass through; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, slices

WORD = 256  # bits of a bitmap word
KNOWN = 400_000  # words that a worker's cache holds
BITS = [1 << i for i in range(1 << 12)]


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class BytePairEncoder:
    """Merges by rank within each match of a pattern; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.two = [ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by the rank queue, which is kept in local names for speed:
        buckets (rank -> heap of positions), words (bitmap of ranks), top (bitmap of words)."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        two, bits = self.two, BITS
        n = len(piece)
        after = list(range(1, n + 1))  # linked list of token starts
        before = list(range(-1, n))
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of a token with its successor
        pair += (-1, -1)
        top, words, buckets = 0, {}, {}
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so still a heap
                else:
                    buckets[rank] = [i]
                    hi = rank >> 8
                    words[hi] = words.get(hi, 0) | bits[rank & 255]
                    top |= bits[hi]
        while top:
            hi = (top & -top).bit_length() - 1  # find first set, on both levels
            word = words[hi]
            low = word & -word
            rank = hi << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[hi] = word ^ low
                if word == low:
                    top ^= bits[hi]
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            pair[j] = -1
            prev = before[i]
            fresh = []
            if end < n:
                before[end] = i
                pair[i] = rank = rank_of(piece[i : after[end]], -1)
                if rank >= 0:
                    fresh.append((rank, i))
            else:
                pair[i] = -1
            if prev >= 0:
                pair[prev] = rank = rank_of(piece[prev:end], -1)
                if rank >= 0:
                    fresh.append((rank, prev))
            for rank, i in fresh:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    hi = rank >> 8
                    words[hi] = words.get(hi, 0) | bits[rank & 255]
                    top |= bits[hi]
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode_text(self, text: str) -> list[int]:
        """Ids of a text, pre-token by pre-token, without any cache."""
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Pieces(dict):
    """pre-token -> packed ids. Bounded: two generations, of which the older one goes."""

    def __init__(self, encode: Callable[[bytes], list[int]], limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = np.array(self.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Chunks(dict):
    """chunk -> packed ids, for chunks that stand after a single space. Bounded: two generations."""

    def __init__(self, encode: Callable[[str], bytes], lead: str, limit: int):
        super().__init__()
        self.encode, self.lead, self.limit, self.old = encode, lead, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        packed = self.old.get(chunk)
        if packed is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise LookupError(chunk)  # the space beside it is not a sure boundary
            packed = self.encode(self.lead + chunk)
        if len(chunk) <= 64:
            self.keep(chunk, packed)
        return packed

    def keep(self, chunk: str, packed: bytes) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = packed


#: A space between two characters that aren't white space always starts a pre-token.
SURE_BREAK = re.compile(r"(?<=\S) (?=\S)")


class TextEncoder:
    """Whole texts to packed ids, by chunks that cannot share a pre-token.

    encode gives the packed ids of any text. The pattern must never match across a space that
    stands between two other characters, which holds for the patterns of byte-level BPE.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = 150_000):
        self.encode = encode
        self.first = Chunks(encode, "", limit // 8)
        self.later = Chunks(encode, " ", limit)

    def __call__(self, text: str) -> bytes:
        return self.join(text, text.split(" "))

    def join(self, text: str, chunks: list[str]) -> bytes:
        """Ids of a text that was split at its spaces."""
        if not text:
            return b""
        try:
            return self.first[chunks[0]] + b"".join(map(self.later.__getitem__, chunks[1:]))
        except LookupError:
            pass
        head, *tail = SURE_BREAK.split(text)
        return self.encode(head) + b"".join([self.odd(x) for x in tail])

    def all(self, texts: list[str], encode_all: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of several texts; their chunks that are not known yet are encoded in one call."""
        split = [text.split(" ") for text in texts]
        later = self.later
        unknown = set(chain.from_iterable(split)).difference(later).difference(later.old)
        new = [c for c in unknown if c and len(c) <= 64 and not c[0].isspace() and not c[-1].isspace()]
        for chunk, packed in zip(new, encode_all([" " + c for c in new]), strict=True):
            later.keep(chunk, packed)
        return list(map(self.join, texts, split))

    def odd(self, chunk: str) -> bytes:
        try:
            return self.later[chunk]
        except LookupError:
            return self.encode(" " + chunk)


@lru_cache(maxsize=4)
def coder(path: str, pattern: str, known: int = KNOWN) -> tuple[BytePairEncoder, TextEncoder]:
    """One for each worker process; it lives from task to task. known: words that its cache holds, twice at most."""
    bpe = BytePairEncoder(load_ranks(path), pattern)
    piece, split = Pieces(bpe.encode_piece, known).__getitem__, bpe.pattern.findall
    return bpe, TextEncoder(lambda text: b"".join(map(piece, split(text))), limit=3 * known // 8)


@lru_cache(maxsize=4)
def decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int) of every whole text. path must exist on the executors."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, texts = coder(path, pattern)
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    packed = texts(text or "")
                    out.add(key, np.frombuffer(packed, "<u4").astype(np.int32), size=len(packed))
                    if out.full():
                        yield out.take()
        yield from out.rest()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of (doc_id, ids). Null ids give empty bytes."""
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = coder(path, pattern)
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for key, ids in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    data = bpe.decode(ids or [])
                    out.add(key, data, size=len(data))
                    if out.full():
                        yield out.take()
        yield from out.rest()

    return df.select("doc_id", "ids").mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, known: int = KNOWN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encodes and decodes in one pass, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, texts = coder(path, pattern, known)
        names = decimals(len(bpe.tokens))
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    ids = np.frombuffer(texts(text or ""), "<u4").tolist()
                    listed = hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest()
                    row = key, len(ids), listed, hashlib.sha256(bpe.decode(ids)).hexdigest()
                    out.add(*row, *[np.array(ids, np.int32)] * with_ids, size=4 * len(ids) * with_ids)
                    if out.full():
                        yield out.take()
        yield from out.rest()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
