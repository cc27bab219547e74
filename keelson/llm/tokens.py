"""Operator 9: token ids in a binary format with direct access to any token.

Directly addressable codes: an id is cut into chunks of 8 bits. Level 0 holds the low chunk of
every id and a continuation bitmap; level 1 holds the next chunk of those ids whose bit is set,
and so on. A rank directory (ones before each block of 512 bits) finds an id's place on the next
level without decoding others.

The "file" is a table of segments in the shared store, written by Spark's committer, so it works on
any file system and survives lost executors. A segment holds whole documents in ascending id
order: their ids, their offsets and the codes. Segments are bounded in size; a longer document
has a segment of its own.

Edge cases: a null text counts as empty; every document has at least its end id; null document ids
come first; repeated ids stay apart in a fixed order; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import string
import struct as binary
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, bucket_of, id_bounds, materialize, partitions

MAGIC = b"KDAC0001"
BLOCK = 512  # bits between two entries of a rank directory
SEGMENT_IDS = 1 << 20
PIECE_BYTES = 8 << 20  # of text that are encoded together
#: A space or none and letters of Latin script up to U+023F, which are letters to every library.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+")
MARKS = b".,;:!?"
LETTER, MARK, LATIN, TAIL, SPACE, FEED = range(1, 7)  # kinds of bytes; LATIN starts such a letter, TAIL continues any character
KINDS = np.zeros(256, np.uint8)
KINDS[[*string.ascii_letters.encode()]] = LETTER
KINDS[[*MARKS]] = MARK
KINDS[0xC3:0xC9] = LATIN
KINDS[0x80:0xC0] = TAIL
KINDS[[32, 10]] = SPACE, FEED
SOLID = np.ones(256, bool)  # bytes that start no white space in any encoding of Unicode's
SOLID[:33] = False
SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False


class Codes:
    """Directly addressable codes of unsigned integers below 2**32."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        rest, levels, n = np.asarray(ids, dtype=np.uint32), [], len(ids)
        while True:
            more = rest > 255
            bits = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
            directory = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
            levels.append(((rest & 255).astype(np.uint8), bits, directory))
            if not more.any():
                return cls(levels, n)
            rest = rest[more] >> 8

    def decode(self) -> np.ndarray:
        """All ids at once."""
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            more = np.unpackbits(bits, bitorder="little", count=len(chunks)).view(bool)
            out[more] |= value << np.uint32(8)
            value = out
        return value

    def __getitem__(self, i: int) -> int:
        """One id, by rank queries only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for depth, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * depth
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            first = block * BLOCK >> 3
            ones = int(np.bitwise_count(bits[first : i >> 3]).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
            i = int(directory[block]) + ones
        return value

    def to_bytes(self) -> bytes:
        parts = [binary.pack("<QB", self.n, len(self.levels))]
        for chunks, bits, directory in self.levels:
            parts += [binary.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), directory.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> Codes:
        n, depth = binary.unpack_from("<QB", data, at)
        at += 9
        levels = []
        for _ in range(depth):
            (m,) = binary.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, m, at)
            at += m
            bits = np.frombuffer(data, np.uint8, (m + 7) // 8, at)
            at += (m + 7) // 8
            blocks = -(-m // BLOCK) + 1
            directory = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            levels.append((chunks, bits, directory))
        return cls(levels, n)


def pack_segment(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Magic, number of documents, ids with a null flag, lengths, codes."""
    flags = np.array([k is None for k in keys], dtype=np.uint8)
    values = np.array([0 if k is None else k for k in keys], dtype="<i8")
    return b"".join(
        [MAGIC, binary.pack("<Q", len(keys)), flags.tobytes(), values.tobytes(), np.array(lengths, dtype="<u8").tobytes(), Codes.encode(ids).to_bytes()]
    )


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Keys, offsets (one more than keys) and codes of a segment."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    (n,) = binary.unpack_from("<Q", data, 8)
    flags = np.frombuffer(data, np.uint8, n, 16)
    values = np.frombuffer(data, "<i8", n, 16 + n)
    lengths = np.frombuffer(data, "<u8", n, 16 + 9 * n).astype(np.int64)
    keys = [None if f else v for f, v in zip(flags.tolist(), values.tolist(), strict=True)]
    return keys, np.concatenate([[0], np.cumsum(lengths)]), Codes.from_bytes(data, 16 + 17 * n)


class Library:
    """The tokenizers library behind a cache of chunks; one for each worker process.

    Texts are cut in the bytes of their Arrow column, and each batch looks up every distinct chunk
    once. The cache is bounded: two generations, of which the older one goes.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"  # of ids on the way to their segment
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token stands for a byte
        added = self.tokenizer.get_added_tokens_decoder()
        for token, i in vocabulary.items():
            self.lengths[i] = len(token.encode()) if i in added else len(token)
        self.limit, self.known, self.old = limit, {}, {}
        self.solid = SOLID.copy()
        self.solid[[t.content.encode()[0] for t in added.values() if t.content]] = False  # white space before an added token ends a text to the pattern
        made = json.loads(self.tokenizer.to_str())
        kind = made.get("pre_tokenizer") or {}
        #: Whether the pattern is the one that BREAKS and WORD are made for; otherwise a text is one chunk.
        self.words = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not made.get("normalizer")
        self.words = self.words and not any(t.lstrip or t.rstrip or t.single_word or WORD.fullmatch(t.content.encode()) or {*t.content} & {*" \n.,;:!?"} for t in added.values())
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255, as the library has it
        self.letters = dict(zip(printed, printed, strict=True)) | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*printed}))}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.word).tobytes()

    def encode_all(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks. A word of letters is a pre-token and goes to the library's model; other chunks go through
        its whole pipeline, together where they start with a space that is a sure break."""
        out: list[bytes] = [b""] * len(chunks)
        joined: list[int] = []
        alone: list[int] = []
        tokenize, letters, code = self.tokenizer.model.tokenize, self.letters, "H" if self.word == "<u2" else "I"
        for i, chunk in enumerate(chunks):
            if self.words and WORD.fullmatch(chunk):
                word = chunk.decode().replace(" ", "\u0120") if chunk.isascii() else chunk.decode("latin-1").translate(letters)
                out[i] = array(code, [t.id for t in tokenize(word)]).tobytes()
            elif self.words and chunk[0] == 32 and len(chunk) > 1 and self.solid[chunk[1]]:
                joined.append(i)
            else:
                alone.append(i)
        for lo in range(0, len(joined), 4096):
            some = joined[lo : lo + 4096]
            for i, packed in zip(some, self.encode_joined([chunks[i] for i in some]), strict=True):
                out[i] = packed
        for lo in range(0, len(alone), 4096):
            some = alone[lo : lo + 4096]
            for i, found in zip(some, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = self.pack(found.ids)
        return out

    def encode_joined(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks are encoded as one text, whose ids are then parted where the bytes of the chunks end; no
        token reaches over a break."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(chunks).decode()], add_special_tokens=False)[0].ids, dtype=self.word)
        ends = np.cumsum([len(c) for c in chunks])
        cuts = [0, *(ids.itemsize * np.searchsorted(np.cumsum(self.lengths[ids]), ends) + ids.itemsize).tolist()]
        packed = ids.tobytes()
        return [packed[a:b] for a, b in pairwise(cuts)]

    def lookup(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks, by the cache."""
        out = list(map(self.known.get, chunks))
        missing = [i for i, packed in enumerate(out) if packed is None]
        new = []
        for i in missing:
            out[i] = self.old.get(chunks[i])
            if out[i] is None:
                new.append(i)
        for i, packed in zip(new, self.encode_all([chunks[i] for i in new]), strict=True):
            out[i] = packed
        for i in missing:
            if len(chunks[i]) <= 64:
                if len(self.known) >= self.limit:
                    self.old, self.known = self.known, {}
                self.known[chunks[i]] = out[i]
        return out

    def packed(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """Packed ids of each text; a null text counts as empty."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        first, last = int(offsets[0]), int(offsets[-1])
        if first == last:
            return pa.array([b""] * len(texts), pa.large_binary())
        offsets = offsets - first
        data = np.frombuffer(texts.buffers()[2], np.uint8, last - first, first)
        starts = breaks(data, offsets, self.solid) if self.words else np.unique(offsets)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self.lookup(chunks.dictionary.to_pylist()), pa.large_binary()).take(chunks.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[np.searchsorted(starts, offsets)]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), ids.buffers()[2]])

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [np.frombuffer(x, self.word).astype("<u4").tobytes() for x in self.packed(pa.array(texts, pa.large_string())).to_pylist()]


def breaks(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = SOLID) -> np.ndarray:
    """Ascending places in the bytes of texts where a pre-token of GPT-2's pattern is sure to start, all starts of
    texts and the end included:

    - at a space or line feed that a solid character follows (white space before it is a pre-token of its own),
      and behind such a line feed, which no pre-token continues;
    - between a letter and one of MARKS, since letters and signs never share a pre-token.
    """
    kinds = KINDS[data]
    before, after = kinds[:-1], kinds[1:]
    lead = np.zeros(len(data), bool)  # white space that a solid character of the same text follows
    lead[:-1] = (before >= SPACE) & solid[data[1:]]
    lead[offsets[1:] - 1] = False
    found = np.zeros(len(data) + 1, bool)
    found[:-1] = lead
    found[1:] |= lead & (kinds == FEED)
    marks = np.flatnonzero(after == MARK) + 1
    last = kinds[marks - 1]
    wide = marks[(last == TAIL) & (marks > 1)]
    found[marks[last == LETTER]] = True
    found[wide[(kinds[wide - 2] == LATIN) & ~((data[wide - 2] == 0xC3) & ((data[wide - 1] | 0x20) == 0xB7))]] = True  # but for the signs of multiplication and division
    found[offsets] = True
    return np.flatnonzero(found)


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
    return Library(path)


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts, the second column, have limit bytes at most, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[1]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = done = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, done = hi, int(sizes[hi - 1])


def write(df: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts with a tokenizers file and store them as segments in ascending id order.

    Returns the stored table: bucket int, start long (ids before the segment in its bucket), n_ids
    long, payload binary. Texts are encoded where they are read; only packed ids are shuffled, to
    id ranges found from the id column alone, and each range streams through one task.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = id_bounds(docs, "doc_id", parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = library(path)
        for big in batches:
            for batch in pieces(big):
                codes = texts.packed(batch[1]).cast(pa.binary())
                width = pa.array(np.full(len(codes), np.dtype(texts.word).itemsize, np.int32))
                yield pa.RecordBatch.from_arrays([batch[0], width, codes], names=["doc_id", "width", "codes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows("bucket int, start bigint, n_ids bigint, payload binary")
        bucket, start, held = None, 0, 0
        keys: list = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        end = np.array([end_id], "<u2" if end_id < 1 << 16 else "<u4")

        def close() -> None:
            nonlocal start, held, keys, lengths, ids
            if keys:
                payload = pack_segment(keys, lengths, np.concatenate(ids))
                out.add(bucket, start, held, payload, size=len(payload))
            start, held, keys, lengths, ids = start + held, 0, [], [], []

        for batch in batches:
            for b, key, width, codes in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    close()
                    bucket, start = b, 0
                n = len(codes) // width + 1
                if held and held + n > SEGMENT_IDS:
                    close()
                keys.append(key)
                lengths.append(n)
                ids += np.frombuffer(codes, f"<u{width}"), end
                held += n
                if out.full():
                    yield out.take()
        close()
        yield from out.rest()

    coded = docs.mapInArrow(encode, "doc_id bigint, width int, codes binary")
    ordered = (
        coded.select(bucket_of(F.col("doc_id"), bounds).alias("bucket"), "doc_id", "width", "codes")
        .repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "doc_id", "codes")
    )
    return materialize(ordered.mapInArrow(pack, "bucket int, start bigint, n_ids bigint, payload binary"), "token-ids")


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the segments.

    The driver holds one sum for each bucket, so as many numbers as there are partitions.
    """
    sums = {r["bucket"]: r["n"] for r in segments.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}
    first, total = {}, 0
    for b in sorted(sums):
        first[b], total = total, total + sums[b]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
        for batch in batches:
            for b, start, payload in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                keys, offsets, codes = unpack_segment(payload)
                ids = memoryview(codes.decode().astype("<u4").tobytes())
                base = first[b] + start
                for k, lo, hi in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    out.add(k, base + lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]))
                if out.full():
                    yield out.take()
        yield from out.rest()

    return segments.select("bucket", "start", "payload").mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
