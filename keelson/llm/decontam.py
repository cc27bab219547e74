"""Operator 3: benchmark decontamination by the q-gram lemma with banded verification.

Texts are case-folded and every run of characters that are no letters or digits becomes one space.
A benchmark item (cut into overlapping windows if it is long) of m characters with a budget of k
edits shares at least m + 1 - q - k * q character q-grams with any region that is k edits away, on
diagonals that differ by k at most. q is 7, or less for short items, so that this bound is never below
1. Shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half; regions that
reach the bound are verified by alignment within the band, many regions at a time.

The benchmark is a stated query set. Its distinct texts are held in blocks of bounded size; GROUP
blocks at a time meet all documents in one pass without a shuffle. Pairs of equal q-grams are counted
in pieces of at most PAIRS, by windows of the benchmark and by stretches of text that overlap by more
than a region is long, so that memory doesn't depend on how often a q-gram occurs.

Edge cases: null and empty texts and items match nothing; items shorter than q characters must occur
as whole words; items of under ten characters must occur as they are; null ids pass through;
repeated items or documents each give their rows; no benchmark, no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, materialize, slices

Q = 7
RATE = 0.1  # edits a character
LONGEST, STRIDE = 512, 256  # windows of long items
REACH = 1024  # more than the text that a window's band covers
BLOCK_BYTES, GROUP = 2 << 20, 8
BREAKS = re.compile(r"[\W_]+")
FILTER_BITS = 20
PAIRS = 1 << 20  # equal q-grams that are counted at a time
STRETCH = 1 << 16  # places of text that are looked up at a time
BREAK = np.uint32(0x110000)  # no character


def fold(text: str | None) -> str:
    return BREAKS.sub(" ", text.casefold()).strip() if text else ""


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = max(len(points) - q + 1, 0)
    hashed = np.zeros(n, np.uint64)
    for i in range(q if n else 0):
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += points[i : i + n]
        hashed ^= hashed >> np.uint64(29)
    return hashed


def gram_size(m: int, k: int) -> int:
    """The largest q of at most Q for which a region within k edits shares a q-gram at least."""
    return max(1, min(Q, m // (k + 1)))


class Index:
    """Inverted list of the q-grams of windows, for one q, and a bit for each hash's low bits."""

    def __init__(self, q: int, numbers: np.ndarray, windows: list[np.ndarray], budget: np.ndarray):
        self.q, self.numbers, self.windows, self.budget = q, numbers, windows, budget
        found = [grams(w, q) for w in windows]
        sizes = np.array([len(g) for g in found], dtype=np.int64)
        self.hashes, code = np.unique(np.concatenate(found), return_inverse=True)
        window = np.repeat(np.arange(len(found)), sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(code, kind="stable")  # so windows ascend within a q-gram
        self.window, self.place = window[order].astype(np.int32), place[order].astype(np.int16)
        self.entry = code[order] * len(windows) + self.window
        self.starts = np.searchsorted(self.entry, np.arange(len(self.hashes) + 1) * len(windows))
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[(self.hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        self.bound = np.array([len(w) for w in windows]) + 1 - q - budget * q

    def candidates(self, points: np.ndarray, owner: np.ndarray, place: np.ndarray, out: list[dict[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, window and band, of bands that reach the bound. owner and place: text of each point, and
        where it stands there. out: what the caller has found by now."""
        hashed = grams(points, self.q)
        at = np.flatnonzero(self.present[(hashed & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        code = np.searchsorted(self.hashes, hashed[at])
        code[code == len(self.hashes)] = 0
        known = self.hashes[code] == hashed[at]
        at, code = at[known], code[known]
        todo = [(0, len(points), 0, len(self.windows))]
        while todo:
            lo, hi, first, last = todo.pop()
            a, b = np.searchsorted(at, (lo, hi))
            if a == b or last - first == 1 and owner[lo] == owner[hi - 1] and out[owner[lo]].get(int(self.numbers[first])) == 0:
                continue
            if last - first == len(self.windows):
                start = self.starts[code[a:b]]
                n = self.starts[code[a:b] + 1] - start
            else:
                start = np.searchsorted(self.entry, code[a:b] * len(self.windows) + first)
                n = np.searchsorted(self.entry, code[a:b] * len(self.windows) + last) - start
            total = int(n.sum())
            if total > PAIRS and last - first > 1:
                mid = (first + last) // 2
                todo += [(lo, hi, first, mid), (lo, hi, mid, last)]
            elif total > PAIRS and hi - lo > 4 * REACH:
                mid = (lo + hi) // 2
                todo += [(lo, mid + REACH, first, last), (mid, hi, first, last)]
            elif total:
                yield self.count(owner, place, np.repeat(at[a:b], n), np.repeat(start, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n))

    def count(self, owner: np.ndarray, place: np.ndarray, text_at: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        window = self.window[entry].astype(np.int64)
        band = (place[text_at] - self.place[entry]) // (self.budget[window] + 1)
        low = int(band.min()) - 1
        width = int(band.max()) - low + 2
        key = (owner[text_at] * len(self.windows) + window) * width + band - low
        base = int(key.min()) - 1
        if int(key.max()) - base < 4 * len(key):
            single = np.bincount(key - base)
            counts = single + np.append(single[1:], 0)  # a band and the one after it
            keys = np.flatnonzero(counts)
            keys, counts = keys + base, counts[keys]
        else:
            keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        window = keys // width % len(self.windows)
        good = counts >= self.bound[window]
        keys, window = keys[good], window[good]
        return keys // width // len(self.windows), window, keys % width + low


def banded(patterns: list[np.ndarray], texts: list[np.ndarray], first: np.ndarray, last: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Least edits between each pattern and a part of its text, over alignments on diagonals first to
    last (text place less pattern place); budget + 1 beyond the budget. Column j of row i holds
    D[i, i + first + j]; all regions go on together, and those beyond their budget drop out."""
    lengths = np.array([len(p) for p in patterns])
    most, width = int(lengths.max(initial=0)), int((last - first).max(initial=-1)) + 1
    result = (budget + 1).astype(np.int64)
    count = len(patterns)
    letters = np.full((count, most + width + 1), BREAK, np.uint32)  # of place first + column
    inside = np.zeros((count, most + width + 1), bool)
    asked = np.zeros((count, most), np.uint32)
    for c, (pattern, text) in enumerate(zip(patterns, texts, strict=True)):
        asked[c, : len(pattern)] = pattern
        lo, hi = max(0, int(first[c])), min(len(text), int(first[c]) + most + width + 1)
        if hi >= lo:
            letters[c, lo - first[c] : hi - first[c]] = text[lo:hi]
        inside[c, max(0, -int(first[c])) : max(0, len(text) + 1 - int(first[c]))] = True
    steps = np.arange(width, dtype=np.int16)
    own = steps[None, :] <= (last - first)[:, None]
    far = (budget + 1).astype(np.int16)[:, None]
    who = np.arange(count)
    row = np.where(inside[:, :width] & own, np.int16(0), far)
    for i in range(1, most + 1):
        best = row + (letters[:, i - 1 : i - 1 + width] != asked[:, i - 1 : i])
        np.minimum(best[:, :-1], row[:, 1:] + np.int16(1), out=best[:, :-1])  # the pattern's character is missing in the text
        best = np.where(inside[:, i : i + width] & own, best, far) - steps
        row = np.minimum(np.minimum.accumulate(best, axis=1) + steps, far)  # extra characters in the text
        row[~(inside[:, i : i + width] & own)] = np.iinfo(np.int16).max // 2
        least = row.min(axis=1)
        done = lengths == i
        result[who[done]] = np.minimum(result[who[done]], least[done])
        stay = ~done & (least < far[:, 0])
        if not stay.any():
            break
        if i % 8 == 0 or done.any():
            who, row, letters, inside, asked, own, far, lengths = (x[stay] for x in (who, row, letters, inside, asked, own, far, lengths))
    return result


class Block:
    """Windows of texts, indexed for each q that their lengths ask for."""

    def __init__(self):
        self.items: list = []
        self.windows: list[str] = []

    def add(self, item: object, text: str) -> None:
        last = max(0, len(text) - LONGEST)
        for at in sorted({*range(0, last, STRIDE), last}):
            self.items.append(item)
            self.windows.append(text[at : at + LONGEST])

    def index(self) -> Block:
        self.points = [points_of(w) for w in self.windows]
        self.budget = np.array([int(len(w) * RATE) for w in self.windows], dtype=np.int64)
        self.short = [i for i, w in enumerate(self.windows) if 0 < len(w) < Q]
        by: dict[int, list[int]] = {}
        for i, w in enumerate(self.windows):
            if len(w) >= Q:
                by.setdefault(gram_size(len(w), int(self.budget[i])), []).append(i)
        self.indexes = [Index(q, np.array(x), [self.points[i] for i in x], self.budget[x]) for q, x in sorted(by.items())]
        return self

    def match(self, texts: list[str]) -> list[dict[int, int]]:
        """For each text: window -> least edits found, for windows within budget."""
        out: list[dict[int, int]] = [{} for _ in texts]
        points = [points_of(t) for t in texts]
        held, size = [], 0
        for t, p in enumerate(points):
            for lo in range(0, max(len(p), 1), STRETCH):
                held.append((t, lo, p[lo : lo + STRETCH + REACH]))
                size += len(held[-1][2])
                if size >= STRETCH:
                    self.search(held, texts, points, out)
                    held, size = [], 0
        self.search(held, texts, points, out)
        for t, text in enumerate(texts):
            for w in self.short:
                if f" {self.windows[w]} " in f" {text} ":
                    out[t][w] = 0
        return out

    def search(self, held: list[tuple[int, int, np.ndarray]], texts: list[str], points: list[np.ndarray], out: list[dict[int, int]]) -> None:
        if not held:
            return
        sizes = np.array([len(p) + 1 for _, _, p in held])
        joined = np.concatenate([x for _, _, p in held for x in (p, [BREAK])]).astype(np.uint32)
        owner = np.repeat([t for t, _, _ in held], sizes)
        place = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat([lo for _, lo, _ in held], sizes)
        left: dict[tuple[int, int, int], None] = {}
        for index in self.indexes:
            for found in index.candidates(joined, owner, place, out):
                for t, w, b in zip(*(x.tolist() for x in found), strict=True):
                    w = int(index.numbers[w])
                    step = int(self.budget[w]) + 1
                    if out[t].get(w) == 0:
                        continue
                    first, last = b * step, (b + 2) * step - 1
                    if self.windows[w] in texts[t][max(0, first) : last + len(self.windows[w]) + step]:
                        out[t][w] = 0
                    elif step > 1:
                        left[t, w, first] = None
        ordered = sorted((x for x in left if out[x[0]].get(x[1]) != 0), key=lambda x: len(self.windows[x[1]]))
        for some in batched(ordered, 128):
            t, w, first = (np.array(x) for x in zip(*some, strict=True))
            k = self.budget[w]
            edits = banded([self.points[i] for i in w], [points[i] for i in t], first - k, first + 2 * k + 1 + k, k)
            for a, b, e, most in zip(t.tolist(), w.tolist(), edits.tolist(), k.tolist(), strict=True):
                if e <= most:
                    out[a][b] = min(e, out[a].get(b, e))


def blocks(benchmark: DataFrame, text_col: str = "text") -> Iterator[Block]:
    """The distinct texts of the benchmark, named by their SHA-256, in blocks of about BLOCK_BYTES, dealt
    by a hash and fetched one at a time."""
    items = benchmark.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for b in range(n):
        block = Block()
        for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).select("text", F.sha2("text", 256).alias("name")).collect():
            if text := fold(r["text"]):
                block.add(r["name"], text)
        if block.windows:
            yield block


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits: each document and item of which it holds a window within budget."""
    spark = df.sparkSession
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, name string, edits int"
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    several = batched(blocks(benchmark, item_text_col), GROUP)
    for group in several:
        shared = spark.sparkContext.broadcast([block.index() for block in group])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = Rows(schema)
            for big in batches:
                for batch in slices(big):
                    keys, texts = batch[0].to_pylist(), [fold(t) for t in batch[1].to_pylist()]
                    for block in shared.value:
                        for key, hits in zip(keys, block.match(texts), strict=True):
                            found: dict = {}
                            for w, edits in hits.items():
                                found[block.items[w]] = min(edits, found.get(block.items[w], edits))
                            for name, edits in found.items():
                                rows.add(key, name, edits)
                    if rows.full():
                        yield rows.take()
            yield from rows.rest()

        part = docs.mapInArrow(run, schema)
        if len(group) == GROUP:  # more may follow: no executor holds more than a group
            part = materialize(part, "matches")
            shared.unpersist()
        out = part if out is None else out.union(part)
    names = benchmark.select(F.col(item_col).alias("item_id"), F.sha2(F.col(item_text_col), 256).alias("name"))
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.join(names, "name").select("doc_id", "item_id", "edits")


def remove(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """df without the rows that hold a benchmark item; a pass for each group of blocks, no shuffle."""
    at = df.columns.index(text_col)
    for group in batched(blocks(benchmark, item_text_col), GROUP):
        shared = df.sparkSession.sparkContext.broadcast([block.index() for block in group])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in slices(big):
                    texts = [fold(t) for t in batch[at].to_pylist()]
                    hit = [False] * len(texts)
                    for block in shared.value:
                        hit = [a or bool(b) for a, b in zip(hit, block.match(texts), strict=True)]
                    yield batch.filter(pa.array([not x for x in hit], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
        if len(group) == GROUP:
            df = materialize(df, "decontaminated")
            shared.unpersist()
    return df
