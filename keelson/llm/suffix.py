"""Operator 7: removal of repeated byte strings with sorted suffixes.

A window of `length` bytes goes if it also starts earlier (smaller id, or the same document before).
Sorting every suffix of a corpus would move many times its size, so suffixes are sorted at anchors:
the place in each window whose 32-gram hash is least (leftmost of equals). Equal windows have their
anchor at the same place, so each repeated window is found at its anchor, and only there.

1. Each distinct text (by SHA-256) gives its anchors where it is read; their hashes are dealt to buckets
   in packed arrays, and anchors whose hash occurs once are dropped. A text's places go by 8 bytes of
   its digest; a text that shares them with another gets the other's places too, which adds suffixes
   and changes no result.
2. The first document of each text with repeated anchors emits, for each, the bytes that its windows
   span. Sampled splitters range-partition these suffixes by their leading bytes. A splitter never
   parts equal leading 32-grams, so all suffixes that could share a window stand in one range.
3. Each range sorts its suffixes, and the reversed bytes before them, by multikey quicksort over
   words of 8 bytes. From the common prefixes of neighbours (across runs and buckets of the sort)
   follows the class of each suffix at each depth; two windows are equal if the classes of both
   sides are. All but the first of a class are repeated.
4. Spans go back to their documents and are cut there. Later copies of a text lose all of it.

An anchor shared by more than HOT texts is emitted window by window instead, dealt by the hash of
the window, so that no task gets them all; a task passes on one of several equal suffixes and marks
the later ones itself.

Edge cases: null texts are empty; texts shorter than a window lose nothing; null ids count as the
smallest; rows that repeat id and text are one document, each with its result; rows that repeat an id
with another text are ordered by the SHA-256 of their text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, free_shuffles, materialize, partitions, slices, tidy

LENGTH = 100
GRAM = 32
HOT = 20_000
RANGES = 16  # of suffixes for each task
SAMPLE_TEXTS = 400  # texts (in expectation) whose anchors give splitters
LOWEST = -(1 << 63)
SPLIT = 1 << 20  # bytes of a text that are hashed at a time; places fit the low bits of a key


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, first byte lowest; data must have 8 more bytes than places."""
    w = data.astype(np.uint64)
    w = w[:-1] | w[1:] << np.uint64(8)
    w = w[:-2] | w[2:] << np.uint64(16)
    return w[:-4] | w[4:] << np.uint64(32)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    w = words8(data)
    n = len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for i, m in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), 1):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(m) + w[8 * i : 8 * i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, hash, and the first and last window start that has its anchor there."""
    out = []
    for base in range(0, max(len(data) - length + 1, 0), SPLIT - length):
        part = np.frombuffer(data, np.uint8, min(SPLIT - 1, len(data) - base), base)
        if len(part) < length:
            break
        hashed = gram_hashes(part)
        keys = hashed >> np.uint64(20) << np.uint64(20) | np.arange(len(hashed), dtype=np.uint64)
        span, width = length - GRAM + 1, 1
        least = keys
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(keys) - span + 1], least[span - width :][: len(keys) - span + 1])
        at = (least & np.uint64(SPLIT - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        place = at[first]
        out.append((place + base, hashed[place], first + base, last + base))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k (id, null lowest), sha (SHA-256), name (its first 8 bytes), text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("k"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))
    return docs.select("k", "sha", name_of(F.col("sha")).alias("name"), "text")


def name_of(sha: Column) -> Column:
    """The first 8 bytes of a digest as a signed number."""
    return F.conv(F.hex(F.substring(sha, 1, 8)), 16, -10).cast("bigint")


PLACE = np.dtype([("at", "<u4"), ("lo", "u1"), ("hi", "u1"), ("hot", "u1")])  # windows start lo to hi bytes before


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """name, places (packed PLACE) of anchors whose hash occurs elsewhere too."""
    parts = partitions(docs.sparkSession)
    packed = "bucket int, n int, texts binary, counts binary, hashes binary, places binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # texts of this task
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = Rows(packed)
            texts = np.repeat(np.array([x[0] for x in held], dtype="<i8"), [len(x[1]) for x in held])
            hashed = np.concatenate([x[1] for x in held])
            place = np.concatenate([x[2] for x in held])
            bucket = (hashed % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
            for b in range(parts):
                mine = order[cuts[b] : cuts[b + 1]]
                if not len(mine):
                    continue
                t = texts[mine]
                starts = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
                runs = np.diff(np.append(starts, len(t))).astype("<u4")
                short = np.ascontiguousarray(hashed[mine].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 1:7]
                out.add(b, len(mine), t[starts].tobytes(), runs.tobytes(), short.tobytes(), place[mine].tobytes())
            yield from out.rest()

        for big in batches:
            for batch in slices(big):
                for sha, name, text in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                    if len(text) * 4 < length or sha in seen:
                        continue
                    seen.add(sha)
                    data = text.encode()
                    at, hashed, first, last = anchors(data, length)
                    if not len(at):
                        continue
                    place = np.zeros(len(at), PLACE)
                    place["at"], place["lo"], place["hi"] = at, at - last, at - first
                    held.append((name, hashed, place))
                    size += len(at)
                if size > 1 << 18:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    kept = "name bigint, places binary"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket = None

        def close() -> Iterator[pa.RecordBatch]:
            texts, hashed, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place["at"], texts, hashed))
            texts, hashed, place = texts[order], hashed[order], place[order]
            fresh = np.ones(len(texts), bool)  # a text that several tasks met counts once
            fresh[1:] = (hashed[1:] != hashed[:-1]) | (texts[1:] != texts[:-1]) | (place["at"][1:] != place["at"][:-1])
            texts, hashed, place = texts[fresh], hashed[fresh], place[fresh].copy()
            starts = np.concatenate([[0], np.flatnonzero(hashed[1:] != hashed[:-1]) + 1])
            sizes = np.repeat(np.diff(np.append(starts, len(hashed))), np.diff(np.append(starts, len(hashed))))
            place["hot"] = sizes > HOT
            texts, place = texts[sizes > 1], place[sizes > 1]
            order = np.argsort(texts, kind="stable")
            texts, place = texts[order], place[order]
            out = Rows(kept)
            if len(texts):
                starts = np.concatenate([[0], np.flatnonzero(texts[1:] != texts[:-1]) + 1])
                for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)], strict=True):
                    out.add(int(texts[lo]), place[lo:hi].tobytes(), size=(hi - lo) * PLACE.itemsize)
                    if out.full():
                        yield out.take()
            yield from out.rest()

        for batch in batches:
            for b, n, texts, counts, hashes, places in zip(*(batch[i].to_pylist() for i in range(6)), strict=True):
                if b != bucket:
                    if held:
                        yield from close()
                    bucket, held = b, []
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :6] = np.frombuffer(hashes, np.uint8).reshape(n, 6)
                held.append((np.repeat(np.frombuffer(texts, "<i8"), np.frombuffer(counts, "<u4")), wide.view("<u8").ravel(), np.frombuffer(places, PLACE)))
        if held:
            yield from close()

    dealt = docs.select("sha", "name", "text").mapInArrow(tidy(emit), packed).repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(pick), kept)


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of an (n, words) array of unsigned integers, by words from the left."""
    n, depth = keys.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, d = stack.pop()
        while hi - lo > 1 and d < depth:
            mine = order[lo:hi]
            if hi - lo <= 48:
                rows = keys[mine, d:].tolist()
                order[lo:hi] = mine[sorted(range(hi - lo), key=rows.__getitem__)]
                break
            word = keys[mine, d]
            a, b, c = word[0], word[(hi - lo) // 2], word[-1]
            pivot = max(min(a, b), min(max(a, b), c))
            less, more = word < pivot, word > pivot
            same = mine[~(less | more)]
            i = lo + np.count_nonzero(less)
            j = i + len(same)
            order[lo:i], order[i:j], order[j:hi] = mine[less], same, mine[more]
            stack.append((lo, i, d))
            stack.append((j, hi, d))
            lo, hi, d = i, j, d + 1
    return order


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """(n, bytes) to (n, words) that compare like the bytes; padded with zeros."""
    padded = np.zeros((len(data), -(-data.shape[1] // 8) * 8), np.uint8)
    padded[:, : data.shape[1]] = data
    return padded.view(">u8").astype(np.uint64)


def neighbours(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows and the common prefix of each with the one before it (0 for the first)."""
    order = multikey_quicksort(big_endian_words(data))
    common = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 14):
        hi = min(len(order), lo + (1 << 14))
        differ = data[order[lo:hi]] != data[order[lo - 1 : hi - 1]]
        common[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), data.shape[1])
    return order, common


def repeats(left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """(n, length - GRAM + 1) marks of windows l bytes before the anchor that an earlier row has too.

    Rows stand in document order. left holds the bytes before the anchor, nearest first.
    """
    n, most = len(left), length - GRAM
    marks = np.zeros((n, most + 1), bool)
    order_r, common_r = neighbours(right)
    order_l, common_l = neighbours(left)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(most + 1):
        who = np.flatnonzero((lo <= l) & (l <= hi))
        if len(who) < 2:
            continue
        class_r[order_r] = np.cumsum(common_r < length - l)
        class_l[order_l] = np.cumsum(common_l < l) if l else 0
        key = class_l[who] * (n + 1) + class_r[who]
        by = np.argsort(key, kind="stable")
        again = np.zeros(len(who), bool)
        again[by[1:]] = key[by[1:]] == key[by[:-1]]
        marks[who[again], l] = True
    return marks


def spans_of(marks: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the bytes that each run of marked windows covers."""
    wide = np.zeros((len(marks), marks.shape[1] + 2), np.int8)
    wide[:, 1:-1] = marks
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, past = np.nonzero(step == -1)
    return row, at[row] - (past - 1), at[row] - first + length


def leading(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 8], "big")


def splitters(docs: DataFrame, parts: int, length: int) -> list[bytes]:
    """Leading 32-grams that cut the anchors of sampled texts into equal parts. Bounded by the sample."""
    n = docs.count()
    rate = min(1.0, SAMPLE_TEXTS / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).select("text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for text in batch[0].to_pylist():
                data = text.encode()
                at, hashed, _, _ = anchors(data, length)
                out |= {data[a : a + GRAM] for a in at[hashed % np.uint64(8) == 0].tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.binary())], names=["gram"])

    found = sorted({bytes(r["gram"]) for r in chosen.mapInArrow(tidy(grams), "gram binary").limit(1 << 18).collect()})
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def spans(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, name, copy, spans: what goes of each document; spans is packed (start, end) as uint32.

    copy marks a later copy of a text: all of it goes if a window fits.
    """
    from bisect import bisect_right

    spark = df.sparkSession
    parts = partitions(spark)
    ranges = RANGES * parts  # several small ranges a task, one after another, keep what a task holds small
    docs = keyed(df, id_col, text_col)
    keys = materialize(docs.select("k", "sha", "name").distinct(), "texts")
    first = materialize(keys.groupBy("sha", "name").agg(F.min("k").alias("first")), "first")
    places = materialize(repeated_anchors(docs, length), "anchors")
    free_shuffles(spark)
    cuts = splitters(docs, ranges, length)
    most = length - GRAM
    listed = places.groupBy("name").agg(F.collect_list("places").alias("places"))
    wanted = first.select(F.col("first").alias("k"), "sha", "name").join(listed, "name").select("k", "sha", "places")
    suffixes = "bucket int, k bigint, name bigint, at bigint, lo int, hi int, body binary"
    done = "k bigint, name bigint, spans binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(suffixes)
        known: set[tuple[bytes, int]] = set()  # windows at shared anchors that this task has passed on
        for big in batches:
            for batch in slices(big):
                for k, name, text, packed in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
                    data = text.encode()
                    place = np.unique(np.concatenate([np.frombuffer(p, PLACE) for p in packed]))
                    for at, lo, hi, hot in place.tolist():
                        if at + GRAM > len(data) or at < lo:
                            continue  # of another text with the same short name
                        hi, lo = min(hi, at), max(lo, at + length - len(data))
                        for a, b in ([(l, l) for l in range(lo, hi + 1)] if hot else [(lo, hi)] if lo <= hi else []):
                            # the bytes before (nearest first), then from the anchor on, as far as its windows reach
                            body = data[at - b : at + length - a]
                            token = body[b : b + GRAM]
                            bucket = xxhash.xxh64_intdigest(body) % ranges if hot else bisect_right(cuts, token)
                            if hot and (body, b) in known:  # documents come in order, so this one is later
                                out.add(k % ranges, k, name, at, a, b, None)
                                continue
                            if hot and len(known) < 1 << 16:
                                known.add((body, b))
                            out.add(bucket, k, name, at, a, b, body, size=len(body))
                        if out.full():
                            yield out.take()
        yield from out.rest()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            k, name, at, lo, hi = (rows[c].to_numpy().astype(np.int64) for c in ("k", "name", "at", "lo", "hi"))
            bodies = rows["body"].to_pylist()
            sent = np.array([x is not None for x in bodies], bool)
            left, right = np.zeros((len(k), max(most, 1)), np.uint8), np.zeros((len(k), length), np.uint8)
            for i, (body, b) in enumerate(zip(bodies, hi.tolist(), strict=True)):
                if body is None:
                    continue
                if b:
                    left[i, :b] = np.frombuffer(body, np.uint8, b)[::-1]
                right[i, : len(body) - b] = np.frombuffer(body, np.uint8, len(body) - b, b)
            marks = np.zeros((len(k), most + 1), bool)
            marks[sent] = repeats(left[sent], right[sent], lo[sent], hi[sent], length)
            marks[~sent, lo[~sent]] = True
            row, start, end = spans_of(marks, at, length)
            out, last = Rows(done), None
            pairs: list[int] = []
            for i, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
                if last is not None and (k[i] != k[last] or name[i] != name[last]):
                    out.add(int(k[last]), int(name[last]), np.array(pairs, "<u4").tobytes())
                    pairs = []
                    if out.full():
                        yield out.take()
                last = i
                if pairs and s <= pairs[-1] and s >= pairs[-2]:
                    pairs[-1] = max(pairs[-1], e)
                else:
                    pairs += [s, e]
            if last is not None:
                out.add(int(k[last]), int(name[last]), np.array(pairs, "<u4").tobytes())
            yield from out.rest()

        for big in batches:
            bucket = big[0].to_numpy()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if lo == hi:
                    continue
                if bucket[lo] != now:
                    if held:
                        yield from close()
                    now, held = bucket[lo], []
                held.append(big.slice(lo, hi - lo))
        if held:
            yield from close()

    body = docs.join(wanted, ["k", "sha"]).dropDuplicates(["k", "sha"]).select("k", "name", "text", "places").sortWithinPartitions("k", "name")
    dealt = body.mapInArrow(tidy(emit), suffixes)
    found = dealt.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "k", "name", "at", "hi").mapInArrow(tidy(sort), done)
    found = materialize(found, "spans")
    free_shuffles(spark)
    gathered = found.groupBy("k", "name").agg(F.collect_list("spans").alias("spans")).withColumn("copy", F.lit(False))
    copies = keys.join(first.select("sha", "first"), "sha").where(F.col("k") > F.col("first")).select("k", "name", F.array().cast("array<binary>").alias("spans"), F.lit(True).alias("copy"))
    return gathered.unionByName(copies)


def merged(n: int, copy: bool | None, packed: list[bytes] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a document of n bytes."""
    if copy:
        return [(0, n)] if n >= length else []
    if not packed:
        return []
    pairs = np.concatenate([np.frombuffer(p, "<u4") for p in packed]).reshape(-1, 2)
    out: list[tuple[int, int]] = []
    for s, e in sorted(map(tuple, pairs.tolist())):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return data
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removals(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for k, text, copy, packed in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
                    data = text.encode()
                    runs = merged(len(data), copy, packed, length)
                    kept = cut(data, runs)
                    out.add(None if k == LOWEST else k, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                yield out.take()

    docs = keyed(df, id_col, text_col)
    return docs.join(spans(df, length, id_col, text_col), ["k", "name"], "left").select("k", "text", "copy", "spans").mapInArrow(tidy(run), schema)


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to the characters that lie in them whole."""
    out = []
    for s, e in runs:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def removed_from(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """df with repeated passages cut out of its texts (whole characters only); other columns stay.

    Rows of which nothing is left go. chars_col, if there is one, is counted anew.
    """
    names = df.columns
    text_at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else None
    mark = "_" * (1 + max(map(len, names)))  # longer than any column's name
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    tagged = df.withColumns({f"{mark}k": F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)), f"{mark}name": name_of(F.unhex(F.sha2(text, 256)))})
    found = spans(df, length, id_col, text_col).select(*[F.col(c).alias(mark + c) for c in ("k", "name", "copy", "spans")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big):
                texts, keep = batch[text_at].to_pylist(), []
                for i, (copy, packed) in enumerate(zip(batch[len(names)].to_pylist(), batch[len(names) + 1].to_pylist(), strict=True)):
                    if copy or packed:
                        data = (texts[i] or "").encode()
                        runs = whole_characters(data, merged(len(data), copy, packed, length))
                        texts[i] = cut(data, runs).decode() if runs else texts[i]
                        if runs and not texts[i].strip():
                            continue
                    keep.append(i)
                columns = [batch[i] for i in range(len(names))]
                columns[text_at] = pa.array(texts, batch[text_at].type)
                if chars_at is not None:
                    columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).take(pa.array(keep, pa.int64()))

    joined = tagged.join(found, [f"{mark}k", f"{mark}name"], "left").select(*[tagged[c] for c in names], f"{mark}copy", f"{mark}spans")
    return joined.mapInArrow(tidy(run), df.schema)
