"""Operator 5: SimHash fingerprints and exact links by vantage-point trees.

Fingerprints are made where the texts are read. Distinct ones are dealt to the leaves of a
vantage-point tree: at each node those within mu bits of the vantage point go inside, others
outside. By the triangle inequality two fingerprints at most r bits apart lie at distances from the
vantage point that differ by at most r, so one that is outside but within mu + r also visits the
inside, and a visitor follows every branch the bound leaves open. Each linked pair thus meets in
the home leaf of one of them, and no link is lost. A task searches a large leaf by a tree of its
own. Leaves only emit a spanning forest of their links; components are then found by joins.

The tree of all fingerprints is built from a sample of at most SAMPLE. A leaf that gets more than HOT
fingerprints even so is dealt to several tasks, each of which compares two blocks of about HOT.

Near copies (`alike`) are texts whose sets of shingles have a Jaccard similarity of 0.8, say. The
fingerprint of a whole text differs in 10 of 64 bits at that point (strangers: in 32 +- 4), a radius
at which the triangle bound prunes nothing. So each text gets several fingerprints, each of a few of
its shingles: those that come first in an order of the fingerprint's own. They are equal for a pair
at similarity s in a share of about s ** FEW, and differ as strangers' do otherwise; the trees search
them at a radius of one bit. Texts that meet are then compared by their sets.

Edge cases: null or wordless texts have fingerprint zero and link like any other; fewer words than
a shingle has make one shingle of all; null ids pass through, and a group without any id has
component null; equal fingerprints are one node, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, arrow_schema, discard, materialize, partitions, slices, tidy
from .graph import components

SEED = 42
SAMPLE = 1 << 17  # most fingerprints that the trees are built from
LEAF = 1024
HOT = 128 * LEAF  # a leaf with more homes or visits is dealt to several tasks
PRINTS, FEW = 10, 3  # fingerprints of a text, and shingles of a fingerprint, in the search for near copies
BLOCK = 1024  # most sets of a side that a task compares at a time


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Each run of width words, joined by spaces; all words if there are fewer."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> list[int]:
    hashed = xxhash.xxh64_intdigest
    return [hashed(x, seed) for x in shingles(words, width)]


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of anything but the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = np.ascontiguousarray(hashes[i : i + (1 << 14)], dtype="<u8")
        ones += np.add.reduce(np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(np.array(shingle_hashes(words, width), dtype=np.uint64))


def mark_of(hashes: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def orders(count: int) -> tuple[np.ndarray, np.ndarray]:
    """What each fingerprint's order of hashes is made of: an exclusive or and an odd multiplier."""
    drawn = np.random.default_rng(SEED).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return drawn[0][:, None], drawn[1][:, None] << np.uint64(1) | np.uint64(1)


def small_prints(hashes: np.ndarray, count: int = PRINTS) -> np.ndarray:
    """count fingerprints of a set: each the bits that are set in over half of the FEW hashes that come
    first in its order (of all, if there are fewer)."""
    mask, odd = orders(count)
    best = np.zeros((count, 0), np.uint64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.concatenate([best, np.broadcast_to(hashes[i : i + (1 << 16)], (count, len(hashes[i : i + (1 << 16)])))], axis=1)
        if part.shape[1] > FEW:
            first = np.argpartition((part ^ mask) * odd, FEW - 1, axis=1)[:, :FEW]
            part = np.take_along_axis(part, first, axis=1)
        best = part
    if best.shape[1] < FEW:
        return np.array([majority(best[0])] * count, dtype=np.uint64)
    a, b, c = best.T
    return a & b | b & c | a & c


def marks(df: DataFrame, width: int, count: int = PRINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, prints of every whole text, all of its set of shingles; no shuffle."""
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, mark binary, prints array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    hashes = shingle_set(words_of(text), width)
                    out.add(key, mark_of(hashes), small_prints(hashes, count).view(np.int64))
                if out.full():
                    yield out.take()
        yield from out.rest()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every whole text; no shuffle."""
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    bits = majority(np.array(shingle_hashes(words_of(text), width), dtype=np.uint64))
                    out.add(key, bits - (bits >> 63 << 64))
                if out.full():
                    yield out.take()
        yield from out.rest()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


class VantageTree:
    """Splits by Hamming distance. nodes: (vantage point, mu, inside, outside) or a leaf's number."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self.random = np.random.default_rng(SEED)
        self.root = self.build(np.unique(sample), max(leaf, 2))

    def build(self, points: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        found = self.split(points) if len(points) > leaf else None
        if found is None:
            self.nodes[at] = self.leaves
            self.leaves += 1
        else:
            vantage, mu, d = found
            self.nodes[at] = (vantage, mu, self.build(points[d <= mu], leaf), self.build(points[d > mu], leaf))
        return at

    def split(self, points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
        """Of a few candidates, the vantage point that puts fewest beside its boundary; none if it parts nothing."""
        best = None
        for vantage in points[self.random.choice(len(points), min(12, len(points)), replace=False)]:
            d = np.bitwise_count(points ^ vantage).astype(np.int16)
            mu = int(np.median(d)) - (np.median(d) == d.max())
            inside, near = np.count_nonzero(d <= mu), np.count_nonzero(np.abs(d - mu - 0.5) < self.radius)
            cost = max(inside, len(points) - inside) + near
            if inside and cost < 1.4 * len(points) and (best is None or cost < best[0]):
                best = cost, vantage, mu, d
        return best[1:] if best else None

    def route(self, points: np.ndarray, ask: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """index of the point, leaf, and whether it is at home there. ask: all are visitors, and meet
        whatever is at home within the radius."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        stack = [(self.root, np.arange(len(points)), np.full(len(points), not ask))]
        while stack:
            at, who, home = stack.pop()
            if not len(who):
                continue
            node = self.nodes[at]
            if not isinstance(node, tuple):
                out.append((who, np.full(len(who), node), home))
                continue
            vantage, mu, inside, outside = node
            d = np.bitwise_count(points[who] ^ vantage).astype(np.int16)
            near = d <= mu + self.radius
            stack.append((inside, who[near], home[near] & (d[near] <= mu)))
            far = (d > mu) | ~home & (d > mu - self.radius)
            stack.append((outside, who[far], home[far]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spanning(index: np.ndarray, ask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, representative) that join what is linked through pairs of ask x index.

    Blocks of the comparison are small; pairs that are joined already are dropped at once, so what
    is kept is linear in the number of fingerprints.
    """
    points, place = np.unique(np.concatenate([index, ask]), return_inverse=True)
    at, asks = place[: len(index)], place[len(index) :]
    label = np.arange(len(points))
    for i in range(0, len(ask), 64):
        mine = asks[i : i + 64]
        for j in range(0, len(index), 4096):
            theirs = at[j : j + 4096]
            x, y = np.nonzero(np.bitwise_count(points[mine][:, None] ^ points[theirs][None, :]) <= radius)
            a, b = label[mine[x]], label[theirs[y]]
            while len(todo := np.flatnonzero(a != b)):
                a, b = a[todo], b[todo]
                low, high = min(a[0], b[0]), max(a[0], b[0])
                label[label == high] = low
                a[a == high] = low
                b[b == high] = low
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def forest(index: np.ndarray, ask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As spanning, by a tree of its own over the index where that is large."""
    if len(index) <= 2 * LEAF:
        return spanning(index, ask, radius)
    tree = VantageTree(index, LEAF, radius)
    who, leaf, home = tree.route(index)
    who, leaf = who[home], leaf[home]
    asks, at, _ = tree.route(ask, ask=True)
    who, leaf = who[order := np.argsort(leaf, kind="stable")], leaf[order]
    asks, at = asks[order := np.argsort(at, kind="stable")], at[order]
    edges = np.arange(tree.leaves + 1)
    own, other = np.searchsorted(leaf, edges), np.searchsorted(at, edges)
    found = [
        spanning(index[who[own[i] : own[i + 1]]], ask[asks[other[i] : other[i + 1]]], radius)
        for i in range(tree.leaves) if own[i] < own[i + 1] and other[i] < other[i + 1]
    ]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (index[:0], index[:0])


def expand(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as times says, and the number of each time."""
    again = np.repeat(rows, times)
    return again, np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)


def spread(key: np.ndarray, leaf: np.ndarray, home: np.ndarray, blocks: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """index of the row, share of its leaf, role: 0 is index only, 1 index and query, 2 query only.

    Homes stand in blocks, and a share compares two blocks or one with itself. Visitors go to each
    block's own share; where they are many they stand in lanes, with a share for each block and lane.
    """
    k, v = blocks[leaf], lanes[leaf]
    block, lane = key % k, key % np.maximum(v, 1)
    mine, other = expand(np.flatnonzero(home), k[home])
    low, high = np.minimum(block[mine], other), np.maximum(block[mine], other)
    ask, to = expand(np.flatnonzero(~home), k[~home])
    shown, each = expand(np.flatnonzero(home), v[home])
    of_lane = lambda at, b, c: k[at] ** 2 + b * v[at] + c
    share = [low * k[mine] + high, np.where(v[ask] > 0, of_lane(ask, to, lane[ask]), to * (k[ask] + 1)), of_lane(shown, block[shown], each)]
    role = [np.where(low == high, 1, np.where(block[mine] == low, 0, 2)), np.full(len(ask), 2), np.zeros(len(shown), int)]
    return np.concatenate([mine, ask, shown]), np.concatenate(share), np.concatenate(role)


class Trees:
    """A vantage-point tree for each plane of fingerprints; leaves are numbered through."""

    def __init__(self, sample: dict[int, np.ndarray], leaf: int, radius: int):
        self.trees = {plane: VantageTree(points, leaf, radius) for plane, points in sorted(sample.items())}
        self.first, self.leaves = {}, 1  # leaf 0 holds planes of which the sample has nothing
        for plane, tree in self.trees.items():
            self.first[plane] = self.leaves
            self.leaves += tree.leaves

    def route(self, planes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        for plane in np.unique(planes).tolist():
            mine = np.flatnonzero(planes == plane)
            if tree := self.trees.get(plane):
                who, leaf, home = tree.route(points[mine])
                out.append((mine[who], leaf + self.first[plane], home))
            else:
                out.append((mine, np.zeros(len(mine), int), np.ones(len(mine), bool)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """plane, a, b: links between distinct fingerprints (columns plane, fp) enough to join every linked
    pair of a plane."""
    spark = fps.sparkSession
    fps = fps.select(F.col("plane").cast("int").alias("plane"), "fp")
    n = fps.count()
    rate = min(1.0, SAMPLE / max(n, 1))
    chosen = fps if rate == 1 else fps.where(F.pmod(F.xxhash64("plane", "fp"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    drawn = chosen.limit(2 * SAMPLE).toPandas()
    trees = Trees({int(p): x["fp"].to_numpy(np.int64).view(np.uint64) for p, x in drawn.groupby("plane")}, int(LEAF * rate), radius)
    sizes = "leaf int, homes bigint, visits bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, trees.leaves), np.int64)
        for batch in batches:
            _, leaf, home = trees.route(batch[0].to_numpy(), batch[1].to_numpy().view(np.uint64))
            for i in (0, 1):
                total[i] += np.bincount(leaf[home == (not i)], minlength=trees.leaves)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *map(pa.array, total[:, seen])], schema=arrow_schema(sizes))

    summed = fps.mapInArrow(tidy(count), sizes).groupBy("leaf").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"))
    blocks, lanes = np.ones(trees.leaves, np.int64), np.zeros(trees.leaves, np.int64)
    for r in summed.where((F.col("homes") > HOT) | (F.col("visits") > HOT)).collect():  # one row for each leaf, and leaves are as bounded as the sample
        blocks[r["leaf"]] = max(1, -(-r["homes"] // HOT))
        lanes[r["leaf"]] = -(-r["visits"] // HOT) if r["visits"] > HOT else 0
    routed = "leaf int, share bigint, plane int, fp bigint, role int"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1 << 14):
                planes, points = batch[0].to_numpy(), batch[1].to_numpy().view(np.uint64)
                who, leaf, home = trees.route(planes, points)
                at, share, role = spread((points[who] % np.uint64(1_000_003)).astype(np.int64), leaf, home, blocks, lanes)
                columns = [pa.array(leaf[at], pa.int32()), pa.array(share), pa.array(planes[who[at]], pa.int32()), pa.array(points[who[at]].view(np.int64)), pa.array(role, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(routed))

    found = "plane int, a bigint, b bigint"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's leaves and shares one after another."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            planes, fp, role = (np.concatenate(x) for x in zip(*held, strict=True))
            for plane in np.unique(planes).tolist():
                mine = planes == plane
                a, b = forest(fp[mine & (role < 2)], fp[mine & (role > 0)], radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), plane), pa.int32()), *(pa.array(x.view(np.int64)) for x in (a, b))], schema=arrow_schema(found))

        for batch in batches:
            leaf, share, planes, fp, role = (batch[i].to_numpy() for i in range(5))
            cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(share) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(leaf)], strict=True):
                if lo == hi:
                    continue
                if now != (leaf[lo], share[lo]):
                    if held:
                        yield from close()
                    now, held = (leaf[lo], share[lo]), []
                held.append((planes[lo:hi], fp[lo:hi].view(np.uint64), role[lo:hi]))
        if held:
            yield from close()

    dealt = fps.mapInArrow(tidy(deal), routed)
    return dealt.repartition(partitions(spark), "leaf", "share").sortWithinPartitions("leaf", "share").mapInArrow(tidy(search), found)


def similar(sets: list[np.ndarray], sides: np.ndarray, likeness: float) -> list[tuple[int, int]]:
    """Pairs that join all sets with a Jaccard similarity of likeness or more. Sets of side 1 are only
    compared with those of side 0, unless all are of one side.

    A pair so alike shares one of the rarest members of each: of n, all but as many as they must have
    in common, and one. Sets that meet there, of fitting sizes, not joined yet, are compared at once.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, members, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    counted = counts[members]
    two = len(np.unique(sides)) > 1
    heads, owners = [], []
    for i, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        n = hi - lo
        keep = n - int(np.ceil(likeness * n - 1e-9)) + 1
        rare = lo + np.lexsort((members[lo:hi], counted[lo:hi]))[:keep] if n else np.zeros(0, np.int64)
        heads.append(members[rare[counted[rare] > 1]])
        owners.append(np.full(len(heads[-1]), i))
    flat, owner = np.concatenate(heads), np.concatenate(owners)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    label, out, seen = np.arange(len(sets)), [], np.zeros(len(counts), bool)
    for i, head in enumerate(heads):
        if not len(head):
            continue
        lo, hi = np.searchsorted(flat, head, "left"), np.searchsorted(flat, head, "right")
        near = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        near = near[(near > i) & (label[near] != label[i])]
        if two:
            near = near[sides[near] != sides[i]]
        near = near[likeness * np.maximum(sizes[near], sizes[i]) <= np.minimum(sizes[near], sizes[i]) + 1e-9]
        if not len(near):
            continue
        seen[mine := members[starts[i] : ends[i]]] = True
        for at in range(0, len(near), 1024):
            some = near[at : at + 1024]
            each, place = expand(starts[some], sizes[some])
            both = np.add.reduceat(seen[members[each + place]], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            for j in some[both / (sizes[i] + sizes[some] - both) >= likeness].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
        seen[mine] = False
    return out


def alike(df: DataFrame, width: int, likeness: float, radius: int = 1, count: int = PRINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: the smallest id reachable over pairs whose sets of shingles have a Jaccard
    similarity of likeness or more.

    Fingerprints only say which texts to compare: for each of the count fingerprints, texts whose
    fingerprints are equal or linked by radius bits are sent to a task as sets, which decide there.
    Texts with equal sets are one, and the same texts meeting again are compared once. More than
    BLOCK that meet are dealt to tasks of two blocks each. A pair at a similarity of s is missed with
    a chance of about (1 - s ** FEW) ** count: 0.0008 at 0.8.
    """
    parts = partitions(df.sparkSession)
    prints = materialize(marks(df, width, count, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("mark", "prints").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    points = nodes.select("mark", F.posexplode("prints").alias("plane", "fp"))
    key = F.struct("plane", "fp")
    pairs = links(materialize(points.select("plane", "fp").distinct(), "points"), radius)
    joined = components(pairs.select(F.struct("plane", F.col("a").alias("fp")).alias("a"), F.struct("plane", F.col("b").alias("fp")).alias("b")))
    met = materialize(points.join(joined, key == F.col("node"), "left").select("mark", "plane", F.coalesce("root.fp", "fp").alias("meet")), "met")
    several = met.groupBy("plane", "meet").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("mark")).alias("who")).where("n > 1")
    wanted = materialize(several.groupBy("n", "who").agg(F.min(F.struct("plane", "meet")).alias("at")).select("at.plane", "at.meet", "n"), "wanted")
    asked = met.join(wanted, ["plane", "meet"]).groupBy("mark").agg(F.collect_list(F.struct("plane", "meet", "n")).alias("at"))
    asked = asked.join(nodes.select("mark", "least"), "mark").select(F.col("least").alias("__id"), "mark", "at.plane", "at.meet", "at.n")
    texts = df.select(F.col(id_col).alias("__of"), F.col(text_col).alias("text")).join(asked, F.col("__of").eqNullSafe(F.col("__id")))
    sent = "plane int, meet bigint, share bigint, side int, mark binary, members binary"
    linked = "a binary, b binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(sent)
        for big in batches:
            for batch in slices(big):
                for mark, text, *places in zip(*(batch[i].to_pylist() for i in range(5)), strict=True):
                    hashes = shingle_set(words_of(text), width)
                    if mark_of(hashes) != mark:  # an id that repeats brings other texts too
                        continue
                    data = hashes.astype("<u8").tobytes()
                    for plane, meet, n in zip(*places, strict=True):
                        k = -(-n // BLOCK)
                        own = int.from_bytes(mark[:7], "little") % k
                        for other in range(k):
                            low, high = min(own, other), max(own, other)
                            out.add(plane, meet, low * k + high, int(own != low), mark, data, size=len(data))
                            if out.full():
                                yield out.take()
        yield from out.rest()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those that meet in a share, one share after another."""
        out, now, held = Rows(linked), None, {}

        def close() -> None:
            names = list(held)
            if len(names) > 1:
                for i, j in similar([np.frombuffer(x, "<u8") for x, _ in held.values()], np.array([s for _, s in held.values()]), likeness):
                    out.add(names[i], names[j])

        for big in batches:
            for batch in slices(big):
                for plane, meet, share, side, mark, data in zip(*(batch[i].to_pylist() for i in range(6)), strict=True):
                    if (plane, meet, share) != now:
                        close()
                        now, held = (plane, meet, share), {}
                    held[mark] = data, side
                if out.full():
                    yield out.take()
        close()
        yield from out.rest()

    packed = texts.select("mark", "text", "plane", "meet", "n").mapInArrow(tidy(pack), sent)
    dealt = packed.repartition(parts, "plane", "meet", "share").sortWithinPartitions("plane", "meet", "share")
    groups = components(materialize(dealt.mapInArrow(tidy(compare), linked), "verified"))
    groups = groups.union(groups.select("root", "root").distinct())  # a root is a node as well
    grouped = materialize(nodes.select("mark", "least").join(groups, F.col("mark") == F.col("node")).select("mark", "least", "root"), "grouped")
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    others = nodes.select("mark", "least").join(grouped.select("mark"), "mark", "left_anti").select("mark", F.col("least").alias("component_id"))
    known = materialize(grouped.join(ids, "root").select("mark", "component_id").unionByName(others), "known")
    discard(met, wanted, nodes, grouped)
    return prints.join(known, "mark").select("doc_id", "component_id")


def first_of_groups(df: DataFrame, width: int, likeness: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose group (by the exact similarity of shingles) has a smaller id. Rows that
    repeat an id stay or go together, and so do rows without an id (they stay if their group has none)."""
    groups = alike(df, width, likeness, id_col=id_col, text_col=text_col)
    gone = groups.where(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id")))
    name = "_" * (1 + max(map(len, df.columns)))  # longer than any column's name
    gone = materialize(gone.select(F.col("doc_id").alias(name)).distinct(), "gone")
    nameless = gone.where(F.col(name).isNull()).limit(1).count()
    kept = df.join(gone, df[id_col] == F.col(name), "left_anti")
    return kept.where(df[id_col].isNotNull()) if nameless else kept


def cluster(prints: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, component_id of (doc_id, fp): the smallest id reachable over links of radius bits or fewer."""
    prints = materialize(prints, "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select(F.lit(0).alias("plane"), "fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")
