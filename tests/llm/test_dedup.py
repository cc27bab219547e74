import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from keelson.llm import digest, shards, simhash

from .fixtures import documents, rows, texts


def test_canonical_digests(spark, monkeypatch):
    assert digest.canonical("  Ａb C\n") == b"ab c" and digest.canonical(None) == b""
    data = [(k, t) for k, t in rows()] + [(1000, "Naïve FI viii"), (1001, "naïve\nﬁ Ⅷ"), (None, "naïve ﬁ Ⅷ"), (None, "alone"), (1001, "another"), (1002, "another")]
    by_bytes: dict = {}
    for k, t in data:
        if k is not None:
            by_bytes.setdefault(digest.canonical(t), []).append(k)
    want = sorted(((k, min(by_bytes.get(digest.canonical(t), [None]), default=None)) for k, t in data), key=str)
    for collide in (False, True):
        if collide:  # digests of few values: the bytes part what they join
            monkeypatch.setattr(digest, "digest", lambda data: str(len(data) % 3))
        got = sorted(((r["doc_id"], r["group_id"]) for r in digest.groups(documents(spark, data)).collect()), key=str)
        assert got == want
    assert digest.groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("data", [rows(), [(5, "abc")], [], [(None, "q"), (None, "a"), (4, "a B"), (4, "other"), *rows()]])
def test_successors(spark, data):
    got = sorted((tuple(r) for r in digest.with_successor(documents(spark, data)).collect()), key=str)
    ordered = sorted(((k, t or "") for k, t in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, least = [], {}
    for k, t in ordered:
        if k is not None:
            least.setdefault(digest.canonical(t), k)
    for i, (k, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        a, b, c = (digest.digest(digest.canonical(x)) for x in (t, new, following))
        want.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, float(a == b), float(a == c), least.get(digest.canonical(t))))
    assert got == sorted(want, key=str)


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: dict, radius: int) -> dict:
    root = {k: k for k in prints}
    keys = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if (prints[a] ^ prints[b]).bit_count() <= radius and root[b] > root[a]:
                    root[b], changed = root[a], True
    return root


def test_simhash_documents(spark):
    data = rows()
    got = simhash.cluster(simhash.fingerprints(documents(spark, data), 3), 2).collect()
    prints = {k: brute_fingerprint(t, 3) for k, t in data}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints, 2)
    assert simhash.cluster(simhash.fingerprints(documents(spark, []), 3), 2).count() == 0


@pytest.mark.parametrize("leaf,hot", [(4, 8), (16, 1000)])
def test_simhash_links_through_many_leaves(spark, monkeypatch, leaf, hot):
    """Chains, a tight cluster and strangers, with leaves far smaller than in use."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(5)
    points = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for _ in range(5):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(20):
            x ^= 1 << int(rng.integers(0, 63)) | 1 << int(rng.integers(0, 63))
            points.append(x)
    x = points[0]
    points += [x ^ 1 << int(rng.integers(0, 63)) ^ 1 << int(rng.integers(0, 63)) ^ 1 << int(rng.integers(0, 63)) for _ in range(60)]
    prints = dict(enumerate(points))
    df = spark.createDataFrame([*prints.items(), (None, 77)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.cluster(df, 2).collect()}
    assert got.pop(None) is None
    assert got == brute_components(prints, 2)


@pytest.mark.parametrize("visitors", [50, 900])
def test_shares_are_bounded_and_meet_all_pairs(visitors):
    """Each pair of homes, and each visitor with each home, meets in one share of at most two blocks."""
    rng = np.random.default_rng(3)
    n, hot = 700, 100
    home = np.arange(n + visitors) < n
    blocks, lanes = np.array([1, 7]), np.array([0, -(-visitors // hot) if visitors > hot else 0])
    at, share, role = simhash.spread(rng.integers(0, 1_000_003, len(home)), np.ones(len(home), int), home, blocks, lanes)
    met = np.zeros((len(home), len(home)), int)
    for s in np.unique(share):
        index, ask = at[(share == s) & (role < 2)], at[(share == s) & (role > 0)]
        assert len(set(index)) == len(index) < 1.5 * hot and len(set(ask)) == len(ask) < 1.5 * hot + min(visitors, hot)
        met[np.ix_(ask, index)] += 1
    both = met + met.T
    assert not met[:, ~home].any() and (met[np.ix_(~home, home)] == 1).all()
    assert (both[np.ix_(home, home)] > 0).all() and both[np.ix_(home, home)].max() == 2


def test_near_copies_of_hot_groups(spark, monkeypatch):
    """Groups far larger than a block, copies with one word in forty changed, null ids and texts, clashing names."""
    import random

    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    data, want = [(None, "odd one out"), (500, None), (501, "")], {None, 500}
    for i in range(6):
        base = [word() for _ in range(240)]
        for j in range(90 if i == 0 else 4):
            copy = list(base)
            for k in rng.sample(range(240), 2 if j else 0):
                copy[k] = word()
            data.append((1000 + 100 * i + j, " ".join(copy)))
        want.add(1000 + 100 * i)
    docs = documents(spark, data).withColumnsRenamed({"bucket": "mark", "fp": "meet", "shard": "__id"})
    left = simhash.first_of_groups(docs, 5)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == want


def test_recall_and_visits():
    """Sets at a similarity of 0.8 share a fingerprint; the trees' work for a point hardly grows with their number."""
    rng = np.random.default_rng(1)
    for n in (5, 9, 45, 450):
        missed = 0
        for _ in range(300):
            union = rng.integers(0, 1 << 63, n + n // 9 if n > 5 else 5, dtype=np.uint64)
            a, b = union[:n], union[n // 9 :] if n > 5 else union[:4]
            assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
            missed += not (simhash.small_prints(np.sort(a)) == simhash.small_prints(np.sort(b))).any()
        assert missed <= 6  # of 300
    visits = []
    for n in (20_000, 160_000):
        points = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        tree = simhash.VantageTree(points, simhash.LEAF, 1)
        who, leaf, home = tree.route(points)
        assert home.sum() == n and np.bincount(leaf[home]).max() <= simhash.LEAF
        visits.append(len(who) / n)
    assert visits[0] < 2 and visits[1] < 1.7 * visits[0]  # for 8 times the points


def test_forest_of_a_large_leaf(monkeypatch):
    """A tree within a task finds what comparing all pairs finds, with visitors that aren't in the index."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 600)] ^ np.uint64(1) << rng.integers(0, 63, 600, dtype=np.uint64)
    index, ask = np.concatenate([base, near[:300]]), near

    def groups(a, b):
        root = {x: x for x in np.concatenate([index, ask]).tolist()}
        find = lambda x: x if root[x] == x else find(root[x])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = sorted((find(x), find(y)))
            root[y] = x
        return {x: find(x) for x in root}

    want = groups(*simhash.spanning(index, ask, 2))
    monkeypatch.setattr(simhash, "LEAF", 16)
    assert groups(*simhash.forest(index, ask, 2)) == want


def test_near_copies_by_exact_similarity(spark):
    """Pairs on both sides of 0.8, four shingles of five, texts of repeated words, and chains, against brute force."""
    import random

    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    data = []
    for i in range(60):
        base = [word() for _ in range(rng.choice([8, 9, 14, 60, 200, 400]))]
        data.append(base)
        for changes in (1, 2, 4, 8):
            copy = list(base)
            for k in rng.sample(range(len(base)), min(changes * max(1, len(base) // 150), len(base))):
                copy[k] = word()
            data.append(copy)
        data += [base[: -max(1, len(base) // 6)], base[: -max(1, len(base) // 4)], base + base[: len(base) // 2] * 3]
    data += [["la"] * 300 + [word() for _ in range(12)] for _ in range(4)]  # mostly one word, hardly a shingle in common
    rng.shuffle(data)
    texts = {100 + i: " ".join(words) for i, words in enumerate(data)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.split()) for k, t in texts.items())}
    root, near = {k: k for k in sets}, [0, 0]
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b]
    for _, _, x in pairs:
        near[x >= 0.8] += x > 0.6
    assert min(near) > 20
    while changed := [(a, b) for a, b, x in pairs if x >= 0.8 and root[a] != root[b]]:
        for a, b in changed:
            root[a] = root[b] = min(root[a], root[b])
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, [*texts.items(), (7, ""), (8, None)]), "").collect()}
    assert left == {k for k in root if root[k] == k} | {7}


def brute_minimax(sizes: list[int], n: int) -> list[int]:
    def cut(capacity):
        out, held = [], 0
        for i, s in enumerate(sizes):
            if held + s > capacity:
                out.append(i)
                held = 0
            held += s
        return out

    capacity = max(max(sizes), -(-sum(sizes) // n))
    while len(cut(capacity)) >= n:
        capacity += 1
    cuts = cut(capacity)
    return [sum(i >= c for c in cuts) for i in range(len(sizes))]


@pytest.mark.parametrize("n,blocks", [(16, 1 << 14), (5, 4), (3, 16), (200, 8)])
def test_shards(spark, monkeypatch, n, blocks):
    monkeypatch.setattr(shards, "BLOCKS", blocks)
    data = [(k, t) for k, t in rows() if t is not None] + [(900 + i, "copied text") for i in range(20)]
    got = {r["doc_id"]: r for r in shards.assign(documents(spark, data), n).collect()}
    groups: dict = {}
    for k, t in sorted(data):
        groups.setdefault(t, []).append(k)
    sizes = [len(v) * (len(t.encode()) + 1) for t, v in groups.items()]
    want, at = {}, {}
    for s, (t, v) in zip(brute_minimax(sizes, n), groups.items(), strict=True):
        for k in v:
            want[k] = (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", s, at.get(s, 0), None)
            at[s] = at.get(s, 0) + 1
    assert {k: tuple(r)[1:] for k, r in got.items()} == want


def test_shards_odd_rows(spark):
    got = shards.assign(documents(spark, [(None, "a"), (None, "a"), (4, None), (4, None), (5, "")])).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [1, 1, 1, 2, 2]
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert shards.assign(documents(spark, [])).count() == 0


def test_bounds_hold_at_random(spark):
    import random

    rng = random.Random(9)
    for _ in range(20):
        sizes = [rng.choice([1, 2, 50, 400]) * rng.randint(1, 9) for _ in range(rng.randint(1, 300))]
        n = rng.randint(1, 20)
        runs, at = [], 0
        i = 0
        while i < len(sizes):
            k = rng.randint(1, 5)
            total = sum(sizes[i : i + k])
            runs.append(shards.Run(at, at + total, at + total - sizes[i : i + k][-1]))
            at += total
            i += k
        low, high = shards.bracket(runs, max(sizes), n)
        shard = brute_minimax(sizes, n)
        per = [sum(s for s, x in zip(sizes, shard, strict=True) if x == j) for j in range(n)]
        assert low <= max(per) <= high


def test_texts_have_the_cases():
    assert None in texts() and "" in texts()
