import hashlib
import random

import numpy as np
import pytest

from keelson.llm import suffix

from .fixtures import documents, rows, texts


def brute(data: list[tuple[int, str | None]], length: int) -> dict:
    seen, out = set(), {}
    for k, text in sorted(data, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1))
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed: int) -> list[tuple[int, str | None]]:
    """Shared passages of 90 to 300 bytes with edits beside them, runs of one letter, copies, repeats inside a text."""
    rng = random.Random(seed)
    letters = "abcdefghij éß日 "
    prose = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [prose(rng.randint(90, 300)) for _ in range(6)] + ["z" * 150, "ab" * 90]
    data: list[tuple[int, str | None]] = []
    for i in range(60):
        parts = [prose(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 40)
            parts += [p[cut:] if rng.random() < 0.5 else p, prose(rng.randint(0, 60))]
        data.append((1000 - 7 * i, "".join(parts)))
    data += [(2000 + i, data[3][1]) for i in range(5)] + [(5, None), (6, ""), (7, "short")]
    rng.shuffle(data)
    return data


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (3000, 4)).astype(np.uint64)
    order = suffix.multikey_quicksort(keys)
    assert keys[order].tolist() == sorted(keys.tolist()) and sorted(order.tolist()) == list(range(3000))
    equal = np.zeros((500, 2), np.uint64)
    assert sorted(suffix.multikey_quicksort(equal).tolist()) == list(range(500))


@pytest.mark.parametrize("split", [1 << 20, 256])
def test_anchors_cover_every_window_once(monkeypatch, split):
    if split != 1 << 20:
        monkeypatch.setattr(suffix, "SPLIT", split)
    data = texts()[-2].encode()[:3000]
    at, _, first, last = suffix.anchors(data)
    covered = sorted((p, a) for a, f, e in zip(at.tolist(), first.tolist(), last.tolist()) for p in range(f, e + 1))
    assert {p for p, _ in covered} == set(range(len(data) - 99))
    assert all(0 <= a - p <= 68 for p, a in covered)


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 3), (3, 2)])
def test_removals(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    data = corpus(seed) if seed > 1 else rows()
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.removals(documents(spark, data)).collect()}
    assert got == brute(data, 100)


def test_odd_tables(spark):
    assert suffix.removals(documents(spark, [])).count() == 0
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef") for _ in range(400))
    got = suffix.removals(documents(spark, [(None, long), (None, long), (4, long), (4, long), (5, long[:200])])).collect()
    assert sorted(((r["doc_id"] or -1), r["n_removed"]) for r in got) == [(-1, 0), (-1, 0), (4, 400), (4, 400), (5, 200)]


def test_texts_are_cut_at_characters(spark):
    data = [(1, "é" * 200), (2, "x" + "é" * 200), (3, "plain"), (4, "é" * 200), (9, None)]
    got = {r["doc_id"]: r for r in suffix.removed_from(documents(spark, data)).collect()}
    assert got[3]["text"] == "plain" and got[3]["n_chars"] == 5 and got[9]["text"] is None
    assert 4 not in got and got[2]["text"] == "x" and got[1]["n_chars"] == len(got[1]["text"]) < 200
    assert list(got[1].asDict()) == documents(spark, data).columns
