"""The pipeline against a plain Python version of its stages."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from keelson.llm import bpe, decontam, langid, simhash

from .test_suffix import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = {k: ["".join(rng.choice(v) for _ in range(rng.randint(3, 8))) for _ in range(400)] for k, v in {"aa": "abcdefgh", "bb": "ijklmnopé"}.items()}
    prose = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    passage, item = prose("aa", 60), prose("bb", 30)
    rows = [(i, prose(k, rng.randint(40, 120)), k) for i, k in enumerate(rng.choices(["aa", "bb"], k=60))]
    rows += [(100, rows[3][1], "aa"), (101, rows[4][1] + " end", "bb"), (102, "12 34 !!", "aa"), (103, None, "aa"), (104, "", None)]
    rows += [(110 + i, f"{prose('aa', 50)} {passage} {prose('aa', 50)}", "aa") for i in range(4)]
    rows += [(120, f"{prose('bb', 40)} {item} {prose('bb', 40)}", "bb"), (121, f"{prose('bb', 40)} {item.upper().replace(' ', ' , ')} {prose('bb', 40)}", None)]
    rng.shuffle(rows)
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(a, b, c, "s", len(b or "")) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_pipeline(spark, folder):
    path, rows, item = folder
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    left = {a: b for a, b, _ in rows if langid.has_letter(b)}

    def grams(text):
        w = simhash.words_of(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {k: grams(t) for k, t in left.items()}
    root = {k: k for k in left}
    for _ in range(5):
        for a in sorted(left):
            for b in left:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[b] = min(root[a], root[b])
    left = {k: t for k, t in left.items() if root[k] == k}
    assert 100 not in left and 101 not in left
    cut = brute(list(left.items()), 100)
    want = {}
    for k, (_, removed, _, sha) in cut.items():
        if removed == 0 and item not in left[k] and decontam.fold(item) not in decontam.fold(left[k]):
            want[k] = sha
    assert 120 not in got and 121 not in got
    assert {k: r["decoded_sha256"] for k, r in got.items() if k in want} == want
    assert set(got) == set(want) | {k for k, v in cut.items() if v[1] and 110 <= k < 114}
    encoder, _ = bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for k in want:
        assert got[k]["ids"] == encoder.encode_text(left[k]) and got[k]["n_tokens"] == len(got[k]["ids"])
        assert hashlib.sha256(left[k].encode()).hexdigest() == got[k]["decoded_sha256"]


def test_stages_keep_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
