import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from keelson.llm import bpe, tokens

from .fixtures import documents, rows, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_library(reference):
    encoder, cached = bpe.coder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    cases = [t or "" for t in texts()]
    cases += ["".join(rng.choice(" \n\t a'sé1²٣日😀_-\x1c\x85") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in cases:
        want = reference.encode_ordinary(text)
        assert encoder.encode_text(text) == want
        assert np.frombuffer(cached(text), "<u4").tolist() == want
        assert encoder.decode(want) == text.encode()


def test_long_piece(reference):
    encoder, _ = bpe.coder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    piece = "".join(rng.choice("abcdefth") for _ in range(60_000))
    assert encoder.encode_piece(piece.encode()) == reference.encode_ordinary(piece)


def test_bpe_query_rows(spark, reference):
    data = [*rows(), (None, "x y"), (1, "x y"), (1, "x y")]
    got = sorted(map(tuple, bpe.digests(documents(spark, data), RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for key, text in data:
        ids = reference.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_encode_decode_frames(spark):
    docs = documents(spark)
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts())}


def test_codes_random_access():
    rng = np.random.default_rng(4)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        codes = tokens.Codes.from_bytes(b"zz" + tokens.Codes.encode(ids).to_bytes(), 2)
        assert np.array_equal(codes.decode(), ids)
        assert [codes[i] for i in range(n)] == ids.tolist()
        with pytest.raises(IndexError):
            codes[n]


@pytest.mark.parametrize("data", [rows(), [*rows(), (None, "x y"), (None, None)], [(5, "a")], []])
def test_token_files(spark, data, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted(map(tuple, tokens.read(tokens.write(documents(spark, data), path)).collect()), key=lambda r: r[1])
    want, at = [], 0
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None))
    for key, text in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    if any(k is None for k, _ in data):  # order of repeated ids: by codes
        assert [r[0] for r in got] == [r[0] for r in want] and sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
    else:
        assert got == want


def test_segments_split(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 50)
    keys, offsets, codes = tokens.unpack_segment(tokens.pack_segment([None, 4], [2, 3], np.array([1, 2, 300, 70_000, 5])))
    assert keys == [None, 4] and offsets.tolist() == [0, 2, 5] and codes[3] == 70_000


def test_library_cache_equals_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, cached = Tokenizer.from_file(path), tokens.Library(path)
    rng = random.Random(6)
    cases = [t or "" for t in texts()] + ["a <|endoftext|> b<|endoftext|>c", "x <|endoftext|>", "é <|endof 日本 text|>"]
    cases += ["".join(rng.choice(" \n\t a'sé1²٣日😀_-\x1c\x85") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in cached(cases)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in cases]


def test_library_is_asked_once_for_a_word(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, cached, asked = Tokenizer.from_file(path), tokens.Library(path), []
    encode_all = cached.encode_all
    monkeypatch.setattr(cached, "encode_all", lambda chunks: asked.extend(chunks) or encode_all(chunks))
    cases = [f"so thelyonré{mark} so" for mark in ("", ".", ",", ";", ":", "!", "?", "\nso", ".\nso")]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in cached(cases)] == [plain.encode(t).ids for t in cases]
    assert sum("thelyonré" in (c if isinstance(c, str) else c.decode()) for c in asked) == 1


@pytest.mark.parametrize("prefix", [False, True])
def test_breaks_equal_library(tmp_path, prefix):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.pre_tokenizer.add_prefix_space = prefix  # another pattern: no breaks within a text
    plain.save(str(tmp_path / "one.json"))
    cached, rng = tokens.Library(str(tmp_path / "one.json"), limit=500), random.Random(8)
    assert cached.words is not prefix
    signs = [*" \n\t\r .,;:!?'-_aZs1éç×÷ÿƻȿɏ日😀\x1c\x85\xa0\u1680\u2003\u2028\u3000\u0301", "\n ", " \n", "'s", "'ll", "the", " tion", "<|endoftext|>"]
    cases: list = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(20_000)] + [None, "", " ", "\n", ""]
    for lo in range(0, len(cases), 700):
        some = cases[lo : lo + 700]
        got = [np.frombuffer(x, cached.word).tolist() for x in cached.packed(pa.array(["skipped", *some])[1:]).to_pylist()]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in some]
    assert len(cached.known) <= 500 and cached.packed(pa.array([], pa.string())).to_pylist() == []


def test_pieces():
    batch = pa.record_batch({"doc_id": range(7), "text": ["a" * 5, None, "b" * 30, "", "é" * 5, "c", None]})
    for limit in (1, 10, 11, 30, 100):
        parts = list(tokens.pieces(batch, limit))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p[1].to_pylist()) <= limit for p in parts)
    assert list(tokens.pieces(batch[:0])) == []
