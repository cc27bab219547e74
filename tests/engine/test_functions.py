import hashlib
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import cron, digests, gf256, names, tags
from keelson.functions.time import civil, decayed, lease_state, remaining, sweep_due
from keelson.operators import merkle


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_tags(spark):
    rows = [
        (1, [(0, b"\0\0\x03\xe9"), (0, b"\0\0\0\1")], 7, 1001, None, None),
        (2, [(0, b"\1"), (0, b"")], 7, 0, None, None),
        (3, [(65538, b"p"), (65538, b"q"), (65537, b"xx"), (65537, b"\0\0\0\x05")], 7, 7, b"p", 5),
        (4, None, 0, 1, None, None),
        (5, [(65537, b"\0\0\0\0\x6b\x49\xd2\0")], 0, 1, None, 1_800_000_000),
    ]
    df = spark.createDataFrame([(a, b, c) for a, b, c, *_ in rows], "id int, tags array<struct<tag_type:bigint,tag_value:binary>>, header_tag long")
    got = df.select("id", tags.kind(F.col("tags"), F.col("header_tag")).alias("k"), tags.parameter(F.col("tags")).alias("d"), tags.expiration(F.col("tags")).alias("e")).collect()
    assert [(r.id, r.k, None if r.d is None else bytes(r.d), r.e) for r in got] == [(a, k, d, e) for a, _, _, k, d, e in rows]


def test_time(spark):
    now = 10_000_000
    got = one(
        spark, **{f"d{i}": F.round(decayed(F.lit(1.0), F.lit(now - i * 86400), now), 6) for i in (0, 30, 60)}, future=decayed(F.lit(1.5), F.lit(now + 1), now),
        **{f"s{i}": lease_state(F.lit(now - i), now) for i in (0, 1, 14 * 86400, 14 * 86400 + 1)}, c=civil(F.lit(1791331200)), z=civil(F.lit(0)),
        due=sweep_due(F.lit(0), F.lit(5), F.lit(False), 5), left=remaining(F.lit(0), F.lit(5), 9),
    )
    assert (got.d0, got.d30, got.d60, got.future) == (1, 0.5, 0.25, 1.5)
    assert (got.s0, got.s1, got["s1209600"], got["s1209601"]) == ("Active", "Grace", "Grace", "Expired")
    assert (got.c.weekday, got.c.day, got.c.month) == (3, 7, 10) and (got.z.weekday, got.z.hour) == (4, 0)
    assert got.due and got.left == 0


@pytest.mark.parametrize("bad", ["", "* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "a * * * *", "* * 0 * *", "* * * 13 *", "* * * * 8", "1,,2 * * * *", "5/2 * * * *", "1-2-3 * * * *"])
def test_cron_refuses(bad):
    with pytest.raises(ValueError):
        cron.Schedule.parse(bad)


def test_cron(spark):
    assert cron.Schedule.parse("*/20 1-5/2 1,15 * 0,7").masks == (1 | 1 << 20 | 1 << 40, 0b101010, 1 << 1 | 1 << 15, 0x1FFE, 1)
    five, ten = (list(map(F.lit, cron.Schedule.parse(f"*/{n} * * * *").masks)) for n in (5, 10))
    t = 1791374400
    got = one(
        spark, a=cron.latest_trigger(F.lit(t), F.lit(t + 60), five), b=cron.latest_trigger(F.lit(t), F.lit(t + 300), five), c=cron.latest_trigger(F.lit(t), F.lit(t + 86400), ten),
        d=cron.latest_trigger(F.lit(t), F.lit(t), five), e=cron.latest_trigger(F.lit(0), F.lit(59), five),
        f=cron.latest_trigger(F.lit(t - 86400 * 30), F.lit(t), list(map(F.lit, cron.Schedule.parse("0 0 20 9 *").masks))),
    )
    assert tuple(got) == (None, t + 300, t + 86400, None, None, None)


def test_names(spark):
    cases = {" Ab-1.Zone ": "ab-1.zone", "a.b.zone": "a.b.zone", "-a.zone": None, "a-.zone": None, ".zone": None, "a..zone": None, "a_b.zone": None, "x" * 63 + ".zone": "x" * 63 + ".zone", "x" * 64 + ".zone": None, "a.zon": None}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    rows = df.select("n", names.canonical_name(F.col("n"), ".zone").alias("c"), names.name_problem(F.col("n"), ".zone").alias("p")).collect()
    assert {r.n: r.c for r in rows} == cases and all((r.p is None) == (r.c is not None) for r in rows)
    got = one(spark, a=names.ipv4_of(F.lit("/ip4/10.0.0.1/udp/1")), b=names.ipv4_of(F.lit("10.0.0.256")), c=names.ipv6_of(F.lit("/ip6/FE80::1/tcp/2")), d=names.ipv6_of(F.lit("10.0.0.1")),
              j=names.job_of_task(F.lit("cron-my-job-60")), k=names.job_of_task(F.lit("x")), t=names.cron_task_id(F.lit("j"), F.lit(60)))
    assert tuple(got) == ("10.0.0.1", None, "fe80::1", None, "my-job", None, "cron-j-60")
    data = hashlib.sha3_256(b"k").digest()
    text = names.bech32("ab", data)
    assert names.from_bech32("ab", text) == data and names.from_bech32("ab", text[:-1] + ("q" if text[-1] != "q" else "p")) is None
    assert names.bech32("a", b"") == "a12uel5l"  # vector of BIP 173


def test_digests(spark):
    sha = lambda b: hashlib.sha3_256(b).digest()
    got = one(
        spark, s=digests.sha3(F.lit(b"ab")), n=digests.sha3(F.lit(None).cast("binary")), i=digests.canonical_id(*[F.lit(x) for x in (b"m", b"h", b"s", b"r", b"p")], F.lit(5), F.lit(258)),
        b=digests.sampled_block(F.lit(b"\1" * 32), F.lit(3)), a=digests.addresses(b"D", F.lit(b"\2" * 32)),
        r=digests.record_digest(b"R", F.lit("x.y"), F.lit(b"o"), F.lit(b"t"), F.array(F.lit("p"), F.lit("qq")), F.lit(9), F.lit(True), F.lit(7), F.lit(b"")),
        z=digests.leading_zero_bits(F.lit(b"\0\x1f")), z0=digests.leading_zero_bits(F.lit(b"\0\0")),
    )
    assert bytes(got.s) == sha(b"ab") and got.n is None
    assert bytes(got.i) == sha(b"mhsrp" + (5).to_bytes(8, "big") + (258).to_bytes(8, "big"))
    assert got.b == int.from_bytes(sha(b"\1" * 32 + b"\0\0\0\3")[:8], "big") % 256
    h = sha(b"D" + b"\2" * 32)
    assert got.a.ipv6 == "fd00" + h[:14].hex() and got.a.ipv4 == (100 << 24 | 64 << 16 | int.from_bytes(h[14:17], "big") & 0x3FFFFF)
    u4 = lambda n: n.to_bytes(4, "big")
    assert bytes(got.r) == sha(b"R" + u4(3) + b"x.y" + b"ot" + u4(2) + u4(1) + b"p" + u4(2) + b"qq" + (9).to_bytes(8, "big") + b"\1" + (7).to_bytes(8, "big") + u4(0))
    assert (got.z, got.z0) == (11, 16)
    assert digests.checksum16(bytes.fromhex("45000073000040004011b861c0a80001c0a800c7")) == 0
    for n in range(1, 9):
        leaves = [sha(bytes([i])) for i in range(n)]
        for i in range(n):
            assert digests.path_root(leaves[i], digests.merkle_path(leaves, i)) == digests.merkle_root(leaves)
    assert digests.merkle_root([]) == sha(b"") and digests.merkle_root([b"x"]) == b"x"
    a, b, c = (sha(x) for x in (b"a", b"b", b"c"))
    assert digests.merkle_root([a, b, c]) == sha(sha(a + b) + c)


def test_erasure_code():
    code = gf256.Code()
    for n in (1, 2, 7, 9, 10, 11, 64, 1024, 65536):
        data = os.urandom(n)
        shards = list(enumerate(code.encode(data)))
        assert code.decode(random.Random(n).sample(shards, 10), n) == data
    data = os.urandom(1234)
    shards = list(enumerate(code.encode(data)))
    for lost in random.Random(1).sample(list(itertools.combinations(range(14), 4)), 150):
        assert code.decode([s for s in shards if s[0] not in lost], 1234) == data
    for bad in (shards[:9], shards[:10] + [shards[0]], [*shards[:9], (14, shards[0][1])], [*shards[:9], (9, b"")]):
        with pytest.raises(ValueError):
            code.decode(bad, 1234)
    with pytest.raises(ValueError):
        code.encode(b"")
    a = np.arange(1, 256)
    assert (gf256.TIMES[a, gf256.INVERSE[a]] == 1).all() and gf256.TIMES[2, 0x80] == 0x1D


def test_search_tree():
    rng = random.Random(4)
    entries = sorted((b"key%d" % i, rng.randbytes(32), i, i % 7 == 0) for i in range(2000))
    root, height = merkle.search_tree_root(entries)
    assert 2 <= height <= 8 and merkle.search_tree_root(entries)[0] == root
    assert merkle.search_tree_root(entries[:-1])[0] != root and merkle.search_tree_root([]) == (bytes(32), 0)
    key = next(k for k in (b"a%d" % i for i in range(100)) if digests.level_of(k) == 0)
    want = hashlib.sha3_256((0).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes(32) + len(key).to_bytes(4, "big") + key + b"i" * 32 + (5).to_bytes(8, "big") + b"\1" + bytes(32)).digest()
    assert merkle.search_tree_root([(key, b"i" * 32, 5, True)]) == (want, 1)


def test_trie_proofs():
    names_ = sorted([b"a.zone", b"ab.zone", b"abc.zone", b"b.zone", b"ba.zone", b"a.zone.x"])
    digest = {n: hashlib.sha3_256(n).digest() for n in names_}
    tree = merkle.trie([(n, digest[n]) for n in names_])
    for n in names_:
        proof = merkle.trie_proof(tree, n, b"T")
        assert proof[-1][1] == digest[n] and merkle.trie_proof_root(proof, b"T") == tree.digest(b"T")
    assert merkle.trie_proof(tree, b"ab.zon", b"T") is None and merkle.trie_proof(tree, b"zz", b"T") is None
    assert merkle.trie([]).digest(b"T") == hashlib.sha3_256(b"T\0\0\0\0\0").digest()
