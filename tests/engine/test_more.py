import hashlib

import pytest
from pyspark.sql import functions as F

from keelson.operators import leases, triggers
from keelson.sources import packets, records


def test_packets(spark):
    v4 = bytes([0x46, 0]) + bytes(7) + bytes([6]) + bytes(14) + (1234).to_bytes(2, "big") + (80).to_bytes(2, "big")
    v6 = bytes([0x60]) + bytes(5) + bytes([17]) + bytes(33) + b"\0\1\0\x35"
    cases = [(v4, (6, 80)), (v6, (17, 53)), (v6[:42], (17, None)), (v4[:19], None), (b"", None), (b"\x10" * 60, None), (bytes([0x60]) + bytes(5) + bytes([58]) + bytes(60), (58, None))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, p binary")
    assert [None if r.x is None else tuple(r.x) for r in df.select("i", packets.packet_info(F.col("p")).alias("x")).orderBy("i").collect()] == [w for _, w in cases]


def test_dns(spark):
    head = bytes.fromhex("abcd8583000100020003000f")
    got = spark.range(1).select(packets.dns_header(F.lit(head)).alias("h"), packets.dns_header(F.lit(head[:11])).alias("n"), packets.name_bytes(F.lit("a.bc")).alias("b")).first()
    assert tuple(got.h) == (0xABCD, True, 0, True, False, True, True, 3, 1, 2, 3, 15) and got.n is None and bytes(got.b) == b"\1a\2bc\0"
    one = bytes(4) + b"\0\2" + bytes(6)
    good = one + b"\1A\2bc\0" + b"\0\1\0\1" + b"\1x\xc0\x0e" + b"\0\x10\0\1"
    loop = bytes(4) + b"\0\1" + bytes(6) + b"\xc0\x0c" + b"\0\1\0\1"
    df = spark.createDataFrame([(1, good), (2, loop), (3, b""), (4, None), (5, good[:-1])], "i int, message binary")
    found = {r.i: r for r in packets.questions(df).collect()}
    assert [(q["name"], q["type"]) for q in found[1].questions] == [("a.bc", 1), ("x.bc", 16)]
    assert all(found[i].error and not found[i].questions for i in (2, 3, 4, 5))


def test_records(spark):
    want = {"magic": b"MAGI", "header": b"", "sender_id": b"s" * 32, "recipient_id": b"", "payload": b"p" * 300, "signature": b"", "core_tag_mask": (1 << 64) - 1, "timestamp": 5,
            "tags": [{"tag_type": 0, "tag_value": b"\0\0\0\1"}, {"tag_type": 65537, "tag_value": b""}]}
    raw = records.build(want)
    assert records.parse(raw, b"MAGI") == want
    df = spark.createDataFrame([(raw,), (raw[:-3] + b"\xff",), (records.build(want | {"magic": b"NOPE"}),), (None,)], "body binary")
    rows = records.decoded(df, b"MAGI").collect()
    assert int(rows[0].core_tag_mask) == (1 << 64) - 1 and rows[0].tags[0].tag_type == 0 and rows[0].error is None and all(r.error for r in rows[1:])
    head = records.header_bytes(7, 1, 2, 300, 9, b"a" * 16, b"b" * 16, (1 << 64) - 2)
    got = spark.range(1).select(records.header_fields(F.lit(head)).alias("h"), records.header_valid(F.lit(head), 7).alias("ok"), records.header_fields(F.lit(b"x")).alias("n")).first()
    assert (got.h.magic, got.h.version, got.h.envelope_len, got.h.fast_tag, bytes(got.h.sender_key_id), int(got.h.sequence_nonce)) == (7, 1, 300, 9, b"a" * 16, (1 << 64) - 2) and got.ok and got.n is None


def test_triggers(spark):
    cron = triggers.cron_tasks(spark.createDataFrame([("j", 60, "w", b"d")], "job_id string, trigger long, worker_id string, data binary"))
    env = triggers.record_tasks(spark.createDataFrame([(3, None, b"r", 7, 1), (4, None, b"r", 7, 2), (0, "x", b"r", 7, 3)], "mask long, target string, record binary, timestamp long, seq long"), spark.createDataFrame([(1, "a"), (2, "b")], "mask long, worker_id string"), 99)
    man = triggers.manual_tasks(spark.createDataFrame([(None, "w", b"", 5), ("own", "w", b"", 6)], "invocation_id string, worker_id string, data binary, seq long"), 99)
    assert sorted(r.task_id for r in triggers.tasks(cron, env, man, cron).collect()) == ["cron-j-60", "env-a-7-1", "env-b-7-1", "env-x-7-3", "manual-w-5", "own"]
    modes = triggers.route_modes(spark.createDataFrame([(1, "Direct"), (2, "Direct")], "peer long, mode string"), spark.createDataFrame([(1, 0, "recovered"), (1, 1, "failed")], "peer long, seq long, event string"))
    assert sorted(map(tuple, modes.collect())) == [(1, "Relay"), (2, "Direct")]
    reg = triggers.Registry()
    reg.register("w", b"code", hashlib.sha3_256(b"code").digest(), ["* * * * *"], [3, 0])
    assert reg.jobs == [("w-0", "* * * * *", None)] and reg.routes == [(3, "w")]
    with pytest.raises(ValueError):
        reg.register("w", b"code", b"no")


def test_claims(spark):
    now = 1000
    base = {"magic_ok": True, "header_ok": True, "kind": 0x30000002, "fqdn": "A.zone", "nonce": 1, "contract": "c", "pow_hash": bytes(32), "expires_at": now + 5, "sig_ok": True, "sender_key": b"k", "timestamp": 9, "payload": b"p" * 32 + b"\0\0\0\2[]" + b"key"}
    schema = "magic_ok boolean, header_ok boolean, kind long, fqdn string, nonce long, contract string, pow_hash binary, expires_at long, sig_ok boolean, sender_key binary, timestamp long, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    bad = [{"magic_ok": False, "sig_ok": False}, {"header_ok": False}, {"kind": 1}, {"nonce": None}, {"fqdn": "a.zonk"}, {"pow_hash": b"\0\1" + bytes(30)}, {"expires_at": now}, {"contract": "d"}, {"sig_ok": False}]
    df = spark.createDataFrame([tuple((base | b)[n] for n in names) for b in [{}, *bad]], schema)
    good, rest = triggers.claims_to_leases(leases.escrowed(df, spark.createDataFrame([("c",)], "contract string")), now, ".zone")
    assert [(r.fqdn, bytes(r.key), r.addrs) for r in good.collect()] == [("a.zone", b"key", [])]
    assert sorted(r.problem for r in rest.collect()) == sorted(["magic", "header", "kind", "tags", "name", "proof of work", "lease", "escrow", "signature"])


def test_resolution(spark):
    q = spark.createDataFrame([(1, "A.zone"), (2, "a.zone"), (1, "k.zone"), (1, "none.zone"), (1, "g.zone"), (1, "old.zone")], "caller long, fqdn string")
    derived = spark.createDataFrame([("k.zone", "D")], "fqdn string, target string")
    over = spark.createDataFrame([(1, "a.ZONE", "O"), (1, "k.zone", "O")], "owner long, domain string, target string")
    pub = spark.createDataFrame([("a.zone", "P", 2000), ("g.zone", "G", 999), ("old.zone", "X", 1000 - 15 * 86400)], "fqdn string, target string, expires_at long")
    got = {(r.caller, r.fqdn): (r.target, r.tier, r.in_grace) for r in leases.resolve(q, derived, over, pub, 1000).collect()}
    assert got == {(1, "A.zone"): ("O", "overlay", None), (2, "a.zone"): ("P", "public", False), (1, "k.zone"): ("D", "derived", None), (1, "none.zone"): (None, None, None), (1, "g.zone"): ("G", "public", True), (1, "old.zone"): (None, None, None)}
    code = lambda **k: leases.response_code(*[F.lit(k.get(n, d)) for n, d in (("response", False), ("opcode", 0), ("questions", 1), ("inside", True), ("grace", False), ("hit", True), ("failed", False), ("upstream", False))])
    got = spark.range(1).select(*[code(**k).alias(f"c{i}") for i, k in enumerate([{"response": True}, {"opcode": 2}, {"questions": 0}, {}, {"grace": True}, {"hit": False}, {"failed": True}, {"inside": False}, {"inside": False, "upstream": True}])]).first()
    assert tuple(got) == (None, "NOTIMP", "FORMERR", "NOERROR", "NXDOMAIN", "NXDOMAIN", "SERVFAIL", "REFUSED", "FORWARD")
