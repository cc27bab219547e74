import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import blobs, clock, custody, dispatch, leases, merkle, queue, replica, retention, rules, trust, workers
from keelson.sources import frames, tables

NOW = 1_700_000_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    "kind,mask,tag,want",
    [(20001, 0, None, 0), (1, 32, None, 0), (8, 0, None, 0), (9, 0, None, 0), (1001, 0, (65537, b"\x6b\x49\xd2\0"), 4), (1001, 0, (65538, b"d"), 3), (30005, 0, None, 3),
     (40001, 0, None, 5), (0, 0, None, 2), (10001, 0, None, 2), (1, 0, None, 1), (0x10000003, 0, None, 1), (11, 0, None, 1), (10, 0, None, 3), (0x30000002, 0, (4, b"x"), 5)],
)
def test_classes(spark, kind, mask, tag, want):
    tags = [(0, kind.to_bytes(4, "big"))] + [tag] * (tag is not None)
    df = spark.createDataFrame([(tags, 0, mask)], "tags array<struct<tag_type:bigint,tag_value:binary>>, header_tag bigint, core_tag_mask bigint")
    assert retention.classified(df).first()["class"] == want


def test_last_write_wins(spark):
    df = spark.createDataFrame([("k", 100, 1, 0), ("k", 200, 1, 1), ("k", 50, 9, 2), ("k", 300, 5, 3), ("k", 300, 4, 4), ("k", 300, 6, 5), ("q", 1, 1, 6)], "key string, ts long, id long, seq long")
    got = [r.outcome for r in retention.arrivals(df, ["key"], "ts", "id", "seq").orderBy("seq").collect()]
    assert got == ["Stored", "Replaced", "SupersededLww", "Replaced", "SupersededLww", "Replaced", "Stored"]
    assert rows(retention.latest(df, ["key"], "ts", "id")) == [("k", 300, 6, 5), ("q", 1, 1, 6)]


def test_store(spark):
    schema = "id long, sender_key string, kind long, param_d binary, expires_at long, class int, timestamp long"
    df = spark.createDataFrame([(1, "s", 1, None, None, 1, 5), (2, "s", 10001, None, None, 2, 5), (3, "s", 10001, None, None, 2, 6), (4, "s", 30001, b"a", None, 3, 1), (5, "s", 30001, b"b", None, 3, 1), (6, "s", 7, None, 100, 4, 1), (7, "s", 40001, None, None, 5, 1), (8, "s", 8, None, None, 0, 1)], schema)
    views = retention.store(df)
    assert {c: sorted(r.id for r in v.collect()) for c, v in views.items()} == {1: [1], 2: [3], 3: [4, 5], 4: [6], 5: [7]}
    assert retention.by_id(views, F.lit(6), 99).count() == 1 and retention.by_id(views, F.lit(6), 100).count() == 0
    gone = retention.delete(views, spark.createDataFrame([(3,), (77,)], "id long"))
    assert gone[2].count() == 0 and gone[1].count() == 1
    with pytest.raises(ValueError):
        retention.delete(views, spark.createDataFrame([(7,)], "id long"))
    assert rows(retention.write_once(views[5], df.where("id in (7, 1)")).select("id", "outcome")) == [(1, "Stored"), (7, "IdempotentDuplicate")]


def test_replicas(spark):
    schema = "key string, envelope_id long, ts long, is_tombstone boolean"
    local = spark.createDataFrame([("key1", 1, 200, False), ("key2", 2, 100, False), ("key3", 20, 150, False), ("key4", 10, 150, False), ("key5", 5, 500, False), ("user", 99, 250, True), ("same", 1, 1, True), ("mine", 1, 1, False)], schema)
    remote = spark.createDataFrame([("key1", 1, 100, False), ("key2", 2, 200, False), ("key3", 10, 150, False), ("key4", 20, 150, False), ("key5", 5, 500, False), ("user", 99, 200, False), ("same", 1, 1, False), ("theirs", 1, 1, False)], schema)
    assert rows(replica.diff(local, remote, ["key"])) == [("key1", "send"), ("key2", "fetch"), ("key3", "send"), ("key4", "fetch"), ("mine", "send"), ("same", "send"), ("theirs", "fetch"), ("user", "send")]
    assert replica.merge(local, remote, ["key"]).count() == 9
    with pytest.raises(ValueError):
        replica.checked_merge(local, remote, F.col("ts") > 1, ["key"])
    found = replica.answer(local, spark.createDataFrame([(1, "r"), (2, "s")], "id long, body string"), F.lit("key1"), F.lit("key2"))
    assert rows(found) == [(1, "r"), (2, "s")]
    index = local.withColumn("ns", F.lit("n")).withColumn("key", F.col("key").cast("binary")).withColumn("envelope_id", F.lpad(F.col("envelope_id").cast("string"), 32, "0").cast("binary"))
    a = merkle.search_tree_roots(index).first()
    b = merkle.search_tree_roots(index.orderBy(F.desc("key")).repartition(3)).first()
    assert a == b and a.height >= 1


def plain_rank(edges, root):
    dist, frontier = {root: 0}, [root]
    for d in range(1, 7):
        frontier = [v for v in {v for (u, v) in edges if u in frontier} if v not in dist]
        dist |= dict.fromkeys(frontier, d)
    out = {u: {v: w for (a, v), w in edges.items() if a == u and v in dist} for u in dist}
    p = {n: float(n == root) for n in dist}
    for _ in range(50):
        q, leak = dict.fromkeys(dist, 0.0), 0.0
        for u in dist:
            total = max(sum(out[u].values()), 1.0)
            for v, w in out[u].items():
                q[v] += 0.85 * p[u] * w / total
            leak += 0.85 * p[u] * max(0.0, 1 - sum(out[u].values()) / total)
        q[root] += 0.15 + leak
        change = max(abs(q[n] - p[n]) for n in dist)
        p = q
        if change < 1e-5:
            break
    return {n: (dist[n], min(max(p[n] / p[root], 0), 1)) for n in dist}


def test_trust(spark):
    rng = random.Random(5)
    edges = {(0, 1): 0.95, (1, 2): 0.8, (0, 3): 0.1} | {(u, v): 1.0 for u in range(3, 9) for v in range(3, 9) if u != v} | {(rng.randrange(20, 40), rng.randrange(20, 40)): 0.5 for _ in range(30)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    got = {r.node: (r.distance, r.score) for r in trust.rank(df, F.lit(0)).collect()}
    want = plain_rank(edges, 0)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    ranked = spark.createDataFrame([(k, *v) for k, v in got.items()], "node long, distance int, score double")
    tiers = {r.target: r for r in trust.evaluate(spark.createDataFrame([(0,), (1,), (2,), (4,), (99,)], "target long"), ranked, F.lit(0)).collect()}
    assert tiers[0].tier == "CorePeer" and tiers[99].tier == "Untrusted" and tiers[99].distance is None and tiers[1].score >= 0.5 and tiers[4].tier != "CorePeer"
    att = spark.createDataFrame([(0, 1, 1, 0.8, 0, 10, True), (0, 2, 2, 0.8, 0, NOW + 9, True), (0, 3, 4, 0.8, 0, NOW + 9, True), (0, 4, 2, 2.0, 0, NOW + 9, True)], "issuer_id long, subject_id long, capability_scopes int, score_weight double, issued_at long, expires_at long, sig_ok boolean").withColumn("arrival_seq", F.col("subject_id"))
    rev = spark.createDataFrame([(0, 3, 5, 0, "a", True), (0, 3, 5, 1, "b", True)], "issuer_id long, subject_id long, revoked_at long, arrival_seq long, reason string, sig_ok boolean")
    assert [r.subject_id for r in trust.valid(att, rev, NOW).collect()] == [2] and trust.latest_revocations(rev).first().reason == "b"
    ev = spark.createDataFrame([(1, 0.6, 1, "Trusted"), (2, 0.3, 3, "Probationary"), (3, 0.2, 3, "Probationary"), (9, 0.9, 1, "CorePeer")], "target long, score double, distance int, tier string")
    assert {r.target: (r.vpn_allowed, r.storage_allowed, r.compute_allowed) for r in trust.admission(ev, att).collect()} == {1: (True, False, False), 2: (False, True, False), 3: (False, False, False), 9: (True, True, True)}
    assert rows(trust.pair_trust(spark.createDataFrame([(0, 1), (5, 5)], "issuer_id long, subject_id long"), att, 0)) == [(0, 1, 0.8), (5, 5, 0.0)]


def test_rules(spark):
    peers = spark.createDataFrame([(1, 100, 1), (2, 200, 3)], "id long, owner long, epoch long")
    table = spark.createDataFrame([(1, 2, "Tcp", 80, "Allow"), (2, None, "Tcp", 443, "Deny")], "rule_no int, source long, protocol string, dst_port int, action string")
    p = spark.createDataFrame([(1, 2, 3, 6, 80), (2, 2, 3, 6, 22), (3, 1, 1, 6, 443), (4, 1, 1, 6, 8080), (5, 2, 2, 6, 80), (6, 9, 1, 6, 80), (7, 1, 1, None, None)], "packet_id long, peer long, epoch long, proto int, dst_port int")
    judged = rules.ingress(p, peers, table, F.lit(100))
    assert {r.packet_id: (r.verdict, r.reason) for r in judged.collect()} == {
        1: ("Allow", "rule"), 2: ("Deny", "quarantine"), 3: ("Deny", "rule"), 4: ("Allow", "same owner"), 5: ("Deny", "revoked epoch"), 6: ("Deny", "unknown peer"), 7: ("Allow", "same owner")}
    assert tuple(rules.counters(judged).first()) == (3, 4, 2, 1)
    out = {r.packet_id: r.verdict for r in rules.egress(p, peers, table, F.lit(1), F.lit(100)).collect()}
    assert out[1] == "Deny" and out[5] == "Deny" and out[4] == "Allow"
    routed = rules.outbound(judged, peers.select(F.col("id").alias("peer")), spark.createDataFrame([(1, "Relay")], "peer long, mode string"), spark.createDataFrame([(8,), (5,)], "relay_id long"))
    assert {r.packet_id: r.route for r in routed.collect()} == {1: "Direct", 2: "Dropped", 3: "Dropped", 4: "Relay:5", 5: "Dropped", 6: "Dropped", 7: "Relay:5"}


def test_clock(spark):
    for values, want in (([10], 10), ([10, -4], 3), ([10, -4, 20], 10), ([-15, -4, 5, 10, 20], 5), ([-4, -3], -3), ([], 0)):
        assert clock.median_offset(spark.createDataFrame([(v,) for v in values], "offset long")).first()[0] == want
    data = [(k, e, s) for s, (k, e) in enumerate([(1, 0), (1, 0), (1, 1), (1, 2), (1, 3), (1, 5), (2, 4), (2, 6)])]
    got = clock.replay_batch(spark.createDataFrame(data, "id long, epoch long, seq long"))
    assert [r.accepted for r in got.orderBy("seq").collect()] == [True, False, False, True, False, True, True, True]
    seqs = spark.createDataFrame([("s", i, v) for i, v in enumerate([0, 0, 5, 5, 3, 6])], "k string, o long, v long")
    assert [r.accepted for r in clock.accepted(seqs, "k", "v", "o").orderBy("o").collect()] == [True, True, True, False, False, True]
    lam = spark.createDataFrame([("q", i, v) for i, v in enumerate([0, 0, 9, 0, 3, 0])], "queue string, seq long, lamport long")
    assert [r.clock for r in clock.lamport(lam).orderBy("seq").collect()] == [1, 2, 9, 10, 3, 11]


def test_leases(spark):
    day = 86400
    req = [("A.zone", 1, "register", 1, NOW + day, NOW), ("a.zone", 2, "register", 2, NOW + 9 * day, NOW + 5), ("a.zone", 3, "renew", 2, NOW + 9 * day, NOW + 5), ("a.zone", 4, "register", 2, NOW + 9 * day, NOW + 2 * day),
           ("a.zone", 5, "renew", 1, NOW + 9 * day, NOW + 2 * day), ("a.zone", 6, "renew", 1, NOW + 99 * day, NOW + 50 * day), ("a.zone", 7, "register", 2, NOW + 99 * day, NOW + 50 * day), ("b.zone", 8, "renew", 1, NOW + day, NOW),
           ("_.zone", 9, "register", 1, NOW + day, NOW), ("b.zone", 10, "register", 1, NOW + 400 * day, NOW)]
    df = spark.createDataFrame(req, "fqdn string, seq long, op string, owner long, expires_at long, at long")
    assert [r.outcome for r in leases.fold(df, ".zone").orderBy("seq").collect()] == ["Ok", "AlreadyActive", "Unauthorized", "GraceUnauthorized", "Ok", "Expired", "Ok", "NotRegistered", "BadName", "BadLease"]
    old = spark.createDataFrame([("a.zone", 1, NOW + 1)], "fqdn string, owner long, expires_at long")
    assert [r.outcome for r in leases.step(old, df.where("seq in (1, 2, 8)"), NOW, ".zone").orderBy("seq").collect()] == ["AlreadyActive", "AlreadyActive", "NotRegistered"]


def test_queue(spark):
    t = spark.createDataFrame([("x", 10, "a", 0), ("x", 15, "b", 1), ("x", 12, "c", 2), ("x", 15, "d", 3)], "id string, lamport long, payload string, seq long")
    assert queue.newest(t).first().payload == "b"
    ev = spark.createDataFrame([("x", i, e) for i, e in enumerate(["dispatch", "expire"] * 3)] + [("y", 0, "dispatch"), ("y", 1, "expire"), ("z", 0, "dispatch"), ("z", 1, "complete")], "id string, seq long, event string")
    assert rows(queue.folded(ev)) == [("x", "DeadLetter", 3), ("y", "Pending", 1), ("z", "Completed", 1)]
    got = queue.tick(queue.jobs(spark, [("a", "*/10 * * * *", NOW - 86400), ("b", "* * * * *", None)]), NOW)
    assert rows(got.select("id", "task_id", "last_run")) == [("a", f"cron-a-{NOW // 600 * 600}", NOW), ("b", None, NOW)]


def test_custody(spark):
    s = custody.staged(spark.createDataFrame([("a", 10), ("b", 26 << 20)], "blob_cid string, size long"), NOW)
    assert [r.blob_cid for r in s.collect()] == ["a"]
    done = custody.acknowledged(s, spark.createDataFrame([("a",)], "blob_cid string")).first()
    assert (done.state, done.shards, done.outcome) == ("Confirmed", [10, 11, 12, 13], "Confirmed")
    assert custody.pruned(s, NOW + 72 * 3600).first().state == "Expired" and custody.pruned(s, NOW + 72 * 3600 - 1).first().state == "Staged"
    keep = spark.createDataFrame([("a", i % 9) for i in range(20)] + [("b", i) for i in range(10)], "blob_cid string, keeper long")
    gates = custody.unlocked(keep, spark.createDataFrame([("c",)], "blob_cid string"))
    assert rows(gates) == [("a", 9, False), ("b", 10, True), ("c", 0, True)]
    t = spark.createDataFrame([(1, "p", 0, 5), (2, "p", 1, 6), (3, "q", 2, 900), (3, "r", 3, 900)], "session_id long, peer string, seq long, last_seen long")
    assert rows(custody.sessions(t)) == [(2, "p", 1, 6), (3, "r", 3, 900)] and custody.active_sessions(t, 1000).count() == 2


def test_blobs(spark):
    data = {1: b"x", 2: bytes(range(256)) * 300, 3: None, 4: b""}
    df = spark.createDataFrame(list(data.items()), "blob_id long, payload binary")
    shards = blobs.encode(df)
    assert shards.count() == 28
    back = {r.blob_id: bytes(r.payload) for r in blobs.decode(shards.where("shard_index % 4 <> 1")).collect()}
    assert back == {k: v for k, v in data.items() if v}
    assert {r.error for r in blobs.decode(shards.where("shard_index < 9")).collect()} == {"too few shards"}
    m = {r.blob_id: r for r in blobs.manifests(df, shards).collect()}
    assert bytes(m[1].cid) == hashlib.sha3_256(b"x").digest() and len(m[2].shard_roots) == 14
    audits = blobs.challenges(shards.where("blob_id = 2").select("blob_id", "shard_index", F.lit(b"s" * 32).alias("seed")))
    roots = shards.select("blob_id", "shard_index", blobs.shard_root(F.col("shard")).alias("root"))
    answers = blobs.respond(audits, shards)
    assert {r.verified for r in blobs.verify(answers, roots).collect()} == {True}
    assert {r.verified for r in blobs.verify(answers.withColumn("data", F.lit(b"no")), roots).collect()} == {False}


def test_dispatch_and_workers(spark):
    df = spark.createDataFrame([(6, 0), (1, 6), (0x30000002, 0), (0x2011, 0), (1, 0x2011), (1, 0x50000009), (9, 0), (11, 0), (1, 0)], "kind long, header_tag long")
    got = dispatch.dispatch(df).collect()
    assert [r.route for r in got] == ["sync", "sync", "names", "blobs", "store", "tasks", "packets", "trust", "store"] and [r.stored for r in got] == [False, False, True, True, True, True, False, True, True]

    def guest(payload, host):
        if payload == b"boom":
            raise ValueError
        if payload == b"big":
            host.emit(b"x" * (2 << 20))
        host.emit(host.get(b"k") + payload)
        return 0 if payload != b"no" else 3

    tasks = spark.createDataFrame([(p, p.encode()) for p in ("ok", "no", "boom", "big")], "task_id string, payload binary")
    out = {r.task_id: r for r in workers.execute(tasks, guest, NOW, {b"k": b"v"}).collect()}
    assert {k: r.status for k, r in out.items()} == {"ok": "Completed", "no": "Failed", "boom": "Trap", "big": "IoExhausted"}
    assert bytes(out["ok"].emitted[0]) == b"vok" and out["ok"].fuel_used == 5 and out["big"].fuel_used == workers.IO_FUEL


def test_sources(spark, tmp_path):
    good, bad = b"MAGI" + bytes(60) + b"body", [b"MAGI", b"XXXX" + bytes(70), b"MAGI" + bytes(64 * 1024 + 100)]
    df = spark.createDataFrame([(x,) for x in [good, *bad]], "frame binary")
    ok, rest = frames.split(df, b"MAGI")
    assert bytes(ok.first().body) == b"body" and sorted(r.problem for r in rest.collect()) == ["magic", "short", "size"]
    head = spark.range(1).select(frames.field(F.lit(b"\1\2\3\0"), 1, 2).alias("f"), frames.claim_payload(F.lit(b"p" * 32 + b"\0\0\0\7" + b'["a/b"]' + b"key")).alias("c"), frames.claim_payload(F.lit(b"p" * 32 + b"\0\0\0\1" + b"{")).alias("d")).first()
    assert head.f == 0x0302 and head.c.addrs == ["a/b"] and bytes(head.c.key) == b"key" and head.d.addrs == []
    up = spark.createDataFrame([("c", 1, "Missing", 0), ("c", 1, "Present", 1), ("c", 0, "Present", 2), ("d", 0, "Present", 3)], "blob_cid string, shard_index int, state string, seq long")
    tables.append(up, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert [(r.shard_index, r.state) for r in tables.shard_states(back, "c").collect()] == [(0, "Present"), (1, "Present")]
    sh = spark.createDataFrame([(b"a", hashlib.sha3_256(b"a").digest()), (b"b", b"no")], "data binary, hash binary")
    assert [bytes(r.data) for r in tables.intact(sh).collect()] == [b"a"]
