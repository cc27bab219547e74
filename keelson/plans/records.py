"""More queries over the driver's tables: records, leases, queues, custody, routes and trust, each with its SQL.

Flags that the tables don't have are derived from keys by fixed rules, over every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import names, tags
from keelson.functions.time import epoch, network_time, remaining
from keelson.operators import blobs, clock, custody, leases, queue, replica, retention, rules, trust

from .queries import JOBS, KIND_SQL, MINUTES_SQL, ODATE, PACKETS_SQL, PEERS, RULES_SQL, SHIP, S, events, kinds, packets, peers, query, read, rule_table


def every(column: str, n: int, rest: int = 0):
    return F.col(column) % n == rest


@query(f"""SELECT event_id, CASE WHEN event_id % 12 = 8 THEN CASE WHEN event_id % 5 <> 0 THEN event_id % 5 ELSE 1 END WHEN event_id % 4 <> 0 THEN event_id % 5000
  WHEN event_id % 6 = 0 THEN 0 ELSE 77 END AS kind, {S} AS expires_at, event_type AS parameter FROM events""")
def record_tags(spark, sf_dir):
    """The first usable tags of records that also hold unusable ones, or none."""
    four = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    tag = lambda kind, value: F.struct(F.lit(kind).cast("bigint").alias("tag_type"), value.alias("tag_value"))
    first = F.when(every("event_id", 4), F.unhex(F.lit("010203"))).otherwise(four(F.col("event_id") % 5000))
    second = F.when(every("event_id", 6), F.unhex(F.lit(""))).otherwise(four(F.lit(77)))
    others = F.array(tag(tags.EXPIRATION_TAG, F.unhex(F.lit("01"))), tag(tags.EXPIRATION_TAG, F.unhex(F.lpad(F.hex("s"), 16, "0"))), tag(tags.PARAMETER_TAG, F.col("event_type").cast("binary")))
    listed = F.when(every("event_id", 12, 8), others).otherwise(F.concat(F.array(tag(0, first), tag(0, second)), others))
    rows = events(spark, sf_dir).withColumn("tags", listed)
    return rows.select("event_id", tags.kind(F.col("tags"), F.col("event_id") % 5).alias("kind"), tags.expiration(F.col("tags")).alias("expires_at"), tags.parameter(F.col("tags")).cast("string").alias("parameter"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN lower(lpad(hex(event_id), 32, '0')) WHEN 1 THEN substr(sha256(CAST(event_id AS VARCHAR)), 1, 32) ELSE repeat('0', 32) END AS sender FROM events""")
def sender_keys(spark, sf_dir):
    header = F.when(every("event_id", 3), F.unhex(F.lpad(F.hex("event_id"), 32, "0")))
    sender = F.when(every("event_id", 3, 1), F.unhex(F.sha2(F.col("event_id").cast("string"), 256))).otherwise(F.unhex(F.lit("0102")))
    return read(spark, sf_dir, "events").select("event_id", F.lower(F.hex(tags.sender_key(header, sender))).alias("sender"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'magic' WHEN o_orderkey % 19 = 0 THEN 'header' WHEN o_orderkey % 23 = 0 THEN 'kind' WHEN o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 THEN 'tags'
  WHEN o_orderkey % 53 = 0 THEN 'hyphen-name' WHEN o_orderkey % 37 = 0 THEN 'proof of work' WHEN o_orderkey % 400 NOT BETWEEN 1 AND 365 THEN 'lease' WHEN o_orderkey % 41 = 0 OR o_orderkey % 43 = 0 THEN 'escrow'
  WHEN o_orderkey % 47 = 0 THEN 'signature' END AS problem FROM orders""")
def claim_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 29 != 0, F.concat(F.when(k % 53 == 0, "-bad").otherwise("order"), k.cast("string"), F.lit(".zone")))
    claims = read(spark, sf_dir, "orders").select(
        k, (k % 17 != 0).alias("magic_ok"), (k % 19 != 0).alias("header_ok"), F.when(k % 23 == 0, 1).otherwise(leases.CLAIM_KIND).alias("kind"), name.alias("fqdn"), F.lit(1).alias("nonce"),
        (F.lit(1_000_000) + k % 400 * 86400).alias("expires_at"), F.when(k % 31 != 0, "c").alias("contract"), F.when(k % 37 == 0, F.unhex(F.lit("0001ff"))).otherwise(F.unhex(F.lit("0000ff"))).alias("pow_hash"),
        F.when(k % 43 != 0, k % 41 != 0).alias("escrow_ok"), (k % 47 != 0).alias("sig_ok"))
    problem = leases.claim_problem(1_000_000, ".zone")
    return claims.select("o_orderkey", F.when(problem == "name", "hyphen-name").otherwise(problem).alias("problem"))


@query("""WITH a AS (SELECT l_suppkey AS target, CASE WHEN l_quantity = 50 AND l_linenumber >= 4 THEN l_linenumber ELSE 0 END AS scopes FROM lineitem),
 f AS (SELECT target, bool_or(scopes & 1 = 1) AS relay, bool_or(scopes & 2 = 2) AS storage, bool_or(scopes & 4 = 4) AS compute FROM a GROUP BY 1),
 s AS (SELECT s_suppkey AS target, s_suppkey % 101 / 100.0 AS score, s_suppkey % 6 AS d FROM supplier),
 t AS (SELECT *, CASE WHEN score >= 0.85 AND d <= 1 THEN 'CorePeer' WHEN score >= 0.5 AND d <= 2 THEN 'Trusted' WHEN score >= 0.15 AND d <= 4 THEN 'Probationary' ELSE 'Untrusted' END AS tier FROM s)
 SELECT t.target, tier, tier = 'CorePeer' OR tier = 'Trusted' AND coalesce(relay, false) AS vpn_allowed,
  tier = 'CorePeer' OR coalesce(storage, false) AND (tier = 'Trusted' OR tier = 'Probationary' AND score >= 0.25) AS storage_allowed,
  tier = 'CorePeer' OR tier = 'Trusted' AND coalesce(compute, false) AS compute_allowed FROM t LEFT JOIN f ON f.target = t.target""")
def admission_rules(spark, sf_dir):
    scopes = F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") >= 4), F.col("l_linenumber")).otherwise(0)
    granted = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject_id"), scopes.alias("capability_scopes"))
    score, distance = F.col("s_suppkey") % 101 / 100, F.col("s_suppkey") % 6
    evaluated = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), score.alias("score"), distance.alias("distance"), trust.tier(score, distance).alias("tier"))
    return trust.admission(evaluated, granted).select("target", "tier", "vpn_allowed", "storage_allowed", "compute_allowed")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'NOTIMP' WHEN event_id % 11 = 0 THEN 'FORMERR' WHEN event_id % 2 = 0 THEN
  CASE WHEN event_id % 17 = 0 THEN 'SERVFAIL' WHEN event_id % 13 = 0 THEN 'NXDOMAIN' WHEN event_id % 3 <> 0 THEN 'NOERROR' ELSE 'NXDOMAIN' END WHEN event_id % 4 = 1 THEN 'FORWARD' ELSE 'REFUSED' END AS code FROM events""")
def resolver_codes(spark, sf_dir):
    e = F.col("event_id")
    code = leases.response_code(e % 7 == 0, F.when(e % 5 == 0, 1).otherwise(0), e % 11, e % 2 == 0, e % 13 == 0, e % 3 != 0, e % 17 == 0, e % 4 == 1)
    return read(spark, sf_dir, "events").select("event_id", code.alias("code"))


@query("""SELECT p_partkey AS blob_cid, CASE WHEN p_partkey % 3 = 0 THEN 'Confirmed' WHEN 600000 >= p_partkey * 100 + 259200 THEN 'Expired' ELSE 'Staged' END AS state,
  CASE WHEN p_partkey % 3 = 0 OR 600000 >= p_partkey * 100 + 259200 THEN 4 ELSE 14 END AS n_shards, CASE WHEN p_partkey % 3 = 0 THEN 'Confirmed' END AS outcome FROM part WHERE p_size * 1000000 < 26214400""")
def custody_states(spark, sf_dir):
    """Blobs below the limit are staged, some acknowledged, the others expire in time."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob_cid"), (F.col("p_size") * 1_000_000).alias("size"))
    held = custody.acknowledged(custody.staged(parts, F.col("blob_cid") * 100), parts.where("blob_cid % 3 = 0"))
    return custody.pruned(held, 600_000).select("blob_cid", "state", F.size("shards").alias("n_shards"), "outcome")


@query(f"""WITH e AS (SELECT user_id % 40 AS session_id, event_id % 60 AS peer, event_id AS seq, {S} AS last_seen FROM events), m AS (SELECT max(last_seen) AS now FROM e),
 i AS (SELECT session_id, max(seq) AS seq FROM e GROUP BY 1), p AS (SELECT peer, max(seq) AS seq FROM e GROUP BY 1)
 SELECT e.session_id, e.peer, e.seq FROM e JOIN i USING (session_id, seq) JOIN p ON p.peer = e.peer AND p.seq = e.seq, m WHERE now - last_seen <= 180000""")
def live_sessions(spark, sf_dir):
    inserts = events(spark, sf_dir).select((F.col("user_id") % 40).alias("session_id"), (F.col("event_id") % 60).alias("peer"), F.col("event_id").alias("seq"), F.col("s").alias("last_seen"))
    now = inserts.agg(F.max("last_seen").alias("now"))
    return custody.active_sessions(custody.sessions(inserts).crossJoin(F.broadcast(now)), F.col("now"), 180_000).select("session_id", "peer", "seq")


@query("""SELECT l_orderkey, l_linenumber, l_partkey AS envelope_id, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <> 7) p ON l_partkey = p_partkey""")
def index_lookup(spark, sf_dir):
    index = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("envelope_id"))
    return replica.lookup(index, read(spark, sf_dir, "part").where("p_size <> 7").select(F.col("p_partkey").alias("id"), "p_name")).select("l_orderkey", "l_linenumber", "envelope_id", "p_name")


@query(f"""WITH r(rule_no, source, protocol, port, action) AS (VALUES {RULES_SQL}), k AS ({PACKETS_SQL}), p AS ({PEERS}),
 h AS (SELECT packet_id, arg_min(action, rule_no) AS action FROM k JOIN r ON (source IS NULL OR source = 3) AND (port IS NULL OR port = dst_port)
  AND (protocol = 'Any' OR protocol = 'Tcp' AND proto = 6 OR protocol = 'Udp' AND proto = 17 OR protocol = 'Icmp' AND proto IN (1, 58)) GROUP BY 1),
 j AS (SELECT k.packet_id, action, CASE WHEN p.id IS NULL THEN 'unknown peer' WHEN action IS NOT NULL THEN 'rule' WHEN owner = 1 THEN 'same owner' ELSE 'quarantine' END AS reason
  FROM k LEFT JOIN p ON k.peer = p.id LEFT JOIN h ON k.packet_id = h.packet_id)
 SELECT packet_id, CASE WHEN reason = 'same owner' OR reason = 'rule' AND action = 'Allow' THEN 'Allow' ELSE 'Deny' END AS verdict, reason FROM j""")
def egress_rules(spark, sf_dir):
    return rules.egress(packets(spark, sf_dir), peers(spark), rule_table(spark), F.lit(3), F.lit(1)).select("packet_id", "verdict", "reason")


@query("""SELECT o_orderkey, c_name AS endpoint, c_name IS NOT NULL AS forwarded FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) c ON o_custkey = c_custkey""")
def forwarded(spark, sf_dir):
    records = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("recipient"))
    clients = read(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("endpoint"))
    return rules.forward(records, clients).select("o_orderkey", "endpoint", "forwarded")


@query("""SELECT l_orderkey * 10 + l_linenumber AS packet_id, CASE WHEN s_nationkey = 4 OR l_returnflag = 'R' THEN 'Dropped' WHEN s_nationkey % 2 = 0 THEN 'Relay:5' ELSE 'Direct' END AS route
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def outbound_routes(spark, sf_dir):
    verdict = F.when(F.col("l_returnflag") == "R", "Deny").otherwise("Allow")
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("packet_id"), F.col("l_suppkey").alias("peer"), verdict.alias("verdict"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("peer"), "s_nationkey")
    modes = s.select("peer", F.when(F.col("s_nationkey") % 2 == 0, "Relayed").otherwise("Direct").alias("mode"))
    return rules.outbound(rows, s.where("s_nationkey <> 4"), modes, spark.range(5, 9).select(F.col("id").alias("relay_id"))).select("packet_id", "route")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'leased' WHEN o_orderkey % 5 <> 0 THEN 'stored' END AS task FROM orders""")
def task_lookup(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    place = lambda rows, name: rows.select("id", F.lit(name).alias("task"))
    return queue.current(o, place(o.where("o_orderstatus = 'F'"), "done"), place(o.where("id % 3 = 0"), "leased"), place(o.where("id % 5 <> 0"), "stored"))


WORK = "CASE WHEN event_id % 97 = 0 THEN 'complete' WHEN event_id % 3 = 0 THEN 'dispatch' WHEN event_id % 3 = 1 THEN 'expire' ELSE 'enqueue' END"


@query(f"""WITH e AS (SELECT user_id AS id, event_id AS seq, {WORK} AS event FROM events),
 f AS (SELECT id, arg_max(event, seq) AS last, bool_or(event = 'complete') AS done, count(*) FILTER (event = 'dispatch') AS attempts FROM e GROUP BY id)
 SELECT id, CASE WHEN done THEN 'Completed' WHEN last = 'expire' AND attempts >= 3 THEN 'DeadLetter' WHEN last = 'dispatch' THEN 'Running' ELSE 'Pending' END AS status, CAST(attempts AS INT) AS attempts FROM f""")
def task_states(spark, sf_dir):
    return queue.folded(read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.expr(WORK).alias("event")))


@query(f"""WITH {MINUTES_SQL}, t AS (SELECT id, id || '-' || event_id AS job, {S} AS now, {S} - event_id % 50 * 3600 AS last FROM events CROSS JOIN (VALUES ('five'), ('weekday'), ('monthly'), ('sunday')) i(id)),
 f AS (SELECT t.*, j.m FROM t ASOF LEFT JOIN j ON t.id = j.id AND t.now // 60 * 60 >= j.m),
 r AS (SELECT job AS id, now AS last_run, CASE WHEN m >= last // 60 * 60 + 60 THEN m END AS trigger FROM f)
 SELECT id, last_run, trigger, CASE WHEN trigger IS NOT NULL THEN 'cron-' || id || '-' || trigger END AS task_id FROM r""")
def cron_ticks(spark, sf_dir):
    """Each event ticks each job, whose last run was up to two days before."""
    rows = events(spark, sf_dir).crossJoin(F.broadcast(queue.jobs(spark, JOBS).drop("last_run")))
    rows = rows.select(F.concat_ws("-", "id", "event_id").alias("id"), "s", *[f"m{i}" for i in range(5)], (F.col("s") - F.col("event_id") % 50 * 3600).alias("last_run"))
    return queue.tick(rows, F.col("s"))


@query(f"""WITH x AS (SELECT 'n' || o_orderkey || '.zone' AS fqdn, o_custkey AS owner, {ODATE} + 31536000 AS e FROM orders WHERE o_orderkey % 3 <> 0),
 r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'register' ELSE 'renew' END AS op, CASE WHEN o_orderkey % 7 = 0 THEN '-x' ELSE 'n' END || o_orderkey || '.zone' AS fqdn,
  o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS owner, 915148800 + o_orderkey % 400 * 86400 AS e FROM orders),
 j AS (SELECT r.*, CASE WHEN x.fqdn IS NULL THEN NULL WHEN 915148800 <= x.e THEN 'Active' WHEN 915148800 <= x.e + 1209600 THEN 'Grace' ELSE 'Expired' END AS state, x.owner = r.owner AS own FROM r LEFT JOIN x ON x.fqdn = r.fqdn)
 SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'BadName' WHEN o_orderkey % 400 NOT BETWEEN 1 AND 365 THEN 'BadLease'
  WHEN op = 'register' THEN CASE WHEN state = 'Active' THEN 'AlreadyActive' WHEN state = 'Grace' AND NOT own THEN 'GraceUnauthorized' ELSE 'Ok' END
  WHEN state IS NULL THEN 'NotRegistered' WHEN state = 'Expired' THEN 'Expired' WHEN state = 'Active' AND NOT own THEN 'Unauthorized' WHEN NOT own THEN 'GraceUnauthorized' ELSE 'Ok' END AS outcome FROM j""")
def lease_requests(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("n"), k, F.lit(".zone")).alias("fqdn"), F.col("o_custkey").alias("owner"), (epoch(F.col("o_orderdate")) + 365 * 86400).alias("expires_at"))
    asked = o.select(
        k, F.when(k % 2 == 0, "register").otherwise("renew").alias("op"), F.concat(F.when(k % 7 == 0, "-x").otherwise("n"), k, F.lit(".zone")).alias("fqdn"),
        (F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0)).alias("owner"), (F.lit(915148800) + k % 400 * 86400).alias("expires_at"))
    return leases.step(old, asked, 915148800, ".zone").select("o_orderkey", "outcome")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Pending' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'DeadLetter' ELSE 'Running' END END"


def tasks(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(STATUS).alias("status"), (F.col("o_totalprice") * 100).cast("bigint").alias("lamport"), F.col("o_custkey").alias("ready_seq"))


@query(f"SELECT id FROM (SELECT min(o_custkey * 100000000 + o_orderkey) % 100000000 AS id FROM orders WHERE {STATUS} NOT IN ('Completed', 'DeadLetter'))")
def next_task(spark, sf_dir):
    """The one task that a dispatch takes; ready numbers that several orders share are told apart by the key."""
    return queue.next_ready(tasks(spark, sf_dir).withColumn("ready_seq", F.col("ready_seq") * 100000000 + F.col("id"))).select("id")


@query(f"SELECT o_orderkey AS id, {STATUS} AS status FROM orders WHERE {STATUS} IN ('Pending', 'Running')")
def rehydrated(spark, sf_dir):
    return queue.rehydrated(tasks(spark, sf_dir)).select("id", "status")


@query(f"""SELECT count(*) AS tasks, count(*) FILTER (t = 'Running') AS active_leases, count(*) FILTER (t = 'Completed') AS completed, count(*) FILTER (t = 'DeadLetter') AS dead, count(*) FILTER (t <> 'Completed') AS disk_writes
 FROM (SELECT {STATUS} AS t FROM orders)""")
def queue_counts(spark, sf_dir):
    return queue.counts(tasks(spark, sf_dir))


@query(f"SELECT o_orderkey AS id FROM orders WHERE {STATUS} = 'DeadLetter'")
def dead_letters(spark, sf_dir):
    return queue.dead_letters(tasks(spark, sf_dir)).select("id")


@query(f"""SELECT l_suppkey AS issuer_id, l_partkey % 50 AS subject_id, max({SHIP} // 2592000) AS revoked_at,
 arg_max(l_orderkey * 10 + l_linenumber, {SHIP} // 2592000 * 1000000000 + l_orderkey * 10 + l_linenumber) AS arrival_seq FROM lineitem GROUP BY 1, 2""")
def newest_revocations(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("issuer_id"), (F.col("l_partkey") % 50).alias("subject_id"), F.floor(epoch(F.col("l_shipdate")) / 2592000).alias("revoked_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival_seq"))
    return trust.latest_revocations(rows).select("issuer_id", "subject_id", "revoked_at", "arrival_seq")


ATTESTED = f"a AS (SELECT event_id, user_id AS i, event_id % 50 AS u, event_id % 120 / 100.0 AS w, {S} AS s FROM events), m AS (SELECT max(s) - 864000 AS now FROM a)"
FADED = "CASE WHEN now - s <= 0 THEN w ELSE least(greatest(w * power(2.0, -(now - s) / 2592000.0), 0), 1) END"


def attested(spark, sf_dir):
    rows = events(spark, sf_dir)
    now = rows.agg((F.max("s") - 864000).alias("now"))
    return rows.crossJoin(F.broadcast(now)).select(
        "event_id", F.col("user_id").alias("issuer_id"), (F.col("event_id") % 50).alias("subject_id"), (F.col("event_id") % 120 / 100).alias("score_weight"), F.col("s").alias("issued_at"),
        (F.col("s") + 1728000).alias("expires_at"), (F.col("event_id") % 9 != 0).alias("sig_ok"), "now", F.col("event_id").alias("arrival_seq"))


@query(f"""WITH {ATTESTED} SELECT event_id, round({FADED}, 6) AS weight FROM a, m WHERE event_id % 9 <> 0 AND now <= s + 1728000 AND w BETWEEN 0 AND 1
 AND NOT EXISTS (SELECT 1 FROM customer c WHERE c_nationkey <> 0 AND c_custkey = i AND c_nationkey * 2 = u)""")
def valid_attestations(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("issuer_id"), (F.col("c_nationkey") * 2).cast("bigint").alias("subject_id"), (F.col("c_nationkey") != 0).alias("sig_ok"))
    return trust.valid(attested(spark, sf_dir), c, F.col("now")).select("event_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {ATTESTED}, f AS (SELECT i, u, min(event_id) AS event_id FROM a GROUP BY 1, 2), p AS (SELECT c_custkey AS i, unnest(range(0, 3)) * 7 + 1 AS u FROM customer)
 SELECT p.i AS issuer_id, p.u AS subject_id, round(coalesce({FADED}, 0), 6) AS trust FROM m, p LEFT JOIN f ON f.i = p.i AND f.u = p.u LEFT JOIN a ON a.event_id = f.event_id""")
def pair_trust(spark, sf_dir):
    rows = attested(spark, sf_dir)
    now = events(spark, sf_dir).agg((F.max("s") - 864000).alias("now"))
    pairs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("issuer_id"), F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1, 8, 15)])).alias("subject_id"))
    return trust.pair_trust(pairs.crossJoin(F.broadcast(now)), rows.drop("now"), F.col("now")).select("issuer_id", "subject_id", F.round("trust", 6).alias("trust"))


ADDRESS = """CASE event_id % 5 WHEN 0 THEN '10.0.' || event_id % 300 || '.7' WHEN 1 THEN '/ip4/192.168.0.' || event_id % 256 || '/udp/4001' WHEN 2 THEN '/ip6/FE80::' || event_id % 10 || '/udp/4001' WHEN 3 THEN '::1' ELSE 'host' || event_id END"""


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 300 < 256 THEN '10.0.' || event_id % 300 || '.7' END WHEN 1 THEN '192.168.0.' || event_id % 256 END AS v4,
 CASE event_id % 5 WHEN 2 THEN 'fe80::' || event_id % 10 WHEN 3 THEN '::1' END AS v6 FROM events""")
def addresses_of_records(spark, sf_dir):
    a = F.expr(ADDRESS)
    return read(spark, sf_dir, "events").select("event_id", names.ipv4_of(a).alias("v4"), names.ipv6_of(a).alias("v6"))


@query(f"SELECT event_id, 'cron-' || event_type || '-x-' || {S} AS task_id, event_type || '-x' AS job FROM events")
def scheduled_task_names(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", names.cron_task_id(F.concat("event_type", F.lit("-x")), F.col("s")).alias("task_id"))
    return rows.withColumn("job", names.job_of_task(F.col("task_id")))


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM documents")
def distinct_content(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("shard"))
    return blobs.stored(rows, F.sha2("shard", 256)).select("hash")


@query(f"SELECT user_id, max({S} // 3600) AS epoch FROM events GROUP BY 1")
def newest_epochs(spark, sf_dir):
    return clock.epochs(events(spark, sf_dir).select("user_id", F.floor(F.col("s") / 3600).alias("epoch")), "user_id", "epoch")


@query(f"SELECT event_id, greatest({S} % 1000 + event_id % 2001 - 1500, 0) AS t, greatest(event_id % 700 - ({S} % 1000), 0) AS left_over FROM events")
def network_times(spark, sf_dir):
    t = F.col("s") % 1000
    return events(spark, sf_dir).select("event_id", network_time(t, F.col("event_id") % 2001 - 1500).alias("t"), remaining(F.lit(0).cast("bigint"), F.col("event_id") % 700, t).alias("left_over"))


@query(f"""WITH k AS (SELECT event_id // 3 AS id, event_id, user_id, {S} AS t, {KIND_SQL} AS kind, event_id % 67 AS mask FROM events),
 c AS (SELECT *, CASE WHEN (mask & 32) <> 0 OR kind IN (8, 9) OR kind BETWEEN 20000 AND 29999 THEN 0 WHEN event_id % 11 = 0 THEN 4 WHEN kind BETWEEN 30000 AND 39999 OR kind = 10 THEN 3
  WHEN kind BETWEEN 268435456 AND 536870911 OR kind = 11 THEN 1 WHEN kind >= 40000 THEN 5 WHEN kind = 0 OR kind BETWEEN 10000 AND 19999 THEN 2 ELSE 1 END AS class FROM k),
 v AS (SELECT id, class FROM c WHERE class IN (1, 5) UNION ALL SELECT id, class FROM c WHERE class = 4 AND event_id % 2 = 0
  UNION ALL SELECT max(t * 100000000 + id) % 100000000, class FROM c WHERE class IN (2, 3) GROUP BY class, user_id, kind)
 SELECT id, arg_min(class, list_position([1, 4, 5, 2, 3], class)) AS class FROM v GROUP BY id""")
def ordered_lookup(spark, sf_dir):
    """The class that answers for each id: the first, in the order of the store, that holds it."""
    k = kinds(events(spark, sf_dir))
    rows = k.select(
        F.expr("event_id div 3").alias("id"), F.col("user_id").alias("sender_key"), "kind", F.lit(None).cast("binary").alias("param_d"), F.col("s").alias("timestamp"),
        F.when(every("event_id", 2), 2).otherwise(0).alias("expires_at"), retention.classify(F.col("kind"), F.col("mask"), every("event_id", 11), F.lit(False)).alias("class"))
    views = retention.store(rows)
    views[retention.TTL] = rows.where(F.col("class") == retention.TTL)  # of several rows of an id one may be over and another not
    return retention.first_by_id(views, F.col("id"), 1).select("id", "class")


@query(f"""WITH e AS (SELECT event_id, user_id, {S} % 100000 AS t, event_id % 97 AS tie FROM events),
 w AS (SELECT *, max(t * 1000 + tie) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
 SELECT count(*) AS received, count(*) FILTER (seen IS NULL) AS inserted, count(*) FILTER (t * 1000 + tie > seen) AS updated, count(*) FILTER (t * 1000 + tie <= seen) AS superseded FROM w""")
def apply_counts(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", (F.col("s") % 100000).alias("t"), (F.col("event_id") % 97).alias("tie"))
    return replica.apply_counts(retention.arrivals(rows, ["user_id"], "t", "tie", "event_id"))


@query("""WITH n AS (SELECT l_orderkey % 997 AS node, CAST(l_orderkey % 997 % 20 AS INT) AS depth, l_partkey AS key, l_suppkey AS envelope_id FROM lineitem),
 t AS (SELECT node FROM n WHERE depth <= 16 AND key BETWEEN 20 AND 40 GROUP BY node ORDER BY min(depth), node LIMIT 64),
 i AS (SELECT DISTINCT envelope_id AS id FROM n WHERE node IN (SELECT node FROM t) ORDER BY id LIMIT 256)
 SELECT id, s_name FROM i JOIN supplier ON s_suppkey = id""")
def range_answer(spark, sf_dir):
    """Whole nodes that hold an entry in range, within the caps of one answer."""
    node = F.col("l_orderkey") % 997
    nodes = read(spark, sf_dir, "lineitem").select(node.alias("node"), (node % 20).cast("int").alias("depth"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("envelope_id"))
    return replica.answer_nodes(nodes, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"), F.lit(20), F.lit(40)).select("id", "s_name")
