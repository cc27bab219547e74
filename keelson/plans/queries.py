"""Queries that apply the operators to the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import cron, digests, names
from keelson.functions.tags import clear_flag, has_flag, set_flag
from keelson.functions.time import civil, decayed, epoch, lease_length_ok, lease_state, within_drift
from keelson.operators import blobs, clock, custody, dispatch, leases, queue, replica, retention, rules, trust

NOW = 1_700_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("s", epoch(F.col("ts")))


S = "(epoch_us(ts) // 1000000)"
SHIP = "(epoch_us(l_shipdate) // 1000000)"
ODATE = "(epoch_us(o_orderdate) // 1000000)"


@query(f"""SELECT user_id, event_type, s, event_id, value FROM (
  SELECT *, {S} AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {S} DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def lww_latest(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", "s", "event_id", "value")
    return retention.latest(rows, ["user_id", "event_type"], "s", "event_id")


@query(f"""WITH e AS (SELECT event_id, user_id, {S} % 100000 AS t, event_id % 97 AS tie FROM events),
 w AS (SELECT *, max(t * 1000 + tie) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
 SELECT event_id, CASE WHEN seen IS NULL THEN 'Stored' WHEN t * 1000 + tie > seen THEN 'Replaced' ELSE 'SupersededLww' END AS outcome FROM w""")
def lww_arrivals(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", (F.col("s") % 100000).alias("t"), (F.col("event_id") % 97).alias("tie"))
    return retention.arrivals(rows, ["user_id"], "t", "tie", "event_id").select("event_id", "outcome")


KINDS = (0, 1, 8, 9, 10, 11, 10001, 20001, 30005, 40001, 0x10000003, 0x30000002, 0x2011, 0x50000001, 6)


def kinds(df: DataFrame) -> DataFrame:
    listed = F.array(*[F.lit(k).cast("bigint") for k in KINDS])
    return df.withColumns({"kind": F.element_at(listed, (F.col("event_id") % len(KINDS) + 1).cast("int")), "mask": (F.col("event_id") % 67).cast("bigint")})


KIND_SQL = f"([{', '.join(map(str, KINDS))}])[CAST(event_id % {len(KINDS)} AS INT) + 1]"


@query(f"""WITH k AS (SELECT event_id, {KIND_SQL} AS kind, event_id % 67 AS mask FROM events)
 SELECT event_id, CASE WHEN (mask & 32) <> 0 OR kind IN (8, 9) OR kind BETWEEN 20000 AND 29999 THEN 0 WHEN event_id % 11 = 0 THEN 4
  WHEN event_id % 13 = 0 OR kind BETWEEN 30000 AND 39999 OR kind = 10 THEN 3 WHEN kind BETWEEN 268435456 AND 536870911 OR kind = 11 THEN 1
  WHEN kind >= 40000 THEN 5 WHEN kind = 0 OR kind BETWEEN 10000 AND 19999 THEN 2 ELSE 1 END AS class FROM k""")
def retention_class(spark, sf_dir):
    k = kinds(events(spark, sf_dir))
    return k.select("event_id", retention.classify(F.col("kind"), F.col("mask"), F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0).alias("class"))


@query(f"""WITH k AS (SELECT event_id, {KIND_SQL} AS kind, ({KIND_SQL.replace('event_id', '(event_id + 4)')}) AS tag FROM events)
 SELECT route, count(*) AS n FROM (SELECT CASE WHEN kind = 6 OR tag = 6 THEN 'sync' WHEN kind = 805306370 OR tag = 805306370 THEN 'names'
  WHEN kind IN (1073741826, 1073741827, 268435459, 8209) OR tag IN (1073741826, 1073741827) THEN 'blobs'
  WHEN kind BETWEEN 1342177280 AND 1610612735 OR tag BETWEEN 1342177280 AND 1610612735 THEN 'tasks' WHEN kind IN (8, 9) OR tag IN (8, 9) THEN 'packets'
  WHEN kind IN (10, 11) OR tag IN (10, 11) THEN 'trust' ELSE 'store' END AS route FROM k) GROUP BY route""")
def dispatch_routes(spark, sf_dir):
    k = kinds(events(spark, sf_dir))
    tag = kinds(k.select("event_id", (F.col("event_id") + 4).alias("e")).select(F.col("event_id").alias("own"), F.col("e").alias("event_id")))
    both = k.select("event_id", "kind").join(tag.select(F.col("own").alias("event_id"), F.col("kind").alias("header_tag")), "event_id")
    return dispatch.dispatch(both).groupBy("route").agg(F.count("*").alias("n"))


TTL = "s + CASE event_type WHEN 'click' THEN 3600 ELSE 86400 END"


@query(f"""SELECT event_id FROM (SELECT event_id, event_type, {S} AS s, (SELECT max({S}) FROM events) AS m FROM events) WHERE m - 43200 < {TTL} AND s <= m - 43200""")
def ttl_alive(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.agg((F.max("s") - 43200).alias("now"))
    rows = e.withColumn("expires_at", F.expr(TTL)).crossJoin(F.broadcast(now))
    return retention.alive(rows.where("s <= now"), F.col("now")).select("event_id")


@query(f"""SELECT count(*) AS n FROM (SELECT event_id, event_type, {S} AS s, (SELECT max({S}) FROM events) AS m FROM events) WHERE {TTL} <= m - 43200""")
def ttl_sweep(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.agg((F.max("s") - 43200).alias("now"))
    return retention.expired(e.withColumn("expires_at", F.expr(TTL)).crossJoin(F.broadcast(now)), F.col("now")).agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1), s AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0)
 SELECT CASE WHEN i.id IN (SELECT id FROM s) THEN 'IdempotentDuplicate' ELSE 'Stored' END AS outcome, count(*) AS n FROM i GROUP BY 1""")
def worm_writes(spark, sf_dir):
    incoming = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    stored = read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))
    return retention.write_once(stored, incoming).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""SELECT o_orderkey, CASE WHEN 915148800 <= e THEN 'Active' WHEN 915148800 <= e + 1209600 THEN 'Grace' ELSE 'Expired' END AS state,
 e > 915148800 AND e <= 915148800 + 31536000 AS length_ok FROM (SELECT o_orderkey, {ODATE} + 31536000 AS e FROM orders)""")
def lease_states(spark, sf_dir):
    e = epoch(F.col("o_orderdate")) + 365 * 86400
    return read(spark, sf_dir, "orders").select("o_orderkey", lease_state(e, 915148800).alias("state"), lease_length_ok(e, 915148800).alias("length_ok"))


@query(f"""WITH m AS (SELECT max({S}) - 86400 AS now FROM events)
 SELECT event_id, round(CASE WHEN now - {S} <= 0 THEN value ELSE least(greatest(value * power(2.0, -(now - {S}) / 2592000.0), 0), 1) END, 6) AS weight FROM events, m""")
def decayed_weights(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.agg((F.max("s") - 86400).alias("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", F.round(decayed(F.col("value"), F.col("s"), F.col("now")), 6).alias("weight"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def unrevoked_orders(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_anti").select("o_orderkey")


def sides(spark, sf_dir):
    e = events(spark, sf_dir)
    cols = [F.col("event_id").alias("key"), (F.col("s") + F.when(F.col("event_id") % 7 == 0, 5).otherwise(0)).alias("ts"), F.col("user_id").alias("envelope_id"), (F.col("event_id") % 10 == 0).alias("is_tombstone")]
    other = [F.col("event_id").alias("key"), (F.col("s") + F.when(F.col("event_id") % 5 == 0, 5).otherwise(0)).alias("ts"), F.col("user_id").alias("envelope_id"), (F.col("event_id") % 20 == 0).alias("is_tombstone")]
    return e.where("event_id % 3 <> 0").select(*cols), e.where("event_id % 4 <> 0").select(*other)


SIDES = f"""l AS (SELECT event_id AS key, {S} + CASE WHEN event_id % 7 = 0 THEN 5 ELSE 0 END AS ts, user_id AS id, event_id % 10 = 0 AS dead FROM events WHERE event_id % 3 <> 0),
 r AS (SELECT event_id AS key, {S} + CASE WHEN event_id % 5 = 0 THEN 5 ELSE 0 END AS ts, user_id AS id, event_id % 20 = 0 AS dead FROM events WHERE event_id % 4 <> 0)"""


@query(f"""WITH {SIDES} SELECT key, op FROM (SELECT coalesce(l.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'send' WHEN l.key IS NULL THEN 'fetch'
 WHEN (l.ts, l.id) > (r.ts, r.id) THEN 'send' WHEN (r.ts, r.id) > (l.ts, l.id) THEN 'fetch' WHEN l.dead AND NOT r.dead THEN 'send' WHEN r.dead AND NOT l.dead THEN 'fetch' END AS op
 FROM l FULL JOIN r ON l.key = r.key) WHERE op IS NOT NULL""")
def replica_diff(spark, sf_dir):
    return replica.diff(*sides(spark, sf_dir), ["key"])


@query(f"""WITH {SIDES} SELECT key, max(ts) AS ts FROM (SELECT key, ts FROM l UNION ALL SELECT key, ts FROM r) GROUP BY key""")
def replica_merge(spark, sf_dir):
    return replica.merge(*sides(spark, sf_dir), ["key"]).select("key", "ts")


@query("""WITH o AS (SELECT user_id, event_id % 50 AS peer_id, arg_max(CAST(round(value * 10) AS BIGINT) - 300, event_id) AS x FROM events GROUP BY 1, 2),
 n AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY x) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM o)
 SELECT user_id, CAST(trunc(sum(x) / count(*)) AS BIGINT) AS median_offset FROM n WHERE i IN ((c + 1) // 2, c // 2 + 1) GROUP BY user_id""")
def median_offsets(spark, sf_dir):
    samples = events(spark, sf_dir).select("user_id", (F.col("event_id") % 50).alias("p"), (F.round(F.col("value") * 10).cast("bigint") - 300).alias("offset"), "event_id")
    last = clock.last_offsets(samples.withColumn("peer_id", F.struct("user_id", "p")), "event_id")
    return clock.median_offset(last.select("peer_id.user_id", "offset"), ["user_id"])


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS n_keepers, count(DISTINCT l_suppkey) >= 10 OR l_partkey % 50 = 0 AS unlocked FROM lineitem GROUP BY l_partkey""")
def distinct_gate(spark, sf_dir):
    k = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return custody.unlocked(k, k.where("l_partkey % 50 = 0"), "l_partkey", "l_suppkey")


RULES = [(1, 3, "Tcp", 80, "Allow"), (2, None, "Tcp", 22, "Deny"), (3, 5, "Any", None, "Deny"), (4, None, "Icmp", None, "Allow"), (5, 7, "Udp", 53, "Allow"), (6, 2, "Tcp", 443, "Deny")]
RULES_SQL = ", ".join(f"({n}, {s or 'NULL'}, '{p}', {d or 'NULL'}, '{a}')" for n, s, p, d, a in RULES)


def packets(spark, sf_dir):
    protocol = F.element_at(F.array(*map(F.lit, (6, 17, 1, 58, 47))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    port = F.element_at(F.array(*map(F.lit, (80, 22, 53, 443))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("packet_id"), (F.col("l_suppkey") % 11).alias("peer"), (F.col("l_orderkey") % 4).alias("epoch"), protocol.alias("proto"), port.alias("dst_port"))


PEERS = "SELECT CAST(range AS BIGINT) AS id, range % 3 AS owner, range % 2 AS epoch FROM range(0, 9)"


def peers(spark):
    return spark.range(9).select("id", (F.col("id") % 3).alias("owner"), (F.col("id") % 2).alias("epoch"))


PACKETS_SQL = """SELECT l_orderkey * 10 + l_linenumber AS packet_id, l_suppkey % 11 AS peer, l_orderkey % 4 AS epoch, ([6, 17, 1, 58, 47])[l_linenumber % 5 + 1] AS proto,
 ([80, 22, 53, 443])[CAST(l_partkey % 4 AS INT) + 1] AS dst_port FROM lineitem"""
JUDGED = f"""WITH r(rule_no, source, protocol, port, action) AS (VALUES {RULES_SQL}), k AS ({PACKETS_SQL}), p AS ({PEERS}),
 h AS (SELECT packet_id, arg_min(action, rule_no) AS action FROM k JOIN r ON (source IS NULL OR source = peer) AND (port IS NULL OR port = dst_port)
  AND (protocol = 'Any' OR protocol = 'Tcp' AND proto = 6 OR protocol = 'Udp' AND proto = 17 OR protocol = 'Icmp' AND proto IN (1, 58)) GROUP BY 1),
 j AS (SELECT k.packet_id, action, CASE WHEN p.id IS NULL THEN 'unknown peer' WHEN k.epoch < p.epoch THEN 'revoked epoch' WHEN action IS NOT NULL THEN 'rule'
  WHEN owner = 1 THEN 'same owner' ELSE 'quarantine' END AS reason FROM k LEFT JOIN p ON k.peer = p.id LEFT JOIN h ON k.packet_id = h.packet_id),
 v AS (SELECT packet_id, reason, CASE WHEN reason = 'same owner' OR reason = 'rule' AND action = 'Allow' THEN 'Allow' ELSE 'Deny' END AS verdict FROM j)"""


def rule_table(spark):
    return spark.createDataFrame(RULES, "rule_no int, source bigint, protocol string, dst_port int, action string")


@query(f"{JUDGED} SELECT packet_id, verdict, reason FROM v")
def first_match_rules(spark, sf_dir):
    return rules.ingress(packets(spark, sf_dir), peers(spark), rule_table(spark), F.lit(1)).select("packet_id", "verdict", "reason")


@query(f"""{JUDGED} SELECT count(*) FILTER (verdict = 'Allow') AS allowed, count(*) FILTER (verdict = 'Deny') AS denied,
 count(*) FILTER (reason IN ('unknown peer', 'quarantine')) AS quarantined, count(*) FILTER (reason = 'revoked epoch') AS revoked FROM v""")
def rule_counters(spark, sf_dir):
    return rules.counters(rules.ingress(packets(spark, sf_dir), peers(spark), rule_table(spark), F.lit(1)))


@query("""SELECT c_custkey AS caller, coalesce(CASE WHEN c_custkey % 50 = 0 THEN 'self' END, CASE WHEN c_custkey % 4 = 0 THEN 'own' || c_nationkey END, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END) AS target,
 CASE WHEN c_custkey % 50 = 0 THEN 'derived' WHEN c_custkey % 4 = 0 THEN 'overlay' WHEN n_nationkey % 5 <> 0 THEN 'public' END AS tier,
 CASE WHEN c_custkey % 50 = 0 OR c_custkey % 4 = 0 OR n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 5 = 1 END AS in_grace FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def three_tier(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    fqdn = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("-k"), F.col("c_custkey").cast("string"))).otherwise(""))
    q = c.select(F.col("c_custkey").alias("caller"), fqdn.alias("fqdn"))
    derived = q.where("caller % 50 = 0").select("fqdn", F.lit("self").alias("target"))
    overlays = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("owner"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("domain"), F.concat(F.lit("own"), F.col("c_nationkey").cast("string")).alias("target"))
    expires = F.when(F.col("n_nationkey") % 5 == 0, NOW - 15 * 86400).when(F.col("n_nationkey") % 5 == 1, NOW - 86400).otherwise(NOW + 1)
    public = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("fqdn"), F.col("n_name").alias("target"), expires.cast("bigint").alias("expires_at"))
    return leases.resolve(q, derived, overlays, public, NOW).select("caller", "target", "tier", "in_grace")


@query("""SELECT p_partkey, worker_id FROM part JOIN (VALUES (1, 'a'), (2, 'b'), (12, 'c')) r(m, worker_id) ON (CAST(p_size AS BIGINT) & m) <> 0 WHERE p_partkey % 9 <> 0
 UNION ALL SELECT p_partkey, 'direct' FROM part WHERE p_partkey % 9 = 0""")
def mask_fan_out(spark, sf_dir):
    routes = spark.createDataFrame([(1, "a"), (2, "b"), (12, "c")], "mask bigint, worker_id string")
    records = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("mask"), F.when(F.col("p_partkey") % 9 == 0, F.lit("direct")).alias("target"))
    return rules.fan_out(records, routes).select("p_partkey", "worker_id")


@query(f"""WITH m AS (SELECT max({ODATE}) AS now FROM orders) SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND now - {ODATE} >= 8640000 THEN CASE WHEN o_orderkey % 5 >= 3 THEN 'DeadLetter' ELSE 'Pending' END
 WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Running' END AS status FROM orders, m""")
def lease_sweep(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    g = o.select("o_orderkey", epoch(F.col("o_orderdate")).alias("granted_at"), F.lit(8640000).cast("bigint").alias("duration"), (F.col("o_orderstatus") == "F").alias("acked"), (F.col("o_orderkey") % 5).alias("attempts"))
    now = g.agg(F.max("granted_at").alias("now"))
    return queue.sweep(g.crossJoin(F.broadcast(now)), F.col("now")).select("o_orderkey", "status")


JOBS = [("five", "*/5 * * * *", None), ("weekday", "30 8 * * 1-5", None), ("monthly", "0 0 1 * *", None), ("sunday", "15,45 */6 * * 7", None)]


#: Every minute of the events and the week before that a job names.
MINUTES_SQL = f"""g AS (SELECT unnest(generate_series((SELECT min({S}) FROM events) // 60 * 60 - 604800, (SELECT max({S}) FROM events), 60)) AS m),
 c AS (SELECT m, to_timestamp(m) AT TIME ZONE 'UTC' AS d FROM g), h AS (SELECT m, minute(d) AS mi, hour(d) AS ho, day(d) AS dy, dayofweek(d) AS wd FROM c),
 j AS (SELECT 'five' AS id, m FROM h WHERE mi % 5 = 0 UNION ALL SELECT 'weekday', m FROM h WHERE mi = 30 AND ho = 8 AND wd BETWEEN 1 AND 5
  UNION ALL SELECT 'monthly', m FROM h WHERE mi = 0 AND ho = 0 AND dy = 1 UNION ALL SELECT 'sunday', m FROM h WHERE mi IN (15, 45) AND ho % 6 = 0 AND wd = 0)"""


@query(f"""WITH {MINUTES_SQL}, t AS (SELECT event_id, {S} // 60 * 60 AS s, id FROM events CROSS JOIN (VALUES ('five'), ('weekday'), ('monthly'), ('sunday')) i(id))
 SELECT t.event_id, t.id, CASE WHEN j.m >= t.s - 10079 * 60 THEN j.m END AS trigger FROM t ASOF LEFT JOIN j ON t.id = j.id AND t.s >= j.m""")
def cron_triggers(spark, sf_dir):
    """Every event is a tick."""
    return job_triggers(spark, events(spark, sf_dir))


def job_triggers(spark, ticks):
    pairs = ticks.select("event_id", "s").crossJoin(F.broadcast(queue.jobs(spark, JOBS)))
    trigger = cron.latest_trigger(F.col("s") - 60 * 10081, F.col("s"), [F.col(f"m{i}") for i in range(5)])
    return pairs.select("event_id", "id", trigger.alias("trigger"))


def graph(spark, sf_dir):
    """Suppliers and parts that lines of returned goods link, both ways."""
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"), (F.col("l_discount") + 0.1).alias("w"))
    both = li.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(li.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("weight"))


@query("""WITH RECURSIVE li AS (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem WHERE l_returnflag = 'R'),
 g AS (SELECT a AS s, b AS d FROM li UNION SELECT b, a FROM li), w(node, distance) AS (SELECT CAST(2 AS BIGINT), 0 UNION SELECT g.d, w.distance + 1 FROM w JOIN g ON g.s = w.node WHERE w.distance < 6)
 SELECT node, min(distance) AS distance FROM w GROUP BY node""")
def trust_distances(spark, sf_dir):
    return trust.distances(graph(spark, sf_dir), F.lit(2))


@query()
def trust_tiers(spark, sf_dir):
    """PageRank until it settles, so rows only; tests compare with a plain power iteration."""
    g = graph(spark, sf_dir)
    ranked = trust.rank(g, F.lit(2))
    targets = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("target"))
    return trust.evaluate(targets, ranked, F.lit(2)).withColumn("score", F.round("score", 4))


@query(f"""WITH e AS (SELECT user_id AS id, {S} // 3600 AS epoch, min(event_id) AS head FROM events GROUP BY 1, 2),
 n AS (SELECT *, CASE WHEN epoch - lag(epoch) OVER (PARTITION BY id ORDER BY epoch) = 1 THEN 0 ELSE 1 END AS start FROM e),
 r AS (SELECT *, sum(start) OVER (PARTITION BY id ORDER BY epoch) AS run FROM n),
 p AS (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY epoch) % 2 = 1 AS fresh FROM r)
 SELECT event_id, event_id = head AND fresh AS accepted FROM events JOIN p ON p.id = user_id AND p.epoch = {S} // 3600""")
def replay_suppression(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").alias("id"), F.floor(F.col("s") / 3600).alias("epoch"), F.col("event_id").alias("seq"))
    return clock.replay_batch(rows).select(F.col("seq").alias("event_id"), "accepted")


@query(f"""SELECT event_id, coalesce(prev, 0) = 0 OR v > prev AS accepted FROM (SELECT event_id, {S} % 1000 AS v,
 max({S} % 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)""")
def sequence_acceptance(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", (F.col("s") % 1000).alias("v"))
    return clock.accepted(rows, "user_id", "v", "event_id").select("event_id", "accepted")


@query("""WITH RECURSIVE z AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 40 ELSE 0 END AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT user_id, event_id, i, CASE WHEN g > 0 THEN g ELSE 1 END AS clock, CASE WHEN g > 0 THEN g ELSE 1 END AS top FROM z WHERE i = 1
  UNION ALL SELECT z.user_id, z.event_id, z.i, CASE WHEN g > 0 THEN g ELSE top + 1 END, greatest(top, CASE WHEN g > 0 THEN g ELSE top + 1 END) FROM f JOIN z ON z.user_id = f.user_id AND z.i = f.i + 1)
 SELECT event_id, clock FROM f""")
def lamport_clock(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 40).otherwise(0).alias("lamport"))
    return clock.lamport(rows).select(F.col("seq").alias("event_id"), "clock")


@query("""SELECT event_type AS id, max(event_id % 1000) AS lamport, arg_min(event_id, -(event_id % 1000) * 100000000 + event_id) AS payload FROM events GROUP BY 1""")
def newest_tasks(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("id"), (F.col("event_id") % 1000).alias("lamport"), F.col("event_id").alias("payload"), F.col("event_id").alias("seq"))
    return queue.newest(rows).select("id", "lamport", "payload")


@query("""WITH n AS (SELECT c_custkey, lower(trim(' ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '.Zone ' WHEN c_custkey % 3 = 1 THEN '-.zone' ELSE '.other' END)) AS x FROM customer)
 SELECT c_custkey, CASE WHEN regexp_full_match(replace(x, '#', '-'), '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*\\.zone') THEN replace(x, '#', '-') END AS name FROM n""")
def name_validation(spark, sf_dir):
    n = F.when(F.col("c_custkey") % 3 == 0, ".Zone ").when(F.col("c_custkey") % 3 == 1, "-.zone").otherwise(".other")
    raw = F.concat(F.lit(" "), F.regexp_replace("c_name", "#", "-"), n)
    return read(spark, sf_dir, "customer").select("c_custkey", names.canonical_name(raw, ".zone").alias("name"))


@query(f"""SELECT event_id, minute(ts) AS minute, hour(ts) AS hour, day(ts) AS day, month(ts) AS month, dayofweek(ts) AS weekday FROM events""")
def civil_fields(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", civil(F.col("s")).alias("c")).select("event_id", "c.*")


@query("""SELECT event_id, 4 * length(regexp_extract(h, '^0*')) + CASE substr(h, length(regexp_extract(h, '^0*')) + 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 2 WHEN '4' THEN 1 WHEN '5' THEN 1
 WHEN '6' THEN 1 WHEN '7' THEN 1 ELSE 0 END AS bits FROM (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM events)""")
def leading_zeros(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", digests.leading_zero_bits(F.unhex(F.sha2(F.col("event_id").cast("string"), 256))).alias("bits"))


@query("SELECT event_id, (event_id % 64 & 36) = 36 AS has, event_id % 64 | 5 AS with_5, event_id % 64 & ~5 AS without_5 FROM events")
def bit_flags(spark, sf_dir):
    m = (F.col("event_id") % 64).cast("bigint")
    return read(spark, sf_dir, "events").select("event_id", has_flag(m, 36).alias("has"), set_flag(m, 5).alias("with_5"), clear_flag(m, 5).alias("without_5"))


@query(f"SELECT count(*) AS n FROM events WHERE abs({S} % 3600 - 1800) <= 30")
def drift_gate(spark, sf_dir):
    return events(spark, sf_dir).where(within_drift(F.col("s") % 3600, 1800)).agg(F.count("*").alias("n"))


@query("SELECT doc_id, strlen(coalesce(text, '')) AS length, sha256(coalesce(text, '')) AS sha FROM documents WHERE strlen(coalesce(text, '')) > 0")
def erasure_round_trip(spark, sf_dir):
    """Encodes every text, loses four shards of fourteen, and rebuilds it."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), F.col("text").cast("binary").alias("payload"))
    left = blobs.encode(docs).where((F.col("shard_index") + F.col("blob_id")) % 14 >= 4)
    back = blobs.decode(left)
    return back.select(F.col("blob_id").alias("doc_id"), F.octet_length("payload").cast("bigint").alias("length"), F.sha2("payload", 256).alias("sha"))


@query()
def content_ids(spark, sf_dir):
    """SHA3 has no counterpart in DuckDB: rows only; tests compare with hashlib."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(digests.content_id(data))).alias("cid"), digests.key_level(data).alias("level"))
