"""Weighted trust graphs: validity, bounded breadth-first search, personalized PageRank and tiers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.time import decayed, lit

HORIZON, ALPHA, EPSILON, ROUNDS = 6, 0.85, 1e-5, 50  # fixed values
RELAY, STORAGE, COMPUTE, DISCOVERY = 1, 2, 4, 8


def latest_revocations(revocations: DataFrame) -> DataFrame:
    """One for each pair; of equal times the later arrival."""
    rest = [c for c in revocations.columns if c not in ("issuer_id", "subject_id")]
    best = F.max_by(F.struct(*rest), F.struct("revoked_at", "arrival_seq"))
    return revocations.groupBy("issuer_id", "subject_id").agg(best.alias("r")).select("issuer_id", "subject_id", "r.*")


def valid(attestations: DataFrame, revocations: DataFrame, now: int | Column) -> DataFrame:
    """Neither revoked (at any time) nor expired, signed, with their decayed weight."""
    kept = attestations.where(F.col("sig_ok") & (lit(now) <= F.col("expires_at")) & F.col("score_weight").between(0, 1))
    kept = kept.join(revocations.where("sig_ok").select("issuer_id", "subject_id"), ["issuer_id", "subject_id"], "left_anti")
    return kept.withColumn("weight", decayed(F.col("score_weight"), F.col("issued_at"), now))


def edges(weighted: DataFrame, order: str = "issued_at") -> DataFrame:
    """src, dst, weight: the latest of each pair, at most 1; none without a positive weight."""
    best = F.max_by("weight", order)
    return (
        weighted.where(F.col("weight") > 0).groupBy(F.col("issuer_id").alias("src"), F.col("subject_id").alias("dst"))
        .agg(F.least(best, F.lit(1.0)).alias("weight"))
    )


def _place(spark) -> str:
    """A path of our own in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='keelson-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/trust-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str | None = None) -> DataFrame:
    """A table in the shared folder: cuts the lineage of a loop and outlives executors."""
    spark = df.sparkSession
    path = path or _place(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def distances(graph: DataFrame, root: Column, horizon: int = HORIZON) -> DataFrame:
    """node, distance of all nodes within the horizon; each round joins only the new frontier."""
    spark = graph.sparkSession
    kind = graph.schema["src"].dataType
    seen = _written(spark.range(1).select(root.cast(kind).alias("node"), F.lit(0).alias("distance")))
    frontier = seen
    for d in range(1, horizon + 1):
        reached = graph.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = _written(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def rank(graph: DataFrame, root: Column, rounds: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """node, distance, score (1 for the root). Weight that a node doesn't hand on returns to the root.

    A round is one join and one pre-aggregated shuffle, written once; the driver sees five numbers.
    """
    reach = distances(graph, root)
    inside = graph.join(reach.select(F.col("node").alias("src")), "src", "left_semi").join(reach.select(F.col("node").alias("dst")), "dst", "left_semi")
    total = inside.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = _written(inside.join(total, "src").select("src", "dst", (F.col("weight") / F.greatest("total", F.lit(1.0))).alias("w")))
    nodes = reach.select("node", (F.col("distance") == 0).alias("is_root"))
    p = nodes.withColumn("p", F.col("is_root").cast("double"))
    places = [_place(graph.sparkSession) for _ in range(2)]  # a round reads one and writes the other
    for i in range(rounds):
        moved = steps.join(p.where("p > 0").select(F.col("node").alias("src"), "p"), "src")
        gained = moved.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("w") * ALPHA).alias("gain"))
        new = _written(p.join(gained, "node", "left").select("node", "is_root", "p", F.coalesce("gain", F.lit(0.0)).alias("gain")), places[i % 2])
        own = lambda c: F.max(F.when(F.col("is_root"), F.col(c)))
        sums = new.agg(F.sum("p").alias("mass"), F.sum("gain").alias("kept"), F.max(F.when(~F.col("is_root"), F.abs(F.col("gain") - F.col("p")))).alias("change"), own("p").alias("root"), own("gain").alias("root_gain")).first()
        back = (1 - ALPHA) + max(ALPHA * sums["mass"] - sums["kept"], 0.0)
        top = sums["root_gain"] + back
        p = new.select("node", "is_root", (F.col("gain") + F.when(F.col("is_root"), back).otherwise(0.0)).alias("p"))
        if max(sums["change"] or 0.0, abs(top - sums["root"])) < epsilon:
            break
    score = F.least(F.greatest(F.col("p") / top, F.lit(0.0)), F.lit(1.0)) if top > 0 else F.lit(0.0)
    return p.join(reach, "node").select("node", "distance", score.alias("score"))


def tier(score: Column, distance: Column) -> Column:
    return (
        F.when((score >= 0.85) & (distance <= 1), "CorePeer").when((score >= 0.50) & (distance <= 2), "Trusted")
        .when((score >= 0.15) & (distance <= 4), "Probationary").otherwise("Untrusted")
    )


def evaluate(targets: DataFrame, ranked: DataFrame, root: Column) -> DataFrame:
    """target, score, distance (null: not reached), tier; the root itself is (1, 0, CorePeer)."""
    own = F.col("target") == root
    found = targets.select("target").join(ranked.withColumnRenamed("node", "target"), "target", "left")
    score = F.when(own, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    distance = F.when(own, 0).otherwise(F.col("distance"))
    return found.select("target", score.alias("score"), distance.alias("distance"), F.when(own, "CorePeer").otherwise(tier(score, distance)).alias("tier"))


def refresh(graph: DataFrame, root: Column) -> DataFrame:
    """The scores of a graph, written: what `evaluate` reads until the next refresh, whatever the graph does meanwhile."""
    return _written(rank(graph, root))


def capable(targets: DataFrame, attestations: DataFrame, scope: int, name: str) -> DataFrame:
    """targets with a flag: any attestation grants the scope, revoked or not."""
    granted = attestations.where(F.col("capability_scopes").bitwiseAND(scope) == scope).select(F.col("subject_id").alias("target")).distinct()
    return targets.join(granted.withColumn(name, F.lit(True)), "target", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def admission(evaluated: DataFrame, attestations: DataFrame) -> DataFrame:
    """evaluated with vpn_allowed, storage_allowed, compute_allowed."""
    for scope, name in ((RELAY, "relay"), (STORAGE, "storage"), (COMPUTE, "compute")):
        evaluated = capable(evaluated, attestations, scope, name)
    core, trusted, trial = (F.col("tier") == t for t in ("CorePeer", "Trusted", "Probationary"))
    return evaluated.select(
        "target", "score", "distance", "tier", (core | trusted & F.col("relay")).alias("vpn_allowed"),
        (core | trusted & F.col("storage") | trial & F.col("storage") & (F.col("score") >= 0.25)).alias("storage_allowed"),
        (core | trusted & F.col("compute")).alias("compute_allowed"),
    )


def pair_trust(pairs: DataFrame, attestations: DataFrame, now: int | Column) -> DataFrame:
    """issuer_id, subject_id, trust: the first attestation of the pair, decayed; 0 if none."""
    first = attestations.groupBy("issuer_id", "subject_id").agg(F.min_by(F.struct("score_weight", "issued_at"), "arrival_seq").alias("a"))
    found = pairs.join(first, ["issuer_id", "subject_id"], "left")
    return found.select("issuer_id", "subject_id", F.coalesce(decayed(F.col("a.score_weight"), F.col("a.issued_at"), now), F.lit(0.0)).alias("trust"))


def changed_since(attestations: DataFrame, since: int) -> DataFrame:
    return attestations.where(F.col("issued_at") >= since)


def ingest_problem(now: int | Column) -> Column:
    """First rule that an incoming attestation breaks, in order; null if none."""
    from keelson.functions.time import within_drift

    return (
        F.when(F.col("public_key").isNull(), "no key").when(~F.col("key_ok"), "key size").when(~F.col("issuer_matches_key"), "issuer")
        .when(~F.col("kind").isin(0x0A, 0x0B), "kind").when(~within_drift(F.col("timestamp"), now), "drift").when(~F.col("sig_ok"), "signature")
    )
