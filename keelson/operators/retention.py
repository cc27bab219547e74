"""Retention classes, last-write-wins views, time-to-live and write-once tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions import tags as T
from keelson.functions.time import lit

EPHEMERAL, APPEND, REPLACEABLE, PARAMETER, TTL, WORM = range(6)


def classify(kind: Column, mask: Column, expiring: Column, parametric: Column) -> Column:
    """The class of a record; the order of the rules matters."""
    return (
        F.when((mask.bitwiseAND(T.ROUTING_FLAG) != 0) | kind.isin(8, 9) | kind.between(20000, 29999), EPHEMERAL)
        .when(expiring, TTL)
        .when(parametric | kind.between(30000, 39999) | (kind == 0x0A), PARAMETER)
        .when(kind.between(0x10000000, 0x1FFFFFFF) | (kind == 0x0B), APPEND)
        .when(kind >= 40000, WORM)
        .when((kind == 0) | kind.between(10000, 19999), REPLACEABLE)
        .otherwise(APPEND)
    )


def classified(records: DataFrame) -> DataFrame:
    """records (tags, header_tag, core_tag_mask, ...) with kind, param_d, expires_at and class."""
    tags = F.col("tags")
    return records.withColumns(
        {"kind": T.kind(tags, F.col("header_tag")), "param_d": T.parameter(tags), "expires_at": T.expiration(tags)}
    ).withColumn("class", classify(F.col("kind"), F.col("core_tag_mask"), T.has_tag(tags, T.EXPIRATION_TAG), T.has_tag(tags, T.PARAMETER_TAG)))


def latest(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """One row for each key: the greatest (ts, tie). Aggregates on the map side before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("__row")
    return rows.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*rows.columns)


def arrivals(rows: DataFrame, keys: list[str], ts: str, tie: str, seq: str) -> DataFrame:
    """rows with the outcome of each write in order of seq: Stored, Replaced or SupersededLww."""
    before = W.partitionBy(*keys).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    seen = F.max(F.struct(ts, tie)).over(before)
    return rows.withColumn("outcome", F.when(seen.isNull(), "Stored").when(F.struct(ts, tie) > seen, "Replaced").otherwise("SupersededLww"))


def alive(rows: DataFrame, now: int | Column, expires: str = "expires_at") -> DataFrame:
    """Visible before, not at, the expiration; a filter that reaches the scan."""
    return rows.where(lit(now) < F.col(expires))


def expired(rows: DataFrame, now: int | Column, expires: str = "expires_at") -> DataFrame:
    """What a sweep takes."""
    return rows.where(F.col(expires) <= lit(now))


def write_once(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """incoming with outcome Stored or IdempotentDuplicate; of repeats within it one is stored."""
    fresh = incoming.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    known = incoming.join(stored.select(key).distinct(), key, "left_semi")
    return fresh.withColumn("outcome", F.lit("Stored")).unionByName(known.withColumn("outcome", F.lit("IdempotentDuplicate")))


def store(records: DataFrame, sender: str = "sender_key", id_col: str = "id", ts: str = "timestamp") -> dict[int, DataFrame]:
    """Views by class of classified records; class 0 is never kept."""
    of = {c: records.where(F.col("class") == c) for c in (APPEND, REPLACEABLE, PARAMETER, TTL, WORM)}
    return {
        APPEND: of[APPEND].dropDuplicates([id_col]),
        REPLACEABLE: latest(of[REPLACEABLE], [sender, "kind"], ts, id_col),
        PARAMETER: latest(of[PARAMETER].withColumn("param_d", F.coalesce("param_d", F.lit(b""))), [sender, "kind", "param_d"], ts, id_col),
        TTL: of[TTL].dropDuplicates([id_col]),
        WORM: of[WORM].dropDuplicates([id_col]),
    }


def by_id(views: dict[int, DataFrame], wanted: Column, now: int | Column | None = None, id_col: str = "id") -> DataFrame:
    """Records of an id over all classes; expired ones are hidden where now is given."""
    found = None
    for c in (APPEND, TTL, WORM, REPLACEABLE, PARAMETER):
        view = views[c] if c != TTL or now is None else alive(views[c], now)
        found = view if found is None else found.unionByName(view)
    return found.where(F.col(id_col) == wanted)


def first_by_id(views: dict[int, DataFrame], wanted: Column, now: int | Column | None = None, id_col: str = "id") -> DataFrame:
    """The one record of each wanted id: of the first class that holds it, in the order append, expiring
    (unless over), write-once, replaceable, parameter."""
    order = (APPEND, TTL, WORM, REPLACEABLE, PARAMETER)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("class"))
    found = by_id(views, wanted, now, id_col)
    rest = [c for c in found.columns if c != id_col]
    return found.groupBy(id_col).agg(F.min_by(F.struct(*rest), place).alias("__row")).select(id_col, "__row.*").select(*found.columns)


def delete(views: dict[int, DataFrame], ids: DataFrame, id_col: str = "id") -> dict[int, DataFrame]:
    """Views without the ids; an id that is write-once is an error."""
    if views[WORM].join(ids, id_col, "left_semi").limit(1).count():
        raise ValueError("write-once records can't be deleted")
    return {c: v if c == WORM else v.join(ids, id_col, "left_anti") for c, v in views.items()}
