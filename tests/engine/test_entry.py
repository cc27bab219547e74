"""Every query against its SQL on the smallest tables; streams against batches."""

import os

import pytest
from pyspark.sql import functions as F

import keelson.plans.records  # noqa: F401
from keelson.plans.queries import ORACLES, QUERIES
from keelson.streaming import ingest, replay

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    return round(float(value), 6) if hasattr(value, "__float__") else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    sql = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_streaming_generations(spark, tmp_path):
    data = [(1, 0), (1, 1), (1, 2), (2, 4), (2, 6)]
    spark.createDataFrame(data, "id long, epoch long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, epoch long").parquet(str(tmp_path / "in"))
    q = replay.generations(stream).writeStream.format("memory").queryName("gen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert sorted(map(tuple, spark.sql("select * from gen").collect())) == [(1, 0, True), (1, 1, False), (1, 2, True), (2, 4, True), (2, 6, True)]


def test_streaming_ingest(spark, tmp_path):
    schema = "id long, tags array<struct<tag_type:bigint,tag_value:binary>>, header_tag long, core_tag_mask long"
    spark.createDataFrame([(1, [], 1, 0), (2, [], 40001, 0), (3, [], 8, 0), (4, [], 6, 0)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(100)
    assert sorted((r.id, r["class"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 5)]


def test_streaming_dedup_and_gate(spark, tmp_path):
    rows = spark.createDataFrame([(1, 100, 100), (1, 100, 100), (2, 131, 100), (3, 69, 100), (4, 70, 100)], "id long, ts_seconds long, consensus long").withColumn("ts", F.timestamp_seconds("ts_seconds"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = replay.deduplicated(replay.gated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert sorted(r.id for r in spark.sql("select id from dd").collect()) == [1, 4]
