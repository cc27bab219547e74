"""The packet stream's order of checks, and small operators that no query reaches."""

import pytest

from keelson.functions.gf256 import Code
from keelson.operators import replica, retention
from keelson.streaming import replay

SCHEMA = "session_id long, packet_id long, seq long, endpoint string, mac_ok boolean, ts_seconds long, consensus long, arrival long"


def run(spark, tmp_path, batches, capacity=None):
    sessions = spark.createDataFrame([(1,), (2,)], "session_id long")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r, 100 * i + j) for j, r in enumerate(rows)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    name = f"packets_{tmp_path.name.replace('-', '_')}"
    q = replay.packets(stream, sessions, capacity=capacity).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return {r.packet_id * 1000 + r.seq: (r.outcome, r.endpoint) for r in spark.sql(f"select * from {name}").collect()}


def test_packets_pass_the_checks_in_order(spark, tmp_path):
    got = run(spark, tmp_path, [[
        (1, 10, 5, "a", True, 1000, 1000), (1, 10, 6, "b", True, 1000, 1001),  # the id again
        (1, 11, 7, "b", True, 1031, 1000), (1, 11, 8, "b", False, 1030, 1000),  # drift leaves the id unused, a bad MAC uses it up
        (1, 11, 9, "b", True, 1000, 1000), (1, 12, 5, "c", True, 1000, 1000), (1, 13, 6, "d", True, 1000, 1000),
        (9, 20, 1, "x", True, 1000, 1000),
    ]])
    assert got == {
        10005: ("Accepted", "a"), 10006: ("Replay", "a"), 11007: ("Drift", "a"), 11008: ("BadMac", "a"), 11009: ("Replay", "a"),
        12005: ("OldSequence", "a"), 13006: ("Accepted", "d"), 20001: ("NoSession", None),
    }


def test_packets_forget_after_two_windows_and_fill_up(spark, tmp_path):
    got = run(spark, tmp_path, [[
        (1, 1, 1, "a", True, 0, 0), (1, 2, 2, "a", True, 1, 1), (1, 3, 3, "a", True, 2, 2),  # a window holds two ids
        (1, 1, 4, "a", True, 60, 60), (1, 1, 5, "a", True, 120, 120), (1, 1, 6, "a", True, 121, 121),
    ]], capacity=2)
    assert [got[k][0] for k in (1001, 2002, 3003, 1004, 1005, 1006)] == ["Accepted", "Accepted", "Full", "Replay", "Accepted", "Replay"]


def test_diff_from_a_bare_root(spark):
    local = spark.createDataFrame([(1,), (2,)], "key long")
    assert replica.diff_from_root(local, b"a", b"a", ["key"]).count() == 0
    assert sorted(map(tuple, replica.diff_from_root(local, b"a", b"b", ["key"]).collect())) == [(1, "send"), (2, "send")]


def test_first_class_of_an_id(spark):
    rows = [(1, 3, 10), (1, 4, 5), (1, 5, 0), (2, 4, 5), (2, 2, 0), (3, 3, 0)]
    df = spark.createDataFrame(rows, "id long, class int, expires_at long")
    views = {c: df.where(f"class = {c}") for c in range(1, 6)}
    answer = lambda now: {r["id"]: r["class"] for r in retention.first_by_id(views, df["id"], now).collect()}
    assert answer(4) == {1: 4, 2: 4, 3: 3} and answer(5) == {1: 5, 2: 2, 3: 3}


@pytest.mark.parametrize("lost", [(0, 3, 7, 9), (10, 11, 12, 13), (0, 10, 5, 13)])
def test_kept_inverses(lost):
    code, payload = Code(), bytes(range(256)) * 5 + b"end"
    shards = [(i, s) for i, s in enumerate(code.encode(payload)) if i not in lost]
    assert code.decode(shards, len(payload)) == code.decode(shards, len(payload)) == payload
