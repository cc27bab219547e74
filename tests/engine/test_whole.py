"""Queries without SQL, over every row of small tables, against plain Python."""

import datetime
import random

from keelson.functions import cron
from keelson.plans import queries

from .test_operators import plain_rank


def test_cron_triggers_of_every_event(spark, tmp_path):
    rng = random.Random(4)
    begin = int(datetime.datetime(2023, 12, 20, tzinfo=datetime.UTC).timestamp())
    seconds = [begin + rng.randrange(40 * 86400) for _ in range(80)] + [begin + 12 * 86400, begin + 12 * 86400 - 1, 0, 59, 60, 3 * 86400]
    spark.createDataFrame(list(enumerate(seconds, 1)), "event_id long, s long").selectExpr("event_id", "timestamp_seconds(s) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.event_id, r.id): r.trigger for r in queries.QUERIES["cron_triggers"](spark, str(tmp_path)).collect()}
    want = {}
    for name, text, _ in queries.JOBS:
        masks = cron.Schedule.parse(text).masks
        for i, s in enumerate(seconds, 1):
            want[i, name] = None
            for t in range(s // 60 * 60, max(s // 60 * 60 - 10080 * 60, 0), -60):
                d = datetime.datetime.fromtimestamp(t, datetime.UTC)
                if all(m >> v & 1 for m, v in zip(masks, (d.minute, d.hour, d.day, d.month, d.isoweekday() % 7), strict=True)):
                    want[i, name] = t
                    break
    assert got == want and None in want.values()


def test_trust_over_all_returned_lines(spark, tmp_path):
    """Lines of few pieces link too."""
    rng = random.Random(6)
    lines = [(rng.randint(1, 12), rng.randint(1, 30), rng.choice("RRA"), float(rng.randint(1, 50)), rng.randint(0, 10) / 100) for _ in range(60)] + [(1, 1, "R", 3.0, 0.05)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_returnflag string, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 14)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    edges: dict = {}
    for supplier, part, flag, _, discount in lines:
        if flag == "R":
            for pair in ((2 * supplier, 2 * part + 1), (2 * part + 1, 2 * supplier)):
                edges[pair] = max(edges.get(pair, 0), discount + 0.1)
    want = plain_rank(edges, 2)
    assert {r.node: r.distance for r in queries.QUERIES["trust_distances"](spark, str(tmp_path)).collect()} == {k: v[0] for k, v in want.items()}
    got = {r.target: r for r in queries.QUERIES["trust_tiers"](spark, str(tmp_path)).collect()}
    assert set(got) == {2 * i for i in range(1, 14)}
    for k, r in got.items():
        distance, score = want.get(k, (None, 0.0))
        assert r.distance == distance and abs(r.score - (1.0 if k == 2 else score)) < 1e-4
