"""Percentiles by bisection, against sorting."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyfold.llm import percentiles

SCHEMA = "usage_id bigint, task_type string, latency_ms int, estimated_cost_usd decimal(12,6), created_at timestamp_ntz, received_at timestamp_ntz"


def logs(spark, n=3000):
    random.seed(11)
    t = datetime(2025, 3, 1)
    rows = []
    for i in range(n):
        late = random.choice([0, 0, 1])
        row = (i, random.choice(["a", "a", "a", "b", None]), random.choice([None, 0, 0, int(random.paretovariate(0.7))]), Decimal(int(random.paretovariate(0.5)) % 10**11) / 10**6, t + timedelta(hours=i % 90), t)
        rows.append(row)
        if late:
            rows.append((*row[:5], t - timedelta(days=1)))
    rows.append((None, "a", 5, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' as v", "'z' as n", "'z' as measure", "'z' as day", "'z' as lo"), rows


def expected(rows, column, by_day):
    groups = {}
    for r in {r[0]: r for r in rows}.values():
        if r[column] is not None:
            key = (r[1], (r[4].date() if r[4] else None) if by_day else None)
            groups.setdefault(key, []).append(float(r[column]))
    return {(*k, p): sorted(v)[max(1, -(-len(v) * pm // 1000)) - 1] for k, v in groups.items() for pm in (500, 900, 950, 990) for p in (pm / 1000,)}


def test_against_sorting(spark):
    df, rows = logs(spark)
    got = percentiles.usage_percentiles(df).collect()
    for column, measure in ((2, "latency_ms"), (3, "estimated_cost_usd")):
        for by_day in (True, False):
            mine = {(r.task_type, r.day, r.percentile): r.value for r in got if r.measure == measure and r.all_days != by_day}
            assert mine == expected(rows, column, by_day)
    assert all(r.error == 0 for r in got)


def test_states_of_parts_give_the_whole(spark):
    df, _ = logs(spark)
    rows = percentiles.once(df, "usage_id", "received_at", ["task_type", "latency_ms"])
    measure = {"latency_ms": F.col("latency_ms")}
    whole = percentiles.state(rows, ["task_type"], measure)
    parts = [percentiles.state(rows.where(f"coalesce(latency_ms, 0) % 3 = {i}"), ["task_type"], measure) for i in range(3)]
    got = [sorted(map(str, percentiles.bisected(s, ["task_type"], ways=w).collect())) for s, w in ((whole, 2), (percentiles.merged(*parts), 64), (percentiles.merged(*parts), 5))]
    assert got[0] == got[1] == got[2]


def test_a_stated_error_holds(spark):
    df, rows = logs(spark)
    exact = expected(rows, 2, False)
    got = percentiles.usage_percentiles(df, {"latency_ms": 50}).where("all_days and measure = 'latency_ms'").collect()
    assert got and all(r.error == 49 and 0 <= exact[r.task_type, None, r.percentile] - r.value <= r.error for r in got)


def test_empty_ties_and_negative_values(spark):
    df, _ = logs(spark, 3)
    assert percentiles.usage_percentiles(df.where("false")).count() == 0
    flat = spark.createDataFrame([(None, -7)] * 9 + [(None, 3)], "g string, x int")
    got = percentiles.bisected(percentiles.state(flat, ["g"], {"x": F.col("x")}), ["g"], (1, 500, 900, 901, 1000)).orderBy("per_mille").collect()
    assert [r.v for r in got] == [-7, -7, -7, 3, 3] and {r.n for r in got} == {10}
    assert [r.v for r in percentiles.bisected(percentiles.state(flat, ["g"], {"x": F.col("x")}, {"x": 5}), ["g"], (500,)).collect()] == [-10]
