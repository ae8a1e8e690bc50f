"""Medians and other percentiles of very large numeric columns, per group, by exact bisection.

For every group and percentile an interval of values is kept that holds the target rank.  In each pass the rows inside
the interval are counted below its midpoints, and the interval narrows to the part that holds the rank, until it is one
value or not wider than the tolerance.  `ways` midpoints are counted in one pass, which saves passes over the data.

What is counted is a table of (group, value, rows), the mergeable state: tables of separate days or partitions are put
together by adding rows of equal values, and give the same percentiles as the rows themselves.  With a tolerance, values
are counted on a grid of that width, which bounds the state; the stated interval then has that width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.storage import written

PER_MILLE = (500, 900, 950, 990)


def once(df: DataFrame, key: str, latest: str, columns: list[str]) -> DataFrame:
    """Each key's latest delivery; of deliveries at one time, the greatest by the other columns.  Rows without a key count one by one."""
    rows = df.select(key, latest, *columns)
    folded = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(latest, *columns)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in columns])
    return folded.unionByName(rows.where(F.col(key).isNull()).select(*columns))


def state(df: DataFrame, groups: list[str], measures: dict[str, Column], tolerance: dict[str, int] | None = None) -> DataFrame:
    """The mergeable state: groups, measure, v (whole number), n (rows).

    `measures` gives each measure as a whole number (scale decimals first); nulls are not counted.  `tolerance` has the
    width of the grid on which a measure's values are counted; v is a grid cell's lower end.
    """
    values = df.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("bigint").alias("v")) for m, c in measures.items()])).alias("x"))
    values = values.select(*groups, "x.measure", "x.v").where(F.col("v").isNotNull())
    for m, width in (tolerance or {}).items():
        values = values.withColumn("v", F.when(F.col("measure") == m, F.col("v") - F.pmod("v", F.lit(width))).otherwise(F.col("v")))
    return values.groupBy(*groups, "measure", "v").agg(F.count("*").alias("n"))


def merged(*states: DataFrame) -> DataFrame:
    """States of separate days or partitions as one."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def regrouped(counts: DataFrame, dropped: list[str]) -> DataFrame:
    """A coarser grouping from the state alone: the dropped columns become null."""
    keys = [c for c in counts.columns if c != "n"]
    rows = counts.withColumns({c: F.lit(None).cast(counts.schema[c].dataType) for c in dropped})
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def bisected(counts: DataFrame, groups: list[str], per_mille: tuple[int, ...] = PER_MILLE, ways: int = 64) -> DataFrame:
    """groups, measure, per_mille, n (rows of the group), v: the state's value at rank ceil(p n), exact also among ties.

    The rows' own value lies in v and v plus the state's tolerance less 1.
    """
    keys = [*groups, "measure"]
    counts = counts.withColumn("__g", F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]))
    spans = counts.groupBy("__g", *keys).agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = spans.select("__g", *keys, "total", "lo", "hi", F.explode(F.array(*[F.lit(p) for p in per_mille])).alias("per_mille"))
    rank = F.floor((F.col("total") * F.col("per_mille") + 999) / 1000).cast("bigint")
    state = written(state.select("*", F.greatest(rank, F.lit(1)).alias("rank"), F.lit(0).cast("bigint").alias("below")), "percentile-intervals")
    done = None
    while True:
        wide = F.col("hi") > F.col("lo")
        finished = state.where(~wide)
        done = finished if done is None else done.unionByName(finished)
        active = state.where(wide)
        # a group's percentiles often share an interval: it is counted once
        intervals = active.select("__g", "lo", "hi").distinct()
        n = intervals.count()
        if n == 0:
            break
        grouped = intervals.groupBy("__g").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # at most one per percentile
        if n <= 500_000:
            grouped = F.broadcast(grouped)
        inside = counts.select("__g", "v", "n").join(grouped, "__g").select("__g", "v", "n", F.explode(F.filter("spans", lambda s: F.col("v").between(s["lo"], s["hi"]))).alias("s"))
        step = F.greatest(F.ceil((F.col("s.hi") - F.col("s.lo") + 1) / ways).cast("bigint"), F.lit(1))
        part = F.floor((F.col("v") - F.col("s.lo")) / step).cast("bigint")
        tally = inside.groupBy("__g", "s.lo", "s.hi", part.alias("part"), step.alias("step")).agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("__g", "lo", "hi").orderBy("part")  # at most `ways` rows
        tally = tally.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
        narrowed = active.join(tally, ["__g", "lo", "hi"]).where((F.col("below") + F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("upto")))
        low = F.col("lo") + F.col("part") * F.col("step")
        state = written(
            narrowed.select("__g", *keys, "total", low.alias("lo"), F.least(F.col("hi"), low + F.col("step") - 1).alias("hi"), "per_mille", "rank", (F.col("below") + F.col("before")).alias("below")),
            "percentile-intervals",
        )
    return done.select(*keys, "per_mille", F.col("total").alias("n"), F.col("lo").alias("v"))


def usage_state(logs: DataFrame, tolerance: dict[str, int] | None = None) -> DataFrame:
    """The state of ai_usage_logs per task_type and day of created_at: latency in ms, cost in millionths of a dollar."""
    rows = once(logs.select("usage_id", "received_at", "task_type", F.to_date("created_at").alias("day"), "latency_ms", "estimated_cost_usd"), "usage_id", "received_at", ["task_type", "day", "latency_ms", "estimated_cost_usd"])
    measures = {"latency_ms": F.col("latency_ms"), "estimated_cost_usd": (F.col("estimated_cost_usd") * 1_000_000)}
    return state(rows, ["task_type", "day"], measures, tolerance)


def usage_percentiles(logs: DataFrame, tolerance: dict[str, int] | None = None) -> DataFrame:
    """task_type, day (null: all days), measure, percentile, rows, value, error.

    Each usage_id counts once, by its latest delivery; a null measure is not counted; a null task_type or day is a group
    of its own (a null day's group has day null and all_days false).  error is the most by which value can be off.
    """
    counts = written(usage_state(logs, tolerance), "usage-state").withColumn("all_days", F.lit(False))
    both = counts.unionByName(regrouped(counts, ["day"]).withColumn("all_days", F.lit(True)))
    out = bisected(written(both, "usage-both"), ["task_type", "day", "all_days"])  # read in every pass
    unit = F.when(F.col("measure") == "latency_ms", 1.0).otherwise(1e6)
    off = F.lit(0)
    for m, width in (tolerance or {}).items():
        off = F.when(F.col("measure") == m, width - 1).otherwise(off)
    return out.select(
        "task_type", "day", "all_days", "measure", (F.col("per_mille") / 1000).alias("percentile"), F.col("n").alias("rows"),
        (F.col("v") / unit).alias("value"), (off / unit).alias("error"),
    )
