"""Aggregations over a ledger of attempts, several of which share one request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.ordering import with_sum_before

#: Statuses of attempts that called a provider, and of those that answered.
CALLED = ("success", "failed", "fallback")
ANSWERED = ("success", "fallback", "cached")


def folded_requests(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and request: what its attempts add up to.

    Counting requests afterwards needs no distinct aggregate, and a key with most of the rows is spread by request.
    """
    is_in = lambda *s: F.col("status").isin(*s)
    return attempts.groupBy(*keys, "request_id").agg(
        F.sum("estimated_cost_usd").alias("cost"), F.count_if(is_in(*CALLED)).alias("attempts"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.count_if(is_in("failed")).alias("failed"),
        F.count_if(is_in("cached")).alias("cached"), F.coalesce(F.bool_or(is_in("fallback")), F.lit(False)).alias("any_fallback"), F.coalesce(F.bool_or(is_in("blocked")), F.lit(False)).alias("any_blocked"),
        F.coalesce(F.bool_or(is_in(*ANSWERED)), F.lit(False)).alias("any_answer"), F.coalesce(F.bool_or(is_in("success", "fallback")), F.lit(False)).alias("any_provider"), F.coalesce(F.bool_or(is_in("failed")), F.lit(False)).alias("any_failed"),
    )


def totals(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Spend, volume and reliability by key; a null request_id is no request."""
    one = F.col("request_id").isNotNull()
    return folded_requests(attempts, keys).groupBy(*keys).agg(
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,6)").alias("cost"), F.count_if(one).alias("requests"), F.sum("attempts").alias("attempts"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("cached_tokens"), F.lit(0)).alias("cached_tokens"),
        F.sum("failed").alias("failed_attempts"), F.count_if(one & F.col("any_fallback")).alias("fallback_requests"), F.sum("cached").alias("cache_hits"), F.count_if(one & F.col("any_blocked")).alias("blocked"),
        F.count_if(one & F.col("any_answer")).alias("answered"), F.count_if(one & F.col("any_provider")).alias("provider_answered"),
        F.count_if(one & F.col("any_failed") & ~F.col("any_answer") & ~F.col("any_blocked")).alias("failed_requests"),
    )


def ratio(over: Column, under: Column, digits: int) -> Column:
    """A ratio rounded half to even, 0 where nothing is under."""
    return F.when(under > 0, F.bround(over.cast("double") / under, digits)).otherwise(F.lit(0.0))


def ratios(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"cost_per_answer": ratio(F.col("cost"), F.col("answered"), 6), "fallback_rate": ratio(F.col("fallback_requests"), F.col("provider_answered"), 4), "cache_rate": ratio(F.col("cached_tokens"), F.col("input_tokens"), 4)})


def by_period(attempts: DataFrame, unit: str) -> DataFrame:
    """Cost and requests by calendar unit (UTC) of creation."""
    rows = attempts.withColumn("period", F.date_trunc(unit, F.col("created_at").cast("timestamp")).cast("date"))
    return totals(rows, ["period"]).select("period", "cost", "requests", "attempts", "failed_attempts")


def filled_days(points: DataFrame, day: str, zero: dict[str, Column]) -> DataFrame:
    """Every day between the first and the last, absent ones with zeros."""
    span = points.agg(F.min(day).alias("a"), F.max(day).alias("b")).where(F.col("a").isNotNull())
    days = span.select(F.explode(F.sequence("a", "b")).alias(day))
    return days.join(points, day, "left").select(day, *[F.coalesce(F.col(c), z).alias(c) for c, z in zero.items()])


def running_spend(attempts: DataFrame) -> DataFrame:
    """What an organization had spent in the month before each attempt; its attempts are sorted hour by hour."""
    rows = attempts.withColumn("month", F.date_trunc("month", F.col("created_at").cast("timestamp")).cast("date"))
    rows = with_sum_before(rows, ["organization_id", "month"], ["created_at", "usage_id"], F.date_trunc("hour", F.col("created_at").cast("timestamp")), F.col("estimated_cost_usd"), "spent")
    return rows.select("usage_id", "organization_id", "month", F.col("spent").cast("decimal(38,6)").alias("spent_before"))


def failure_runs(attempts: DataFrame) -> DataFrame:
    """Runs of consecutive failed attempts of a model within a day: start, end, length.

    A run is known by the attempts before it in the day that did not fail; they are counted hour by hour.
    """
    rows = attempts.withColumns({"day": F.to_date("created_at"), "failed": F.coalesce(F.col("status") == "failed", F.lit(False))})
    rows = with_sum_before(rows, ["provider", "model", "day"], ["created_at", "usage_id"], F.date_trunc("hour", F.col("created_at").cast("timestamp")), F.when(F.col("failed"), 0).otherwise(1), "run")
    return rows.where("failed").groupBy("provider", "model", "day", "run").agg(F.min("created_at").alias("started"), F.max("created_at").alias("ended"), F.count("*").alias("length")).drop("run")
