"""Queries over the usage ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import ledger as L
from tallyfold.plans.model import sql, table, usage

_TOTALS = """coalesce(sum(estimated_cost_usd), 0)::DECIMAL(38, 6) AS cost, count(DISTINCT request_id) AS requests,
  count(*) FILTER (status IN ('success', 'failed', 'fallback')) AS attempts, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens,
  coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(cached_tokens), 0)::BIGINT AS cached_tokens,
  count(*) FILTER (status = 'failed') AS failed_attempts, count(DISTINCT request_id) FILTER (status = 'fallback') AS fallback_requests,
  count(*) FILTER (status = 'cached') AS cache_hits, count(DISTINCT request_id) FILTER (status = 'blocked') AS blocked,
  count(DISTINCT request_id) FILTER (status IN ('success', 'fallback', 'cached')) AS answered,
  count(DISTINCT request_id) FILTER (status IN ('success', 'fallback')) AS provider_answered"""


def _failed(keys: str = "", where: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}count(*) AS failed_requests FROM (SELECT {k}request_id FROM usage1 {where} GROUP BY {k}request_id HAVING bool_or(status = 'failed') AND NOT bool_or(status IN ('success', 'fallback', 'cached', 'blocked'))) {f'GROUP BY {keys}' if keys else ''}"


#: What totals are made of.
BASE = ("request_id", "status", "estimated_cost_usd", "input_tokens", "output_tokens", "cached_tokens")


def _last30(spark, d):
    rows = usage(spark, d, *BASE, "task_type", "created_at")
    newest = table(spark, d, "ai_usage_logs").select(F.date_sub(F.max(F.to_date("created_at")), 29)).scalar()
    return rows.where(F.to_date("created_at") >= newest)


def _breakdown(spark, d):
    rows = usage(spark, d, *BASE, "provider", "model", "task_type", "organization_id")
    parts = [L.totals(rows.withColumn("key", key), ["key"]).select(F.lit(name).alias("dimension"), "key", "cost", "requests", "input_tokens", "output_tokens", "failed_attempts") for name, key in (
        ("provider", F.col("provider")), ("model", F.concat_ws(":", "provider", "model")), ("task", F.col("task_type")), ("organization", F.col("organization_id")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_org(spark, d):
    orgs = table(spark, d, "organizations").select("organization_id", F.col("name").alias("label"))
    return L.totals(usage(spark, d, *BASE, "organization_id"), ["organization_id"]).join(orgs, "organization_id").select("organization_id", "label", "cost", "requests")


def _recent_failures(spark, d):
    orgs = table(spark, d, "organizations").select("organization_id", F.col("slug").alias("organization"))
    rows = usage(spark, d, "organization_id", "provider", "model", "status", "error_message", "created_at").where(F.col("status").isin("failed", "blocked"))
    return rows.join(orgs, "organization_id").orderBy(F.desc("created_at"), F.desc("usage_id")).limit(25).select("usage_id", "organization", "provider", "model", "status", "error_message", "created_at")


def _facets(spark, d):
    rows = usage(spark, d, "provider", "model")
    return rows.select(F.lit("provider").alias("facet"), F.col("provider").alias("value")).unionByName(rows.select(F.lit("model").alias("facet"), F.concat_ws(":", "provider", "model").alias("value"))).distinct()


def _counters(spark, d):
    rows = usage(spark, d, "organization_id", "created_at", "input_tokens", "output_tokens", "estimated_cost_usd").withColumn("month", F.date_trunc("month", F.col("created_at").cast("timestamp")).cast("date"))
    return rows.groupBy("organization_id", "month").agg(F.sum(F.col("input_tokens").cast("bigint") + F.col("output_tokens")).alias("tokens"), F.sum("estimated_cost_usd").cast("decimal(38,6)").alias("cost"))


def _user_day(spark, d):
    rows = usage(spark, d, "status", "user_id", "created_at", "request_id").where(F.col("status").isin(*L.CALLED) & F.col("user_id").isNotNull()).withColumn("day", F.to_date("created_at"))
    return rows.select("user_id", "day", "request_id").distinct().groupBy("user_id", "day").agg(F.count("request_id").alias("requests"))


def _spread(spark, d):
    rows = usage(spark, d, "provider", "model", "latency_ms", "status").where("latency_ms is not null")
    return rows.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"), F.bround(F.sum("latency_ms") / F.count("*"), 4).alias("mean"), F.count_if(F.col("status") == "failed").alias("failed"))


def _cube(spark, d):
    """All breakdowns in one pass: grouping sets over the folded requests."""
    rows = L.folded_requests(usage(spark, d, *BASE, "provider", "model", "task_type"), ["provider", "model", "task_type"])
    rows = rows.groupBy("provider", "model", "task_type").agg(F.sum("cost").cast("decimal(38,6)").alias("cost"), F.count("*").alias("n"))
    return rows.rollup("provider", "model", "task_type").agg(F.sum("cost").cast("decimal(38,6)").alias("cost"), F.grouping_id().cast("bigint").alias("level"), F.sum("n").alias("request_groups"))


def _attempt_order(spark, d):
    """Attempts of a request in order, with whether the next one took over."""
    from pyspark.sql import Window

    w = Window.partitionBy("request_id").orderBy("created_at", "usage_id")
    return usage(spark, d, "request_id", "created_at", "status").select("usage_id", "request_id", F.row_number().over(w).alias("attempt"), F.lead("status").over(w).alias("next_status"))


QUERIES = {
    "agg1_usage_totals": lambda s, d: L.totals(usage(s, d, *BASE), []).drop("failed_requests"),
    "agg2_failed_requests": lambda s, d: L.totals(usage(s, d, *BASE), []).select("failed_requests"),
    "agg3_usage_ratios": lambda s, d: L.ratios(L.totals(usage(s, d, *BASE, "provider"), ["provider"])).select("provider", "cost_per_answer", "fallback_rate", "cache_rate"),
    "agg4_usage_breakdown": _breakdown,
    "agg5_usage_by_day": lambda s, d: L.by_period(usage(s, d, *BASE, "created_at"), "day"),
    "agg5_usage_by_month": lambda s, d: L.by_period(usage(s, d, *BASE, "created_at"), "month"),
    "agg6_usage_facets": _facets,
    "agg7_month_counters": _counters,
    "agg7_user_day_requests": _user_day,
    "agg32_usage_by_status": lambda s, d: usage(s, d, "provider", "model", "status", "estimated_cost_usd").groupBy("provider", "model", "status").agg(F.count("*").alias("calls"), F.sum("estimated_cost_usd").cast("decimal(38,6)").alias("cost")),
    "agg33_latency_spread": _spread,
    "prd17_usage_last_30_days": lambda s, d: L.totals(_last30(s, d), ["task_type"]),
    "joi15_usage_by_organization": _by_org,
    "joi16_recent_failures": _recent_failures,
    "sca91_filled_days": lambda s, d: L.filled_days(L.by_period(usage(s, d, *BASE, "created_at"), "day"), "period", {"cost": F.lit(0).cast("decimal(38,6)"), "requests": F.lit(0).cast("bigint")}),
    "ret7_running_spend": lambda s, d: L.running_spend(usage(s, d, "organization_id", "created_at", "estimated_cost_usd")),
    "ret14_failure_runs": lambda s, d: L.failure_runs(usage(s, d, "provider", "model", "created_at", "status")),
    "ret8_attempt_order": _attempt_order,
    "ext_usage_rollup": _cube,
}

SQL = {
    "agg1_usage_totals": sql(f"SELECT {_TOTALS} FROM usage1", "usage1"),
    "agg2_failed_requests": sql(_failed(), "usage1"),
    "agg3_usage_ratios": sql(f""", t AS (SELECT provider, {_TOTALS} FROM usage1 GROUP BY provider)
        SELECT provider, CASE WHEN answered > 0 THEN round_even(cost::DOUBLE / answered, 6) ELSE 0 END AS cost_per_answer,
        CASE WHEN provider_answered > 0 THEN round_even(fallback_requests::DOUBLE / provider_answered, 4) ELSE 0 END AS fallback_rate,
        CASE WHEN input_tokens > 0 THEN round_even(cached_tokens::DOUBLE / input_tokens, 4) ELSE 0 END AS cache_rate FROM t""", "usage1"),
    "agg4_usage_breakdown": sql(", k AS (" + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {e} AS key, * FROM usage1" for n, e in (("provider", "provider"), ("model", "provider || ':' || model"), ("task", "task_type"), ("organization", "organization_id"))) + f"""), t AS (SELECT dimension, key, {_TOTALS} FROM k GROUP BY dimension, key)
        SELECT dimension, key, cost, requests, input_tokens, output_tokens, failed_attempts FROM t""", "usage1"),
    "agg5_usage_by_day": sql(f", t AS (SELECT CAST(created_at AS DATE) AS period, {_TOTALS} FROM usage1 GROUP BY 1) SELECT period, cost, requests, attempts, failed_attempts FROM t", "usage1"),
    "agg5_usage_by_month": sql(f", t AS (SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, {_TOTALS} FROM usage1 GROUP BY 1) SELECT period, cost, requests, attempts, failed_attempts FROM t", "usage1"),
    "agg6_usage_facets": sql("SELECT DISTINCT 'provider' AS facet, provider AS value FROM usage1 UNION SELECT DISTINCT 'model', concat_ws(':', provider, model) FROM usage1", "usage1"),
    "agg7_month_counters": sql("SELECT organization_id, CAST(date_trunc('month', created_at) AS DATE) AS month, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(estimated_cost_usd) AS DECIMAL(38, 6)) AS cost FROM usage1 GROUP BY 1, 2", "usage1"),
    "agg7_user_day_requests": sql("SELECT user_id, CAST(created_at AS DATE) AS day, count(DISTINCT request_id) AS requests FROM usage1 WHERE status IN ('success', 'failed', 'fallback') AND user_id IS NOT NULL GROUP BY 1, 2", "usage1"),
    "agg32_usage_by_status": sql("SELECT provider, model, status, count(*) AS calls, CAST(sum(estimated_cost_usd) AS DECIMAL(38, 6)) AS cost FROM usage1 GROUP BY 1, 2, 3", "usage1"),
    "agg33_latency_spread": sql("SELECT provider, model, count(*) AS calls, min(latency_ms) AS least, max(latency_ms) AS most, round_even(sum(latency_ms)::DOUBLE / count(*), 4) AS mean, count(*) FILTER (status = 'failed') AS failed FROM usage1 WHERE latency_ms IS NOT NULL GROUP BY 1, 2", "usage1"),
    "prd17_usage_last_30_days": sql(f""", w AS (SELECT * FROM usage1 WHERE CAST(created_at AS DATE) >= (SELECT max(CAST(created_at AS DATE)) - 29 FROM ai_usage_logs)),
        t AS (SELECT task_type, {_TOTALS} FROM w GROUP BY task_type), f AS ({_failed('task_type').replace('usage1', 'w')})
        SELECT t.*, coalesce(f.failed_requests, 0) AS failed_requests FROM t LEFT JOIN f ON t.task_type IS NOT DISTINCT FROM f.task_type""", "usage1"),
    "joi15_usage_by_organization": sql(f", t AS (SELECT organization_id, {_TOTALS} FROM usage1 GROUP BY 1) SELECT organization_id, name AS label, cost, requests FROM t JOIN organizations USING (organization_id)", "usage1"),
    "joi16_recent_failures": sql("SELECT usage_id, slug AS organization, provider, model, status, error_message, u.created_at FROM usage1 u JOIN organizations o USING (organization_id) WHERE status IN ('failed', 'blocked') ORDER BY u.created_at DESC, usage_id DESC LIMIT 25", "usage1"),
    "sca91_filled_days": sql(f""", t AS (SELECT CAST(created_at AS DATE) AS period, {_TOTALS} FROM usage1 GROUP BY 1), days AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE) AS period FROM t)
        SELECT period, coalesce(cost, 0)::DECIMAL(38, 6) AS cost, coalesce(requests, 0) AS requests FROM days LEFT JOIN t USING (period)""", "usage1"),
    "ret7_running_spend": sql("SELECT usage_id, organization_id, CAST(date_trunc('month', created_at) AS DATE) AS month, CAST(coalesce(sum(estimated_cost_usd) OVER (PARTITION BY organization_id, date_trunc('month', created_at) ORDER BY created_at, usage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(38, 6)) AS spent_before FROM usage1", "usage1"),
    "ret14_failure_runs": sql(""", r AS (SELECT *, CAST(created_at AS DATE) AS day, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY provider, model, CAST(created_at AS DATE) ORDER BY created_at, usage_id ROWS UNBOUNDED PRECEDING) AS run FROM usage1)
        SELECT provider, model, day, min(created_at) AS started, max(created_at) AS ended, count(*) AS length FROM r WHERE status = 'failed' GROUP BY provider, model, day, run""", "usage1"),
    "ret8_attempt_order": sql("SELECT usage_id, request_id, CAST(row_number() OVER w AS INT) AS attempt, lead(status) OVER w AS next_status FROM usage1 WINDOW w AS (PARTITION BY request_id ORDER BY created_at, usage_id)", "usage1"),
    "ext_usage_rollup": sql(""", g AS (SELECT provider, model, task_type, request_id, sum(estimated_cost_usd) AS cost FROM usage1 GROUP BY 1, 2, 3, 4)
        SELECT provider, model, task_type, CAST(sum(cost) AS DECIMAL(38, 6)) AS cost, grouping_id(provider, model, task_type) AS level, count(*) AS request_groups FROM g GROUP BY ROLLUP (provider, model, task_type)""", "usage1"),
}
