"""Queries of the training-data problems, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import consistent, leaks, mixing, nearcopies, percentiles, splitting
from tallyfold.sources.tables import table


def merged_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per task from states computed apart: the days of each half month, put together."""
    logs = table(spark, d, "ai_usage_logs")
    rows = percentiles.once(logs.select("usage_id", "received_at", "task_type", F.to_date("created_at").alias("day"), "latency_ms"), "usage_id", "received_at", ["task_type", "day", "latency_ms"])
    apart = [percentiles.state(part, ["task_type"], {"latency_ms": F.col("latency_ms")}) for part in (rows.where("day(day) <= 15"), rows.where("day(day) > 15 or day is null"))]
    out = percentiles.bisected(percentiles.merged(*apart), ["task_type"])
    return out.select("task_type", (F.col("per_mille") / 1000).alias("percentile"), F.col("n").alias("rows"), F.col("v").alias("latency_ms"))


def coarse_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles within a stated error of 50 ms and 0.0001 dollars per task."""
    out = percentiles.usage_percentiles(table(spark, d, "ai_usage_logs"), {"latency_ms": 50, "estimated_cost_usd": 100})
    return out.where("all_days").drop("day", "all_days")


QUERIES = {
    "p2_percentiles": lambda spark, d: percentiles.usage_percentiles(table(spark, d, "ai_usage_logs")),
    "p2_merged": merged_percentiles,
    "p2_coarse": coarse_percentiles,
    "p3_found": lambda spark, d: splitting.found(table(spark, d, "blocks"), table(spark, d, "sections")),
    "p3_pieces": lambda spark, d: splitting.paragraph_pieces(table(spark, d, "blocks"), table(spark, d, "sections")),
    "p4_found": lambda spark, d: nearcopies.found(table(spark, d, "blocks")),
    "p4_classes": lambda spark, d: nearcopies.classes_and_links(table(spark, d, "blocks")),
    "p4_pairs": lambda spark, d: nearcopies.class_pairs(table(spark, d, "blocks")),
    "p6_found": lambda spark, d: leaks.found(table(spark, d, "documents"), table(spark, d, "eval_passages")),
    "p6_leaks": lambda spark, d: leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_passages")).distinct(),
    "p7_mix": lambda spark, d: mixing.mixed(table(spark, d, "documents"), table(spark, d, "source_targets"))[0],
    "p7_shares": lambda spark, d: mixing.shares(*mixing.mixed(table(spark, d, "documents"), table(spark, d, "source_targets"))),
    "p8_found": lambda spark, d: consistent.found(table(spark, d, "documents")),
    "p8_consistent": lambda spark, d: consistent.consistent(table(spark, d, "documents"), "doc_id", "text"),
}

_ONCE = """
  SELECT * FROM (
    SELECT usage_id, task_type, CAST(created_at AS DATE) AS day, latency_ms, estimated_cost_usd, row_number() OVER (PARTITION BY usage_id ORDER BY received_at DESC) AS rn FROM ai_usage_logs
  ) WHERE rn = 1
"""

_SIMILAR = r"""once AS (
  SELECT block_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) = 1
), grams AS (
  SELECT DISTINCT block_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT block_id, w, unnest(range(1, len(w) - 1)) AS i FROM once WHERE len(w) >= 20)
), sizes AS (SELECT block_id, count(*) AS n FROM grams GROUP BY 1), shared AS (
  SELECT a.block_id AS x, b.block_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.block_id < b.block_id GROUP BY 1, 2
), alike AS (SELECT x, y, c, p.n AS nx, q.n AS ny FROM shared JOIN sizes p ON p.block_id = x JOIN sizes q ON q.block_id = y WHERE 10 * c >= 6 * (p.n + q.n - c))"""

SQL: dict[str, str] = {
    "p2_percentiles": f"""
WITH once AS ({_ONCE}), vals AS (
  SELECT task_type, day, 'latency_ms' AS measure, CAST(latency_ms AS DOUBLE) AS v FROM once WHERE latency_ms IS NOT NULL
  UNION ALL SELECT task_type, day, 'estimated_cost_usd', CAST(estimated_cost_usd AS DOUBLE) FROM once WHERE estimated_cost_usd IS NOT NULL
), grp AS (
  SELECT task_type, day, false AS all_days, measure, v FROM vals
  UNION ALL SELECT task_type, NULL, true, measure, v FROM vals
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task_type, day, all_days, measure ORDER BY v) AS rn, count(*) OVER (PARTITION BY task_type, day, all_days, measure) AS n FROM grp
), ps AS (SELECT unnest([500, 900, 950, 990]) AS pm)
SELECT task_type, day, all_days, measure, pm / 1000.0::DOUBLE AS percentile, n AS "rows", v AS value, 0.0::DOUBLE AS error
FROM ranked JOIN ps ON rn = greatest((n * pm + 999) // 1000, 1)
""",
    "p2_merged": f"""
WITH ranked AS (
  SELECT task_type, CAST(latency_ms AS BIGINT) AS v, row_number() OVER (PARTITION BY task_type ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY task_type) AS n
  FROM ({_ONCE}) WHERE latency_ms IS NOT NULL
), ps AS (SELECT unnest([500, 900, 950, 990]) AS pm)
SELECT task_type, pm / 1000.0::DOUBLE AS percentile, n AS "rows", v AS latency_ms FROM ranked JOIN ps ON rn = greatest((n * pm + 999) // 1000, 1)
""",
    "p4_found": f"""
WITH {_SIMILAR}
SELECT x AS block_id_a, y AS block_id_b FROM alike
""",
    "p4_classes": f"""
WITH {_SIMILAR}, sets AS (SELECT block_id, string_agg(g, '|' ORDER BY g) AS s FROM grams GROUP BY 1), classes AS (SELECT block_id, min(block_id) OVER (PARTITION BY s) AS class_id FROM sets),
links AS (SELECT c.class_id, count(*) AS links FROM (SELECT x, y FROM alike UNION ALL SELECT y, x FROM alike) p JOIN classes c ON c.block_id = x AND c.class_id = x JOIN classes k ON k.block_id = y AND k.class_id = y GROUP BY 1)
SELECT block_id, class_id, coalesce(links, 0) AS links FROM classes LEFT JOIN links USING (class_id)
""",
    "p4_pairs": f"""
WITH {_SIMILAR}, sets AS (SELECT block_id, string_agg(g, '|' ORDER BY g) AS s FROM grams GROUP BY 1), leads AS (SELECT min(block_id) AS block_id FROM sets GROUP BY s)
SELECT x AS class_a, y AS class_b, round(c::DOUBLE / (nx + ny - c), 6) AS similarity FROM alike JOIN leads a ON a.block_id = x JOIN leads b ON b.block_id = y
""",
    "p3_found": "SELECT DISTINCT accession, paragraph_id FROM blocks WHERE length(text) > 2400",
}
