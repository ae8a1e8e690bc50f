"""The tables as the operators see them, in Spark and as the same views in SQL.

Rows delivered twice count once: a filing and a paragraph by their last ingestion, an extraction by its last creation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.sources.tables import table


def latest(df: DataFrame, key: str, *by: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key: a partial aggregation, whatever the number of deliveries.

    Only `columns` (all if none are named) are read and sent; name what a query needs.
    """
    keep = [c for c in columns or df.columns if c != key]
    rows = df.select(key, *dict.fromkeys([*keep, *by]))
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*by)).alias("r")).select(key, "r.*")


def filings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "filings"), "document_id", "ingested_at", columns=columns)


def paragraphs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "blocks"), "block_id", "ingested_at", columns=columns)


def extractions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "extracted"), "extracted_id", "created_at", columns=columns)


def mentions(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Every extraction of a known filing, with its filing's dates and its entity's key; `more`: confidence, quote, description."""
    f = filings(spark, d, "cik", "accession", "form_type", "filed_at")
    e = extractions(spark, d, "document_id", "paragraph_id", "name", "entity_type", *more).withColumnRenamed("extracted_id", "mention_id")
    return e.join(f, "document_id").withColumn("slug", T.slug(F.col("name")))


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections")


VIEWS = {
    "fil": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC) AS rn FROM filings) WHERE rn = 1",
    "par": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) AS rn FROM blocks) WHERE rn = 1",
    "ext": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY extracted_id ORDER BY created_at DESC) AS rn FROM extracted) WHERE rn = 1",
    "men": "SELECT e.extracted_id AS mention_id, e.document_id, f.cik, f.accession, f.form_type, f.filed_at, e.paragraph_id, e.name, e.entity_type, e.confidence, e.quote, e.description,"
    " regexp_replace(regexp_replace(lower(trim(e.name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM ext e JOIN fil f USING (document_id)",
    "ent": "SELECT cik, slug, arg_min(name, (filed_at, mention_id)) AS name, arg_min(entity_type, (filed_at, mention_id)) AS entity_type, count(*) AS mention_count,"
    " count(DISTINCT document_id) AS documents, min(filed_at) AS first_seen, max(filed_at) AS latest_seen FROM men GROUP BY cik, slug",
    "usage1": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY usage_id ORDER BY received_at DESC) AS rn FROM ai_usage_logs) WHERE rn = 1",
}
NEEDS = {"men": ("ext", "fil"), "ent": ("ext", "fil", "men")}


def sql(body: str, *views: str) -> str:
    """A statement over the named views; `body` may go on with further common tables after a leading comma."""
    wanted: list[str] = []
    for v in views:
        wanted += [x for x in (*NEEDS.get(v, ()), v) if x not in wanted]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {head}{body}"
    return f"WITH {head} {body}" if head else body


def entities_of(m: DataFrame) -> DataFrame:
    """One row per company and key: name and type of the first mention, counts, span."""
    first = F.struct("filed_at", "mention_id")
    return m.groupBy("cik", "slug").agg(
        F.min_by("name", first).alias("name"), F.min_by("entity_type", first).alias("entity_type"), F.count("*").alias("mention_count"),
        F.count_distinct("document_id").alias("documents"), F.min("filed_at").alias("first_seen"), F.max("filed_at").alias("latest_seen"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    return entities_of(mentions(spark, d))


def usage(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "ai_usage_logs"), "usage_id", "received_at", columns=columns)
