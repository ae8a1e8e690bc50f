"""The relationship graph of each company's entities: edges, degrees, importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of an entity's importance and the half-life of its recency in days.
WEIGHTS = {"frequency": 0.35, "spread": 0.25, "recency": 0.20, "centrality": 0.20}
HALF_LIFE = 540
TOGETHER = "mentioned_with"


def co_occurrence(mentions: DataFrame, min_shared: int = 1) -> DataFrame:
    """Pairs of a company's entities cited in the same filings: weight, the filings, span of both.

    Pairs arise within one filing's distinct entities only, never over all entities of a company.
    """
    cited = mentions.select("cik", "document_id", "slug").distinct()
    span = mentions.groupBy("cik", "slug").agg(F.min("filed_at").alias("first"), F.max("filed_at").alias("last"))
    a, b = cited.withColumnRenamed("slug", "source"), cited.withColumnRenamed("slug", "target")
    pairs = a.join(b, ["cik", "document_id"]).where(F.col("source") < F.col("target"))
    edges = pairs.groupBy("cik", "source", "target").agg(F.count("*").alias("weight"), F.sort_array(F.collect_set("document_id")).alias("documents")).where(F.col("weight") >= min_shared)
    side = lambda at: span.select("cik", F.col("slug").alias(at), F.col("first").alias(f"first_{at}"), F.col("last").alias(f"last_{at}"))
    edges = edges.join(side("source"), ["cik", "source"]).join(side("target"), ["cik", "target"])
    return edges.select("cik", "source", "target", F.lit(TOGETHER).alias("relationship"), "weight", "documents", F.least("first_source", "first_target").alias("first_seen"), F.greatest("last_source", "last_target").alias("last_seen"))


def asserted(links: DataFrame, known: DataFrame) -> DataFrame:
    """Edges stated in the text, folded: both ends known, none to itself; weight is the number of filings."""
    ends = known.select("cik", "slug")
    rows = links.where(F.col("source") != F.col("target"))
    for end in ("source", "target"):
        rows = rows.join(ends.withColumnRenamed("slug", end), ["cik", end], "left_semi")
    return rows.groupBy("cik", "source", "target", "relationship").agg(
        F.count_distinct("document_id").alias("weight"), F.sort_array(F.collect_set("document_id")).alias("documents"), F.min("filed_at").alias("first_seen"), F.max("filed_at").alias("last_seen")
    ).select("cik", "source", "target", "relationship", "weight", "documents", "first_seen", "last_seen")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select("cik", F.explode(F.array("source", "target")).alias("slug")).groupBy("cik", "slug").agg(F.count("*").alias("degree"))


def with_strength(edges: DataFrame) -> DataFrame:
    """Weight relative to the company's strongest edge, 4 digits."""
    most = edges.groupBy("cik").agg(F.max("weight").alias("most"))
    return edges.join(most, "cik").withColumn("strength", F.bround(F.least(F.lit(1.0), F.col("weight") / F.col("most")), 4)).drop("most")


def _part(value: Column) -> Column:
    return F.bround(value, 4)


def scored(entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with their degree, the four parts of their importance and the score from 0 to 100."""
    totals = mentions.groupBy("cik").agg(F.count_distinct("document_id").alias("total_documents"), F.max("filed_at").alias("newest"))
    rows = entities.join(degrees(edges), ["cik", "slug"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    most = rows.groupBy("cik").agg(F.max("mention_count").alias("most_mentions"), F.max("degree").alias("most_degree"))
    rows = rows.join(totals, "cik").join(most, "cik")
    days = F.greatest(F.lit(0), F.datediff("newest", "latest_seen"))
    rows = rows.withColumns({
        "frequency": _part(F.log1p(F.col("mention_count").cast("double")) / F.log1p(F.col("most_mentions").cast("double"))),
        "spread": _part(F.least(F.lit(1.0), F.col("documents") / F.col("total_documents"))),
        "recency": _part(F.when(F.col("latest_seen").isNull(), 0.0).otherwise(F.pow(F.lit(0.5), days / F.lit(float(HALF_LIFE))))),
        "centrality": _part(F.when(F.col("most_degree") > 0, F.col("degree") / F.col("most_degree")).otherwise(0.0)),
    })
    total = sum((F.lit(w) * F.col(p) for p, w in list(WEIGHTS.items())[1:]), F.lit(WEIGHTS["frequency"]) * F.col("frequency"))
    return rows.withColumn("importance", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total * 100, 0).cast("int")))).drop("most_mentions", "most_degree", "total_documents", "newest")


def nodes(scores: DataFrame, min_importance: int = 0, limit: int | None = None) -> DataFrame:
    """Each company's nodes from a least importance up, or its `limit` most important."""
    rows = scores.where(F.col("importance") >= min_importance)
    if limit:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("importance"), "slug"))).where(F.col("place") <= limit).drop("place")
    return rows.select("cik", F.col("slug").alias("id"), F.col("name").alias("label"), F.col("entity_type").alias("type"), "importance", F.col("mention_count").alias("mentions"))


def kept_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges, with their strength among all edges, of which both ends are kept."""
    rows = with_strength(edges)
    for end in ("source", "target"):
        rows = rows.join(kept.select("cik", F.col("id").alias(end)), ["cik", end], "left_semi")
    return rows.select("cik", "source", "target", "relationship", "strength")


def contract(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One JSON document per company with its nodes and edges in display order.

    A document is one row: give it nodes that `nodes` has limited, and the edges between them, whose number that bounds.
    """
    n = node_rows.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "id", "label", "type", "importance", "mentions"))).alias("n"))
    e = edge_rows.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("o"), "source", "target", "relationship", "strength"))).alias("e"))
    rows = n.join(e, "cik", "left")
    return rows.select("cik", F.to_json(F.struct(
        F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["type"].alias("type"), x["importance"].alias("importance"), x["mentions"].alias("mentions"))).alias("nodes"),
        F.coalesce(F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["relationship"].alias("relationship"), x["strength"].alias("strength"))), F.array()).alias("edges"),
    )).alias("graph"))
