"""Further rows of the inventory: lookups, predicates, folds and orders, each small."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import evidence as EV
from tallyfold.operators import graph as G
from tallyfold.operators import merge as M
from tallyfold.operators import timeline as TL
from tallyfold.plans.derived import _CHANGES, _CO, _EDGES, _TYPED, FILED, _edges, _links, _listed
from tallyfold.plans.memory import _MET, _metrics, _observed
from tallyfold.plans.model import entities, extractions, filings, mentions, paragraphs, sql, table, usage

#: The kinds' colours in reading views, and the one for others.
COLOURS = {"company": "#60a5fa", "executive": "#f472b6", "geography": "#22d3ee", "metric": "#fbbf24", "product": "#a78bfa", "risk": "#f87171", "segment": "#fb923c", "strategy": "#34d399"}
OTHER_COLOUR = "#34d399"


def _first_of_kind(s, d):
    return mentions(s, d).groupBy("cik", "slug").agg(F.min_by("mention_id", F.struct("filed_at", "mention_id")).alias("survivor"), F.count_distinct("entity_type").alias("kinds"))


def _survivors(s, d):
    """Every mention beside the id that its entity keeps."""
    w = Window.partitionBy("cik", "slug").orderBy("mention_id")
    return mentions(s, d).select("mention_id", F.first("mention_id").over(w).alias("survivor"))


def _reading(s, d):
    """Mentions of a filing's topic in reading order."""
    order = T.reading_order(F.col("paragraph_id"), F.lit(None).cast("int"), F.lit(0))
    w = Window.partitionBy("document_id", "slug").orderBy("o", "mention_id")
    return mentions(s, d).withColumn("o", order).select("mention_id", "document_id", "slug", F.row_number().over(w).alias("place"))


def _pages_null_last(s, d):
    return paragraphs(s, d, "document_id", "page_number").select("document_id", "page_number").distinct().orderBy("document_id", F.col("page_number").asc_nulls_last())


def _events_once(s, d):
    rows = TL.events(filings(s, d, *FILED), mentions(s, d)).select("cik", "kind", F.concat_ws(":", "accession", "slug").alias("ref"), F.col("filed_at").alias("at"), "key")
    return M.inserted_if_absent(rows.unionByName(rows), ["cik", "kind", "ref", "at"], ["key"])


def _relationships(s, d):
    """Stated edges as a merge of writes, one per filing and edge."""
    w = _links(s, d).select("cik", "source", "target", "relationship", "document_id", "filed_at").distinct().where("source <> target")
    w = w.withColumns({"documents": F.col("document_id"), "first_seen": F.col("filed_at"), "last_seen": F.col("filed_at")})
    return _listed(M.upserted(w, ["cik", "source", "target", "relationship"], ["filed_at", "document_id"], {"documents": "set", "first_seen": "least", "last_seen": "greatest"}, "writes"))


def _neighbours(s, d):
    e = _edges(s, d)
    both = e.select("cik", F.col("source").alias("slug"), F.col("target").alias("other")).unionByName(e.select("cik", F.col("target").alias("slug"), F.col("source").alias("other")))
    return both.groupBy("cik", "slug").agg(F.count_distinct("other").alias("neighbours"))


def _company_summary(s, d):
    f = filings(s, d, *FILED).groupBy("cik").agg(F.count("*").alias("documents"), F.min("filed_at").alias("first_filed"), F.max("filed_at").alias("last_filed"))
    e = entities(s, d).groupBy("cik").agg(F.count("*").alias("entities"), F.sum("mention_count").alias("mentions"))
    return f.join(e, "cik", "full_outer").select("cik", "documents", "first_filed", "last_filed", "entities", "mentions")


def _quality(s, d):
    """Constraints of the tables as counts of rows that break them."""
    x, f, u = extractions(s, d, "confidence", "entity_type"), filings(s, d, "page_count"), usage(s, d, "input_tokens", "output_tokens", "cached_tokens", "estimated_cost_usd")
    checks = [
        ("confidence", x.where("confidence is null or confidence < 0 or confidence > 1")), ("entity_type", x.where(~F.coalesce(F.col("entity_type").isin(*COLOURS), F.lit(False)))),
        ("page_count", f.where("page_count < 1")), ("tokens", u.where("input_tokens < 0 or output_tokens < 0 or cached_tokens > input_tokens")), ("cost", u.where("estimated_cost_usd < 0")),
    ]
    out = None
    for name, rows in checks:
        one = rows.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken")
        out = one if out is None else out.unionByName(one)
    return out


def _search_text(s, d):
    """Paragraphs of periodic filings that speak of a topic of their own company by name."""
    top = entities(s, d).where("mention_count >= 3").select("cik", "slug", "name")
    p = paragraphs(s, d, "document_id", "text").join(filings(s, d, *FILED).where(F.col("form_type").isin(*TL.PERIODIC)).select("document_id", "cik"), "document_id")
    return EV.names_in(p.select("block_id", "cik", "text"), top, "block_id")


def _redacted(s, d):
    """Error messages without what looks like a key or an address."""
    m = F.regexp_replace("error_message", r"[A-Za-z0-9_-]{24,}", "[redacted]")
    m = F.regexp_replace(m, r"[\w.+-]+@[\w-]+\.[\w.]+", "[address]")
    return usage(s, d, "error_message").where("error_message is not null").select("usage_id", F.substring(m, 1, 500).alias("message"))


def _mention_spans(s, d):
    e = extractions(s, d, "document_id", "paragraph_id", "quote").where("quote is not null").select("extracted_id", "document_id", "paragraph_id", "quote")
    p = paragraphs(s, d, "document_id", "paragraph_id", "text").groupBy("document_id", "paragraph_id").agg(F.min_by("text", "block_id").alias("text"))
    return e.join(p, ["document_id", "paragraph_id"]).select("extracted_id", F.instr("text", F.col("quote")).alias("at"), F.length("quote").alias("length"))


def _role_on(s, d):
    """The organization's plan row in force when a request was made: an interval join on open-ended spans, first span that fits."""
    o = table(s, d, "organizations").select("organization_id", F.to_date("created_at").alias("since"), F.lit(None).cast("date").alias("until"), "monthly_tokens")
    u = usage(s, d, "organization_id", "created_at").select("usage_id", "organization_id", F.to_date("created_at").alias("day"))
    return u.join(o, "organization_id").where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") <= F.col("until")))).select("usage_id", "organization_id", "monthly_tokens")


def _prefix_edges(s, d):
    """Edges of the graph as of a date: both ends seen by then."""
    early = entities(s, d).where(F.col("first_seen") <= F.lit("2020-12-31").cast("date")).select("cik", "slug")
    e = _edges(s, d).select("cik", "source", "target", "relationship")
    return e.join(early.withColumnRenamed("slug", "source"), ["cik", "source"], "left_semi").join(early.withColumnRenamed("slug", "target"), ["cik", "target"], "left_semi")


QUERIES = {
    "win1_survivors": _survivors,
    "agg48_merged_kinds": _first_of_kind,
    "win5_reading_order": _reading,
    "win13_restated": lambda s, d: _observed(s, d).where("restated").select("mention_id", "cik", "metric", "period"),
    "agg44_series": lambda s, d: _observed(s, d).groupBy("cik", "metric").agg(F.count("*").alias("points"), F.count_distinct("period").alias("periods"), F.min("filed_at").alias("first"), F.max("filed_at").alias("last")),
    "prj27_metric_rows": lambda s, d: _metrics(s, d).select("mention_id", "cik", "document_id", "metric", "period", "value", "unit"),
    "srt10_event_log": lambda s, d: TL.events(filings(s, d, *FILED), mentions(s, d)).orderBy(F.desc("filed_at"), "key").limit(50).select("key", "filed_at"),
    "srt12_pages_null_last": _pages_null_last,
    "srt14_pending_paragraphs": lambda s, d: paragraphs(s, d, "document_id", "page_number").where("page_number is null").orderBy("block_id").limit(500).select("block_id", "document_id"),
    "srt18_events_with_total": lambda s, d: TL.changes(filings(s, d, *FILED), mentions(s, d)).groupBy("cik").agg(F.count("*").alias("total"), F.max("filed_at").alias("newest")),
    "snk9_relationship_upsert": _relationships,
    "snk10_events_once": _events_once,
    "joi2_citation_rows": lambda s, d: mentions(s, d).join(table(s, d, "companies").select("cik", F.col("name").alias("company")), "cik").select("mention_id", "company", "accession", "paragraph_id"),
    "joi5_entities_with_mentions": lambda s, d: table(s, d, "companies").select("cik").join(entities(s, d), "cik", "left").groupBy("cik").agg(F.count("slug").alias("entities"), F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mentions")),
    "joi10_topic_mentions": lambda s, d: mentions(s, d).join(entities(s, d).select("cik", "slug", F.col("entity_type").alias("kind")), ["cik", "slug"]).select("mention_id", "slug", "kind"),
    "joi26_interval_join": _role_on,
    "joi33_first_duplicates": lambda s, d: paragraphs(s, d, "text").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("block_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1"),
    "agg10_documents_of_entities": lambda s, d: mentions(s, d).groupBy("cik", "slug").agg(F.array_join(F.transform(F.sort_array(F.collect_set("document_id")), lambda x: x.cast("string")), ",").alias("documents")),
    "agg13_company_summary": _company_summary,
    "agg17_event_kinds": lambda s, d: TL.changes(filings(s, d, *FILED), mentions(s, d)).groupBy("kind").agg(F.count("*").alias("n")),
    "agg18_neighbours": _neighbours,
    "agg29_parse_stats": lambda s, d: paragraphs(s, d, "accession", "page_number", "text").groupBy("accession").agg(F.count("*").alias("paragraphs"), F.max("page_number").alias("pages"), F.sum(F.length("text")).alias("characters")),
    "agg42_memory_counts": lambda s, d: entities(s, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("mention_count").alias("mentions")),
    "gra14_edges_as_of": _prefix_edges,
    "prd11_on_page": lambda s, d: paragraphs(s, d, "paragraph_id", "page_number").where(T.paragraph_page(F.col("paragraph_id"), F.col("page_number")) == 3).select("block_id"),
    "prd12_recent_changes": lambda s, d: TL.changes(filings(s, d, *FILED), mentions(s, d)).where("filed_at >= date '2022-01-01' and kind in ('newly_disclosed', 'expanded')").select("accession", "slug", "kind"),
    "prd13_active_risks": lambda s, d: entities(s, d).where("entity_type = 'risk'").select("cik", "slug", "mention_count"),
    "prd29_constraints": _quality,
    "sca16_paragraph_keys": lambda s, d: mentions(s, d).select("mention_id", F.coalesce(T.base_paragraph(F.col("paragraph_id")), F.concat(F.lit("mention:"), F.col("mention_id").cast("string"))).alias("key")),
    "sca23_quote_places": _mention_spans,
    "sca34_colours": lambda s, d: mentions(s, d).select("mention_id", T.looked_up(COLOURS, F.col("entity_type"), F.lit(OTHER_COLOUR)).alias("colour")),
    "sca38_names_in_text": _search_text,
    "sca49_event_keys": lambda s, d: TL.events(filings(s, d, *FILED), mentions(s, d)).select("key"),
    "sca66_redacted": _redacted,
    "gra2_undirected": lambda s, d: G.co_occurrence(mentions(s, d), min_shared=2).select("cik", "source", "target", "weight"),
}

SQL = {
    "win1_survivors": sql("SELECT mention_id, first_value(mention_id) OVER (PARTITION BY cik, slug ORDER BY mention_id) AS survivor FROM men", "men"),
    "agg48_merged_kinds": sql("SELECT cik, slug, arg_min(mention_id, (filed_at, mention_id)) AS survivor, count(DISTINCT entity_type) AS kinds FROM men GROUP BY 1, 2", "men"),
    "win5_reading_order": sql(r", m AS (SELECT *, CASE WHEN regexp_matches(paragraph_id, '^\d+_\d+(#\d+)?$') THEN 0 ELSE 1 END AS o1 FROM men), o AS (SELECT *, CASE WHEN o1 = 0 THEN TRY_CAST(split_part(paragraph_id, '_', 1) AS INT) ELSE 0 END AS o2, CASE WHEN o1 = 0 THEN TRY_CAST(split_part(split_part(paragraph_id, '_', 2), '#', 1) AS INT) ELSE 0 END AS o3 FROM m) SELECT mention_id, document_id, slug, CAST(row_number() OVER (PARTITION BY document_id, slug ORDER BY o1, o2, o3, mention_id) AS INT) AS place FROM o", "men"),
    "win13_restated": sql(_MET + " SELECT mention_id, cik, metric, period FROM obs WHERE restated", "men"),
    "agg44_series": sql(_MET + " SELECT cik, metric, count(*) AS points, count(DISTINCT period) AS periods, min(filed_at) AS first, max(filed_at) AS last FROM obs GROUP BY 1, 2", "men"),
    "prj27_metric_rows": sql(_MET + " SELECT mention_id, cik, document_id, metric, period, value, unit FROM met", "men"),
    "srt10_event_log": sql(_CHANGES + " SELECT key, filed_at FROM ev ORDER BY filed_at DESC, key LIMIT 50", "men"),
    "srt12_pages_null_last": sql("SELECT DISTINCT document_id, page_number FROM par ORDER BY document_id, page_number NULLS LAST", "par"),
    "srt14_pending_paragraphs": sql("SELECT block_id, document_id FROM par WHERE page_number IS NULL ORDER BY block_id LIMIT 500", "par"),
    "srt18_events_with_total": sql(_CHANGES + " SELECT cik, count(*) AS total, max(filed_at) AS newest FROM chg GROUP BY 1", "men"),
    "snk9_relationship_upsert": sql(_TYPED + " SELECT cik, source, target, relationship, array_to_string(list_sort(list(DISTINCT document_id)), ',') AS documents, min(filed_at) AS first_seen, max(filed_at) AS last_seen, count(*) AS writes FROM links WHERE source <> target GROUP BY 1, 2, 3, 4", "men"),
    "snk10_events_once": sql(_CHANGES + " SELECT DISTINCT cik, kind, concat_ws(':', accession, slug) AS ref, filed_at AS at, key FROM ev", "men"),
    "joi2_citation_rows": sql("SELECT mention_id, c.name AS company, accession, paragraph_id FROM men JOIN companies c USING (cik)", "men"),
    "joi5_entities_with_mentions": sql("SELECT c.cik, count(slug) AS entities, coalesce(sum(mention_count), 0)::BIGINT AS mentions FROM companies c LEFT JOIN ent ON ent.cik = c.cik GROUP BY 1", "ent"),
    "joi10_topic_mentions": sql("SELECT mention_id, men.slug, ent.entity_type AS kind FROM men JOIN ent ON ent.cik = men.cik AND ent.slug = men.slug", "ent"),
    "joi26_interval_join": sql("SELECT usage_id, u.organization_id, monthly_tokens FROM usage1 u JOIN organizations o ON o.organization_id = u.organization_id AND CAST(o.created_at AS DATE) <= CAST(u.created_at AS DATE)", "usage1"),
    "joi33_first_duplicates": sql("SELECT sha256(text) AS hash, min(block_id) AS kept, count(*) AS copies FROM par GROUP BY 1 HAVING count(*) > 1", "par"),
    "agg10_documents_of_entities": sql("SELECT cik, slug, array_to_string(list_sort(list(DISTINCT document_id)), ',') AS documents FROM men GROUP BY 1, 2", "men"),
    "agg13_company_summary": sql(", f AS (SELECT cik, count(*) AS documents, min(filed_at) AS first_filed, max(filed_at) AS last_filed FROM fil GROUP BY 1), e AS (SELECT cik, count(*) AS entities, sum(mention_count)::BIGINT AS mentions FROM ent GROUP BY 1) SELECT cik, documents, first_filed, last_filed, entities, mentions FROM f FULL JOIN e USING (cik)", "ent"),
    "agg17_event_kinds": sql(_CHANGES + " SELECT kind, count(*) AS n FROM chg GROUP BY 1", "men"),
    "agg18_neighbours": sql(_EDGES + " SELECT cik, slug, count(DISTINCT other) AS neighbours FROM (SELECT cik, source AS slug, target AS other FROM edges UNION ALL SELECT cik, target, source FROM edges) GROUP BY 1, 2", "men", "ent"),
    "agg29_parse_stats": sql("SELECT accession, count(*) AS paragraphs, max(page_number) AS pages, sum(length(text))::BIGINT AS characters FROM par GROUP BY 1", "par"),
    "agg42_memory_counts": sql("SELECT entity_type, count(*) AS n, sum(mention_count)::BIGINT AS mentions FROM ent GROUP BY 1", "ent"),
    "gra14_edges_as_of": sql(_EDGES + " SELECT e.cik, source, target, relationship FROM edges e JOIN ent a ON a.cik = e.cik AND a.slug = source AND a.first_seen <= DATE '2020-12-31' JOIN ent b ON b.cik = e.cik AND b.slug = target AND b.first_seen <= DATE '2020-12-31'", "men", "ent"),
    "prd11_on_page": sql("SELECT block_id FROM par WHERE coalesce(CASE WHEN TRY_CAST(split_part(split_part(paragraph_id, '#', 1), '_', 1) AS INT) > 0 THEN TRY_CAST(split_part(split_part(paragraph_id, '#', 1), '_', 1) AS INT) END, page_number) = 3", "par"),
    "prd12_recent_changes": sql(_CHANGES + " SELECT accession, slug, kind FROM chg WHERE filed_at >= DATE '2022-01-01' AND kind IN ('newly_disclosed', 'expanded')", "men"),
    "prd13_active_risks": sql("SELECT cik, slug, mention_count FROM ent WHERE entity_type = 'risk'", "ent"),
    "prd29_constraints": sql("SELECT 'confidence' AS rule, count(*) FILTER (confidence IS NULL OR confidence < 0 OR confidence > 1) AS broken FROM ext UNION ALL SELECT 'entity_type', count(*) FILTER (NOT coalesce(entity_type IN ('company', 'executive', 'geography', 'metric', 'product', 'risk', 'segment', 'strategy'), false)) FROM ext"
        " UNION ALL SELECT 'page_count', count(*) FILTER (page_count < 1) FROM fil UNION ALL SELECT 'tokens', count(*) FILTER (input_tokens < 0 OR output_tokens < 0 OR cached_tokens > input_tokens) FROM usage1 UNION ALL SELECT 'cost', count(*) FILTER (estimated_cost_usd < 0) FROM usage1", "ext", "fil", "usage1"),
    "sca16_paragraph_keys": sql("SELECT mention_id, coalesce(split_part(paragraph_id, '#', 1), 'mention:' || mention_id) AS key FROM men", "men"),
    "sca23_quote_places": sql(", p AS (SELECT document_id, paragraph_id, arg_min(text, block_id) AS text FROM par GROUP BY 1, 2) SELECT extracted_id, CAST(instr(text, quote) AS INT) AS at, CAST(length(quote) AS INT) AS length FROM ext JOIN p USING (document_id, paragraph_id) WHERE quote IS NOT NULL", "ext", "par"),
    "sca34_colours": sql("SELECT mention_id, CASE " + " ".join(f"WHEN entity_type = '{k}' THEN '{v}'" for k, v in COLOURS.items()) + f" ELSE '{OTHER_COLOUR}' END AS colour FROM men", "men"),
    "sca38_names_in_text": sql(r", w AS (SELECT block_id, cik, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM par JOIN fil USING (document_id) WHERE form_type IN ('10-K', '10-Q', '20-F', '40-F')), n AS (SELECT cik, slug, array_to_string(regexp_extract_all(lower(name), '[\p{L}\p{N}_]+'), ' ') AS q FROM ent WHERE mention_count >= 3) SELECT block_id, slug FROM w JOIN n USING (cik) WHERE q <> '' AND contains(t, ' ' || q || ' ')", "ent", "par"),
    "sca49_event_keys": sql(_CHANGES + " SELECT key FROM ev", "men"),
    "sca66_redacted": sql(r"SELECT usage_id, substr(regexp_replace(regexp_replace(error_message, '[A-Za-z0-9_-]{24,}', '[redacted]', 'g'), '[\w.+-]+@[\w-]+\.[\w.]+', '[address]', 'g'), 1, 500) AS message FROM usage1 WHERE error_message IS NOT NULL", "usage1"),
    "gra2_undirected": sql(_CO + " SELECT cik, source, target, weight FROM cospan WHERE weight >= 2", "men", "ent"),
}
