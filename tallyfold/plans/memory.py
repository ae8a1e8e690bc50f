"""Queries on memory: merges, series, evidence, pages, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import evidence as E
from tallyfold.operators import merge as M
from tallyfold.operators import retrieval as R
from tallyfold.plans.model import entities, extractions, filings, mentions, paragraphs, sql, table
from tallyfold.plans.scalars import _SLUG, _WORDS, _case  # the same functions in SQL


def _company_writes(s, d):
    c = table(s, d, "companies")
    first = c.select("cik", F.col("created_at").alias("at"), F.lit(1).alias("seq"), "name", "ticker", "sic")
    second = c.select("cik", F.col("updated_at").alias("at"), F.lit(2).alias("seq"), F.upper("name").alias("name"), F.when(F.col("sic") > "5", F.concat("ticker", F.lit("X"))).alias("ticker"), F.lit("0000").alias("sic"))
    return first.unionByName(second)


def _metrics(s, d):
    m = mentions(s, d).where("entity_type = 'metric'")
    v = extractions(s, d, "period", "value", "unit").select(F.col("extracted_id").alias("mention_id"), "period", "value", "unit")
    return m.join(v, "mention_id").select("mention_id", "cik", "document_id", "filed_at", T.metric(F.col("name")).alias("metric"), "period", "value", "unit")


def _observed(s, d):
    return M.observations(_metrics(s, d).where("value is not null"))


def _series(s, d):
    rows = _observed(s, d)
    return rows.groupBy("cik", "metric", "period").agg(F.count("*").alias("observations"), F.max_by("value", F.struct("filed_at", "document_id")).alias("latest_value"), F.count_if("restated").alias("restated"))


def _merged(s, d, kind):
    m = mentions(s, d, "description").where(F.col("entity_type") == kind)
    return M.upserted(m, ["cik", "slug"], ["filed_at", "mention_id"], {"name": "first", "description": "first_known"}, "mentions").join(
        m.groupBy("cik", "slug").agg(F.min("filed_at").alias("first_seen"), F.max("filed_at").alias("last_seen")), ["cik", "slug"])


def _risks(s, d):
    newest = filings(s, d, "cik", "filed_at").groupBy("cik").agg(F.max("filed_at").alias("newest"))
    return M.dropped_marked(entities(s, d), newest, "cik", "risk").select("cik", "slug", "entity_type", "latest_seen", "status")


def _people(s, d):
    m = mentions(s, d).where("entity_type = 'executive'").withColumn("person", T.person(F.col("name")))
    return m.groupBy("cik", "person").agg(F.max_by("name", F.struct(F.length("name").alias("l"), (-F.datediff("filed_at", F.lit("1970-01-01").cast("date"))).alias("d"), (-F.col("mention_id")).alias("m"))).alias("full_name"), F.count("*").alias("mentions"))


def _overview(s, d):
    e = entities(s, d)
    return e.groupBy("cik").pivot("entity_type", ["company", "executive", "geography", "metric", "product", "risk", "segment", "strategy"]).count().na.fill(0)


def _company_list(s, d):
    f = filings(s, d, "cik", "filed_at").groupBy("cik").agg(F.count("*").alias("documents"), F.max("filed_at").alias("latest"))
    return table(s, d, "companies").select("cik", "ticker", "name").join(f, "cik", "left").select("cik", "ticker", "name", F.coalesce("documents", F.lit(0)).alias("documents"), "latest")


def _top_entities(s, d):
    w = Window.partitionBy("cik").orderBy(F.desc("mention_count"), "slug")
    return entities(s, d).withColumn("place", F.row_number().over(w)).where("place <= 10").select("cik", "slug", "mention_count", "place")


def _sectioned(s, d):
    sec = table(s, d, "sections").groupBy("document_id", F.col("ordinal").alias("section_ordinal")).agg(F.min("title").alias("title"))
    return paragraphs(s, d, "document_id", "section_ordinal").join(sec, ["document_id", "section_ordinal"], "left").select("block_id", "document_id", "section_ordinal", "title")


def _search(s, d):
    v = table(s, d, "embeddings")
    return R.nearest(v, v.where("vec_id % 100 = 0"), 20)


def _rerank(s, d):
    hits = R.nearest(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 100 = 0"), 60)
    dated = hits.withColumn("filed_at", F.date_add(F.lit("2020-01-01").cast("date"), F.col("vec_id").cast("int")))
    return R.reranked(dated, 0.15, 20)


def _replaced(s, d):
    """The paragraphs of filings that were ingested again take the place of those stored."""
    again = table(s, d, "filings").groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id")
    stored = paragraphs(s, d, "document_id", "text").select("document_id", "block_id", "text")
    return M.replaced(stored, stored.join(again, "document_id", "left_semi").withColumn("text", F.concat(F.lit("again: "), F.col("text"))), "document_id")


def _known_topics(s, d):
    w = Window.partitionBy("cik").orderBy(F.desc("mention_count"), "name")
    return entities(s, d).withColumn("place", F.row_number().over(w)).where("place <= 40").select("cik", "name", "entity_type", "place")


_MET = f""", met AS (SELECT m.mention_id, m.cik, m.document_id, m.filed_at, {_case(T.METRIC_ALIASES, _WORDS.format(c='m.name'), _WORDS.format(c='m.name'))} AS metric, e.period, e.value, e.unit
    FROM men m JOIN ext e ON e.extracted_id = m.mention_id WHERE m.entity_type = 'metric'),
  once AS (SELECT * FROM met WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik, metric, period, document_id ORDER BY filed_at, mention_id) = 1),
  obs AS (SELECT *, period IS NOT NULL AND row_number() OVER (PARTITION BY cik, metric, period ORDER BY filed_at, document_id) > 1 AS restated FROM once)"""
_PAGE = "coalesce(CASE WHEN TRY_CAST(split_part(split_part(paragraph_id, '#', 1), '_', 1) AS INT) > 0 THEN TRY_CAST(split_part(split_part(paragraph_id, '#', 1), '_', 1) AS INT) END, page_number)"
_FOLDQ = r"lower(trim(regexp_replace(translate({c}, '‘’“”–—' || chr(160), '''''\"\"-- '), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', ' ', 'g')))".replace('\\"', '"')


def _kind_sql(kind: str) -> str:
    return sql(f"SELECT cik, slug, arg_min(name, (filed_at, mention_id)) AS name, arg_min(description, (filed_at, mention_id)) FILTER (description IS NOT NULL) AS description, count(*) AS mentions, min(filed_at) AS first_seen, max(filed_at) AS last_seen FROM men WHERE entity_type = '{kind}' GROUP BY 1, 2", "men")


QUERIES = {
    "snk1_company_upsert": lambda s, d: M.upserted(_company_writes(s, d), ["cik"], ["at", "seq"], {"name": "last", "ticker": "last_known", "sic": "first"}),
    "snk2_document_upsert": lambda s, d: M.upserted(table(s, d, "filings"), ["accession"], ["ingested_at"], {"content_sha256": "last", "page_count": "last", "form_type": "last", "filed_at": "last", "published_at": "first", "fiscal_period": "first"}, "deliveries"),
    "snk2_changed_deliveries": lambda s, d: M.changed_deliveries(table(s, d, "filings").select("document_id", "accession", "content_sha256", "ingested_at"), "accession", "content_sha256", ["ingested_at"]),
    "snk3_replaced_paragraphs": _replaced,
    "snk5_metric_observations": lambda s, d: _observed(s, d).select("mention_id", "cik", "metric", "period", "document_id", "value", "restated"),
    "snk6_entity_upsert": lambda s, d: M.upserted(mentions(s, d, "description").withColumns({"first_seen": F.col("filed_at"), "latest_seen": F.col("filed_at")}), ["cik", "slug"], ["filed_at", "mention_id"], {"name": "last", "description": "last_known", "entity_type": "first", "first_seen": "least", "latest_seen": "greatest"}, "mention_count"),
    "snk7_mentions_once": lambda s, d: M.inserted_if_absent(mentions(s, d, "quote").select("document_id", "slug", "paragraph_id", "mention_id", "quote"), ["document_id", "slug", "paragraph_id"], ["mention_id"]),
    "snk8_dropped_risks": _risks,
    "agg12_company_list": _company_list,
    "agg13_entities_by_type": _overview,
    "agg11_corpus_totals": lambda s, d: filings(s, d, "filed_at").agg(F.count("*").alias("documents"), F.max("filed_at").alias("newest"), F.min("filed_at").alias("oldest")),
    "agg9_entity_counts": lambda s, d: entities(s, d).select("cik", "slug", "mention_count", "documents"),
    "agg15_document_stats": lambda s, d: E.document_stats(paragraphs(s, d, "document_id", "paragraph_id", "page_number", "text")),
    "agg23_topics": lambda s, d: _merged(s, d, "strategy"),
    "agg25_products": lambda s, d: _merged(s, d, "product"),
    "agg24_people": _people,
    "agg26_metric_series": _series,
    "agg30_page_paragraphs": lambda s, d: paragraphs(s, d, "document_id", "page_number").groupBy("document_id", "page_number").agg(F.count("*").alias("paragraphs")),
    "agg45_paragraph_confidence": lambda s, d: mentions(s, d, "confidence").groupBy("document_id", "paragraph_id").agg(F.max("confidence").alias("confidence")),
    "agg46_paragraph_entities": lambda s, d: E.paragraph_entities(mentions(s, d, "confidence")),
    "agg47_folded_labels": lambda s, d: mentions(s, d).groupBy("slug").agg(F.array_join(F.sort_array(F.collect_set("name")), "|").alias("labels"), F.count("*").alias("n")),
    "evi_citations": lambda s, d: E.resolved(mentions(s, d, "quote"), paragraphs(s, d, "document_id", "paragraph_id", "text", "page_number", "section_ordinal")),
    "joi13_full_texts": lambda s, d: E.full_texts(paragraphs(s, d, "document_id", "ordinal", "text")),
    "joi21_sections_of_paragraphs": _sectioned,
    "joi11_cited_paragraphs": lambda s, d: paragraphs(s, d, "document_id", "paragraph_id").join(mentions(s, d).select("document_id", "paragraph_id").distinct(), ["document_id", "paragraph_id"], "left_semi").select("block_id", "document_id", "paragraph_id"),
    "prd20_uncited_mentions": lambda s, d: mentions(s, d).join(paragraphs(s, d, "document_id", "paragraph_id").select("document_id", "paragraph_id").distinct(), ["document_id", "paragraph_id"], "left_anti").select("mention_id", "document_id", "paragraph_id"),
    "win11_page_neighbours": lambda s, d: E.page_neighbours(paragraphs(s, d, "document_id", "page_number")),
    "msc41_all_pages": lambda s, d: E.all_pages(filings(s, d, "page_count"), paragraphs(s, d, "document_id", "page_number")),
    "srt9_top_entities": _top_entities,
    "srt13_known_topics": _known_topics,
    "ret1_search": _search,
    "srt2_reranked": _rerank,
    "src21_hashed_embeddings": lambda s, d: paragraphs(s, d, "text").select("block_id", R.hashed_embedding(64)("text").alias("embedding")),
}

_COS = """, q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 9) AS sc FROM q JOIN embeddings ON vec_id <> query_id),
  r AS (SELECT query_id, vec_id, round_even(sc, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, vec_id) AS INT) AS place FROM s)"""

SQL = {
    "snk1_company_upsert": "SELECT cik, upper(name) AS name, coalesce(CASE WHEN sic > '5' THEN ticker || 'X' END, ticker) AS ticker, sic FROM companies",
    "snk2_document_upsert": "SELECT accession, arg_max(content_sha256, ingested_at) AS content_sha256, first(page_count ORDER BY ingested_at DESC) AS page_count, arg_max(form_type, ingested_at) AS form_type, arg_max(filed_at, ingested_at) AS filed_at, arg_min(published_at, ingested_at) AS published_at, first(fiscal_period ORDER BY ingested_at) AS fiscal_period, count(*) AS deliveries FROM filings GROUP BY accession",
    "snk2_changed_deliveries": "SELECT document_id, accession, content_sha256, ingested_at FROM filings QUALIFY content_sha256 IS DISTINCT FROM lag(content_sha256) OVER (PARTITION BY accession ORDER BY ingested_at)",
    "snk3_replaced_paragraphs": sql("SELECT document_id, block_id, CASE WHEN document_id IN (SELECT document_id FROM filings GROUP BY 1 HAVING count(*) > 1) THEN 'again: ' || text ELSE text END AS text FROM par", "par"),
    "snk5_metric_observations": sql(_MET + " SELECT mention_id, cik, metric, period, document_id, value, restated FROM obs", "men"),
    "snk6_entity_upsert": sql("SELECT cik, slug, arg_max(name, (filed_at, mention_id)) AS name, arg_max(description, (filed_at, mention_id)) FILTER (description IS NOT NULL) AS description, arg_min(entity_type, (filed_at, mention_id)) AS entity_type, min(filed_at) AS first_seen, max(filed_at) AS latest_seen, count(*) AS mention_count FROM men GROUP BY 1, 2", "men"),
    "snk7_mentions_once": sql("SELECT document_id, slug, paragraph_id, mention_id, quote FROM men QUALIFY row_number() OVER (PARTITION BY document_id, slug, paragraph_id ORDER BY mention_id) = 1", "men"),
    "snk8_dropped_risks": sql(", n AS (SELECT cik, max(filed_at) AS newest FROM fil GROUP BY 1) SELECT cik, slug, entity_type, latest_seen, CASE WHEN entity_type = 'risk' AND latest_seen < newest THEN 'dropped' ELSE 'active' END AS status FROM ent LEFT JOIN n USING (cik)", "ent"),
    "agg12_company_list": sql(", f AS (SELECT cik, count(*) AS documents, max(filed_at) AS latest FROM fil GROUP BY 1) SELECT cik, ticker, name, coalesce(documents, 0) AS documents, latest FROM companies LEFT JOIN f USING (cik)", "fil"),
    "agg13_entities_by_type": sql("SELECT cik, " + ", ".join(f"count(*) FILTER (entity_type = '{t}') AS {t}" for t in ("company", "executive", "geography", "metric", "product", "risk", "segment", "strategy")) + " FROM ent GROUP BY 1", "ent"),
    "agg11_corpus_totals": sql("SELECT count(*) AS documents, max(filed_at) AS newest, min(filed_at) AS oldest FROM fil", "fil"),
    "agg9_entity_counts": sql("SELECT cik, slug, mention_count, documents FROM ent", "ent"),
    "agg15_document_stats": sql(f"SELECT document_id, count(DISTINCT {_PAGE}) AS pages_with_text, min({_PAGE}) AS first_page, count(DISTINCT split_part(paragraph_id, '#', 1)) AS paragraphs, sum(length(text))::BIGINT AS characters, max({_PAGE}) AS last_page FROM par GROUP BY 1", "par"),
    "agg23_topics": _kind_sql("strategy"),
    "agg25_products": _kind_sql("product"),
    "agg26_metric_series": sql(_MET + " SELECT cik, metric, period, count(*) AS observations, arg_max(value, (filed_at, document_id)) AS latest_value, count(*) FILTER (restated) AS restated FROM obs GROUP BY 1, 2, 3", "men"),
    "agg30_page_paragraphs": sql("SELECT document_id, page_number, count(*) AS paragraphs FROM par GROUP BY 1, 2", "par"),
    "agg45_paragraph_confidence": sql("SELECT document_id, paragraph_id, max(confidence) AS confidence FROM men GROUP BY 1, 2", "men"),
    "agg46_paragraph_entities": sql("SELECT document_id, paragraph_id, slug, name, entity_type, confidence FROM men QUALIFY row_number() OVER (PARTITION BY document_id, paragraph_id, slug ORDER BY coalesce(confidence, 0) DESC, mention_id) = 1", "men"),
    "agg47_folded_labels": sql("SELECT slug, array_to_string(list_sort(list(DISTINCT name)), '|') AS labels, count(*) AS n FROM men GROUP BY 1", "men"),
    "evi_citations": sql(f""", b AS (SELECT * FROM par QUALIFY row_number() OVER (PARTITION BY document_id, paragraph_id ORDER BY block_id) = 1)
        SELECT mention_id, m.document_id, m.paragraph_id, b.block_id, {_PAGE.replace('paragraph_id', 'm.paragraph_id').replace('page_number', 'b.page_number')} AS page,
        CASE WHEN b.block_id IS NULL THEN 'no such paragraph' WHEN NOT (coalesce(length(trim(quote)), 0) > 0 AND (contains(b.text, quote) OR contains({_FOLDQ.format(c='b.text')}, {_FOLDQ.format(c='quote')}))) THEN 'the quote is not in the paragraph' END AS error
        FROM men m LEFT JOIN b ON b.document_id = m.document_id AND b.paragraph_id = m.paragraph_id""", "men", "par"),
    "joi13_full_texts": sql("SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal, block_id) AS text FROM par GROUP BY 1", "par"),
    "joi21_sections_of_paragraphs": sql(", s AS (SELECT document_id, ordinal AS section_ordinal, min(title) AS title FROM sections GROUP BY 1, 2) SELECT block_id, par.document_id, par.section_ordinal, title FROM par LEFT JOIN s USING (document_id, section_ordinal)", "par"),
    "joi11_cited_paragraphs": sql("SELECT block_id, document_id, paragraph_id FROM par WHERE EXISTS (SELECT 1 FROM men m WHERE m.document_id = par.document_id AND m.paragraph_id = par.paragraph_id)", "men", "par"),
    "prd20_uncited_mentions": sql("SELECT mention_id, document_id, paragraph_id FROM men WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.document_id = men.document_id AND par.paragraph_id = men.paragraph_id)", "men", "par"),
    "win11_page_neighbours": sql("SELECT document_id, page_number, count(*) AS paragraphs, lag(page_number) OVER w AS prev_page, lead(page_number) OVER w AS next_page FROM par WHERE page_number IS NOT NULL GROUP BY 1, 2 WINDOW w AS (PARTITION BY document_id ORDER BY page_number)", "par"),
    "msc41_all_pages": sql(", c AS (SELECT document_id, page_number, count(*) AS paragraphs FROM par WHERE page_number IS NOT NULL GROUP BY 1, 2), m AS (SELECT document_id, max(page_number) AS m FROM c GROUP BY 1), p AS (SELECT f.document_id, CAST(unnest(generate_series(1, greatest(coalesce(page_count, 0), coalesce(m, 0)))) AS INT) AS page_number FROM fil f LEFT JOIN m USING (document_id)) SELECT p.document_id, p.page_number, coalesce(paragraphs, 0) AS paragraphs FROM p LEFT JOIN c USING (document_id, page_number)", "fil", "par"),
    "srt9_top_entities": sql("SELECT cik, slug, mention_count, CAST(row_number() OVER w AS INT) AS place FROM ent WINDOW w AS (PARTITION BY cik ORDER BY mention_count DESC, slug) QUALIFY place <= 10", "ent"),
    "srt13_known_topics": sql("SELECT cik, name, entity_type, CAST(row_number() OVER w AS INT) AS place FROM ent WINDOW w AS (PARTITION BY cik ORDER BY mention_count DESC, name) QUALIFY place <= 40", "ent"),
    "ret1_search": sql(_COS.replace(", q AS", "WITH q AS", 1) + " SELECT * FROM r WHERE place <= 20"),
    "srt2_reranked": sql(_COS.replace(", q AS", "WITH q AS", 1) + """, h AS (SELECT *, DATE '2020-01-01' + CAST(vec_id AS INT) AS filed_at FROM r WHERE place <= 60),
        b AS (SELECT *, round_even(score * (1 - 0.15::DOUBLE) + (filed_at - min(filed_at) OVER w)::DOUBLE / (max(filed_at) OVER w - min(filed_at) OVER w) * 0.15::DOUBLE, 6) AS blended FROM h WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, vec_id, blended, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, place) AS INT) AS "rank" FROM b QUALIFY "rank" <= 20"""),
}
