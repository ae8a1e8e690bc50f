"""Small operators of the inventory, each as a query of its own: spans, ratios, look-ups, labels, orders and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import carried as CO
from tallyfold.operators import extraction as X
from tallyfold.operators import graph as G
from tallyfold.operators import merge as M
from tallyfold.operators import timeline as TL
from tallyfold.plans.cards import _fragments, _quotes, _texts
from tallyfold.plans.derived import _CHANGES, _CO, _COMP, _EDGES, _TYPED, FILED, _links, _scores
from tallyfold.plans.memory import _MET, _metrics, _observed
from tallyfold.plans.model import entities, extractions, filings, mentions, paragraphs, sql, table, usage
from tallyfold.plans.parsing import _CHECKED, _PACKED, _RECURSIVE, _chunks, _tables
from tallyfold.storage import written

C = F.col
#: The kinds of entities in their order.
KINDS = ("company", "executive", "geography", "metric", "product", "risk", "segment", "strategy")
#: Where a kind's entities go in the older layout; all others stay entities.
OLDER = {"strategy": "topic", "executive": "person", "risk": "risk", "product": "product", "metric": "metric"}


def _checked(s, d):
    return X.checked(extractions(s, d, "document_id", "paragraph_id", "name", "entity_type", "confidence", "quote"), paragraphs(s, d, "document_id", "paragraph_id", "text"))


def _places(s, d, *columns):
    """One row per cited place: a paragraph delivered under several block ids counts as its first."""
    rows = paragraphs(s, d, "document_id", "paragraph_id", *columns)
    return rows.groupBy("document_id", "paragraph_id").agg(*[F.min_by(c, "block_id").alias(c) for c in ("block_id", *columns)])


def _overview(s, d):
    """Each company's memory: entities, mentions, span, and the ten entities with most mentions."""
    e = written(entities(s, d), "overview-entities")
    top = e.withColumn("place", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("mention_count"), "slug"))).where("place <= 10")
    top = top.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("place", "slug"))).alias("t")).select("cik", F.array_join(F.transform("t", lambda x: x["slug"]), ",").alias("top"))
    return e.groupBy("cik").agg(F.count("*").alias("entities"), F.sum("mention_count").alias("mentions"), F.min("first_seen").alias("first_seen"), F.max("latest_seen").alias("latest_seen")).join(top, "cik")


def _known(s, d):
    """Edges stated by paragraphs whose two ends are known and differ."""
    ends = entities(s, d).where("mention_count >= 2").select("cik", "slug")
    rows = _links(s, d).where("source <> target")
    for end in ("source", "target"):
        rows = rows.join(ends.withColumnRenamed("slug", end), ["cik", end], "left_semi")
    return rows.groupBy("cik", "source", "target", "relationship").agg(F.count_distinct("document_id").alias("documents"))


def _revision_facts(s, d):
    """Facts of readable deliveries, one row per fact."""
    fact = "array<struct<key:string,label:string,value:string,unit:string,period:string,status:string,evidence:struct<paragraph_id:string,page:int>>>"
    rows = table(s, d, "card_revisions").where(F.json_array_length("facts").isNotNull()).dropDuplicates(["revision_id"])
    return rows.select("revision_id", "card_id", "kind", F.posexplode(F.from_json("facts", fact)).alias("place", "f")).select("revision_id", "card_id", "kind", "place", "f.*")


def _spine(s, d):
    """Filings and first citations of topics as one list by day."""
    f = filings(s, d, *FILED).select(C("filed_at").alias("occurred_at"), F.lit("filing").alias("kind"), C("accession").alias("ref"), "cik")
    e = entities(s, d).select(C("first_seen").alias("occurred_at"), C("entity_type").alias("kind"), C("slug").alias("ref"), "cik")
    return f.unionByName(e)


def _titled(s, d):
    """An event's title and category."""
    e = entities(s, d).select("cik", "slug", C("name").alias("topic"), "entity_type")
    rows = TL.events(filings(s, d, *FILED), mentions(s, d)).join(e, ["cik", "slug"], "left").join(filings(s, d, "fiscal_period").select("document_id", "fiscal_period"), "document_id")
    words = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    label = F.concat_ws(" ", F.nullif("fiscal_period", F.lit("")), "form_type")
    return rows.select("key", F.when(C("kind") == "filed", F.concat(label, F.lit(" Filed"))).otherwise(F.concat("topic", F.lit(" "), words)).alias("title"), F.initcap(F.coalesce("entity_type", F.lit("Filing"))).alias("category"), F.date_format("filed_at", "MMM yyyy").alias("month"))


def _fallback(s, d):
    """The text of each cited place; where the paragraph is not there, the filing's first text."""
    e = extractions(s, d, "document_id", "paragraph_id")
    exact = _places(s, d, "text").select("document_id", "paragraph_id", C("text").alias("exact"))
    first = paragraphs(s, d, "document_id", "ordinal", "text").groupBy("document_id").agg(F.min_by("text", F.struct("ordinal", "block_id")).alias("whole"))
    rows = e.join(exact, ["document_id", "paragraph_id"], "left").join(first, "document_id", "left")
    return rows.select("extracted_id", F.length(F.coalesce("exact", "whole")).alias("length"), F.when(C("exact").isNotNull(), "paragraph").when(C("whole").isNotNull(), "filing").alias("found"))


def _requests(s, d):
    """Each request's first and last attempt told apart by id: requests without an answer, and answers without a first attempt that failed."""
    u = usage(s, d, "request_id", "status").where("request_id is not null")
    sent = u.where("status = 'failed'").groupBy("request_id").agg(F.count("*").alias("failures"))
    got = u.where(C("status").isin("success", "fallback", "cached")).groupBy("request_id").agg(F.count("*").alias("answers"))
    rows = sent.join(got, "request_id", "full_outer")
    return rows.select("request_id", F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("answers", F.lit(0)).alias("answers"), F.when(C("answers").isNull(), "no answer").when(C("failures").isNull(), "at once").otherwise("after failures").alias("outcome"))


def _first_new(s, d):
    """Of a topic new in a filing, how much of each cited quote was said before."""
    return CO.overlaps(_quotes(s, d), _texts(s, d), "mention_id", "before_id").select("mention_id", "runs", "found", (C("share") >= TL.CARRIED_OVER).alias("carried"))


def _neighbours(s, d):
    """Pages of a filing that hold text, with the page before and after and the number of paragraphs."""
    p = paragraphs(s, d, "document_id", "page_number").where("page_number > 0").groupBy("document_id", "page_number").agg(F.count("*").alias("paragraphs"))
    w = Window.partitionBy("document_id").orderBy("page_number")  # the pages of one filing
    return p.select("document_id", "page_number", "paragraphs", F.lag("page_number").over(w).alias("before"), F.lead("page_number").over(w).alias("after"))


def _reading(s, d):
    """A filing's pages as they are read: each with its paragraphs in order, paragraphs without a page last."""
    p = paragraphs(s, d, "document_id", "page_number", "ordinal", "paragraph_id").groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("ordinal", "block_id", "paragraph_id"))).alias("p"))
    w = Window.partitionBy("document_id").orderBy(F.asc_nulls_last("page_number"))
    return p.select("document_id", "page_number", F.array_join(F.transform("p", lambda x: x["paragraph_id"]), ",").alias("paragraph_ids"), F.row_number().over(w).alias("place"))


def _once(s, d):
    """Paragraphs of a filing's chunks, each once: where it stands first."""
    rows = _chunks(s, d).select("document_id", "section_ordinal", "chunk", F.posexplode("paragraph_ids").alias("place", "paragraph_id"))
    at = F.struct(F.coalesce("section_ordinal", F.lit(-1)).alias("section"), "chunk", "place")
    return rows.groupBy("document_id", "paragraph_id").agg(F.min(at).alias("at"), F.count("*").alias("chunks")).select("document_id", "paragraph_id", "at.section", "at.chunk", "chunks")


def _legacy(s, d):
    """Entities in the older layout: how many of each sort; a metric only with a value."""
    e = extractions(s, d, "entity_type", "value")
    to = T.looked_up(OLDER, C("entity_type"), F.lit("entity"))
    return e.where((C("entity_type") != "metric") | C("value").isNotNull()).groupBy(to.alias("sort")).agg(F.count("*").alias("n"))


def _cleared(s, d):
    """What is left when the companies without a ticker have their memory cleared: entities, and mentions by cascade."""
    gone = table(s, d, "companies").where("ticker is null").select("cik")
    kept = entities(s, d).join(gone, "cik", "left_anti")
    m = mentions(s, d).join(kept.select("cik", "slug"), ["cik", "slug"], "left_semi")
    return kept.groupBy("cik").agg(F.count("*").alias("entities")).join(m.groupBy("cik").agg(F.count("*").alias("mentions")), "cik")


def _json_facts(s, d):
    """Facts of a card kind spread over their fields, null fields left out."""
    rows = _revision_facts(s, d)
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in ("label", "value", "unit", "period", "status")]), F.array("label", "value", "unit", "period", "status"))
    return rows.select("kind", F.explode(fields).alias("field", "content")).where("content is not null").groupBy("kind", "field").agg(F.count("*").alias("facts"), F.count_distinct("content").alias("contents"))


def _logged(s, d):
    """The ledger as lines of JSON, with what looks like a key left out."""
    u = usage(s, d, "provider", "model", "status", "input_tokens", "error_message").where("error_message is not null")
    message = F.regexp_replace("error_message", "[A-Za-z0-9_-]{24,}", "[redacted]")
    return u.select("usage_id", F.to_json(F.struct(C("usage_id").alias("id"), "provider", "model", "status", C("input_tokens").alias("tokens"), message.alias("message"))).alias("line"))


QUERIES = {
    "agg14_memory_overview": _overview,
    "agg19_typed_edges": lambda s, d: G.asserted(_links(s, d), entities(s, d)).select("cik", "source", "target", "relationship", "weight", F.size("documents").alias("documents"), "first_seen", "last_seen"),
    "agg20_shared_filings": lambda s, d: G.co_occurrence(mentions(s, d)).select("cik", "source", "target", "weight", "first_seen", "last_seen"),
    "agg21_earlier_date": lambda s, d: filings(s, d, "filed_at", "published_at").select("document_id", F.least("filed_at", F.to_date("published_at")).alias("earlier")),
    "agg22_later_date": lambda s, d: filings(s, d, "filed_at", "published_at").select("document_id", F.greatest("filed_at", F.to_date("published_at")).alias("later")),
    "agg27_merged_risks": lambda s, d: M.dropped_marked(entities(s, d), filings(s, d, "cik", "filed_at").groupBy("cik").agg(F.max("filed_at").alias("newest")), "cik", "risk").where("entity_type = 'risk'").select("cik", "slug", "mention_count", "first_seen", "latest_seen", "status"),
    "agg28_extended_span": lambda s, d: table(s, d, "card_revisions").groupBy("card_id").agg(F.min(F.least("as_of", F.to_date("created_at"))).alias("since"), F.max(F.greatest("as_of", F.to_date("created_at"))).alias("until")),
    "agg31_seed_listing": lambda s, d: mentions(s, d).groupBy("slug", "name").agg(F.count("*").alias("mentions"), F.min("mention_id").alias("first_mention")),
    "agg34_entities_of_kinds": lambda s, d: entities(s, d).groupBy("entity_type").agg(F.count("*").alias("entities"), F.sum("mention_count").alias("mentions")),
    "agg37_tokens_by_model": lambda s, d: usage(s, d, "provider", "model", "input_tokens", "output_tokens", "cached_tokens").groupBy("provider", "model").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens")]),
    "agg38_cache_rate": lambda s, d: usage(s, d, "model", "input_tokens", "cached_tokens").groupBy("model").agg(F.bround(F.coalesce(F.try_divide(F.sum("cached_tokens").cast("double"), F.sum("input_tokens")), F.lit(0.0)), 4).alias("rate")),
    "agg39_cache_rate_of_answers": lambda s, d: usage(s, d, "input_tokens", "cached_tokens").select("usage_id", F.bround(F.coalesce(F.try_divide(C("cached_tokens").cast("double"), C("input_tokens")), F.lit(0.0)), 4).alias("rate")),
    "agg40_acceptance": lambda s, d: _checked(s, d).groupBy("document_id").agg(F.count("*").alias("extractions"), F.bround(F.count_if(C("reason").isNull()).cast("double") / F.count("*"), 4).alias("accepted")),
    "agg41_durations": lambda s, d: usage(s, d, "created_at", "received_at", "status").select("usage_id", F.when(C("status") != "failed", F.unix_micros(C("received_at").cast("timestamp")) - F.unix_micros(C("created_at").cast("timestamp"))).alias("microseconds")),
    "agg43_mentions_of_entities": lambda s, d: mentions(s, d).groupBy("cik", "slug").agg(F.count("*").alias("mentions"), F.count_distinct("document_id", F.coalesce("paragraph_id", F.lit(""))).alias("places")),
    "agg49_stranded_rows": lambda s, d: extractions(s, d, "document_id", "entity_type").join(filings(s, d, "accession"), "document_id", "left_anti").agg(F.count("*").alias("stranded")),
    "crd2_card_facts": lambda s, d: mentions(s, d).groupBy("document_id", "slug").agg(F.min_by("paragraph_id", F.struct(T.reading_order(C("paragraph_id"), F.lit(None).cast("int"), F.lit(0)).alias("o"), "mention_id")).alias("first_paragraph"), F.count_distinct(T.base_paragraph(C("paragraph_id"))).alias("paragraphs")),
    "crd3_metric_facts": lambda s, d: _observed(s, d).where("period is not null").groupBy("cik", "metric", "period").agg(F.max_by("value", F.struct("filed_at", "document_id")).alias("value"), F.max("filed_at").alias("as_of")),
    "crd4_product_facts": lambda s, d: entities(s, d).where("entity_type = 'product'").select("cik", "slug", "name", "first_seen"),
    "crd5_active_risk_facts": lambda s, d: entities(s, d).where("entity_type = 'risk'").join(filings(s, d, "cik", "filed_at").groupBy("cik").agg(F.max("filed_at").alias("newest")), "cik").where(C("latest_seen") >= C("newest")).select("cik", "slug", "name"),
    "crd10_facts_by_kind": lambda s, d: _revision_facts(s, d).groupBy("kind").agg(F.count("*").alias("facts"), F.count_distinct("card_id").alias("cards"), F.count_if(C("value").isNull()).alias("without_value")),
    "crd14_material_revisions": lambda s, d: table(s, d, "card_revisions").dropDuplicates(["revision_id"]).where(sum((F.coalesce(F.json_array_length(F.get_json_object("delta", f"$.{k}")), F.lit(0)) for k in ("added", "removed")), F.coalesce(F.json_array_length(F.get_json_object("delta", "$.changed")), F.lit(0))) > 0).select("revision_id", "card_id", "as_of"),
    "gra6_frequency": lambda s, d: _scores(s, d).select("cik", "slug", "mention_count", "frequency"),
    "gra7_spread": lambda s, d: _scores(s, d).select("cik", "slug", "documents", "spread"),
    "gra8_recency": lambda s, d: _scores(s, d).select("cik", "slug", "latest_seen", "recency"),
    "gra9_centrality": lambda s, d: _scores(s, d).select("cik", "slug", "degree", "centrality"),
    "gra11_relative_to_company": lambda s, d: _scores(s, d).groupBy("cik").agg(F.max("frequency").alias("most_frequent"), F.max("centrality").alias("most_central"), F.max("importance").alias("most_important")),
    "joi1_paragraphs_of_companies": lambda s, d: paragraphs(s, d, "document_id").join(filings(s, d, "cik", "accession", "form_type"), "document_id").join(table(s, d, "companies").select("cik", "ticker"), "cik").select("block_id", "accession", "form_type", "ticker"),
    "joi3_mentions_of_a_batch": lambda s, d: mentions(s, d).join(entities(s, d).select("cik", "slug", C("name").alias("label")), ["cik", "slug"]).join(paragraphs(s, d, "document_id", "paragraph_id", "page_number").where("page_number <= 10").select("document_id", "paragraph_id"), ["document_id", "paragraph_id"], "left_semi").select("mention_id", "label"),
    "joi4_citation_places": lambda s, d: extractions(s, d, "document_id", "paragraph_id").join(_places(s, d), ["document_id", "paragraph_id"], "left").select("extracted_id", "block_id", F.when(C("block_id").isNull(), "no such paragraph").alias("error")),
    "joi7_companies_with_filings": lambda s, d: table(s, d, "companies").select("cik").join(filings(s, d, "cik", "form_type"), "cik", "left").groupBy("cik").agg(F.count("document_id").alias("filings"), F.count_distinct("form_type").alias("forms")),
    "joi8_mentions_with_places": lambda s, d: mentions(s, d).join(_places(s, d, "page_number"), ["document_id", "paragraph_id"], "left").select("mention_id", "accession", "block_id", "page_number"),
    "joi12_text_or_filing": _fallback,
    "joi18_filing_of_accession": lambda s, d: filings(s, d, "accession", "cik").join(table(s, d, "companies").select("cik", "name"), "cik").select("accession", "document_id", "name"),
    "joi20_without_vectors": lambda s, d: table(s, d, "documents").where("length(text) > 0").select("doc_id").distinct().join(table(s, d, "embeddings").select(C("vec_id").alias("doc_id")), "doc_id", "left_anti"),
    "joi23_topics_together": lambda s, d: G.co_occurrence(mentions(s, d)).where("weight >= 2").select("cik", "source", "target", "weight"),
    "joi24_known_ends": _known,
    "joi27_filing_before": lambda s, d: TL.comparable(filings(s, d, *FILED)).where("next_document_id is not null").select(C("next_document_id").alias("document_id"), C("document_id").alias("before_id")),
    "joi32_same_period_once": lambda s, d: filings(s, d, "cik", "form_type", "fiscal_period", "filed_at").groupBy("cik", "form_type", "fiscal_period").agg(F.max_by("document_id", F.struct("filed_at", "document_id")).alias("document_id"), F.count("*").alias("filings")),
    "joi34_fields_of_facts": _json_facts,
    "joi35_answers_of_requests": _requests,
    "joi36_pages_of_citations": lambda s, d: extractions(s, d, "document_id", "paragraph_id").join(_places(s, d, "page_number"), ["document_id", "paragraph_id"]).select("extracted_id", T.paragraph_page(C("paragraph_id"), C("page_number")).alias("page")),
    "joi37_cited_mentions": lambda s, d: mentions(s, d, "quote").where("paragraph_id is not null and quote is not null").select("mention_id", "slug", F.length("quote").alias("length")),
    "msc13_kinds": lambda s, d: extractions(s, d, "entity_type").groupBy("entity_type").agg(F.count("*").alias("n")).withColumn("place", F.array_position(F.array(*[F.lit(k) for k in KINDS]), C("entity_type"))).where("place > 0").select("place", "entity_type", "n"),
    "msc16_evidence_of_revisions": lambda s, d: _revision_facts(s, d).where("evidence is not null").select("revision_id", "place", "evidence.paragraph_id", "evidence.page"),
    "msc17_history": lambda s, d: table(s, d, "card_revisions").dropDuplicates(["revision_id"]).groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("revision", "revision_id"))).alias("r")).select("card_id", F.array_join(F.transform("r", lambda x: x["revision_id"].cast("string")), ",").alias("history")),
    "msc20_kinds_as_text": lambda s, d: extractions(s, d, "entity_type").where("entity_type is not null").groupBy(F.lit(1).alias("one")).agg(F.array_join(F.array_sort(F.collect_set("entity_type")), "\n").alias("text")).select("text"),
    "msc36_usage_as_json": lambda s, d: usage(s, d, "input_tokens", "output_tokens", "cached_tokens").select("usage_id", F.to_json(F.struct("input_tokens", "output_tokens", "cached_tokens"), {"ignoreNullFields": "false"}).alias("usage")),
    "msc40_chunks_written": lambda s, d: _chunks(s, d).agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens")),
    "msc42_pages": _neighbours,
    "msc43_reading_view": _reading,
    "msc48_event_log": lambda s, d: table(s, d, "events").where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("events"), F.min("event_id").alias("first"), F.max("event_id").alias("last")),
    "msc49_ticker": lambda s, d: table(s, d, "companies").where("ticker is not null").select(F.upper(F.trim("ticker")).alias("ticker"), "cik").groupBy("ticker").agg(F.min("cik").alias("cik"), F.count("*").alias("companies")),
    "msc50_breakdown": lambda s, d: usage(s, d, "task_type", "status", "estimated_cost_usd").groupBy(F.coalesce("task_type", F.lit("unknown")).alias("name"), "status").agg(F.count("*").alias("attempts"), F.sum("estimated_cost_usd").cast("decimal(38,6)").alias("cost")),
    "msc54_styled": lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(F.lower("text").rlike("<style|style="), F.lit(False)).alias("styled")).distinct(),
    "msc56_paths": lambda s, d: filings(s, d, "accession", "source_format").select("document_id", F.concat(F.lit("filings/"), "accession", F.lit("/source."), F.lower("source_format")).alias("source"), F.concat(F.lit("filings/"), "accession", F.lit("/pages")).alias("pages")),
    "prd1_routed": lambda s, d: _fragments(s, d).where("cards <> ''").select("document_id", "ordinal", F.size(F.split("cards", ",")).alias("cards")),
    "prd5_narrowed": lambda s, d: TL.changes(filings(s, d, *FILED), mentions(s, d)).where("kind = 'narrowed'").select("document_id", "slug", "paragraphs", "previous_paragraphs"),
    "prd7_absences": lambda s, d: TL.changes(filings(s, d, *FILED), mentions(s, d)).where("kind = 'no_longer_disclosed'").groupBy("form_type").agg(F.count("*").alias("absences")),
    "prd16_graph_until": lambda s, d: _scores(s, d).where((C("importance") >= 50) & (C("first_seen").isNull() | (C("first_seen") <= F.lit("2023-12-31").cast("date")))).select("cik", "slug", "importance"),
    "prd21_refused_entities": lambda s, d: _checked(s, d).where("reason is not null").select("extracted_id", "reason"),
    "prd24_unknown_kinds": lambda s, d: extractions(s, d, "entity_type").where(~F.coalesce(C("entity_type").isin(*KINDS), F.lit(False))).agg(F.count("*").alias("rows")),
    "prd26_broken_constraints": lambda s, d: usage(s, d, "input_tokens", "cached_tokens", "latency_ms").where("input_tokens < 0 or cached_tokens > input_tokens or latency_ms < 0").select("usage_id"),
    "prj20_paragraphs_once": _once,
    "prj26_older_layout": _legacy,
    "prj30_timeline_entries": _titled,
    "ret4_wrong_widths": lambda s, d: table(s, d, "embeddings").groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("vectors")),
    "sca9_table_sizes": lambda s, d: _tables(s, d).select("document_id", F.size("cells").alias("rows"), F.array_max(F.transform("cells", lambda r: F.size(r))).alias("columns")),
    "sca13_chunk_anchors": lambda s, d: _chunks(s, d).select("document_id", F.concat(F.lit("c-"), F.coalesce(C("section_ordinal").cast("string"), F.lit("")), F.lit("-"), "chunk").alias("anchor"), "tokens"),
    "sca22_located_quotes": lambda s, d: extractions(s, d, "document_id", "paragraph_id", "quote").where("length(trim(quote)) > 0").join(_places(s, d, "text"), ["document_id", "paragraph_id"]).select("extracted_id", (F.instr("text", C("quote")) > 0).alias("exact")),
    "sca52_citation_labels": lambda s, d: mentions(s, d).join(_places(s, d, "page_number"), ["document_id", "paragraph_id"]).select("mention_id", F.concat_ws(", ", "form_type", F.concat(F.lit("p. "), F.nullif("page_number", F.lit(0)))).alias("label")),
    "sca58_fact_display": lambda s, d: _revision_facts(s, d).select("revision_id", "place", F.concat_ws(" ", "label", "value", "unit", F.concat(F.lit("("), "period", F.lit(")"))).alias("shown")),
    "sca64_dashes": lambda s, d: _revision_facts(s, d).select("revision_id", "place", F.coalesce("value", F.lit("—")).alias("value")),
    "set1_all_edges": lambda s, d: G.co_occurrence(mentions(s, d)).unionByName(G.asserted(_links(s, d), entities(s, d))).groupBy("cik", "relationship").agg(F.count("*").alias("edges")),
    "set5_earlier_runs": lambda s, d: CO.runs_of(paragraphs(s, d, "document_id", "text").where("length(text) > 0"), ["document_id"], "text").select("document_id", "run").distinct().groupBy("document_id").agg(F.count("*").alias("runs")),
    "set9_touched_cards": lambda s, d: _fragments(s, d).where("cards <> ''").select("document_id", F.explode(F.split("cards", ",")).alias("card")).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("card")), ",").alias("cards")),
    "set10_distinct_citations": lambda s, d: extractions(s, d, "document_id", "paragraph_id").select("document_id", "paragraph_id").distinct(),
    "snk12_cleared_memory": _cleared,
    "snk15_log_lines": _logged,
    "srt6_kind_ranks": lambda s, d: TL.events(filings(s, d, *FILED), mentions(s, d)).groupBy("kind", "rank").agg(F.count("*").alias("events")),
    "srt7_spine": _spine,
    "srt15_first_chunks": lambda s, d: paragraphs(s, d, "document_id", "ordinal").withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal", "block_id"))).where("place <= 3").select("document_id", "block_id", "place"),
    "srt16_newest_filing": lambda s, d: filings(s, d, "cik", "filed_at").groupBy("cik").agg(F.max_by("document_id", F.struct("filed_at", "document_id")).alias("document_id")),
    "tml8_days": lambda s, d: TL.comparable(filings(s, d, *FILED)).where("next_document_id is not null").join(filings(s, d, "filed_at").select(C("document_id").alias("next_document_id"), C("filed_at").alias("day")), "next_document_id").groupBy("day").agg(F.count("*").alias("comparisons")),
    "win10_newest_revisions": lambda s, d: table(s, d, "card_revisions").groupBy("card_id").agg(F.max_by("revision_id", F.struct(F.coalesce("revision", F.lit(-1)), "revision_id")).alias("revision_id")),
    "win12_overlaps": lambda s, d: _chunks(s, d).withColumn("before", F.lag("paragraph_ids").over(Window.partitionBy("document_id", "section_ordinal").orderBy("chunk"))).where("before is not null").select("document_id", "section_ordinal", "chunk", F.size(F.array_intersect("paragraph_ids", "before")).alias("shared")),
}

_JF = """, rev AS (SELECT * FROM card_revisions WHERE facts IS NOT NULL AND json_valid(facts) AND json_type(facts) = 'ARRAY' QUALIFY row_number() OVER (PARTITION BY revision_id ORDER BY revision_id) = 1),
  un AS (SELECT revision_id, card_id, kind, unnest(range(0, len(a)))::INT AS place, a FROM (SELECT *, from_json(facts, '["JSON"]') AS a FROM rev)),
  fct AS (SELECT revision_id, card_id, kind, place, a[place + 1]->>'$.label' AS label, a[place + 1]->>'$.value' AS value, a[place + 1]->>'$.unit' AS unit, a[place + 1]->>'$.period' AS period, a[place + 1]->>'$.status' AS status, a[place + 1]->'$.evidence' AS evidence FROM un)"""
_FIRST = ", plc AS (SELECT document_id, paragraph_id, min(block_id) AS block_id, arg_min(page_number, block_id) AS page_number, arg_min(text, block_id) AS text FROM par GROUP BY 1, 2)"
_IN = ", ".join(f"'{k}'" for k in KINDS)
_ORDER = "CASE WHEN regexp_matches(paragraph_id, '^\\d+_\\d+(#\\d+)?$') THEN (0, TRY_CAST(split_part(paragraph_id, '_', 1) AS INT), TRY_CAST(split_part(split_part(paragraph_id, '_', 2), '#', 1) AS INT), coalesce(TRY_CAST(split_part(paragraph_id, '#', 2) AS INT), 0)) ELSE (1, 0, 0, 0) END"
_CARDS = "CASE WHEN f.form_type IN ('10-K', '10-Q') THEN 'revenue' END AS c1, CASE WHEN regexp_matches(title, '(?i)item\\s*1a|risk\\s*factors') THEN 'risks' END AS c2, CASE WHEN regexp_matches(title, '(?i)cash\\s*flow|capital\\s*expend') THEN 'capex' END AS c3, CASE WHEN regexp_matches(title, '(?i)item\\s*3|legal\\s*proceedings') THEN 'litigation' END AS c4"
_ROUTED = f", rt AS (SELECT s.document_id, s.ordinal, {_CARDS} FROM (SELECT document_id, ordinal, min(title) AS title FROM sections GROUP BY 1, 2) s JOIN fil f USING (document_id)), rc AS (SELECT document_id, ordinal, [x FOR x IN [c1, c2, c3, c4] IF x IS NOT NULL] AS c FROM rt)"

SQL = {
    "agg14_memory_overview": sql("SELECT cik, count(*) AS entities, CAST(sum(mention_count) AS BIGINT) AS mentions, min(first_seen) AS first_seen, max(latest_seen) AS latest_seen, string_agg(slug, ',' ORDER BY mention_count DESC, slug) FILTER (p <= 10) AS top FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY mention_count DESC, slug) AS p FROM ent) GROUP BY 1", "ent"),
    "agg19_typed_edges": sql(_TYPED + " SELECT cik, source, target, relationship, weight, CAST(len(documents) AS INT) AS documents, first_seen, last_seen FROM typed", "men", "ent"),
    "agg20_shared_filings": sql(_CO + " SELECT cik, source, target, weight, first_seen, last_seen FROM cospan", "men", "ent"),
    "agg21_earlier_date": sql("SELECT document_id, least(filed_at, CAST(published_at AS DATE)) AS earlier FROM fil", "fil"),
    "agg22_later_date": sql("SELECT document_id, greatest(filed_at, CAST(published_at AS DATE)) AS later FROM fil", "fil"),
    "agg27_merged_risks": sql("SELECT cik, slug, mention_count, first_seen, latest_seen, CASE WHEN latest_seen < newest THEN 'dropped' ELSE 'active' END AS status FROM ent JOIN (SELECT cik, max(filed_at) AS newest FROM fil GROUP BY 1) USING (cik) WHERE entity_type = 'risk'", "ent"),
    "agg28_extended_span": "SELECT card_id, min(least(as_of, CAST(created_at AS DATE))) AS since, max(greatest(as_of, CAST(created_at AS DATE))) AS until FROM card_revisions GROUP BY 1",
    "agg31_seed_listing": sql("SELECT slug, name, count(*) AS mentions, min(mention_id) AS first_mention FROM men GROUP BY 1, 2", "men"),
    "agg34_entities_of_kinds": sql("SELECT entity_type, count(*) AS entities, CAST(sum(mention_count) AS BIGINT) AS mentions FROM ent GROUP BY 1", "ent"),
    "agg37_tokens_by_model": sql("SELECT provider, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens FROM usage1 GROUP BY 1, 2", "usage1"),
    "agg38_cache_rate": sql("SELECT model, round_even(coalesce(sum(cached_tokens)::DOUBLE / nullif(sum(input_tokens), 0), 0), 4) AS rate FROM usage1 GROUP BY 1", "usage1"),
    "agg39_cache_rate_of_answers": sql("SELECT usage_id, round_even(coalesce(cached_tokens::DOUBLE / nullif(input_tokens, 0), 0), 4) AS rate FROM usage1", "usage1"),
    "agg40_acceptance": sql(_CHECKED + " SELECT document_id, count(*) AS extractions, round_even(count(*) FILTER (reason IS NULL)::DOUBLE / count(*), 4) AS accepted FROM c GROUP BY 1", "ext", "par"),
    "agg41_durations": sql("SELECT usage_id, CASE WHEN status <> 'failed' THEN epoch_us(received_at) - epoch_us(created_at) END AS microseconds FROM usage1", "usage1"),
    "agg43_mentions_of_entities": sql("SELECT cik, slug, count(*) AS mentions, count(DISTINCT (document_id, coalesce(paragraph_id, ''))) AS places FROM men GROUP BY 1, 2", "men"),
    "agg49_stranded_rows": sql("SELECT count(*) AS stranded FROM ext WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.document_id = ext.document_id)", "ext"),
    "crd2_card_facts": sql(f"SELECT document_id, slug, arg_min(paragraph_id, ({_ORDER}, mention_id)) AS first_paragraph, count(DISTINCT split_part(paragraph_id, '#', 1)) AS paragraphs FROM men GROUP BY 1, 2", "men"),
    "crd3_metric_facts": sql(_MET + " SELECT cik, metric, period, arg_max(value, (filed_at, document_id)) AS value, max(filed_at) AS as_of FROM obs WHERE period IS NOT NULL GROUP BY 1, 2, 3", "men"),
    "crd4_product_facts": sql("SELECT cik, slug, name, first_seen FROM ent WHERE entity_type = 'product'", "ent"),
    "crd5_active_risk_facts": sql("SELECT cik, slug, name FROM ent JOIN (SELECT cik, max(filed_at) AS newest FROM fil GROUP BY 1) USING (cik) WHERE entity_type = 'risk' AND latest_seen >= newest", "ent"),
    "crd10_facts_by_kind": sql("WITH " + _JF[2:] + " SELECT kind, count(*) AS facts, count(DISTINCT card_id) AS cards, count(*) FILTER (value IS NULL) AS without_value FROM fct GROUP BY 1"),
    "crd14_material_revisions": "SELECT DISTINCT revision_id, card_id, as_of FROM card_revisions WHERE coalesce(json_array_length(delta->'$.added'), 0) + coalesce(json_array_length(delta->'$.removed'), 0) + coalesce(json_array_length(delta->'$.changed'), 0) > 0",
    "gra6_frequency": sql(_EDGES + " SELECT cik, slug, mention_count, frequency FROM scored", "men", "ent"),
    "gra7_spread": sql(_EDGES + " SELECT cik, slug, documents, spread FROM scored", "men", "ent"),
    "gra8_recency": sql(_EDGES + " SELECT cik, slug, latest_seen, recency FROM scored", "men", "ent"),
    "gra9_centrality": sql(_EDGES + " SELECT cik, slug, degree, centrality FROM scored", "men", "ent"),
    "gra11_relative_to_company": sql(_EDGES + " SELECT cik, max(frequency) AS most_frequent, max(centrality) AS most_central, max(importance) AS most_important FROM scored GROUP BY 1", "men", "ent"),
    "joi1_paragraphs_of_companies": sql("SELECT block_id, f.accession, f.form_type, ticker FROM par JOIN fil f USING (document_id) JOIN companies c ON c.cik = f.cik", "par", "fil"),
    "joi3_mentions_of_a_batch": sql("SELECT mention_id, ent.name AS label FROM men JOIN ent USING (cik, slug) WHERE EXISTS (SELECT 1 FROM par WHERE par.document_id = men.document_id AND par.paragraph_id = men.paragraph_id AND page_number <= 10)", "ent", "par"),
    "joi4_citation_places": sql(_FIRST + " SELECT extracted_id, block_id, CASE WHEN block_id IS NULL THEN 'no such paragraph' END AS error FROM ext LEFT JOIN plc USING (document_id, paragraph_id)", "ext", "par"),
    "joi7_companies_with_filings": sql("SELECT c.cik, count(document_id) AS filings, count(DISTINCT form_type) AS forms FROM companies c LEFT JOIN fil USING (cik) GROUP BY 1", "fil"),
    "joi8_mentions_with_places": sql(_FIRST + " SELECT mention_id, accession, block_id, page_number FROM men LEFT JOIN plc USING (document_id, paragraph_id)", "men", "par"),
    "joi12_text_or_filing": sql(_FIRST + ", whole AS (SELECT document_id, arg_min(text, (ordinal, block_id)) AS whole FROM par GROUP BY 1) SELECT extracted_id, CAST(length(coalesce(plc.text, whole)) AS INT) AS length, CASE WHEN plc.text IS NOT NULL THEN 'paragraph' WHEN whole IS NOT NULL THEN 'filing' END AS found FROM ext LEFT JOIN plc USING (document_id, paragraph_id) LEFT JOIN whole USING (document_id)", "ext", "par"),
    "joi18_filing_of_accession": sql("SELECT accession, document_id, name FROM fil JOIN companies USING (cik)", "fil"),
    "joi20_without_vectors": "SELECT DISTINCT doc_id FROM documents WHERE length(text) > 0 AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)",
    "joi23_topics_together": sql(_CO + " SELECT cik, source, target, weight FROM co WHERE weight >= 2", "men", "ent"),
    "joi24_known_ends": sql(_TYPED + " SELECT cik, source, target, relationship, weight AS documents FROM typed t WHERE EXISTS (SELECT 1 FROM ent e WHERE e.cik = t.cik AND e.slug = source AND mention_count >= 2) AND EXISTS (SELECT 1 FROM ent e WHERE e.cik = t.cik AND e.slug = target AND mention_count >= 2)", "men", "ent"),
    "joi27_filing_before": sql(_COMP + " SELECT document_id, before_id FROM comp WHERE before_id IS NOT NULL", "men"),
    "joi32_same_period_once": sql("SELECT cik, form_type, fiscal_period, arg_max(document_id, (filed_at, document_id)) AS document_id, count(*) AS filings FROM fil GROUP BY 1, 2, 3", "fil"),
    "joi34_fields_of_facts": sql("WITH " + _JF[2:] + " SELECT kind, field, count(*) AS facts, count(DISTINCT content) AS contents FROM (UNPIVOT fct ON label, value, unit, period, status INTO NAME field VALUE content) GROUP BY 1, 2"),
    "joi35_answers_of_requests": sql("SELECT request_id, failures, answers, CASE WHEN answers = 0 THEN 'no answer' WHEN failures = 0 THEN 'at once' ELSE 'after failures' END AS outcome FROM (SELECT request_id, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status IN ('success', 'fallback', 'cached')) AS answers FROM usage1 WHERE request_id IS NOT NULL GROUP BY 1) WHERE failures + answers > 0", "usage1"),
    "joi36_pages_of_citations": sql(_FIRST + " SELECT extracted_id, coalesce(CASE WHEN TRY_CAST(split_part(split_part(paragraph_id, '#', 1), '_', 1) AS INT) > 0 THEN TRY_CAST(split_part(split_part(paragraph_id, '#', 1), '_', 1) AS INT) END, page_number) AS page FROM ext JOIN plc USING (document_id, paragraph_id)", "ext", "par"),
    "joi37_cited_mentions": sql("SELECT mention_id, slug, CAST(length(quote) AS INT) AS length FROM men WHERE paragraph_id IS NOT NULL AND quote IS NOT NULL", "men"),
    "msc13_kinds": sql(f"SELECT list_position([{_IN}], entity_type)::BIGINT AS place, entity_type, count(*) AS n FROM ext WHERE entity_type IN ({_IN}) GROUP BY 2", "ext"),
    "msc16_evidence_of_revisions": sql("WITH " + _JF[2:] + " SELECT revision_id, place, evidence->>'$.paragraph_id' AS paragraph_id, TRY_CAST(evidence->>'$.page' AS INT) AS page FROM fct WHERE evidence IS NOT NULL AND json_type(evidence) = 'OBJECT'"),
    "msc17_history": "SELECT card_id, string_agg(revision_id::VARCHAR, ',' ORDER BY revision NULLS FIRST, revision_id) AS history FROM (SELECT DISTINCT card_id, revision, revision_id FROM card_revisions) GROUP BY 1",
    "msc20_kinds_as_text": sql("SELECT string_agg(DISTINCT entity_type, chr(10) ORDER BY entity_type) AS text FROM ext", "ext"),
    "msc36_usage_as_json": sql("SELECT usage_id, json_object('input_tokens', input_tokens, 'output_tokens', output_tokens, 'cached_tokens', cached_tokens)::VARCHAR AS usage FROM usage1", "usage1"),
    "msc40_chunks_written": _RECURSIVE(_PACKED + " SELECT count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM chunked", "par"),
    "msc42_pages": sql(", pg AS (SELECT document_id, page_number, count(*) AS paragraphs FROM par WHERE page_number > 0 GROUP BY 1, 2) SELECT *, lag(page_number) OVER w AS before, lead(page_number) OVER w AS after FROM pg WINDOW w AS (PARTITION BY document_id ORDER BY page_number)", "par"),
    "msc43_reading_view": sql("SELECT document_id, page_number, string_agg(paragraph_id, ',' ORDER BY ordinal, block_id) AS paragraph_ids, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number NULLS LAST) AS INT) AS place FROM par GROUP BY 1, 2", "par"),
    "msc48_event_log": "SELECT event_type, count(*) AS events, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "msc49_ticker": "SELECT upper(trim(ticker)) AS ticker, min(cik) AS cik, count(*) AS companies FROM companies WHERE ticker IS NOT NULL GROUP BY 1",
    "msc50_breakdown": sql("SELECT coalesce(task_type, 'unknown') AS name, status, count(*) AS attempts, CAST(sum(estimated_cost_usd) AS DECIMAL(38, 6)) AS cost FROM usage1 GROUP BY 1, 2", "usage1"),
    "msc54_styled": "SELECT DISTINCT doc_id, coalesce(regexp_matches(lower(text), '<style|style='), false) AS styled FROM documents",
    "msc56_paths": sql("SELECT document_id, 'filings/' || accession || '/source.' || lower(source_format) AS source, 'filings/' || accession || '/pages' AS pages FROM fil", "fil"),
    "prd1_routed": sql(_ROUTED + " SELECT document_id, ordinal, CAST(len(c) AS INT) AS cards FROM rc WHERE len(c) > 0", "fil"),
    "prd5_narrowed": sql(_CHANGES + " SELECT document_id, slug, paragraphs, previous_paragraphs FROM chg WHERE kind = 'narrowed'", "men"),
    "prd7_absences": sql(_CHANGES + " SELECT form_type, count(*) AS absences FROM chg WHERE kind = 'no_longer_disclosed' GROUP BY 1", "men"),
    "prd16_graph_until": sql(_EDGES + " SELECT cik, slug, importance FROM scored WHERE importance >= 50 AND (first_seen IS NULL OR first_seen <= DATE '2023-12-31')", "men", "ent"),
    "prd21_refused_entities": sql(_CHECKED + " SELECT extracted_id, reason FROM c WHERE reason IS NOT NULL", "ext", "par"),
    "prd24_unknown_kinds": sql(f"SELECT count(*) AS rows FROM ext WHERE NOT coalesce(entity_type IN ({_IN}), false)", "ext"),
    "prd26_broken_constraints": sql("SELECT usage_id FROM usage1 WHERE input_tokens < 0 OR cached_tokens > input_tokens OR latency_ms < 0", "usage1"),
    "prj20_paragraphs_once": _RECURSIVE(_PACKED + ", pos AS (SELECT c.document_id, c.sec, chunk, i - a AS place, paragraph_id FROM chunk c JOIN seq ON seq.document_id = c.document_id AND seq.sec = c.sec AND i BETWEEN a AND b) SELECT document_id, paragraph_id, arg_min(sec, (sec, chunk, place)) AS section, CAST(arg_min(chunk, (sec, chunk, place)) AS INT) AS chunk, count(*) AS chunks FROM pos GROUP BY 1, 2", "par"),
    "prj26_older_layout": sql("SELECT CASE entity_type WHEN 'strategy' THEN 'topic' WHEN 'executive' THEN 'person' WHEN 'risk' THEN 'risk' WHEN 'product' THEN 'product' WHEN 'metric' THEN 'metric' ELSE 'entity' END AS sort, count(*) AS n FROM ext WHERE entity_type <> 'metric' OR value IS NOT NULL GROUP BY 1", "ext"),
    "prj30_timeline_entries": sql(_CHANGES + """ SELECT key, CASE kind WHEN 'filed' THEN concat_ws(' ', nullif(fiscal_period, ''), ev.form_type) || ' Filed' WHEN 'newly_disclosed' THEN ent.name || ' Newly Disclosed' WHEN 'disclosed_again' THEN ent.name || ' Disclosed Again' WHEN 'expanded' THEN ent.name || ' Expanded'
        WHEN 'narrowed' THEN ent.name || ' Narrowed' ELSE ent.name || ' No Longer Disclosed' END AS title, upper(substr(coalesce(entity_type, 'Filing'), 1, 1)) || substr(coalesce(entity_type, 'Filing'), 2) AS category, strftime(ev.filed_at, '%b %Y') AS month FROM ev LEFT JOIN ent ON ent.cik = ev.cik AND ent.slug = ev.slug JOIN fil f ON f.document_id = ev.document_id""", "men", "ent"),
    "ret4_wrong_widths": "SELECT coalesce(len(embedding), -1)::INT AS width, count(*) AS vectors FROM embeddings GROUP BY 1",
    "sca9_table_sizes": sql("SELECT max(document_id) AS document_id, CAST(count(*) + 1 AS INT) AS rows, 3 AS columns FROM fil GROUP BY cik", "fil"),
    "sca13_chunk_anchors": _RECURSIVE(_PACKED + " SELECT document_id, 'c-' || coalesce(section_ordinal::VARCHAR, '') || '-' || chunk AS anchor, tokens FROM chunked", "par"),
    "sca22_located_quotes": sql(_FIRST + " SELECT extracted_id, contains(text, quote) AS exact FROM ext JOIN plc USING (document_id, paragraph_id) WHERE length(trim(quote)) > 0", "ext", "par"),
    "sca52_citation_labels": sql(_FIRST + " SELECT mention_id, concat_ws(', ', form_type, 'p. ' || nullif(page_number, 0)) AS label FROM men JOIN plc USING (document_id, paragraph_id)", "men", "par"),
    "sca58_fact_display": sql("WITH " + _JF[2:] + " SELECT revision_id, place, concat_ws(' ', label, value, unit, '(' || period || ')') AS shown FROM fct"),
    "sca64_dashes": sql("WITH " + _JF[2:] + " SELECT revision_id, place, coalesce(value, '—') AS value FROM fct"),
    "set1_all_edges": sql(_EDGES + " SELECT cik, relationship, count(*) AS edges FROM edges GROUP BY 1, 2", "men", "ent"),
    "set5_earlier_runs": sql(r", w AS (SELECT document_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM par WHERE length(text) > 0), r AS (SELECT document_id, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 2, 2))]) AS run FROM w WHERE len(w) > 0) SELECT document_id, count(DISTINCT run) AS runs FROM r GROUP BY 1", "par"),
    "set9_touched_cards": sql(_ROUTED + ", one AS (SELECT DISTINCT document_id, unnest(c) AS card FROM rc) SELECT document_id, string_agg(card, ',' ORDER BY card) AS cards FROM one GROUP BY 1", "fil"),
    "set10_distinct_citations": sql("SELECT DISTINCT document_id, paragraph_id FROM ext", "ext"),
    "snk12_cleared_memory": sql(", kept AS (SELECT * FROM ent WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.cik = ent.cik AND ticker IS NULL)) SELECT cik, count(*) AS entities, CAST(sum(mention_count) AS BIGINT) AS mentions FROM kept GROUP BY 1", "ent"),
    "snk15_log_lines": sql("""SELECT usage_id, '{"id":' || usage_id || coalesce(',"provider":' || to_json(provider), '') || coalesce(',"model":' || to_json(model), '') || coalesce(',"status":' || to_json(status), '') || coalesce(',"tokens":' || input_tokens, '') || ',"message":' || to_json(regexp_replace(error_message, '[A-Za-z0-9_-]{24,}', '[redacted]', 'g')) || '}' AS line FROM usage1 WHERE error_message IS NOT NULL""", "usage1"),
    "srt6_kind_ranks": sql(_CHANGES + ' SELECT kind, "rank", count(*) AS events FROM ev GROUP BY 1, 2', "men"),
    "srt7_spine": sql("SELECT filed_at AS occurred_at, 'filing' AS kind, accession AS ref, cik FROM fil UNION ALL SELECT first_seen, entity_type, slug, cik FROM ent", "ent", "fil"),
    "srt15_first_chunks": sql("SELECT document_id, block_id, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, block_id) AS p FROM par) WHERE p <= 3", "par"),
    "srt16_newest_filing": sql("SELECT cik, arg_max(document_id, (filed_at, document_id)) AS document_id FROM fil GROUP BY 1", "fil"),
    "tml8_days": sql(_COMP + " SELECT filed_at AS day, count(*) AS comparisons FROM comp WHERE before_id IS NOT NULL GROUP BY 1", "men"),
    "win10_newest_revisions": "SELECT card_id, arg_max(revision_id, (coalesce(revision, -1), revision_id)) AS revision_id FROM card_revisions GROUP BY 1",
    "win12_overlaps": _RECURSIVE(_PACKED + ", ov AS (SELECT document_id, section_ordinal, chunk, string_split(paragraph_ids, ',') AS p, lag(string_split(paragraph_ids, ',')) OVER (PARTITION BY document_id, section_ordinal ORDER BY chunk) AS before FROM chunked) SELECT document_id, section_ordinal, CAST(chunk AS INT) AS chunk, CAST(len(list_intersect(p, before)) AS INT) AS shared FROM ov WHERE before IS NOT NULL", "par"),
}
