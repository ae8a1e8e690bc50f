"""Further small operators of the inventory: views of filings, entities and cards, labels, and checks of what arrives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import cards as CD
from tallyfold.operators import carried as CO
from tallyfold.operators import graph as G
from tallyfold.operators import snapshots
from tallyfold.operators import timeline as TL
from tallyfold.plans.cards import _OVER, _facts, _fragments, _quotes, _texts
from tallyfold.plans.dealt import SQL as DEALT
from tallyfold.plans.derived import _CHANGES, _EDGES, _TYPED, FILED, _edges, _links
from tallyfold.plans.entries import _FIRST, _ROUTED, KINDS, _places, _titled
from tallyfold.plans.model import entities, extractions, filings, mentions, paragraphs, sql, table, usage
from tallyfold.plans.pages import _DRAWN, _lines
from tallyfold.plans.parsing import _PACKED, _RECURSIVE, _TABLED, _blocks, _chunks, _tables

C = F.col
WORDS = ("revenue", "risk", "supplier", "export", "margin", "demand", "cash", "plant", "customer", "growth", "cost", "market")


def _rules(s, d):
    """Every card of the rules with the fragments routed to it, cards without any included."""
    rules = s.createDataFrame([(i, r[0]) for i, r in enumerate(CD.RULES)], "place int, card string")
    hits = _fragments(s, d).where("cards <> ''").select(F.explode(F.split("cards", ",")).alias("card")).groupBy("card").agg(F.count("*").alias("fragments"))
    return rules.join(hits, "card", "left").select("place", "card", F.coalesce("fragments", F.lit(0)).alias("fragments"))


def _deltas(s, d):
    """Each snapshot's changes as a JSON object of sorted keys."""
    rows = snapshots.found(table(s, d, "card_revisions"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(C("change") == kind, C("fact_key")))).alias(kind)
    return rows.groupBy("card_id", "document_id").agg(of("added"), of("removed"), of("changed")).select("card_id", "document_id", F.to_json(F.struct("added", "removed", "changed")).alias("delta"))


def _bodies(s, d):
    """What has arrived in place of a list of facts."""
    facts = C("facts")
    kind = F.when(facts.isNull(), "null").when(F.json_array_length(facts).isNull(), "no list").when(F.json_array_length(facts) == 0, "empty").otherwise("facts")
    return table(s, d, "card_revisions").groupBy(kind.alias("body")).agg(F.count("*").alias("rows"))


def _generated(s, pages=87, each=13, words=40):
    """A filing of `pages` pages made by rule, for load tests: page, paragraph, text; the same on every run."""
    rows = s.range(pages * each).select((F.floor(C("id") / each) + 1).cast("int").alias("page"), (C("id") % each + 1).cast("int").alias("paragraph"), "id")
    pool = F.array(*[F.lit(w) for w in WORDS])
    said = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.element_at(pool, ((C("id") * 7919 + k * 104729 + C("id") * k) % len(WORDS) + 1).cast("int")))
    return rows.select("page", "paragraph", F.array_join(said, " ").alias("text"))


def _ranked_cards(s, d):
    """Cards by their number of revisions, those with a history first."""
    r = table(s, d, "card_revisions").groupBy("kind", "card_id").agg(F.count_distinct("document_id").alias("revisions"))
    w = Window.partitionBy("kind").orderBy((C("revisions") > 1).cast("int").desc(), "card_id")
    return r.withColumn("place", F.row_number().over(w)).where("place <= 10")


QUERIES = {
    "crd7_cards_of_rules": lambda s, d: _rules(s, d).where("fragments = 0").select("card"),
    "joi6_degrees_of_all": lambda s, d: entities(s, d).select("cik", "slug").join(G.degrees(_edges(s, d)), ["cik", "slug"], "left").select("cik", "slug", F.coalesce("degree", F.lit(0)).alias("degree")),
    "joi9_sections_of_mentions": lambda s, d: mentions(s, d).join(entities(s, d).select("cik", "slug", C("name").alias("label")), ["cik", "slug"]).join(_places(s, d, "section_ordinal"), ["document_id", "paragraph_id"], "left").select("mention_id", "label", "section_ordinal"),
    "joi14_filings_of_edges": lambda s, d: G.asserted(_links(s, d), entities(s, d)).select("cik", "source", "target", "relationship", F.explode("documents").alias("document_id")),
    "joi30_topic_rows": lambda s, d: mentions(s, d).join(entities(s, d).where(C("entity_type").isin("risk", "strategy")).select("cik", "slug", "first_seen"), ["cik", "slug"]).select("mention_id", "slug", (C("filed_at") == C("first_seen")).alias("is_first")),
    "msc9_line_tops": lambda s, d: _lines(s, d).select("document_id", "page", "line", (C("baseline") - 0.75 * C("size")).alias("top"), (C("baseline") + 0.25 * C("size")).alias("bottom")),
    "msc34_error_kinds": lambda s, d: usage(s, d, "error_message").where("error_message is not null").groupBy(F.when(C("error_message").rlike("(?i)quota|rate limit|429"), "quota").when(C("error_message").rlike("(?i)time"), "timeout").otherwise("other").alias("kind")).agg(F.count("*").alias("attempts")),
    "msc44_company_filings": lambda s, d: filings(s, d, *FILED).select("document_id", "cik", "accession", "filed_at").join(paragraphs(s, d, "document_id").groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left").select("cik", "accession", "filed_at", F.coalesce("n", F.lit(0)).alias("paragraphs")),
    "msc45_entity_list": lambda s, d: entities(s, d).orderBy(F.desc("mention_count"), "cik", "slug").limit(100).select("cik", "slug", "mention_count"),
    "msc46_entity_mentions": lambda s, d: mentions(s, d).join(_places(s, d, "page_number"), ["document_id", "paragraph_id"], "left").select("mention_id", "cik", "slug", F.nullif("page_number", F.lit(0)).alias("page")),
    "prd3_rules": _rules,
    "prd14_events_since": lambda s, d: table(s, d, "events").where((C("event_type") == "purchase") & (F.to_date("ts") >= F.lit("2024-01-10").cast("date"))).select("event_id", "user_id"),
    "prd25_relationships": lambda s, d: G.asserted(_links(s, d), entities(s, d)).where(C("relationship").isin(*[f"tells_of_{k}" for k in KINDS])).groupBy("relationship").agg(F.count("*").alias("edges")),
    "prj4_pages_of_markup": lambda s, d: _blocks(s, d).groupBy("document_id").agg(F.max("page").alias("pages")),
    "prj19_viewer_blocks": lambda s, d: _chunks(s, d).select("document_id", "section_ordinal", "chunk", F.posexplode("paragraph_ids").alias("place", "paragraph_id")).select("document_id", "section_ordinal", "chunk", "place", "paragraph_id", F.try_element_at(F.split("paragraph_id", "_"), F.lit(1)).try_cast("int").alias("page")),
    "prj21_rendered_paragraphs": lambda s, d: paragraphs(s, d, "document_id", "paragraph_id", "page_number", "ordinal").where("page_number is not null and page_number <> 0").groupBy("document_id", "paragraph_id").agg(F.min(F.struct("ordinal", "block_id")).alias("at")).select("document_id", "paragraph_id", "at.ordinal", "at.block_id"),
    "prj25_chunk_rows": lambda s, d: _chunks(s, d).select("document_id", "section_ordinal", "chunk", F.sha2("text", 256).alias("sha256"), F.length("text").alias("char_count"), "tokens", F.size("paragraph_ids").alias("paragraphs")),
    "ret19_bodies": _bodies,
    "ret27_company_of_ticker": lambda s, d: table(s, d, "companies").where("ticker is not null").select(F.upper("ticker").alias("ticker"), "cik", "name"),
    "sca8_table_rows": lambda s, d: _tables(s, d).select("document_id", (F.size("cells") - 1).alias("body_rows")),
    "sca10_table_text": lambda s, d: _tables(s, d).select("document_id", F.concat("caption", F.lit("\n"), F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n")).alias("text")),
    "sca36_runs_of_quotes": lambda s, d: extractions(s, d, "quote").withColumn("w", T.said(C("quote"))).where("size(w) >= 4").select("extracted_id", F.size(T.shingles(C("w"))).alias("runs")),
    "sca42_longest_new": lambda s, d: CO.new_words(_quotes(s, d), _texts(s, d), "mention_id", "before_id").where("longest >= 4").select("mention_id", "longest"),
    "sca43_said_again": lambda s, d: CO.already_said(_quotes(s, d), _texts(s, d), "mention_id", "before_id"),
    "sca46_event_categories": lambda s, d: _titled(s, d).select("key", "category"),
    "sca47_event_titles": lambda s, d: _titled(s, d).select("key", "title"),
    "sca50_paragraph_counts": lambda s, d: TL.topic_counts(mentions(s, d)).select("document_id", "slug", F.concat(C("n").cast("string"), F.when(C("n") == 1, " paragraph").otherwise(" paragraphs")).alias("text")),
    "sca59_deltas": _deltas,
    "sca60_material": lambda s, d: snapshots.found(table(s, d, "card_revisions")).groupBy("card_id", "document_id").agg(F.count("*").alias("changes")),
    "sca85_provenance": lambda s, d: extractions(s, d, "document_id", "paragraph_id").where("paragraph_id is not null").select("extracted_id", F.to_json(F.struct("document_id", "paragraph_id")).alias("source")),
    "snk4_vectors_of_documents": lambda s, d: table(s, d, "documents").select("doc_id").distinct().join(table(s, d, "embeddings").select(C("vec_id").alias("doc_id"), "label", F.size("embedding").alias("width")), "doc_id", "left").select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("width", F.lit(0)).alias("width")),
    "src25_generated_filing": lambda s, d: _generated(s),
    "srt8_card_facts": lambda s, d: _facts(s, d).withColumn("place", F.row_number().over(Window.partitionBy("cik", "card", "document_id").orderBy(F.desc("paragraphs"), "slug"))).where("place <= 5").select("cik", "card", "document_id", "slug", "place"),
    "srt17_cards_by_history": _ranked_cards,
    "win8_revision_numbers": lambda s, d: snapshots.card_snapshots(table(s, d, "card_revisions")).groupBy("card_id", "document_id", "next_document_id", "is_first").agg(F.count("fact_key").alias("facts")).select("card_id", "document_id", "next_document_id", "is_first", "facts"),
}

_P5 = DEALT["p5_found"].strip()
_POOL = ", ".join(f"'{w}'" for w in WORDS)

SQL = {
    "crd7_cards_of_rules": sql(_ROUTED + ", u AS (SELECT unnest(c) AS card FROM rc) SELECT card FROM (VALUES ('revenue'), ('products'), ('guidance'), ('risks'), ('capex'), ('litigation')) v(card) WHERE card NOT IN (SELECT card FROM u)", "fil"),
    "joi6_degrees_of_all": sql(_EDGES + " SELECT cik, slug, degree FROM scored", "men", "ent"),
    "joi9_sections_of_mentions": sql(", plc AS (SELECT document_id, paragraph_id, arg_min_null(section_ordinal, block_id) AS section_ordinal FROM par GROUP BY 1, 2) SELECT mention_id, ent.name AS label, section_ordinal FROM men JOIN ent USING (cik, slug) LEFT JOIN plc USING (document_id, paragraph_id)", "ent", "par"),
    "joi14_filings_of_edges": sql(_TYPED + " SELECT cik, source, target, relationship, unnest(documents) AS document_id FROM typed", "men", "ent"),
    "joi30_topic_rows": sql("SELECT mention_id, slug, filed_at = first_seen AS is_first FROM men JOIN (SELECT cik, slug, first_seen, entity_type AS k FROM ent) e USING (cik, slug) WHERE k IN ('risk', 'strategy')", "ent"),
    "msc9_line_tops": sql(_DRAWN + " SELECT document_id, page, line, baseline - 7.5 AS top, baseline + 2.5 AS bottom FROM lines", "par"),
    "msc34_error_kinds": sql("SELECT CASE WHEN regexp_matches(error_message, '(?i)quota|rate limit|429') THEN 'quota' WHEN regexp_matches(error_message, '(?i)time') THEN 'timeout' ELSE 'other' END AS kind, count(*) AS attempts FROM usage1 WHERE error_message IS NOT NULL GROUP BY 1", "usage1"),
    "msc44_company_filings": sql("SELECT cik, fil.accession, filed_at, coalesce(n, 0) AS paragraphs FROM fil LEFT JOIN (SELECT document_id, count(*) AS n FROM par GROUP BY 1) USING (document_id)", "fil", "par"),
    "msc45_entity_list": sql("SELECT cik, slug, mention_count FROM ent ORDER BY mention_count DESC, cik, slug LIMIT 100", "ent"),
    "msc46_entity_mentions": sql(_FIRST.replace("arg_min(page", "arg_min_null(page") + " SELECT mention_id, cik, slug, nullif(page_number, 0) AS page FROM men LEFT JOIN plc USING (document_id, paragraph_id)", "men", "par"),
    "prd3_rules": sql(_ROUTED + ", u AS (SELECT unnest(c) AS card FROM rc) SELECT CAST(place AS INT) AS place, v.card, (SELECT count(*) FROM u WHERE u.card = v.card) AS fragments FROM (VALUES (0, 'revenue'), (1, 'products'), (2, 'guidance'), (3, 'risks'), (4, 'capex'), (5, 'litigation')) v(place, card)", "fil"),
    "prd14_events_since": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) >= DATE '2024-01-10'",
    "prd25_relationships": sql(_TYPED + " SELECT relationship, count(*) AS edges FROM typed WHERE relationship LIKE 'tells_of_%' GROUP BY 1", "men", "ent"),
    "prj4_pages_of_markup": sql("SELECT document_id, CAST(count(DISTINCT coalesce(page_number, 0)) AS INT) AS pages FROM par GROUP BY 1", "par"),
    "prj19_viewer_blocks": _RECURSIVE(_PACKED + " SELECT c.document_id, nullif(c.sec, -1) AS section_ordinal, CAST(chunk AS INT) AS chunk, CAST(i - a AS INT) AS place, paragraph_id, TRY_CAST(split_part(paragraph_id, '_', 1) AS INT) AS page FROM chunk c JOIN seq ON seq.document_id = c.document_id AND seq.sec = c.sec AND i BETWEEN a AND b", "par"),
    "prj21_rendered_paragraphs": sql("SELECT document_id, paragraph_id, arg_min(ordinal, (ordinal, block_id)) AS ordinal, arg_min(block_id, (ordinal, block_id)) AS block_id FROM par WHERE page_number <> 0 GROUP BY 1, 2", "par"),
    "prj25_chunk_rows": _RECURSIVE(_PACKED + " SELECT document_id, section_ordinal, CAST(chunk AS INT) AS chunk, sha256(text) AS sha256, CAST(length(text) AS INT) AS char_count, tokens, CAST(len(string_split(paragraph_ids, ',')) AS INT) AS paragraphs FROM chunked", "par"),
    "ret19_bodies": "SELECT CASE WHEN facts IS NULL THEN 'null' WHEN NOT json_valid(facts) OR json_type(CASE WHEN json_valid(facts) THEN facts END) <> 'ARRAY' THEN 'no list' WHEN json_array_length(CASE WHEN json_valid(facts) THEN facts END) = 0 THEN 'empty' ELSE 'facts' END AS body, count(*) AS rows FROM card_revisions GROUP BY 1",
    "ret27_company_of_ticker": "SELECT upper(ticker) AS ticker, cik, name FROM companies WHERE ticker IS NOT NULL",
    "sca8_table_rows": sql("SELECT max(document_id) AS document_id, CAST(count(*) AS INT) AS body_rows FROM fil GROUP BY cik", "fil"),
    "sca10_table_text": _RECURSIVE(_TABLED + " SELECT document_id, text FROM whole", "fil"),
    "sca36_runs_of_quotes": sql(r", q AS (SELECT extracted_id, regexp_extract_all(lower(quote), '[\p{L}\p{N}_]+') AS w FROM ext WHERE quote IS NOT NULL) SELECT extracted_id, CAST(len(list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)])) AS INT) AS runs FROM q WHERE len(w) >= 4", "ext"),
    "sca42_longest_new": sql(_OVER + " SELECT mention_id, longest FROM nw WHERE longest >= 4", "men", "par"),
    "sca43_said_again": sql(_OVER + " SELECT mention_id FROM ov JOIN nw USING (mention_id) WHERE share >= 0.5 AND longest < 4", "men", "par"),
    "sca46_event_categories": sql(_CHANGES + " SELECT key, upper(substr(coalesce(entity_type, 'Filing'), 1, 1)) || substr(coalesce(entity_type, 'Filing'), 2) AS category FROM ev LEFT JOIN ent ON ent.cik = ev.cik AND ent.slug = ev.slug", "men", "ent"),
    "sca47_event_titles": sql(_CHANGES + """ SELECT key, CASE kind WHEN 'filed' THEN concat_ws(' ', nullif(fiscal_period, ''), ev.form_type) || ' Filed' ELSE ent.name || CASE kind WHEN 'newly_disclosed' THEN ' Newly Disclosed' WHEN 'disclosed_again' THEN ' Disclosed Again' WHEN 'expanded' THEN ' Expanded' WHEN 'narrowed' THEN ' Narrowed' ELSE ' No Longer Disclosed' END END AS title
        FROM ev LEFT JOIN ent ON ent.cik = ev.cik AND ent.slug = ev.slug JOIN fil f ON f.document_id = ev.document_id""", "men", "ent"),
    "sca50_paragraph_counts": sql(_CHANGES + " SELECT document_id, slug, n || CASE WHEN n = 1 THEN ' paragraph' ELSE ' paragraphs' END AS text FROM cnt", "men"),
    "sca59_deltas": f"""WITH p AS ({_P5}), l AS (SELECT card_id, document_id, {", ".join(f"coalesce(string_agg(to_json(fact_key)::VARCHAR, ',' ORDER BY fact_key) FILTER (change = '{k}'), '') AS {k}" for k in ("added", "removed", "changed"))} FROM p GROUP BY 1, 2)
        SELECT card_id, document_id, '{{"added":[' || added || '],"removed":[' || removed || '],"changed":[' || changed || ']}}' AS delta FROM l""",
    "sca60_material": f"SELECT card_id, document_id, count(*) AS changes FROM ({_P5}) GROUP BY 1, 2",
    "sca85_provenance": sql("""SELECT extracted_id, '{"document_id":' || document_id || ',"paragraph_id":' || to_json(paragraph_id) || '}' AS source FROM ext WHERE paragraph_id IS NOT NULL""", "ext"),
    "snk4_vectors_of_documents": "SELECT doc_id, coalesce(label, -1) AS label, CAST(coalesce(len(embedding), 0) AS INT) AS width FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN embeddings ON vec_id = doc_id",
    "src25_generated_filing": f"SELECT CAST(id // 13 + 1 AS INT) AS page, CAST(id % 13 + 1 AS INT) AS paragraph, array_to_string([([{_POOL}])[(id * 7919 + k * 104729 + id * k) % {len(WORDS)} + 1] FOR k IN range(0, 40)], ' ') AS text FROM range(0, 1131) r(id)",
    "srt8_card_facts": sql(_CHANGES + r""", tl AS (SELECT document_id, ordinal AS section_ordinal, min(title) AS title FROM sections GROUP BY 1, 2), pl AS (SELECT document_id, paragraph_id, min(section_ordinal) AS section_ordinal FROM par GROUP BY 1, 2),
        rw AS (SELECT men.*, title FROM men JOIN pl USING (document_id, paragraph_id) LEFT JOIN tl USING (document_id, section_ordinal) WHERE form_type IN ('10-K', '20-F', '40-F')),
        cd AS (SELECT *, 'risks' AS card FROM rw WHERE regexp_matches(title, '(?i)item\s*1a|risk\s*factors') UNION ALL SELECT *, 'litigation' FROM rw WHERE regexp_matches(title, '(?i)item\s*3|legal\s*proceedings')),
        fc AS (SELECT cik, card, document_id, slug, count(DISTINCT split_part(paragraph_id, '#', 1)) AS paragraphs FROM cd GROUP BY 1, 2, 3, 4)
        SELECT cik, card, document_id, slug, CAST(row_number() OVER (PARTITION BY cik, card, document_id ORDER BY paragraphs DESC, slug) AS INT) AS place FROM fc QUALIFY place <= 5""", "men", "par"),
    "srt17_cards_by_history": "SELECT kind, card_id, revisions, CAST(row_number() OVER (PARTITION BY kind ORDER BY CAST(revisions > 1 AS INT) DESC, card_id) AS INT) AS place FROM (SELECT kind, card_id, count(DISTINCT document_id) AS revisions FROM card_revisions GROUP BY 1, 2) QUALIFY place <= 10",
    "win8_revision_numbers": _P5[: _P5.index("), pairs AS (")] + "), nx AS (SELECT *, lead(document_id) OVER (PARTITION BY card_id ORDER BY as_of, document_id) AS next_document_id FROM seq) SELECT nx.card_id, nx.document_id, next_document_id, before IS NULL AS is_first, count(DISTINCT fact_key) AS facts FROM nx LEFT JOIN facts f ON f.card_id = nx.card_id AND f.document_id = nx.document_id GROUP BY 1, 2, 3, 4",
}
