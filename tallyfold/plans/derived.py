"""Queries on what is derived from mentions: graph and timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import graph as G
from tallyfold.operators import timeline as TL
from tallyfold.plans.model import entities, entities_of, filings, mentions, paragraphs, sql
from tallyfold.storage import written


FILED = ("cik", "accession", "form_type", "filed_at")


def links_of(m):
    """Edges stated by a paragraph: from a company named in it to every other thing cited there."""
    a = m.where("entity_type = 'company'").select("cik", "document_id", "paragraph_id", "filed_at", F.col("slug").alias("source")).distinct()
    b = m.where("entity_type <> 'company'").select("cik", "document_id", "paragraph_id", F.col("slug").alias("target"), F.concat(F.lit("tells_of_"), F.col("entity_type")).alias("relationship")).distinct()
    return a.join(b, ["cik", "document_id", "paragraph_id"])


def _links(s, d):
    return links_of(mentions(s, d))


def _world(s, d):
    """Mentions, entities and edges, each computed once for a query that uses them several times."""
    m = written(mentions(s, d), "graph-mentions")
    e = written(entities_of(m), "graph-entities")
    edges = G.co_occurrence(m).unionByName(G.asserted(links_of(m), e))
    return m, e, written(edges, "graph-edges")


def _edges(s, d):
    return _world(s, d)[2]


def _listed(edges):
    """An edge's filings as one text."""
    return edges.withColumn("documents", F.array_join(F.transform("documents", lambda x: x.cast("string")), ","))


def _graph(s, d):
    """Scored entities, and the edges they were scored with."""
    m, e, edges = _world(s, d)
    return G.scored(e, m, edges), edges


def _scores(s, d):
    return _graph(s, d)[0]


_CITED = """, cited AS (SELECT DISTINCT cik, document_id, slug FROM men)"""
_CO = _CITED + """, co AS (
  SELECT a.cik, a.slug AS source, b.slug AS target, 'mentioned_with' AS relationship, count(*) AS weight, list_sort(list(DISTINCT document_id)) AS documents
  FROM cited a JOIN cited b USING (cik, document_id) WHERE a.slug < b.slug GROUP BY 1, 2, 3
), cospan AS (
  SELECT co.*, least(x.first_seen, y.first_seen) AS first_seen, greatest(x.latest_seen, y.latest_seen) AS last_seen
  FROM co JOIN ent x ON x.cik = co.cik AND x.slug = source JOIN ent y ON y.cik = co.cik AND y.slug = target)"""
_TYPED = """, links AS (
  SELECT DISTINCT a.cik, a.document_id, a.filed_at, a.slug AS source, b.slug AS target, 'tells_of_' || b.entity_type AS relationship
  FROM men a JOIN men b USING (cik, document_id, paragraph_id) WHERE a.entity_type = 'company' AND b.entity_type <> 'company'
), typed AS (
  SELECT cik, source, target, relationship, count(DISTINCT document_id) AS weight, list_sort(list(DISTINCT document_id)) AS documents, min(filed_at) AS first_seen, max(filed_at) AS last_seen
  FROM links WHERE source <> target GROUP BY 1, 2, 3, 4)"""
_EDGES = _CO + _TYPED + """, edges AS (SELECT * FROM cospan UNION ALL SELECT * FROM typed),
  strong AS (SELECT e.*, round_even(least(1.0::DOUBLE, weight::DOUBLE / max(weight) OVER (PARTITION BY cik)), 4) AS strength FROM edges e),
  deg AS (SELECT cik, slug, count(*) AS degree FROM (SELECT cik, source AS slug FROM edges UNION ALL SELECT cik, target FROM edges) GROUP BY 1, 2),
  tot AS (SELECT cik, count(DISTINCT document_id) AS total, max(filed_at) AS newest FROM men GROUP BY 1),
  base AS (SELECT e.*, coalesce(degree, 0) AS degree, total, newest, max(mention_count) OVER (PARTITION BY cik) AS mm, max(coalesce(degree, 0)) OVER (PARTITION BY cik) AS md
    FROM ent e LEFT JOIN deg USING (cik, slug) JOIN tot USING (cik)),
  parts AS (SELECT *, round_even(ln(1 + mention_count::DOUBLE) / ln(1 + mm::DOUBLE), 4) AS frequency, round_even(least(1.0::DOUBLE, documents::DOUBLE / total), 4) AS spread,
    round_even(pow(0.5::DOUBLE, greatest(0, newest - latest_seen) / 540.0::DOUBLE), 4) AS recency, CASE WHEN md > 0 THEN round_even(degree::DOUBLE / md, 4) ELSE 0 END AS centrality FROM base),
  scored AS (SELECT *, greatest(0, least(100, CAST(round_even((0.35::DOUBLE * frequency + 0.25::DOUBLE * spread + 0.2::DOUBLE * recency + 0.2::DOUBLE * centrality) * 100, 0) AS INT))) AS importance FROM parts)"""

_COMP = """, comp AS (SELECT *, lag(document_id) OVER w AS before_id, lead(document_id) OVER w AS next_id FROM fil
    WHERE form_type IN ('10-K', '10-Q', '20-F', '40-F') WINDOW w AS (PARTITION BY cik, form_type ORDER BY filed_at, accession)),
  cnt AS (SELECT document_id, slug, count(DISTINCT coalesce(split_part(paragraph_id, '#', 1), 'mention:' || mention_id)) AS n FROM men GROUP BY 1, 2)"""
_CHANGES = _COMP + """, cmp AS (
    SELECT document_id, before_id, slug, sum(a)::BIGINT AS after, sum(b)::BIGINT AS before FROM (
      SELECT c.document_id, c.before_id, n.slug, n.n AS a, 0 AS b FROM comp c JOIN cnt n USING (document_id) WHERE before_id IS NOT NULL
      UNION ALL SELECT c.document_id, c.before_id, n.slug, 0, n.n FROM comp c JOIN cnt n ON n.document_id = c.before_id) GROUP BY 1, 2, 3),
  seen AS (SELECT x.document_id, x.slug, list_sort(list(DISTINCT p.form_type)) AS seen_in FROM cmp x JOIN comp c USING (document_id)
    JOIN comp p ON p.cik = c.cik AND (p.filed_at, p.accession) < (c.filed_at, c.accession) JOIN cnt n ON n.document_id = p.document_id AND n.slug = x.slug
    WHERE after > 0 AND before = 0 GROUP BY 1, 2),
  kinds AS (SELECT x.*, c.cik, c.accession, c.form_type, c.filed_at, coalesce(seen_in, []) AS seen_in,
    CASE WHEN after > 0 AND before = 0 AND list_contains(coalesce(seen_in, []), c.form_type) THEN 'disclosed_again' WHEN after > 0 AND before = 0 THEN 'newly_disclosed'
      WHEN before > 0 AND after = 0 THEN CASE WHEN c.form_type IN ('10-K', '20-F', '40-F') THEN 'no_longer_disclosed' END
      WHEN after - before >= 3 AND after >= 1.25 * before THEN 'expanded' WHEN before - after >= 3 AND before >= 1.25 * after THEN 'narrowed' END AS kind
    FROM cmp x JOIN comp c USING (document_id) LEFT JOIN seen s ON s.document_id = x.document_id AND s.slug = x.slug),
  chg AS (SELECT document_id, before_id, cik, accession, form_type, filed_at, slug, kind, after AS paragraphs, before AS previous_paragraphs,
    CASE WHEN kind = 'newly_disclosed' THEN array_to_string(seen_in, ' and a ') ELSE '' END AS named_earlier_in FROM kinds WHERE kind IS NOT NULL),
  ev AS (SELECT *, CASE kind WHEN 'filed' THEN 0 WHEN 'newly_disclosed' THEN 1 WHEN 'expanded' THEN 2 WHEN 'narrowed' THEN 3 WHEN 'no_longer_disclosed' THEN 4 ELSE 5 END AS "rank", accession || ':' || kind || ':' || slug AS key
    FROM (SELECT document_id, NULL::BIGINT AS before_id, cik, accession, form_type, filed_at, '' AS slug, 'filed' AS kind, NULL::BIGINT AS paragraphs, NULL::BIGINT AS previous_paragraphs, '' AS named_earlier_in FROM fil UNION ALL SELECT * FROM chg))"""


def _nodes(s, d):
    return G.nodes(_scores(s, d), min_importance=30)


def _pruned(s, d):
    """Nodes from an importance of 30 up, and the edges between them."""
    scores, edges = _graph(s, d)
    kept = written(G.nodes(scores, min_importance=30), "graph-nodes")
    return kept, G.kept_edges(edges, kept)


def _contract(s, d):
    """Each company's 40 most important nodes and the edges between them as one document."""
    scores, edges = _graph(s, d)
    top = written(G.nodes(scores, limit=40), "graph-top")
    return G.contract(top, G.kept_edges(edges, top))


def _as_of(s, d):
    scores = _scores(s, d)
    until = F.lit("2022-12-31").cast("date")
    return G.nodes(scores.where(F.col("first_seen").isNull() | (F.col("first_seen") <= until)))


def _categories(s, d):
    types = entities(s, d).select("cik", "slug", "entity_type")
    rows = TL.changes(filings(s, d, *FILED), mentions(s, d)).join(types, ["cik", "slug"], "left")
    return rows.groupBy(F.initcap(F.coalesce("entity_type", F.lit("Filing"))).alias("category"), "kind").agg(F.count("*").alias("events"))


def _newest_events(s, d):
    rows = TL.events(filings(s, d, *FILED), mentions(s, d))
    n = F.abs(F.coalesce("paragraphs", F.lit(0)) - F.coalesce("previous_paragraphs", F.lit(0)))
    return rows.withColumn("moved", n).orderBy(F.desc("filed_at"), "accession", "rank", F.desc("moved"), "slug").limit(100).select("key", "filed_at", "moved")


def _evidence(s, d):
    return TL.evidence(TL.changes(filings(s, d, *FILED), mentions(s, d)), mentions(s, d, "quote"), paragraphs(s, d, "document_id", "paragraph_id", "text"))


def _titles(s, d):
    """The sentence shown beside an event."""
    c = F.col
    plural = lambda x: F.concat(c(x).cast("string"), F.when(c(x) == 1, " paragraph").otherwise(" paragraphs"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    cited, was, before = say("Cited in ", plural("paragraphs")), F.coalesce(c("was"), F.lit("last filing")), c("previous_paragraphs").cast("string")
    first = F.when(c("named_earlier_in") != "", say(cited, "; first time in a ", c("form_type"), ", named earlier in a ", c("named_earlier_in"), ".")).otherwise(say(cited, "; in no earlier filing on record."))
    text = (
        F.when(c("kind") == "newly_disclosed", first)
        .when(c("kind") == "disclosed_again", say(cited, "; absent from the ", was, ", cited in an earlier ", c("form_type"), "."))
        .when(c("kind") == "expanded", say(cited, ", up from ", before, " in the ", was, "."))
        .when(c("kind") == "narrowed", say(cited, ", down from ", before, " in the ", was, "."))
        .otherwise(say("Cited in ", plural("previous_paragraphs"), " of the ", was, "; in none of this filing."))
    )
    labels = filings(s, d, "fiscal_period", "form_type").select(F.col("document_id").alias("before_id"), F.concat_ws(" ", F.nullif("fiscal_period", F.lit("")), "form_type").alias("was"))
    return TL.events(filings(s, d, *FILED), mentions(s, d)).where("kind <> 'filed'").join(labels, "before_id", "left").select("key", text.alias("summary"))


_PL = "{x}::VARCHAR || CASE WHEN {x} = 1 THEN ' paragraph' ELSE ' paragraphs' END"
_P, _B = _PL.format(x="paragraphs"), _PL.format(x="previous_paragraphs")

QUERIES = {
    "gra1_co_occurrence": lambda s, d: _listed(G.co_occurrence(mentions(s, d))),
    "gra3_asserted_edges": lambda s, d: _listed(G.asserted(_links(s, d), entities(s, d))),
    "gra4_strength": lambda s, d: G.with_strength(_edges(s, d)).select("cik", "source", "target", "relationship", "strength"),
    "gra5_degrees": lambda s, d: G.degrees(_edges(s, d)),
    "gra10_importance": lambda s, d: _scores(s, d).select("cik", "slug", "frequency", "spread", "recency", "centrality", "importance"),
    "gra12_graph_nodes": _nodes,
    "gra12_graph_edges": lambda s, d: _pruned(s, d)[1],
    "gra12_graph_contract": _contract,
    "gra13_explained": lambda s, d: _scores(s, d).select("cik", "slug", "importance", "mention_count", "documents", "latest_seen", "degree", "frequency", "spread", "recency", "centrality"),
    "gra14_graph_as_of": _as_of,
    "srt3_top_nodes": lambda s, d: G.nodes(_scores(s, d), limit=5),
    "tml1_events": lambda s, d: TL.events(filings(s, d, *FILED), mentions(s, d)),
    "tml2_changes": lambda s, d: TL.changes(filings(s, d, *FILED), mentions(s, d)),
    "tml4_evidence": _evidence,
    "tml6_categories": _categories,
    "srt5_newest_events": _newest_events,
    "sca48_event_summaries": _titles,
    "win2_previous_filing": lambda s, d: TL.comparable(filings(s, d, *FILED)).select("document_id", "cik", "form_type", "next_document_id"),
    "win3_coverage": lambda s, d: TL.coverage(filings(s, d, *FILED)),
    "win4_first_citations": lambda s, d: TL.first_citations(TL.comparable(filings(s, d, *FILED)), TL.topic_counts(mentions(s, d))).select("cik", "slug", "form_type", "at.filed_at", "at.accession"),
    "agg16_topic_paragraphs": lambda s, d: TL.topic_counts(mentions(s, d)),
    "joi28_compared_topics": lambda s, d: TL.compared(TL.comparable(filings(s, d, *FILED)), TL.topic_counts(mentions(s, d))),
}

SQL = {
    "gra1_co_occurrence": sql(_CO + " SELECT * REPLACE (array_to_string(documents, ',') AS documents) FROM cospan", "men", "ent"),
    "gra3_asserted_edges": sql(_TYPED + " SELECT * REPLACE (array_to_string(documents, ',') AS documents) FROM typed", "men", "ent"),
    "gra4_strength": sql(_EDGES + " SELECT cik, source, target, relationship, strength FROM strong", "men", "ent"),
    "gra5_degrees": sql(_EDGES + " SELECT * FROM deg", "men", "ent"),
    "gra10_importance": sql(_EDGES + " SELECT cik, slug, frequency, spread, recency, centrality, importance FROM scored", "men", "ent"),
    "gra12_graph_nodes": sql(_EDGES + " SELECT cik, slug AS id, name AS label, entity_type AS type, importance, mention_count AS mentions FROM scored WHERE importance >= 30", "men", "ent"),
    "gra12_graph_edges": sql(_EDGES + " SELECT s.cik, source, target, relationship, strength FROM strong s JOIN scored a ON a.cik = s.cik AND a.slug = source AND a.importance >= 30 JOIN scored b ON b.cik = s.cik AND b.slug = target AND b.importance >= 30", "men", "ent"),
    "gra12_graph_contract": sql(_EDGES + """, top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY cik ORDER BY importance DESC, slug) <= 40),
      n AS (SELECT cik, string_agg('{"id":' || to_json(slug) || coalesce(',"label":' || to_json(name), '') || coalesce(',"type":' || to_json(entity_type), '') || ',"importance":' || importance || ',"mentions":' || mention_count || '}', ',' ORDER BY importance DESC, slug, name) AS n FROM top GROUP BY 1),
      e AS (SELECT s.cik, string_agg('{"source":' || to_json(source) || ',"target":' || to_json(target) || ',"relationship":' || to_json(relationship) || ',"strength":' || strength || '}', ',' ORDER BY strength DESC, source, target, relationship) AS e FROM strong s JOIN top a ON a.cik = s.cik AND a.slug = source JOIN top b ON b.cik = s.cik AND b.slug = target GROUP BY 1)
      SELECT cik, '{"nodes":[' || n || '],"edges":[' || coalesce(e, '') || ']}' AS graph FROM n LEFT JOIN e USING (cik)""", "men", "ent"),
    "gra13_explained": sql(_EDGES + " SELECT cik, slug, importance, mention_count, documents, latest_seen, degree, frequency, spread, recency, centrality FROM scored", "men", "ent"),
    "gra14_graph_as_of": sql(_EDGES + " SELECT cik, slug AS id, name AS label, entity_type AS type, importance, mention_count AS mentions FROM scored WHERE first_seen IS NULL OR first_seen <= DATE '2022-12-31'", "men", "ent"),
    "srt3_top_nodes": sql(_EDGES + " SELECT cik, slug AS id, name AS label, entity_type AS type, importance, mention_count AS mentions FROM scored QUALIFY row_number() OVER (PARTITION BY cik ORDER BY importance DESC, slug) <= 5", "men", "ent"),
    "tml1_events": sql(_CHANGES + " SELECT * FROM ev", "men"),
    "tml2_changes": sql(_CHANGES + " SELECT * FROM chg", "men"),
    "tml4_evidence": sql(_CHANGES + r""", m AS (SELECT *, CASE WHEN regexp_matches(paragraph_id, '^\d+_\d+(#\d+)?$') THEN 0 ELSE 1 END AS o1, coalesce(TRY_CAST(split_part(paragraph_id, '_', 1) AS INT), 0) AS o2,
        coalesce(TRY_CAST(split_part(split_part(paragraph_id, '_', 2), '#', 1) AS INT), 0) AS o3, coalesce(TRY_CAST(split_part(paragraph_id, '#', 2) AS INT), 0) AS o4 FROM men),
        txt AS (SELECT document_id, paragraph_id, arg_min(text, block_id) AS text FROM par WHERE length(text) > 0 GROUP BY 1, 2), words AS (SELECT document_id, paragraph_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM txt),
        runs AS (SELECT document_id, paragraph_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 2, 2))]) END AS r FROM words),
        aim AS (SELECT accession || ':' || kind || ':' || slug AS key, slug, CASE WHEN kind = 'no_longer_disclosed' THEN before_id ELSE document_id END AS cited_in, CASE WHEN kind <> 'no_longer_disclosed' THEN before_id END AS against FROM chg),
        old AS (SELECT key, list_distinct(flatten(list(r))) AS r FROM aim JOIN (SELECT DISTINCT document_id, slug, paragraph_id FROM m) b ON b.document_id = against AND b.slug = aim.slug JOIN runs ON runs.document_id = against AND runs.paragraph_id = b.paragraph_id GROUP BY 1),
        j AS (SELECT aim.key, cited_in, m.mention_id, m.paragraph_id, m.quote, row_number() OVER (PARTITION BY aim.key ORDER BY o1, CASE WHEN o1 = 0 THEN o2 ELSE 0 END, CASE WHEN o1 = 0 THEN o3 ELSE 0 END, CASE WHEN o1 = 0 THEN o4 ELSE 0 END, mention_id) AS place,
          CASE WHEN against IS NOT NULL AND len(n.r) > 0 THEN len(list_intersect(n.r, coalesce(old.r, [])))::DOUBLE / len(n.r) END AS share
          FROM aim JOIN m ON m.document_id = cited_in AND m.slug = aim.slug LEFT JOIN runs n ON n.document_id = cited_in AND n.paragraph_id = m.paragraph_id LEFT JOIN old ON old.key = aim.key),
        best AS (SELECT key, bool_and(share IS NOT NULL) AS known, min(place) FILTER (share < 0.5) AS fresh FROM j GROUP BY 1)
        SELECT j.key, cited_in, mention_id, paragraph_id, quote, CASE WHEN known THEN fresh IS NOT NULL END AS new_paragraph FROM j JOIN best ON best.key = j.key AND place = CASE WHEN known AND fresh IS NOT NULL THEN fresh ELSE 1 END""", "men", "par"),
    "tml6_categories": sql(_CHANGES + " SELECT upper(substr(coalesce(entity_type, 'Filing'), 1, 1)) || substr(coalesce(entity_type, 'Filing'), 2) AS category, kind, count(*) AS events FROM chg LEFT JOIN ent USING (cik, slug) GROUP BY 1, 2", "men", "ent"),
    "srt5_newest_events": sql(_CHANGES + " SELECT key, filed_at, abs(coalesce(paragraphs, 0) - coalesce(previous_paragraphs, 0)) AS moved FROM ev ORDER BY filed_at DESC, accession, \"rank\", moved DESC, slug LIMIT 100", "men"),
    "sca48_event_summaries": sql(_CHANGES + f""", told AS (SELECT ev.*, coalesce(nullif(concat_ws(' ', nullif(b.fiscal_period, ''), b.form_type), ''), 'last filing') AS was FROM ev LEFT JOIN fil b ON b.document_id = before_id WHERE kind <> 'filed')
        SELECT key, CASE kind WHEN 'newly_disclosed' THEN CASE WHEN named_earlier_in <> '' THEN 'Cited in ' || {_P} || '; first time in a ' || form_type || ', named earlier in a ' || named_earlier_in || '.' ELSE 'Cited in ' || {_P} || '; in no earlier filing on record.' END
        WHEN 'disclosed_again' THEN 'Cited in ' || {_P} || '; absent from the ' || was || ', cited in an earlier ' || form_type || '.' WHEN 'expanded' THEN 'Cited in ' || {_P} || ', up from ' || previous_paragraphs || ' in the ' || was || '.'
        WHEN 'narrowed' THEN 'Cited in ' || {_P} || ', down from ' || previous_paragraphs || ' in the ' || was || '.' ELSE 'Cited in ' || {_B} || ' of the ' || was || '; in none of this filing.' END AS summary FROM told""", "men"),
    "win2_previous_filing": sql(_COMP + " SELECT document_id, cik, form_type, next_id AS next_document_id FROM comp", "men"),
    "win3_coverage": sql(_COMP + " SELECT f.document_id, f.accession, CASE WHEN c.document_id IS NULL THEN 'not compared' WHEN before_id IS NULL THEN 'baseline' ELSE 'compared' END AS coverage FROM fil f LEFT JOIN comp c USING (document_id)", "men"),
    "win4_first_citations": sql(_COMP + " SELECT m.cik, slug, m.form_type, arg_min(m.filed_at, (m.filed_at, m.accession)) AS filed_at, arg_min(m.accession, (m.filed_at, m.accession)) AS accession FROM men m JOIN comp c USING (document_id) GROUP BY 1, 2, 3", "men"),
    "agg16_topic_paragraphs": sql(_COMP + " SELECT * FROM cnt", "men"),
    "joi28_compared_topics": sql(_CHANGES + " SELECT * FROM cmp", "men"),
}
