"""Queries on markup, chunks and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.sentences import sentence_spans
from tallyfold.operators import chunks as CH
from tallyfold.operators import extraction as X
from tallyfold.plans.memory import _FOLDQ
from tallyfold.plans.model import extractions, filings, paragraphs, sql, table
from tallyfold.sources import markup

#: The tagger's rules for the test tables: (pattern, name, kind).
RULES = [
    (rf"(^|[^\p{{L}}])({word})($|[^\p{{L}}])", name, kind)
    for word, name, kind in (("warrant(y|ies)", "Warranties", "risk"), ("tariffs?", "Tariffs", "risk"), ("hedges?", "Hedges", "strategy"), ("auditors?", "Auditors", "company"), ("receivables?", "Receivables", "metric"))
]


def as_markup(s, d):
    """Each filing as markup: its paragraphs in order, a page break wherever the page changes."""
    p = paragraphs(s, d, "document_id", "page_number", "ordinal", "text").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("page_number", F.lit(0)).alias("page"), "ordinal", "block_id", "text"))).alias("p"))
    escape = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    piece = F.transform("p", lambda x, i: F.concat(F.when((i > 0) & (F.get("p", i - 1)["page"] != x["page"]), '<hr style="page-break-after: always"/>').otherwise(""), F.lit("<p>"), escape(x["text"]), F.lit("</p>")))
    return p.select("document_id", F.concat(F.lit("<html><head><title>x</title></head><body>"), F.array_join(piece, "\n"), F.lit("</body></html>")).alias("html"))


def _blocks(s, d):
    return markup.parsed(as_markup(s, d)).where("kind = 'block'").select("document_id", "page", "text")


def _sections(s, d):
    """Headings in corpus documents, whose blank lines part paragraphs."""
    escape = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = table(s, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("<p>"), F.replace(escape(F.col("text")), F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p>")).alias("html"))
    return markup.parsed(docs, "doc_id").where("kind = 'section'").select("document_id", "ordinal", "level", "title")


def _tables(s, d):
    """A table of each company's filings, header first."""
    rows = filings(s, d, "cik", "accession", "form_type", "filed_at").groupBy("cik").agg(F.max("document_id").alias("document_id"), F.array_sort(F.collect_list(F.struct(F.col("accession"), F.col("form_type"), F.col("filed_at").cast("string").alias("filed")))).alias("r"))
    body = F.transform("r", lambda x: F.array(x["accession"], x["form_type"], x["filed"]))
    return rows.select("document_id", F.lit(0).alias("ordinal"), F.concat(F.lit("Filings of "), "cik").alias("caption"), F.concat(F.array(F.array(F.lit("accession"), F.lit("form"), F.lit("filed"))), body).alias("cells"))


def _chunks(s, d):
    return CH.chunks(paragraphs(s, d, "document_id", "section_ordinal", "ordinal", "paragraph_id", "page_number", "text"))


def _listed(chunk_rows):
    """A chunk's paragraphs as one text."""
    return chunk_rows.withColumn("paragraph_ids", F.array_join("paragraph_ids", ","))


_TIDY = r"trim(regexp_replace(text, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"

QUERIES = {
    "prj1_parsed_blocks": _blocks,
    "prj3_parsed_sections": _sections,
    "prj15_chunks": lambda s, d: _listed(_chunks(s, d)),
    "prj14_oversized_parts": lambda s, d: CH.oversized_parts(paragraphs(s, d, "paragraph_id", "text")),
    "prj16_table_parts": lambda s, d: CH.table_parts(_tables(s, d)),
    "prj17_document_chunks": lambda s, d: _listed(CH.document_chunks(paragraphs(s, d, "document_id", "section_ordinal", "ordinal", "paragraph_id", "page_number", "text"), _tables(s, d), filings(s, d, "accession"))),
    "prj18_paragraphs_of_chunks": lambda s, d: CH.paragraphs_of(_chunks(s, d)),
    "prj22_chunk_pages": lambda s, d: _chunks(s, d).select("document_id", F.explode("paragraph_ids").alias("id")).select("document_id", F.split_part("id", F.lit("_"), F.lit(1)).try_cast("int").alias("page")).distinct(),
    "sca17_sentences": lambda s, d: paragraphs(s, d, "text").select("block_id", F.explode(sentence_spans()("text")).alias("s")).select("block_id", "s.start", "s.end"),
    "sca24_anchored_quotes": lambda s, d: X.with_sentences(extractions(s, d, "document_id", "paragraph_id", "quote"), paragraphs(s, d, "document_id", "paragraph_id", "text")),
    "prd23_checked_extractions": lambda s, d: X.checked(extractions(s, d, "document_id", "paragraph_id", "name", "entity_type", "confidence", "quote"), paragraphs(s, d, "document_id", "paragraph_id", "text")),
    "agg36_refusals": lambda s, d: X.checked(extractions(s, d, "document_id", "paragraph_id", "name", "entity_type", "confidence", "quote"), paragraphs(s, d, "document_id", "paragraph_id", "text")).groupBy("reason").agg(F.count("*").alias("n")),
    "src17_tagged": lambda s, d: X.tagged(paragraphs(s, d, "text"), RULES),
    "prj23_rendered": lambda s, d: paragraphs(s, d, "document_id", "ordinal", "paragraph_id", "text").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "block_id", F.concat(F.lit("["), F.col("paragraph_id"), F.lit("] "), F.col("text")).alias("line")))).alias("p")).select("document_id", F.array_join(F.transform("p", lambda x: x["line"]), "\n\n").alias("text")),
}

_CHECKED = r""", k AS (SELECT document_id, paragraph_id, arg_min(text, block_id) AS paragraph FROM par GROUP BY 1, 2), a AS (SELECT ext.*, k.paragraph, trim(regexp_replace(name, '[\s\x{a0}]+', ' ', 'g')) AS nm FROM ext LEFT JOIN k USING (document_id, paragraph_id)),
  c AS (SELECT extracted_id, document_id, paragraph_id, CASE WHEN coalesce(length(nm), 0) = 0 THEN 'no name' WHEN NOT coalesce(entity_type IN ('company', 'executive', 'geography', 'metric', 'product', 'risk', 'segment', 'strategy'), false) THEN 'unknown kind'
    WHEN confidence IS NULL OR isnan(confidence) OR confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' WHEN paragraph IS NULL THEN 'no such paragraph' WHEN coalesce(length(trim(quote)), 0) = 0 THEN 'no quote'
    WHEN len(string_split(nm, ' ')) > 7 THEN 'a phrase, not a name' WHEN NOT (contains(paragraph, quote) OR contains(""" + _FOLDQ.format(c="paragraph") + ", " + _FOLDQ.format(c="quote") + """)) THEN 'the quote is not in the paragraph' END AS reason FROM a)"""
_HEADING = r"length({t}) <= 120 AND regexp_matches({t}, '(?i)^(part\s+[ivx]+\b|item\s+\d+[a-z]?)')"

# paragraphs of more than 600 tokens in parts of whole sentences, packed greedily one piece at a time
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PARTS = rf""", sen AS (SELECT block_id, flatten([[x[i:i + 2399] FOR i IN range(1, length(x) + 1, 2400)] FOR x IN string_split(regexp_replace(text, '([.!?]){_SPACE}([A-Z(“"])', '\1' || chr(1) || '\2', 'g'), chr(1))]) AS p FROM par WHERE length(text) // 4 > 600),
  fold AS (SELECT block_id, p, 1 AS i, 1 AS part, length(p[1]) AS n FROM sen
    UNION ALL SELECT block_id, p, i + 1, CASE WHEN n + 1 + length(p[i + 1]) > 2400 THEN part + 1 ELSE part END, CASE WHEN n + 1 + length(p[i + 1]) > 2400 THEN length(p[i + 1]) ELSE n + 1 + length(p[i + 1]) END FROM fold WHERE i < len(p)),
  parts AS (SELECT block_id, part, string_agg(p[i], ' ' ORDER BY i) AS text FROM fold GROUP BY 1, 2)"""
# sections packed one paragraph at a time: `first` begins the open chunk, `last` ends the newest closed one; a step closes up to two
_PACKED = _PARTS + """, pieces AS (
    SELECT document_id, coalesce(section_ordinal, -1) AS sec, ordinal, block_id, 0 AS part, paragraph_id, page_number, text FROM par WHERE length(text) > 0 AND length(text) // 4 <= 600
    UNION ALL SELECT document_id, coalesce(section_ordinal, -1), ordinal, block_id, part, paragraph_id || '#' || part, page_number, parts.text FROM parts JOIN par USING (block_id)),
  seq AS (SELECT *, row_number() OVER w AS i, length(text) AS z, sum(length(text) + 2) OVER w AS upto FROM pieces WINDOW w AS (PARTITION BY document_id, sec ORDER BY ordinal, block_id, part ROWS UNBOUNDED PRECEDING)),
  ends AS (SELECT document_id, sec, max(i) AS n FROM seq GROUP BY 1, 2),
  step AS (SELECT document_id, sec, 0::BIGINT AS i, 1::BIGINT AS first, 0::HUGEINT AS gone, 0::BIGINT AS last, NULL::BIGINT AS a1, NULL::BIGINT AS b1, NULL::BIGINT AS a2, NULL::BIGINT AS b2 FROM ends
    UNION ALL SELECT s.document_id, s.sec, s.i, CASE WHEN NOT closes THEN f WHEN z > 700 THEN s.i + 1 ELSE s.i END, CASE WHEN NOT closes THEN g WHEN z > 700 THEN s.upto ELSE s.upto - z - 2 END,
      CASE WHEN closes THEN s.i WHEN hard THEN s.i - 1 ELSE last END, CASE WHEN hard THEN first END, CASE WHEN hard THEN s.i - 1 END, CASE WHEN closes THEN f END, CASE WHEN closes THEN s.i END
    FROM (SELECT q.document_id, q.sec, q.i, q.z, q.upto, step.first, step.last, step.first < q.i AND q.upto - 2 - gone > 2400 AS hard, CASE WHEN step.first < q.i AND q.upto - 2 - gone > 2400 THEN q.i ELSE step.first END AS f,
      CASE WHEN step.first < q.i AND q.upto - 2 - gone > 2400 THEN q.upto - q.z - 2 ELSE gone END AS g, q.upto - 2 - g >= 1400 AS closes FROM step JOIN seq q ON q.document_id = step.document_id AND q.sec = step.sec AND q.i = step.i + 1) s),
  cut AS (SELECT document_id, sec, a1 AS a, b1 AS b FROM step WHERE a1 IS NOT NULL UNION ALL SELECT document_id, sec, a2, b2 FROM step WHERE a2 IS NOT NULL
    UNION ALL SELECT step.document_id, step.sec, first, n FROM step JOIN ends ON ends.document_id = step.document_id AND ends.sec = step.sec AND n = i WHERE last < n),
  chunk AS (SELECT document_id, sec, row_number() OVER (PARTITION BY document_id, sec ORDER BY b, a) - 1 AS chunk, a, b FROM cut),
  chunked AS (SELECT c.document_id, nullif(c.sec, -1) AS section_ordinal, chunk, string_agg(paragraph_id, ',' ORDER BY i) AS paragraph_ids, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text,
    CAST(greatest(1, (sum(length(text)) + 2 * (count(*) - 1)) // 4) AS INT) AS tokens, min(page_number) AS first_page, max(page_number) AS last_page
    FROM chunk c JOIN seq ON seq.document_id = c.document_id AND seq.sec = c.sec AND i BETWEEN a AND b GROUP BY ALL)"""
# a table of each company's filings; rows go to a part while they fit with caption and header
_TABLED = """, lines AS (SELECT max(document_id) AS document_id, 'Filings of ' || cik || chr(10) AS caption, list(accession || ' | ' || form_type || ' | ' || filed_at ORDER BY accession, form_type, filed_at::VARCHAR) AS b FROM fil GROUP BY cik),
  heads AS (SELECT *, caption || 'accession | form | filed' AS head FROM lines), whole AS (SELECT *, head || chr(10) || array_to_string(b, chr(10)) AS text FROM heads),
  tfold AS (SELECT document_id, head, b, 1 AS i, 0 AS part, length(head) + 1 + length(b[1]) AS n FROM whole WHERE length(text) > 2400
    UNION ALL SELECT document_id, head, b, i + 1, CASE WHEN n + 1 + length(b[i + 1]) > 2400 THEN part + 1 ELSE part END, CASE WHEN n + 1 + length(b[i + 1]) > 2400 THEN length(head) + 1 + length(b[i + 1]) ELSE n + 1 + length(b[i + 1]) END FROM tfold WHERE i < len(b)),
  tparts AS (SELECT document_id, 0 AS ordinal, CAST(part AS INT) AS part, head || chr(10) || string_agg(b[i], chr(10) ORDER BY i) AS text FROM tfold GROUP BY document_id, head, part UNION ALL SELECT document_id, 0, 0, text FROM whole WHERE length(text) <= 2400)"""
_RECURSIVE = lambda body, *views: sql(body, *views).replace("WITH ", "WITH RECURSIVE ", 1)
_ALL = _PACKED + _TABLED + """, firsts AS (SELECT document_id, sec, min((ordinal, block_id)) AS begins, (SELECT count(*) FROM chunk c WHERE c.document_id = seq.document_id AND c.sec = seq.sec) AS n FROM seq GROUP BY 1, 2),
  starts AS (SELECT document_id, sec, coalesce(sum(n) OVER (PARTITION BY document_id ORDER BY begins ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(n) OVER (PARTITION BY document_id) AS total FROM firsts),
  everything AS (SELECT c.document_id, CAST(start + chunk AS INT) AS ordinal, 's' || coalesce(section_ordinal::VARCHAR, 'None') || ':' || (start + chunk) AS salt, 'prose' AS kind, section_ordinal, paragraph_ids, NULL::INT AS table_ordinal, tokens, first_page, last_page, text
      FROM chunked c JOIN starts s ON s.document_id = c.document_id AND s.sec = coalesce(section_ordinal, -1)
    UNION ALL SELECT t.document_id, CAST(coalesce((SELECT any_value(total) FROM starts WHERE starts.document_id = t.document_id), 0) + row_number() OVER (PARTITION BY t.document_id ORDER BY ordinal, part) - 1 AS INT), 'table:' || ordinal || ':' || part, 'table', NULL, '', ordinal, CAST(greatest(1, length(text) // 4) AS INT), NULL, NULL, text FROM tparts t)"""

SQL = {
    "prj14_oversized_parts": _RECURSIVE(_PARTS + " SELECT block_id, paragraph_id || '#' || part AS part_id, parts.text FROM parts JOIN par USING (block_id)", "par"),
    "prj15_chunks": _RECURSIVE(_PACKED + " SELECT * REPLACE (CAST(chunk AS INT) AS chunk) FROM chunked", "par"),
    "prj16_table_parts": _RECURSIVE(_TABLED + " SELECT * FROM tparts", "fil"),
    "prj17_document_chunks": _RECURSIVE(_ALL + rf" SELECT document_id, ordinal, 'c_' || substr(sha256(accession || chr(0) || salt || chr(0) || lower({_TIDY})), 1, 12) AS chunk_id, kind, section_ordinal, paragraph_ids, table_ordinal, tokens, first_page, last_page, text FROM everything JOIN (SELECT document_id, accession FROM fil) USING (document_id)", "par", "fil"),
    "prj22_chunk_pages": _RECURSIVE(_PACKED + " SELECT DISTINCT document_id, TRY_CAST(split_part(paragraph_id, '_', 1) AS INT) AS page FROM seq", "par"),
    "prj1_parsed_blocks": sql(f", t AS (SELECT document_id, dense_rank() OVER (PARTITION BY document_id ORDER BY coalesce(page_number, 0)) AS page, {_TIDY} AS text FROM par) SELECT document_id, CAST(page AS INT) AS page, text FROM t WHERE text <> '' AND NOT ({_HEADING.format(t='text')})", "par"),
    "prj3_parsed_sections": rf"""WITH t AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS i, string_split(text, chr(10) || chr(10)) AS parts FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, i, {_TIDY.replace('text,', 'parts[i],')} AS title FROM t),
        h AS (SELECT * FROM p WHERE {_HEADING.format(t='title')}) SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS ordinal, CASE WHEN regexp_matches(title, '(?i)^part') THEN 1 ELSE 2 END AS level, title FROM h""",
    "prd23_checked_extractions": sql(_CHECKED + " SELECT * FROM c", "ext", "par"),
    "agg36_refusals": sql(_CHECKED + " SELECT reason, count(*) AS n FROM c GROUP BY 1", "ext", "par"),
    "src17_tagged": sql(r", p AS (SELECT * FROM par WHERE NOT (len(regexp_split_to_array(trim(text), '\s+')) < 12 AND NOT regexp_matches(rtrim(text), '[.?!]$'))) " + " UNION ALL ".join(f"SELECT block_id, '{n}' AS name, '{k}' AS entity_type FROM p WHERE regexp_matches(text, '(?i){p}')" for p, n, k in RULES), "par"),
    "prj23_rendered": sql("SELECT document_id, string_agg('[' || paragraph_id || '] ' || text, chr(10) || chr(10) ORDER BY ordinal, block_id) AS text FROM par GROUP BY 1", "par"),
    "prj18_paragraphs_of_chunks": _RECURSIVE(_PACKED + " SELECT document_id, paragraph_id, arg_min(text, (block_id, part)) AS text FROM pieces GROUP BY 1, 2", "par"),
}
