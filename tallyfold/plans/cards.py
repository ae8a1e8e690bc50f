"""Queries on cards, carried-over text, sets and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import cards as CD
from tallyfold.operators import carried as CO
from tallyfold.operators import snapshots
from tallyfold.operators import timeline as TL
from tallyfold.operators.evidence import full_texts
from tallyfold.plans.dealt import SQL as DEALT
from tallyfold.plans.derived import _CHANGES, _COMP, _EDGES, FILED
from tallyfold.plans.model import filings, mentions, paragraphs, sql, table


def _facts(s, d):
    return CD.projected(mentions(s, d), paragraphs(s, d, "document_id", "paragraph_id", "section_ordinal"), table(s, d, "sections"))


def _fragments(s, d):
    sec = table(s, d, "sections").groupBy("document_id", "ordinal").agg(F.min("title").alias("title"))
    rows = sec.join(filings(s, d, *FILED).select("document_id", "form_type"), "document_id")
    rows = rows.withColumns({"doc_kind": F.lit(None).cast("string"), "role": F.lit(None).cast("string")})
    return CD.routed(rows, "form_type", "doc_kind", "title", "role").select("document_id", "ordinal", "title", F.array_join("cards", ",").alias("cards"))


def _quotes(s, d):
    """Quotes of filings that are compared, each with the filing before."""
    c = TL.comparable(filings(s, d, *FILED)).where("next_document_id is not null").select(F.col("document_id").alias("before_id"), F.col("next_document_id").alias("document_id"))
    return mentions(s, d, "quote").where("quote is not null").join(c, "document_id").select("mention_id", "before_id", "quote")


def _texts(s, d):
    return full_texts(paragraphs(s, d, "document_id", "ordinal", "text")).withColumnRenamed("document_id", "before_id")


def _withheld(s, d):
    """Topics that the mentions make new in a filing, though a sentence quoted for them stands in the one before."""
    c = TL.changes(filings(s, d, *FILED), mentions(s, d)).where(F.col("kind").isin("newly_disclosed", "disclosed_again"))
    said = CO.already_said(_quotes(s, d), _texts(s, d), "mention_id", "before_id")
    again = mentions(s, d).join(said, "mention_id", "left_semi").select("document_id", "slug").distinct()
    return c.join(again, ["document_id", "slug"], "left_semi").select(F.concat_ws(":", "accession", "kind", "slug").alias("key"))


def _current(s, d):
    """The newest readable facts of each card, one row per fact."""
    rows = snapshots.card_snapshots(table(s, d, "card_revisions")).where("next_document_id is null and fact_key is not null")
    return rows.select("card_id", "document_id", "fact_key", "value", "status")


def _moved(s, d):
    """Facts of consecutive snapshots whose value differs: before, after, and which way a number went."""
    f = snapshots.card_snapshots(table(s, d, "card_revisions")).where("fact_key is not null").withColumn("value", F.expr("substr(value, 2)"))
    before = f.where("next_document_id is not null").select("card_id", F.col("next_document_id").alias("document_id"), "fact_key", F.col("value").alias("before"))
    both = f.select("card_id", "document_id", "fact_key", F.col("value").alias("after")).join(before, ["card_id", "document_id", "fact_key"])
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("card_id", "document_id", "fact_key", "before", "after", T.direction(F.col("before"), F.col("after")).alias("direction"))


def _summaries(s, d):
    """What a person would write about each revision of a card."""
    n = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" " + word)))
    text = F.concat(F.concat_ws("; ", n("changed", "changed"), n("added", "new"), n("removed", "no longer disclosed")), F.lit("."))
    return _sizes(s, d).select("card_id", "document_id", text.alias("summary"))


def _strongest(s, d):
    from tallyfold.operators import graph as G
    from tallyfold.plans.derived import _edges

    w = Window.partitionBy("cik").orderBy(F.desc("strength"), "source", "target", "relationship")
    return G.with_strength(_edges(s, d)).withColumn("place", F.row_number().over(w)).where("place <= 10").select("cik", "source", "target", "relationship", "strength", "place")


def _sizes(s, d):
    ch = snapshots.found(table(s, d, "card_revisions"))
    return ch.groupBy("card_id", "document_id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change") == "changed").alias("changed"))


def _islands(s, d):
    """Filings of a company in order, grouped while the form stays the same."""
    w = Window.partitionBy("cik").orderBy("filed_at", "accession")
    rows = filings(s, d, *FILED).withColumn("turn", F.when(F.lag("form_type").over(w).eqNullSafe(F.col("form_type")), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("turn").over(w))
    return rows.groupBy("cik", "island", "form_type").agg(F.count("*").alias("filings"), F.min("filed_at").alias("first"), F.max("filed_at").alias("last"))


def _spine(s, d):
    """One flat log of a company: filings, first citations of topics, and card revisions' dates."""
    f = filings(s, d, *FILED)
    a = f.select("cik", F.col("filed_at").alias("at"), F.lit("filing").alias("kind"), F.col("accession").alias("ref"))
    b = mentions(s, d).groupBy("cik", "slug").agg(F.min("filed_at").alias("at")).select("cik", "at", F.lit("topic").alias("kind"), F.col("slug").alias("ref"))
    c = mentions(s, d).where("entity_type = 'metric'").select("cik", F.col("filed_at").alias("at"), F.lit("metric").alias("kind"), F.col("mention_id").cast("string").alias("ref"))
    return a.unionByName(b).unionByName(c)


def _chunk_rows(s, d):
    p = paragraphs(s, d, "accession", "text").withColumn("hash", T.content_id("c", F.col("accession"), F.col("text")))
    w = Window.partitionBy("hash").orderBy("block_id")
    rows = p.withColumn("place", F.row_number().over(w))
    return rows.where("place = 1").select("hash", "block_id", "accession")


def _shared_topics(s, d):
    """Topics of a company that two of its forms share, and those of one form only."""
    rows = mentions(s, d).groupBy("cik", "slug").agg(F.sort_array(F.collect_set("form_type")).alias("forms"))
    return rows.select("cik", "slug", F.array_join("forms", ",").alias("forms"), (F.size("forms") > 1).alias("shared"))


def _prev_next_topics(s, d):
    c = TL.comparable(filings(s, d, *FILED)).where("next_document_id is not null").select("document_id", "next_document_id")
    t = mentions(s, d).select("document_id", "slug").distinct()
    here = c.join(t, "document_id").select("document_id", "slug")
    there = c.join(t.withColumnRenamed("document_id", "next_document_id"), "next_document_id").select("document_id", "slug")
    return here.union(there).distinct()


_RULE_SQL = "array_to_string(list_filter([" + ", ".join(
    "CASE WHEN " + (f"form_type IN ('{r[1].replace('|', chr(39) + ', ' + chr(39))}')" if r[1] else f"regexp_matches(title, '(?i){r[3]}')" if r[3] else "false") + f" THEN '{r[0]}' END" for r in CD.RULES
) + "], lambda x: x IS NOT NULL), ',')"
_FACTS = r""", t AS (SELECT document_id, ordinal AS section_ordinal, min(title) AS title FROM sections GROUP BY 1, 2), pl AS (SELECT document_id, paragraph_id, min(section_ordinal) AS section_ordinal FROM par GROUP BY 1, 2),
  m AS (SELECT men.*, title, CASE WHEN regexp_matches(paragraph_id, '^\d+_\d+(#\d+)?$') THEN 0 ELSE 1 END AS o1, coalesce(TRY_CAST(split_part(paragraph_id, '_', 1) AS INT), 0) AS o2, coalesce(TRY_CAST(split_part(split_part(paragraph_id, '_', 2), '#', 1) AS INT), 0) AS o3
    FROM men JOIN pl USING (document_id, paragraph_id) LEFT JOIN t USING (document_id, section_ordinal) WHERE form_type IN ('10-K', '20-F', '40-F')),
  r AS (SELECT *, 'risks' AS card FROM m WHERE regexp_matches(title, '(?i)item\s*1a|risk\s*factors') UNION ALL SELECT *, 'litigation' FROM m WHERE regexp_matches(title, '(?i)item\s*3|legal\s*proceedings')),
  facts AS (SELECT cik, card, document_id, filed_at, slug, count(DISTINCT split_part(paragraph_id, '#', 1)) AS paragraphs, arg_min(mention_id, (o1, CASE WHEN o1 = 0 THEN o2 ELSE 0 END, CASE WHEN o1 = 0 THEN o3 ELSE 0 END, mention_id)) AS mention_id FROM r GROUP BY 1, 2, 3, 4, 5),
  rev AS (SELECT cik, card, document_id, filed_at, count(*) AS facts, CAST(row_number() OVER w AS INT) AS revision, lead(document_id) OVER w AS following, lag(document_id) OVER w AS before_id FROM facts GROUP BY 1, 2, 3, 4 WINDOW w AS (PARTITION BY cik, card ORDER BY filed_at, document_id))"""
_SAIDQ = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
_OVER = _COMP + f""", q AS (SELECT mention_id, before_id, {_SAIDQ.format(c='quote')} AS w FROM men JOIN comp USING (document_id) WHERE before_id IS NOT NULL AND quote IS NOT NULL),
  tx AS (SELECT document_id AS before_id, {_SAIDQ.format(c="string_agg(text, chr(10) || chr(10) ORDER BY ordinal, block_id)")} AS w FROM par GROUP BY 1),
  qr AS (SELECT mention_id, before_id, w, i - 1 AS position, array_to_string(list_slice(w, i, i + 3), ' ') AS run FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM q WHERE len(w) > 0)),
  tr AS (SELECT DISTINCT before_id, array_to_string(list_slice(w, i, i + 3), ' ') AS run FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM tx WHERE len(w) > 0)),
  ov AS (SELECT mention_id, count(*) AS runs, count(tr.run) AS found, round_even(count(tr.run)::DOUBLE / count(*), 6) AS share FROM (SELECT DISTINCT mention_id, before_id, run FROM qr) x LEFT JOIN tr USING (before_id, run) GROUP BY 1),
  hit AS (SELECT mention_id, len(any_value(w)) AS n, coalesce(list(DISTINCT position) FILTER (tr.run IS NOT NULL), []) AS hits FROM qr LEFT JOIN tr USING (before_id, run) WHERE len(w) >= 4 GROUP BY 1),
  mk AS (SELECT mention_id, n, i, NOT list_bool_or([h <= i AND i < h + 4 FOR h IN hits] || [false]) AS new FROM (SELECT *, unnest(range(0, n)) AS i FROM hit)),
  isl AS (SELECT *, i - row_number() OVER (PARTITION BY mention_id, new ORDER BY i) AS g FROM mk),
  runlen AS (SELECT mention_id, max(c) AS longest FROM (SELECT mention_id, g, count(*) AS c FROM isl WHERE new GROUP BY 1, 2) GROUP BY 1),
  nw AS (SELECT mk.mention_id, CAST(any_value(n) AS INT) AS words, CAST(count(*) FILTER (new) AS INT) AS new, CAST(coalesce(any_value(longest), 0) AS INT) AS longest FROM mk LEFT JOIN runlen USING (mention_id) GROUP BY 1)"""

_P5 = DEALT["p5_found"].strip()
_HEAD = _P5[: _P5.index(", pairs AS")]
_SIZED = f"SELECT card_id, document_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM ({_P5}) GROUP BY 1, 2"
_NUM = "TRY_CAST(regexp_replace(replace({c}, ',', ''), '^\\$+', '') AS DOUBLE)".replace("\\\\", "\\")

QUERIES = {
    "prd2_routed_sections": _fragments,
    "crd1_projected_facts": _facts,
    "crd9_revisions": lambda s, d: CD.revisions(_facts(s, d)),
    "set6_card_changes": lambda s, d: CD.card_changes(_facts(s, d)),
    "win9_current_facts": _current,
    "crd8_revision_sizes": _sizes,
    "sca61_revision_summaries": _summaries,
    "sca63_directions": _moved,
    "srt4_strongest_edges": _strongest,
    "set4_carried_over": lambda s, d: CO.overlaps(_quotes(s, d), _texts(s, d), "mention_id", "before_id"),
    "sca40_new_words": lambda s, d: CO.new_words(_quotes(s, d), _texts(s, d), "mention_id", "before_id"),
    "tml3_withheld": _withheld,
    "win14_form_islands": _islands,
    "set7_spine": _spine,
    "set8_first_chunks": _chunk_rows,
    "set3_shared_topics": _shared_topics,
    "set2_topics_of_pairs": _prev_next_topics,
    "srt11_newest_filings": lambda s, d: filings(s, d, *FILED).orderBy(F.desc("filed_at"), F.desc("document_id")).limit(50).select("document_id", "accession", "filed_at"),
    "win15_oldest_by_form": lambda s, d: filings(s, d, *FILED).groupBy("cik", "form_type").agg(F.min_by("accession", F.struct("filed_at", "accession")).alias("oldest"), F.count("*").alias("filings")),
}

SQL = {
    "prd2_routed_sections": sql(f", t AS (SELECT document_id, ordinal, min(title) AS title FROM sections GROUP BY 1, 2) SELECT document_id, ordinal, title, {_RULE_SQL} AS cards FROM t JOIN fil USING (document_id)", "fil"),
    "crd1_projected_facts": sql(_FACTS + " SELECT * FROM facts", "men", "par"),
    "crd9_revisions": sql(_FACTS + " SELECT cik, card, document_id, filed_at, facts, revision, following FROM rev", "men", "par"),
    "set6_card_changes": sql(_FACTS + """ SELECT rev.cik, rev.card, rev.document_id, f.slug, 'added' AS change FROM rev JOIN facts f USING (cik, card, document_id) WHERE NOT EXISTS (SELECT 1 FROM facts p WHERE p.cik = rev.cik AND p.card = rev.card AND p.document_id = rev.before_id AND p.slug = f.slug)
        UNION ALL SELECT rev.cik, rev.card, rev.document_id, p.slug, 'removed' FROM rev JOIN facts p ON p.cik = rev.cik AND p.card = rev.card AND p.document_id = rev.before_id WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.cik = rev.cik AND f.card = rev.card AND f.document_id = rev.document_id AND f.slug = p.slug)""", "men", "par"),
    "win9_current_facts": _HEAD + " SELECT card_id, document_id, fact_key, value, status FROM facts JOIN (SELECT card_id, document_id FROM seq QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY as_of DESC, document_id DESC) = 1) USING (card_id, document_id)",
    "crd8_revision_sizes": _SIZED,
    "sca61_revision_summaries": f"SELECT card_id, document_id, concat_ws('; ', CASE WHEN changed > 0 THEN changed || ' changed' END, CASE WHEN added > 0 THEN added || ' new' END, CASE WHEN removed > 0 THEN removed || ' no longer disclosed' END) || '.' AS summary FROM ({_SIZED})",
    "sca63_directions": _HEAD + f""", m AS (SELECT s.card_id, s.document_id, a.fact_key, substr(b.value, 2) AS before, substr(a.value, 2) AS after FROM seq s JOIN facts a USING (card_id, document_id) JOIN facts b ON b.card_id = s.card_id AND b.document_id = s.before AND b.fact_key = a.fact_key)
        SELECT *, CASE WHEN {_NUM.format(c='before')} IS NULL OR {_NUM.format(c='after')} IS NULL THEN 'changed' WHEN {_NUM.format(c='after')} > {_NUM.format(c='before')} THEN 'rose' WHEN {_NUM.format(c='after')} < {_NUM.format(c='before')} THEN 'fell' ELSE 'held' END AS direction FROM m WHERE before IS DISTINCT FROM after""",
    "srt4_strongest_edges": sql(_EDGES + " SELECT cik, source, target, relationship, strength, CAST(row_number() OVER (PARTITION BY cik ORDER BY strength DESC, source, target, relationship) AS INT) AS place FROM strong QUALIFY place <= 10", "men", "ent"),
    "set4_carried_over": sql(_OVER + " SELECT * FROM ov", "men", "par"),
    "sca40_new_words": sql(_OVER + " SELECT * FROM nw", "men", "par"),
    "tml3_withheld": sql(_CHANGES + _OVER.removeprefix(_COMP) + ", ag AS (SELECT DISTINCT document_id, slug FROM men JOIN ov USING (mention_id) JOIN nw USING (mention_id) WHERE share >= 0.5 AND longest < 4) SELECT accession || ':' || kind || ':' || chg.slug AS key FROM chg JOIN ag USING (document_id, slug) WHERE kind IN ('newly_disclosed', 'disclosed_again')", "men", "par"),
    "win14_form_islands": sql(", t AS (SELECT *, CASE WHEN form_type IS NOT DISTINCT FROM lag(form_type) OVER w THEN 0 ELSE 1 END AS turn FROM fil WINDOW w AS (PARTITION BY cik ORDER BY filed_at, accession)), i AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY cik ORDER BY filed_at, accession ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM t) SELECT cik, island, form_type, count(*) AS filings, min(filed_at) AS first, max(filed_at) AS last FROM i GROUP BY 1, 2, 3", "fil"),
    "set7_spine": sql("SELECT cik, filed_at AS at, 'filing' AS kind, accession AS ref FROM fil UNION ALL SELECT cik, min(filed_at), 'topic', slug FROM men GROUP BY cik, slug UNION ALL SELECT cik, filed_at, 'metric', mention_id::VARCHAR FROM men WHERE entity_type = 'metric'", "men"),
    "set8_first_chunks": sql(r", h AS (SELECT block_id, accession, 'c_' || substr(sha256(accession || chr(0) || '' || chr(0) || lower(trim(regexp_replace(text, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')))), 1, 12) AS hash FROM par) SELECT hash, block_id, accession FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY block_id) = 1", "par"),
    "set3_shared_topics": sql("SELECT cik, slug, array_to_string(list_sort(list(DISTINCT form_type)), ',') AS forms, count(DISTINCT form_type) > 1 AS shared FROM men GROUP BY 1, 2", "men"),
    "set2_topics_of_pairs": sql(_COMP + " SELECT comp.document_id, slug FROM comp JOIN men USING (document_id) WHERE next_id IS NOT NULL UNION SELECT comp.document_id, slug FROM comp JOIN men ON men.document_id = next_id", "men"),
    "srt11_newest_filings": sql("SELECT document_id, accession, filed_at FROM fil ORDER BY filed_at DESC, document_id DESC LIMIT 50", "fil"),
    "win15_oldest_by_form": sql("SELECT cik, form_type, arg_min(accession, (filed_at, accession)) AS oldest, count(*) AS filings FROM fil GROUP BY 1, 2", "fil"),
}
