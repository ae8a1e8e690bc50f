"""Queries on pages whose text is known by where it was drawn: the paragraphs of filings, drawn by rule and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import geometry as GE
from tallyfold.plans.model import paragraphs, sql

#: How the pages are drawn: words of a line, of a run, points of a letter, the left and upper margin, the step of a line, the size, the page.
WORDS, RUN, LETTER, LEFT, TOP, STEP, SIZE, WIDTH, HEIGHT = 12, 6, 5.0, 72.0, 72.0, 14.0, 10.0, 612.0, 792.0


def _runs(s, d):
    """Each page's paragraphs in lines of twelve words, each line drawn as up to two runs, an empty line after each paragraph."""
    p = paragraphs(s, d, "document_id", "page_number", "ordinal", "text").where("length(text) > 0 and page_number is not null").withColumn("w", F.split(T.collapsed(F.col("text")), " "))
    page = Window.partitionBy("document_id", "page_number").orderBy("ordinal", "block_id")  # the paragraphs of one page
    count = F.ceil(F.size("w") / WORDS).cast("int")
    p = p.withColumn("above", F.coalesce(F.sum(count + 1).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = p.select("document_id", F.col("page_number").alias("page"), "w", "above", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"), F.lit(1).alias("one"))
    rows = rows.select("document_id", "page", (F.col("above") + F.col("i")).alias("n"), F.slice("w", F.col("i") * WORDS + 1, WORDS).alias("w"))
    rows = rows.select("document_id", "page", "n", F.array_join(F.slice("w", 1, RUN), " ").alias("a"), F.array_join(F.slice("w", RUN + 1, RUN), " ").alias("b"))
    end = F.lit(LEFT) + LETTER * F.length("a")
    drawn = F.array_compact(F.array(
        F.struct(F.lit(0).alias("k"), F.col("a").alias("text"), F.lit(LEFT).alias("x0"), end.alias("x1")),
        F.when(F.col("b") != "", F.struct(F.lit(1).alias("k"), F.col("b").alias("text"), (end + LETTER).alias("x0"), (end + LETTER + LETTER * F.length("b")).alias("x1"))),
    ))
    rows = rows.select("document_id", "page", "n", F.explode(drawn).alias("r"))
    return rows.select("document_id", "page", (F.col("n") * 2 + F.col("r.k")).alias("run"), "r.text", "r.x0", "r.x1", (F.lit(TOP) + STEP * F.col("n")).alias("baseline"), F.lit(SIZE).alias("size"), F.lit(False).alias("rotated"), (F.col("r.k") == 0).alias("begins"))


def _lines(s, d):
    return GE.lines(_runs(s, d))


def _paragraphs(s, d):
    runs = _runs(s, d)
    pages = runs.select("document_id", "page").distinct().select("*", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(False).alias("rotated"))
    return GE.paragraphs(GE.lines(runs), pages)


QUERIES = {
    "prj8_lines": lambda s, d: _lines(s, d).select("document_id", "page", "line", "text", "x0", "x1", "baseline"),
    "prj10_page_paragraphs": lambda s, d: _paragraphs(s, d).select("document_id", "page", "paragraph", "text"),
    "prj11_breaks": lambda s, d: GE.breaks(_lines(s, d)).groupBy("document_id", "page", "paragraph").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")),
    "prj12_boxes": lambda s, d: _paragraphs(s, d).select("document_id", "page", "paragraph", "x0", "y0", "x1", "y1"),
    "prj13_headings": lambda s, d: _paragraphs(s, d).select("document_id", "page", "paragraph", "level", "paragraph_id"),
    "prj28_page_rows": lambda s, d: _paragraphs(s, d).groupBy("document_id", "page").agg(F.count("*").alias("paragraphs"), F.count("level").alias("headings")),
    "prj29_points": lambda s, d: _paragraphs(s, d).select("document_id", "page", "paragraph", *[F.bround(F.col(c) * 0.75, 2).alias(c) for c in ("x0", "y0", "x1", "y1")]),
    "sca11_boxes_as_json": lambda s, d: _paragraphs(s, d).where("x0 is not null").select("document_id", "page", "paragraph", F.to_json(F.struct(*[F.bround(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("box")),
}

# the same pages: w words a paragraph, n the line's number on its page counting an empty line after each paragraph
_DRAWN = r""", src AS (SELECT document_id, page_number AS page, ordinal, block_id, string_split(trim(regexp_replace(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), ' ') AS w FROM par WHERE length(text) > 0 AND page_number IS NOT NULL),
  top AS (SELECT *, (len(w) + 11) // 12 AS k, coalesce(sum((len(w) + 11) // 12 + 1) OVER (PARTITION BY document_id, page ORDER BY ordinal, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM src),
  ln AS (SELECT document_id, page, ordinal, block_id, i, above + i AS n, array_to_string(w[12 * i + 1:12 * i + 12], ' ') AS text FROM (SELECT *, unnest(range(0, k)) AS i FROM top)),
  lines AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY n) AS line, 72.0::DOUBLE AS x0, 72 + 5.0::DOUBLE * length(text) AS x1, 72 + 14.0::DOUBLE * n AS baseline FROM ln),
  st AS (SELECT *, baseline - lag(baseline) OVER (PARTITION BY document_id, page ORDER BY line) AS step FROM lines), ld AS (SELECT document_id, page, coalesce(median(step) FILTER (step > 0 AND step < 30), 12) AS usual FROM st GROUP BY 1, 2),
  par2 AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 1.35 * usual OR regexp_matches(text, '^\s*[•●◦▪‣∙·\-–]\s') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY line) AS paragraph FROM st JOIN ld USING (document_id, page)),
  pp AS (SELECT document_id, page, paragraph, string_agg(text, ' ' ORDER BY line) AS text, min(line) AS first_line, max(line) AS last_line, min(x0) AS x0, least(612, max(x1)) AS x1, min(baseline) - 7.5 AS y0, least(792, max(baseline) + 2.5) AS y1 FROM par2 GROUP BY 1, 2, 3),
  hh AS (SELECT *, CASE WHEN length(text) > 120 THEN NULL WHEN regexp_matches(text, '(?i)^part\s+[ivx]+\b') THEN 1 WHEN regexp_matches(text, '(?i)^item\s+\d+[a-z]?') THEN 2 END AS level FROM pp)"""

SQL = {
    "prj8_lines": sql(_DRAWN + " SELECT document_id, page, line, text, x0, x1, baseline FROM lines", "par"),
    "prj10_page_paragraphs": sql(_DRAWN + " SELECT document_id, page, CAST(paragraph AS BIGINT) AS paragraph, text FROM pp", "par"),
    "prj11_breaks": sql(_DRAWN + " SELECT document_id, page, CAST(paragraph AS BIGINT) AS paragraph, first_line, last_line FROM pp", "par"),
    "prj12_boxes": sql(_DRAWN + " SELECT document_id, page, CAST(paragraph AS BIGINT) AS paragraph, x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM pp", "par"),
    "prj13_headings": sql(_DRAWN + " SELECT document_id, page, CAST(paragraph AS BIGINT) AS paragraph, level, CASE WHEN level IS NULL THEN page || '_' || CAST(sum(CASE WHEN level IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY paragraph) AS BIGINT) END AS paragraph_id FROM hh", "par"),
    "prj28_page_rows": sql(_DRAWN + " SELECT document_id, page, count(*) AS paragraphs, count(level) AS headings FROM hh GROUP BY 1, 2", "par"),
    "prj29_points": sql(_DRAWN + " SELECT document_id, page, CAST(paragraph AS BIGINT) AS paragraph, round_even(x0 * 0.75, 2) AS x0, round_even(y0::DOUBLE * 0.75, 2) AS y0, round_even(x1::DOUBLE * 0.75, 2) AS x1, round_even(y1::DOUBLE * 0.75, 2) AS y1 FROM pp", "par"),
    "sca11_boxes_as_json": sql(_DRAWN + """ SELECT document_id, page, CAST(paragraph AS BIGINT) AS paragraph, '{"x0":' || round_even(x0, 2) || ',"y0":' || round_even(y0::DOUBLE, 2) || ',"x1":' || round_even(x1::DOUBLE, 2) || ',"y1":' || round_even(y1::DOUBLE, 2) || '}' AS box FROM pp""", "par"),
}
