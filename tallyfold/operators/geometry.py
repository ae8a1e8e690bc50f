"""Paragraphs of pages that are known by where their text was drawn: runs to lines, lines to paragraphs, paragraphs to boxes.

A run is a piece of text drawn at once: document_id, page, run (order of drawing), text, x0, x1, baseline (from the
page's top), size, and whether it is rotated and begins a new line.  Reading the bytes of a format is left to a reader;
everything after it is windows over a page's runs and lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T

#: A gap between words, between paragraphs, a change of size, an indent (in sizes, leadings, points, sizes).
WORD_GAP, PARAGRAPH_GAP, SIZE_STEP, INDENT = 0.15, 1.35, 1.5, 0.8
#: How far text reaches above and below its baseline, in sizes.
ASCENT, DESCENT = 0.75, 0.25
#: Fixed value: what begins an item of a list.
BULLET = r"^\s*[•●◦▪‣∙·\-–]\s"
PAGE = ("document_id", "page")


def lines(runs: DataFrame) -> DataFrame:
    """document_id, page, line, text, x0, x1, baseline, size, measurable: runs between line ends, with a space where they stand apart.

    Rotated runs give text but no place; a line with one is not measurable.  Lines without visible text are left out.
    """
    order = Window.partitionBy(*PAGE).orderBy("run")  # the runs of one page
    c = F.col
    rows = runs.withColumn("line", F.sum(F.when(c("begins"), 1).otherwise(0)).over(order))
    before = Window.partitionBy(*PAGE, "line").orderBy("run")
    last = F.last(F.when(~c("rotated"), c("x1")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.lag("text").over(before).isNotNull()) & ~F.lag("text").over(before).endswith(" ") & ~c("text").startswith(" ") & (c("x0") - last > WORD_GAP * c("size"))
    rows = rows.withColumn("piece", F.concat(F.when(apart, " ").otherwise(""), "text"))
    seen = lambda x: F.when(~c("rotated") & (F.trim("text") != ""), c(x))
    grouped = rows.groupBy(*PAGE, "line").agg(
        F.array_sort(F.collect_list(F.struct("run", "piece"))).alias("p"), F.min(seen("x0")).alias("x0"), F.max(seen("x1")).alias("x1"),
        F.min_by(seen("baseline"), F.when(seen("baseline").isNotNull(), c("run"))).alias("baseline"), F.coalesce(F.max(seen("size")), F.lit(0.0)).alias("size"), (~F.bool_or("rotated")).alias("measurable"),
    )
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return grouped.select(*PAGE, "line", text.alias("text"), "x0", "x1", "baseline", "size", "measurable").where(F.trim("text") != "")


def leadings(line_rows: DataFrame) -> DataFrame:
    """document_id, page, leading: the median step down between neighbouring lines that could be of one paragraph."""
    placed = line_rows.where(F.col("baseline").isNotNull())
    order = Window.partitionBy(*PAGE).orderBy("line")
    step, most = F.col("baseline") - F.lag("baseline").over(order), F.greatest("size", F.lag("size").over(order), F.lit(1.0))
    rows = placed.select(*PAGE, "size", step.alias("step"), most.alias("most"))
    near = (F.col("step") > 0) & (F.col("step") < 3 * F.col("most"))
    return rows.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(near, F.col("step"))), 1.2 * F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(10.0))).alias("leading"))


def breaks(line_rows: DataFrame) -> DataFrame:
    """The lines with `paragraph` (from 1 on a page): a line begins one if it is a list item, moved up, stands far below, changes size or is indented."""
    order = Window.partitionBy(*PAGE).orderBy("line")
    c = F.col
    was = lambda x: F.lag(x).over(order)
    rows = line_rows.join(leadings(line_rows), list(PAGE), "left").withColumns({"step": c("baseline") - was("baseline"), "size_step": F.abs(c("size") - was("size")), "was_size": was("size"), "shift": c("x0") - was("x0"), "opens": was("line").isNull()})
    moved = (c("step") <= 0) | (c("step") > PARAGRAPH_GAP * c("leading")) | ((c("was_size") > 0) & (c("size") > 0) & (c("size_step") > SIZE_STEP)) | ((c("size") > 0) & (c("shift") > INDENT * c("size")))
    starts = c("opens") | c("text").rlike(BULLET) | F.coalesce(c("step").isNotNull() & moved, F.lit(False))
    return rows.withColumn("starts", starts).withColumn("paragraph", F.sum(c("starts").cast("int")).over(order)).drop("step", "size_step", "was_size", "shift", "opens", "starts", "leading")


def heading(text: Column, longest: int = 120) -> Column:
    """1 for the heading of a part, 2 for an item's, null for prose."""
    return F.when(F.length(text) > longest, None).when(text.rlike(r"(?i)^part\s+[ivx]+\b"), 1).when(text.rlike(r"(?i)^item\s+\d+[a-z]?"), 2)


def paragraphs(line_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, page, paragraph, level (of a heading), paragraph_id (of prose), text, x0, y0, x1, y1.

    `pages` has document_id, page, width, height, rotated.  The box is that of the lines within the page; null where the
    page or a line is rotated.
    """
    c = F.col
    rows = breaks(line_rows).groupBy(*PAGE, "paragraph").agg(
        F.array_sort(F.collect_list(F.struct("line", "text"))).alias("p"), F.bool_and("measurable").alias("measurable"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min(c("baseline") - ASCENT * c("size")).alias("y0"), F.max(c("baseline") + DESCENT * c("size")).alias("y1"),
    )
    rows = rows.withColumn("text", T.collapsed(F.array_join(F.transform("p", lambda x: x["text"]), " "))).where(c("text") != "").withColumn("level", heading(c("text")))
    order = Window.partitionBy(*PAGE).orderBy("paragraph")
    index = F.sum(c("level").isNull().cast("int")).over(order)
    rows = rows.join(pages, list(PAGE)).withColumn("index", index)
    boxed = c("measurable") & ~c("rotated")
    box = {"x0": F.greatest(F.lit(0.0), "x0"), "y0": F.greatest(F.lit(0.0), "y0"), "x1": F.least("width", "x1"), "y1": F.least("height", "y1")}
    return rows.select(*PAGE, "paragraph", "level", F.when(c("level").isNull(), F.concat_ws("_", c("page").cast("string"), c("index").cast("string"))).alias("paragraph_id"), "text", *[F.when(boxed, v).alias(k) for k, v in box.items()])


def composed(outer: list[Column], inner: list[Column]) -> list[Column]:
    """Two placements (a b c d e f) as one: what `inner` places, placed again by `outer`."""
    a, b, c, d, e, f = inner
    k, m, n, o, p, q = outer
    return [a * k + b * n, a * m + b * o, c * k + d * n, c * m + d * o, e * k + f * n + p, e * m + f * o + q]
