"""Paragraphs packed into chunks of bounded size inside their sections, with a paragraph of overlap.

Packing is a fold over a section's paragraphs in order.  Only their sizes decide it, so Python sees an array of sizes
per section and gives back where to cut; the texts stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallyfold.functions import text as T
from tallyfold.storage import written

#: Tokens aimed at and allowed, characters a token stands for, what joins paragraphs.
TARGET, CEILING, CHARS, JOIN = 350, 600, 4, "\n\n"


def packed(sizes: list[int], target: int = TARGET * CHARS, ceiling: int = CEILING * CHARS, overlap: int = 1) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of each chunk of paragraphs with the given sizes.

    A chunk ends once it reaches the target; the next begins with the last `overlap` paragraphs unless they take over
    half the target.  A paragraph that would break the ceiling begins a chunk without overlap; the chunk before it ends
    where it is, even if it holds the overlap alone.  What is left at the end is a chunk if it holds anything new.
    """
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s + len(JOIN))
    length = lambda a, b: sums[b] - sums[a] - len(JOIN) if b > a else 0
    first = covered = 0
    for i in range(len(sizes)):
        if i > first and length(first, i + 1) > ceiling:
            yield first, i
            first = covered = i
        if length(first, i + 1) >= target:
            yield first, i + 1
            covered = i + 1
            back = max(first, i + 1 - overlap)
            first = i + 1 if length(back, i + 1) > target // 2 else back
    if covered < len(sizes):
        yield first, len(sizes)


def filled(sizes: list[int], base: int, limit: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of pieces that fit the limit, where each run costs `base` and each piece its size and one."""
    first, total = 0, base
    for i, size in enumerate(sizes):
        if i > first and total + 1 + size > limit:
            yield first, i
            first, total = i, base
        total += 1 + size
    if sizes:
        yield first, len(sizes)


CUTS = ArrayType(StructType([StructField("first", IntegerType()), StructField("end", IntegerType())]))


def _cuts():
    """A column function: sizes of a section's paragraphs -> (first, last + 1) of its chunks; a batch holds many sections."""

    def run(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: [{"first": a, "end": b} for a, b in packed(list(s))], na_action="ignore")

    run.__annotations__ = {"sizes": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, CUTS)


def sentence_parts(text: str, ceiling: int = CEILING * CHARS) -> list[str]:
    """A paragraph in parts of whole sentences, each at most the ceiling; a longer sentence is cut there.

    Here a sentence ends with a gap of white space between an end mark and a capital, an opening quote or bracket.
    """
    sentences, start = [], 0
    for gap in re.finditer(r"\s+", text):
        before, after = text[max(0, gap.start() - 1) : gap.start()], text[gap.end() : gap.end() + 1]
        if before and before in ".!?" and after and (after in "(“\"" or "A" <= after <= "Z"):
            sentences.append(text[start : gap.start()])
            start = gap.end()
    sentences.append(text[start:])
    pieces = [s[i : i + ceiling] for s in sentences for i in range(0, len(s), ceiling)]
    return [" ".join(pieces[a:b]) for a, b in filled([len(p) for p in pieces], -1, ceiling)]


def with_parts(paragraphs: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """The paragraphs, those of more tokens than the ceiling in parts (`4_2#1`): adds `part`, 0 for a whole paragraph."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentence_parts(t, ceiling * CHARS), na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    big = F.col("__big")
    cut = F.pandas_udf(run, ArrayType(StringType()))(F.when(big, F.col("text")))  # only long texts travel
    rows = paragraphs.withColumn("__big", F.floor(F.length("text") / CHARS) > ceiling).withColumn("__p", F.coalesce(cut, F.array("text"))).select("*", F.posexplode("__p").alias("__n", "__text"))
    rows = rows.withColumns({"part": F.when(big, F.col("__n") + 1).otherwise(0), "text": F.col("__text")})
    return rows.withColumn("paragraph_id", F.when(F.col("part") > 0, F.concat_ws("#", "paragraph_id", F.col("part").cast("string"))).otherwise(F.col("paragraph_id"))).drop("__big", "__p", "__n", "__text")


def chunks(paragraphs: DataFrame) -> DataFrame:
    """document_id, section_ordinal, chunk (from 0 in the section), paragraph_ids, text, tokens, first_page, last_page.

    Paragraphs above the ceiling are split first, so that no chunk of several paragraphs and no part exceeds it.
    Paragraphs without a section are packed together as one.  A group is one section of one filing.
    """
    return _sections(paragraphs).drop("begins")


def _sections(paragraphs: DataFrame) -> DataFrame:
    texts = with_parts(paragraphs.where(F.length("text") > 0)).withColumn("section", F.coalesce("section_ordinal", F.lit(-1)))
    rows = texts.groupBy("document_id", "section").agg(F.array_sort(F.collect_list(F.struct("ordinal", "block_id", "part", "paragraph_id", "page_number", "text"))).alias("p"))
    begins = F.struct(F.col("p")[0]["ordinal"].alias("ordinal"), F.col("p")[0]["block_id"].alias("block_id")).alias("begins")
    rows = rows.select("document_id", "section", begins, "p", F.posexplode(_cuts()(F.transform("p", lambda x: F.length(x["text"])))).alias("chunk", "c"))
    rows = rows.withColumn("p", F.slice("p", F.col("c.first") + 1, F.col("c.end") - F.col("c.first")))
    text = F.array_join(F.transform("p", lambda x: x["text"]), JOIN)
    pages = F.array_compact(F.transform("p", lambda x: x["page_number"]))
    return rows.select("document_id", F.nullif("section", F.lit(-1)).alias("section_ordinal"), "chunk", F.transform("p", lambda x: x["paragraph_id"]).alias("paragraph_ids"), text.alias("text"), F.greatest(F.lit(1), F.floor(F.length(text) / CHARS)).cast("int").alias("tokens"), F.array_min(pages).alias("first_page"), F.array_max(pages).alias("last_page"), "begins")


def document_chunks(paragraphs: DataFrame, tables: DataFrame, filings: DataFrame) -> DataFrame:
    """All chunks of a filing, prose before tables: document_id, ordinal (in the filing), chunk_id, kind, section_ordinal, paragraph_ids, table_ordinal, tokens, first_page, last_page, text.

    Sections stand in the order in which their first paragraphs do.  A chunk's id follows from the accession, its text,
    and its section and ordinal (a table: its ordinal and part).  Ordinals are running sums over a filing's sections and
    tables, of which each is one row there.
    """
    prose = written(_sections(paragraphs), "chunks-prose")
    before = Window.partitionBy("document_id").orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)
    counted = prose.groupBy("document_id", "section_ordinal").agg(F.min("begins").alias("begins"), F.count("*").alias("n"))
    starts = counted.select("document_id", F.coalesce("section_ordinal", F.lit(-1)).alias("section"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    totals = counted.groupBy("document_id").agg(F.sum("n").alias("prose"))
    rows = prose.withColumn("section", F.coalesce("section_ordinal", F.lit(-1))).join(starts, ["document_id", "section"])
    none = lambda t: F.lit(None).cast(t)
    section = F.coalesce(F.col("section_ordinal").cast("string"), F.lit("None"))
    ordinal = (F.col("start") + F.col("chunk")).cast("int")
    rows = rows.select("document_id", ordinal.alias("ordinal"), F.concat(F.lit("s"), section, F.lit(":"), ordinal.cast("string")).alias("salt"), F.lit("prose").alias("kind"), "section_ordinal", "paragraph_ids", none("int").alias("table_ordinal"), "tokens", "first_page", "last_page", "text")
    parts = table_parts(tables)
    within = Window.partitionBy("document_id").orderBy("ordinal", "part")  # the tables of one filing
    tabled = parts.withColumn("place", F.row_number().over(within) - 1).join(totals, "document_id", "left")
    tabled = tabled.select(
        "document_id", (F.coalesce("prose", F.lit(0)) + F.col("place")).cast("int").alias("ordinal"), F.concat_ws(":", F.lit("table"), F.col("ordinal").cast("string"), F.col("part").cast("string")).alias("salt"), F.lit("table").alias("kind"),
        none("int").alias("section_ordinal"), F.array().cast("array<string>").alias("paragraph_ids"), F.col("ordinal").alias("table_ordinal"), F.greatest(F.lit(1), F.floor(F.length("text") / CHARS)).cast("int").alias("tokens"), none("int").alias("first_page"), none("int").alias("last_page"), "text",
    )
    both = rows.unionByName(tabled).join(filings.select("document_id", "accession"), "document_id")
    return both.withColumn("chunk_id", T.content_id("c", F.col("accession"), F.col("text"), F.col("salt"))).drop("salt", "accession")


def oversized_parts(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs above the ceiling in parts of whole sentences, each with the paragraph's id and its number (`4_2#1`)."""
    big = paragraphs.where(F.floor(F.length("text") / CHARS) > CEILING)
    return with_parts(big).select("block_id", F.col("paragraph_id").alias("part_id"), "text")


def paragraphs_of(chunk_rows: DataFrame) -> DataFrame:
    """Chunks taken apart again: each paragraph of a document once, by the first chunk that holds it.

    A chunk whose text has another number of parts than it has ids (a paragraph holds a blank line) stays one row, with
    the chunk's own anchor `c-section-chunk` (`c--chunk` without a section).
    """
    parts = F.split("text", JOIN)
    rows = chunk_rows.where(F.size(parts) == F.size("paragraph_ids")).select("document_id", "section_ordinal", "chunk", F.posexplode(F.arrays_zip(F.col("paragraph_ids").alias("id"), parts.alias("text"))).alias("place", "p"))
    first = rows.groupBy("document_id", F.col("p.id").alias("paragraph_id")).agg(F.min_by("p.text", F.struct(F.coalesce("section_ordinal", F.lit(-1)).alias("s"), "chunk", "place")).alias("text"))
    anchor = F.concat(F.lit("c-"), F.coalesce(F.col("section_ordinal").cast("string"), F.lit("")), F.lit("-"), F.col("chunk").cast("string"))
    whole = chunk_rows.where(F.size(parts) != F.size("paragraph_ids")).select("document_id", anchor.alias("paragraph_id"), "text")
    return first.unionByName(whole)


def table_parts(tables: DataFrame, limit: int = CEILING * CHARS) -> DataFrame:
    """document_id, ordinal, part, text: a table whole where it fits the limit, else its rows in parts with caption and header on each.

    `tables` has document_id, ordinal, cells and, if they have one, caption.
    """

    def run(sizes: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([[{"first": a, "end": b} for a, b in filled(list(s), int(base), limit)] for s, base in zip(sizes, bases, strict=True)], dtype=object)

    run.__annotations__ = {"sizes": pd.Series, "bases": pd.Series, "return": pd.Series}
    caption = F.coalesce(F.concat(F.nullif("caption", F.lit("")), F.lit("\n")), F.lit("")) if "caption" in tables.columns else F.lit("")
    rows = tables.select("document_id", "ordinal", caption.alias("caption"), F.transform("cells", lambda r: F.array_join(r, " | ")).alias("lines"))
    rows = rows.withColumns({"whole": F.concat("caption", F.array_join("lines", "\n")), "header": F.coalesce(F.get("lines", F.lit(0)), F.lit("")), "body": F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))})
    cuts = F.pandas_udf(run, CUTS)(F.transform("body", lambda r: F.length(r)), F.length("caption") + F.length("header"))
    part = lambda c: F.concat("caption", F.array_join(F.concat(F.array("header"), F.slice("body", c["first"] + 1, c["end"] - c["first"])), "\n"))
    fits = (F.length("whole") <= limit) | (F.size("body") == 0)
    rows = rows.withColumn("cuts", cuts).withColumn("parts", F.when(fits, F.array("whole")).otherwise(F.transform("cuts", part)))
    return rows.select("document_id", "ordinal", F.posexplode("parts").alias("part", "text"))
