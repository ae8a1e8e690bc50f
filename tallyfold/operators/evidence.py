"""Citations resolved to the paragraphs they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.storage import written

#: Rows at most of the table that tells where a name may begin: it is sent to every task, however many names there are.
SLOTS = 1 << 21


def resolved(citations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Every citation with its paragraph's text and page, or an error.

    The cited pairs are made distinct before the join, so a paragraph that a third of the citations name is looked up
    once; a paragraph delivered under several block ids counts as its first.
    """
    cited = citations.select("document_id", "paragraph_id").distinct()
    texts = paragraphs.groupBy("document_id", "paragraph_id").agg(F.min_by(F.struct("block_id", "text", "page_number", "section_ordinal"), "block_id").alias("b"))
    looked = cited.join(texts, ["document_id", "paragraph_id"], "left")
    rows = citations.join(looked, ["document_id", "paragraph_id"], "left")
    error = F.when(F.col("b").isNull(), "no such paragraph").when(~T.quote_located(F.col("quote"), F.col("b.text")), "the quote is not in the paragraph")
    return rows.select("mention_id", "document_id", "paragraph_id", "b.block_id", T.paragraph_page(F.col("paragraph_id"), F.col("b.page_number")).alias("page"), error.alias("error"))


def paragraph_entities(mentions: DataFrame) -> DataFrame:
    """Entities of each paragraph at their highest confidence, the first mention among equals."""
    order = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("mention_id")).alias("m"))
    return mentions.groupBy("document_id", "paragraph_id", "slug").agg(F.max_by(F.struct("name", "entity_type", "confidence"), order).alias("r")).select("document_id", "paragraph_id", "slug", "r.name", "r.entity_type", "r.confidence")


def full_texts(paragraphs: DataFrame) -> DataFrame:
    """Each filing's text, its paragraphs in order; a group is one filing's paragraphs."""
    parts = paragraphs.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "block_id", "text"))).alias("p"))
    return parts.select("document_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def page_neighbours(paragraphs: DataFrame) -> DataFrame:
    """Pages with text of each filing and the pages with text before and after them."""
    pages = paragraphs.where(F.col("page_number").isNotNull()).groupBy("document_id", "page_number").agg(F.count("*").alias("paragraphs"))
    w = Window.partitionBy("document_id").orderBy("page_number")
    return pages.select("document_id", "page_number", "paragraphs", F.lag("page_number").over(w).alias("prev_page"), F.lead("page_number").over(w).alias("next_page"))


def all_pages(filings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Every page from 1 to a filing's last, with its paragraphs; a filing without a page count has the pages with text."""
    counts = paragraphs.where("page_number is not null").groupBy("document_id", "page_number").agg(F.count("*").alias("paragraphs"))
    most = counts.groupBy("document_id").agg(F.max("page_number").alias("m"))
    rows = filings.select("document_id", "page_count").join(most, "document_id", "left").withColumn("total", F.greatest(F.coalesce("page_count", F.lit(0)), F.coalesce("m", F.lit(0))))
    pages = rows.where("total > 0").select("document_id", F.explode(F.sequence(F.lit(1), "total")).alias("page_number"))
    return pages.join(counts, ["document_id", "page_number"], "left").select("document_id", "page_number", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


def document_stats(paragraphs: DataFrame) -> DataFrame:
    page = T.paragraph_page(F.col("paragraph_id"), F.col("page_number"))
    return paragraphs.groupBy("document_id").agg(
        F.count_distinct(page).alias("pages_with_text"), F.min(page).alias("first_page"), F.count_distinct(T.base_paragraph(F.col("paragraph_id"))).alias("paragraphs"),
        F.sum(F.length("text")).alias("characters"), F.max(page).alias("last_page"),
    )


def names_in(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, slug: the names of a company (cik, slug, name) that stand in its texts (key, cik, text), adjacent and whole.

    Texts and names meet in the first two words of a name, or in its only one.  A place in a text is sent only if a name
    may begin there, which a table of at most SLOTS rows tells before anything is sent, and it takes along as many words
    as the longest such name has, never the text.
    """
    slot = F.xxhash64("cik", "__o").bitwiseAND(F.lit(SLOTS - 1))
    named = names.select("cik", "slug", T.said(F.col("name")).alias("__w")).where(F.size("__w") > 0)
    known = written(named.select("cik", "slug", F.array_join("__w", " ").alias("__n"), F.array_join(F.slice("__w", 1, 2), " ").alias("__o"), F.size("__w").alias("__size")), "names")
    slots = known.groupBy(slot.alias("__slot")).agg(F.max("__size").alias("__most"))
    # outer: else Spark looks for a text's words once more, to tell whether it has any
    places = texts.select(key, "cik", T.said(F.col("text")).alias("__w")).select(key, "cik", "__w", F.posexplode_outer("__w").alias("__i", "__first"))
    openings = F.array("__first", F.concat_ws(" ", "__first", F.get("__w", F.col("__i") + 1)))
    starts = places.select(key, "cik", "__w", "__i", F.explode(openings).alias("__o")).withColumn("__slot", slot).join(F.broadcast(slots), "__slot")
    runs = starts.select(key, "cik", "__o", F.array_join(F.slice("__w", F.col("__i") + 1, F.col("__most")), " ").alias("__run"))
    met = runs.join(known, ["cik", "__o"]).where(F.startswith(F.concat("__run", F.lit(" ")), F.concat("__n", F.lit(" "))))
    return met.select(key, "slug").distinct()
