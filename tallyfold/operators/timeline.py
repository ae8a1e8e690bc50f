"""What changed between a company's successive filings of one form, from the paragraphs that cite each topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import carried
from tallyfold.operators.ordering import with_next
from tallyfold.storage import written

#: Forms compared filing to filing, those in which absence tells something, and the display order of kinds.
PERIODIC = ("10-K", "10-Q", "20-F", "40-F")
ANNUAL = ("10-K", "20-F", "40-F")
ORDER = {"filed": 0, "newly_disclosed": 1, "expanded": 2, "narrowed": 3, "no_longer_disclosed": 4, "disclosed_again": 5}
#: Least difference and least ratio of paragraphs for a topic to have grown or shrunk.
MIN_DELTA, MIN_RATIO = 3, 1.25
#: Fixed value: the share of a paragraph's word runs said before from which it is carried over.
CARRIED_OVER = 0.5


def grown(before: Column, after: Column) -> Column:
    return (before > 0) & (after - before >= MIN_DELTA) & (after >= MIN_RATIO * before)


def comparable(filings: DataFrame) -> DataFrame:
    """Periodic filings that amend none, each with its company's next of the form."""
    rows = filings.where(F.col("form_type").isin(*PERIODIC) & ~F.col("form_type").endswith("/A")).select("document_id", "cik", "accession", "form_type", "filed_at")
    return with_next(rows, ["cik", "form_type"], ["filed_at", "accession"], F.trunc("filed_at", "year"), "document_id")


def coverage(filings: DataFrame) -> DataFrame:
    """Each filing as baseline, compared or not compared."""
    c = comparable(filings)
    later = c.where(F.col("next_document_id").isNotNull()).select(F.col("next_document_id").alias("document_id"), F.lit(True).alias("has_before"))
    rows = filings.select("document_id", "accession").join(c.select("document_id", F.lit(True).alias("is_comparable")), "document_id", "left").join(later, "document_id", "left")
    return rows.select("document_id", "accession", F.when(F.col("is_comparable").isNull(), "not compared").when(F.col("has_before").isNull(), "baseline").otherwise("compared").alias("coverage"))


def topic_counts(mentions: DataFrame) -> DataFrame:
    """Distinct paragraphs of a filing that cite a topic; parts of one paragraph count once."""
    key = F.coalesce(T.base_paragraph(F.col("paragraph_id")), F.concat(F.lit("mention:"), F.col("mention_id").cast("string")))
    return mentions.groupBy("document_id", "slug").agg(F.count_distinct(key).alias("n"))


def compared(c: DataFrame, counts: DataFrame) -> DataFrame:
    """(filing, topic) of every comparison: paragraphs now and in the filing before, each side counted without a full outer join.

    `c` is `comparable` and `counts` is `topic_counts`.
    """
    pairs = c.where(F.col("next_document_id").isNotNull()).select(F.col("document_id").alias("before_id"), F.col("next_document_id").alias("document_id"))
    here = counts.join(pairs, "document_id").select("document_id", "before_id", "slug", F.col("n").alias("after"), F.lit(0).cast("bigint").alias("before"))
    there = counts.select(F.col("document_id").alias("before_id"), "slug", "n").join(pairs, "before_id").select("document_id", "before_id", "slug", F.lit(0).cast("bigint").alias("after"), F.col("n").alias("before"))
    return here.unionByName(there).groupBy("document_id", "before_id", "slug").agg(F.sum("after").alias("after"), F.sum("before").alias("before"))


def first_citations(c: DataFrame, counts: DataFrame) -> DataFrame:
    """By company, topic and form: where a compared filing first cites the topic."""
    return counts.join(c, "document_id").groupBy("cik", "slug", "form_type").agg(F.min(F.struct("filed_at", "accession")).alias("at"))


def changes(filings: DataFrame, mentions: DataFrame) -> DataFrame:
    """Events of topics: kind, paragraphs now and before, and the other forms that named a new topic earlier.

    Filings and mentions are read once: what the comparison needs of them are two small tables.
    """
    c = written(comparable(filings), "timeline-filings")
    counts = written(topic_counts(mentions), "timeline-counts")
    f = c.select("document_id", "cik", "accession", "form_type", "filed_at")
    rows = compared(c, counts).join(f, "document_id")
    earlier = first_citations(c, counts).select("cik", "slug", F.col("form_type").alias("form"), "at")
    new = rows.where((F.col("after") > 0) & (F.col("before") == 0)).join(earlier, ["cik", "slug"]).where(F.col("at") < F.struct("filed_at", "accession"))
    seen = new.groupBy("document_id", "slug").agg(F.array_sort(F.collect_set("form")).alias("seen_in"))
    rows = rows.join(seen, ["document_id", "slug"], "left").withColumn("seen_in", F.coalesce("seen_in", F.array().cast("array<string>")))
    a, b = F.col("after"), F.col("before")
    kind = (
        F.when((a > 0) & (b == 0) & F.array_contains("seen_in", F.col("form_type")), "disclosed_again").when((a > 0) & (b == 0), "newly_disclosed")
        .when((b > 0) & (a == 0) & F.col("form_type").isin(*ANNUAL), "no_longer_disclosed").when(grown(b, a), "expanded").when(grown(a, b) & (a > 0), "narrowed")
    )
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    named = F.when(F.col("kind") == "newly_disclosed", F.array_join("seen_in", " and a ")).otherwise("")
    return rows.select("document_id", "before_id", "cik", "accession", "form_type", "filed_at", "slug", "kind", a.alias("paragraphs"), b.alias("previous_paragraphs"), named.alias("named_earlier_in"))


def filed(filings: DataFrame) -> DataFrame:
    return filings.select("document_id", F.lit(None).cast("bigint").alias("before_id"), "cik", "accession", "form_type", "filed_at", F.lit("").alias("slug"), F.lit("filed").alias("kind"), F.lit(None).cast("bigint").alias("paragraphs"), F.lit(None).cast("bigint").alias("previous_paragraphs"), F.lit("").alias("named_earlier_in"))


def events(filings: DataFrame, mentions: DataFrame) -> DataFrame:
    """All events with their display rank and stable key."""
    rows = filed(filings).unionByName(changes(filings, mentions))
    rank = T.looked_up({k: str(v) for k, v in ORDER.items()}, F.col("kind"), F.lit("9")).cast("int")
    return rows.withColumns({"rank": rank, "key": F.concat_ws(":", "accession", "kind", "slug")})


def evidence(change_rows: DataFrame, mentions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The citation that an event points at: key, cited_in, mention_id, paragraph_id, quote, new_paragraph.

    It is the first one in reading order whose paragraph is not carried over from what the compared filing says of the
    topic, and then `new_paragraph` is true; if all are carried over it is the first one, and false.  For a dropped topic
    it is the first one in the filing before, and null; so it is where a paragraph's text is not known.  A paragraph is
    carried over if at least `CARRIED_OVER` of its word runs stand in the topic's paragraphs there.
    """
    dropped = F.col("kind") == "no_longer_disclosed"
    at = change_rows.select(F.concat_ws(":", "accession", "kind", "slug").alias("key"), "slug", F.when(dropped, F.col("before_id")).otherwise(F.col("document_id")).alias("cited_in"), F.when(~dropped, F.col("before_id")).alias("against"))
    at = written(at, "evidence-events")
    order = F.struct(T.reading_order(F.col("paragraph_id"), F.lit(None).cast("int"), F.lit(0)).alias("o"), F.col("mention_id").alias("id"))
    cited = mentions.select(F.col("document_id").alias("cited_in"), "slug", "mention_id", "paragraph_id", "quote", order.alias("order"))
    rows = written(at.join(cited, ["cited_in", "slug"]), "evidence-cited")
    texts = paragraphs.where(F.length("text") > 0).groupBy("document_id", "paragraph_id").agg(F.min_by("text", "block_id").alias("text"))
    # the runs of the topic's paragraphs in the filing compared with, and of each cited paragraph, once however often it is cited
    place = lambda doc: texts.withColumnRenamed("document_id", doc)
    earlier = at.where(F.col("against").isNotNull()).join(mentions.select(F.col("document_id").alias("against"), "slug", "paragraph_id").distinct(), ["against", "slug"]).join(place("against"), ["against", "paragraph_id"]).select("key", "text")
    looked = rows.where(F.col("against").isNotNull()).select("key", "cited_in", "paragraph_id").distinct().join(place("cited_in"), ["cited_in", "paragraph_id"]).select("key", F.struct("key", "paragraph_id").alias("where"), F.col("text").alias("quote"))
    shares = carried.overlaps(looked, earlier, "where", "key").select("where.key", "where.paragraph_id", "share")
    judged = rows.join(shares, ["key", "paragraph_id"], "left").withColumn("known", F.col("share").isNotNull())
    fresh = F.struct((F.col("share") >= CARRIED_OVER).alias("carried"), "order")
    pick = F.struct("mention_id", "paragraph_id", "quote", "cited_in", "share")
    best = judged.groupBy("key").agg(F.bool_and("known").alias("known"), F.min_by(pick, fresh).alias("fresh"), F.min_by(pick, "order").alias("first"))
    new = F.when(F.col("known"), F.col("fresh.share") < CARRIED_OVER)
    return best.withColumn("p", F.when(new, F.col("fresh")).otherwise(F.col("first"))).select("key", "p.cited_in", "p.mention_id", "p.paragraph_id", "p.quote", new.alias("new_paragraph"))
