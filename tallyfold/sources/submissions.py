"""Listings of filings as a regulator publishes them: parallel arrays per company, to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBMISSION = "cik string, name string, tickers array<string>, sic string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, reportDate: array<string>, acceptanceDateTime: array<string>, primaryDocument: array<string>>>"


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Company listings, read with their schema."""
    return spark.read.schema(SUBMISSION).json(path, multiLine=True)


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik (ten digits), title from a map of entries, whatever its keys."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.map_values(F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>"))
    return raw.select(F.explode(entries).alias("e")).select(F.upper("e.ticker").alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"), F.col("e.title").alias("title"))


def recent_filings(listing: DataFrame, forms: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """One row per listed filing in the listing's order (newest first); the first `limit` of each company's wanted forms."""
    r = "filings.recent."
    zipped = F.arrays_zip(*[F.col(r + c).alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument")])
    rows = listing.select("cik", F.posexplode(zipped).alias("pos", "f"))
    if forms:
        rows = rows.where(F.col("f.form").isin(*forms))
    accepted = F.coalesce(F.to_timestamp("f.acceptanceDateTime"), F.to_timestamp("f.filingDate"))
    rows = rows.select("cik", "pos", F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form_type"), F.to_date("f.filingDate").alias("filed_at"), F.to_date(F.nullif("f.reportDate", F.lit(""))).alias("reported"), accepted.alias("accepted_at"), F.col("f.primaryDocument").alias("document"))
    if limit:
        kept = rows.groupBy("cik").agg(F.slice(F.array_sort(F.collect_list("pos")), 1, limit).alias("kept"))
        rows = rows.join(kept, "cik").where(F.array_contains("kept", F.col("pos"))).drop("kept")
    return rows


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of documents with their digest, and whether they are PDF by name or first bytes."""
    files = spark.read.format("binaryFile").load(path)
    pdf = F.lower("path").endswith(".pdf") | (F.hex(F.substring("content", 1, 5)) == "255044462D")
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), pdf.alias("is_pdf"), F.when(~pdf, F.decode("content", "UTF-8")).alias("html"))


def new_documents(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """Arrivals whose bytes aren't those already taken in under the same name."""
    return arrived.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")
