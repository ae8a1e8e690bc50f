"""Queries on sources: the tables written in the shapes that publishers deliver, and read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from tallyfold.plans.cards import _OVER
from tallyfold.plans.entries import _first_new
from tallyfold.plans.model import filings, sql, table
from tallyfold.sources import submissions as SUB
from tallyfold.sources.tables import published
from tallyfold.storage import remove, shared_folder


def _place(s, name):
    """A new folder for files that go with the application."""
    path = f"{shared_folder(s)}/tallyfold/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, s, path)
    return path


def _tickers(s, d):
    """The map of tickers as one document: a fixed few hundred companies."""
    path = _place(s, "tickers")
    entry = F.struct(F.col("cik").cast("bigint").alias("cik_str"), F.col("ticker").alias("ticker"), F.col("name").alias("title"))
    rows = table(s, d, "companies").where("ticker is not null").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("cik", entry.alias("e")))).alias("m"))
    rows.select(F.to_json("m")).coalesce(1).write.text(path)
    return SUB.tickers(s, path)


def _listings(s, d):
    """Each company's filings in parallel arrays, newest first, one document for each company."""
    path = _place(s, "listings")
    f = filings(s, d, "cik", "accession", "form_type", "filed_at")
    day = F.col("filed_at").cast("string")
    listed = f.groupBy("cik").agg(F.reverse(F.array_sort(F.collect_list(F.struct(day.alias("day"), "accession", "form_type")))).alias("r"))
    of = lambda c: F.transform("r", lambda x: x[c])
    recent = F.struct(of("accession").alias("accessionNumber"), of("form_type").alias("form"), of("day").alias("filingDate"), F.transform("r", lambda x: F.lit("")).alias("reportDate"), F.transform("r", lambda x: F.concat(x["day"], F.lit("T12:00:00.000Z"))).alias("acceptanceDateTime"), F.transform("r", lambda x: F.concat(x["accession"], F.lit(".htm"))).alias("primaryDocument"))
    listed.select("cik", F.struct(recent.alias("recent")).alias("filings")).write.json(path)
    return s.read.schema(SUB.SUBMISSION).json(path)


def _raw(s, d):
    """The passages as files, read back as bytes with their digest."""
    path = _place(s, "raw")
    rows = table(s, d, "eval_passages").where("item_id is not null and length(passage) > 0").select("item_id", F.regexp_replace("passage", r"\s+", " ").alias("value")).dropDuplicates(["item_id"])
    rows.repartition("item_id").write.partitionBy("item_id").text(path)
    return SUB.raw_documents(s, f"{path}/*/*.txt").select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "sha256", "is_pdf")


def _published(s, d):
    """A table replaced as a whole: what is read is the last version that was written to its end."""
    path = _place(s, "published")
    first = filings(s, d, "cik", "form_type").where("form_type = '10-K'").select("document_id", "form_type")
    published(first, path)
    return published(filings(s, d, "cik", "form_type").select("document_id", "form_type"), path).groupBy("form_type").agg(F.count("*").alias("filings"))


QUERIES = {
    "src2_tickers": _tickers,
    "src3_listings": lambda s, d: _listings(s, d).select("cik", F.size("filings.recent.form").alias("filings")),
    "src4_recent_filings": lambda s, d: SUB.recent_filings(_listings(s, d), ["10-K", "10-Q"], 3).select("cik", "pos", "accession", "form_type", "filed_at"),
    "src5_filing_by_accession": lambda s, d: SUB.recent_filings(_listings(s, d)).select("accession", "cik", "filed_at"),
    "src7_raw_documents": _raw,
    "snk18_published": _published,
    "sca39_said_before": _first_new,
}

_LISTED = ", l AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed_at DESC, accession DESC, form_type DESC) - 1 AS pos FROM fil)"

SQL = {
    "src2_tickers": "SELECT upper(ticker) AS ticker, cik, name AS title FROM companies WHERE ticker IS NOT NULL",
    "src3_listings": sql("SELECT cik, CAST(count(*) AS INT) AS filings FROM fil GROUP BY 1", "fil"),
    "src4_recent_filings": sql(_LISTED + " SELECT cik, CAST(pos AS INT) AS pos, accession, form_type, filed_at FROM l WHERE form_type IN ('10-K', '10-Q') QUALIFY row_number() OVER (PARTITION BY cik ORDER BY pos) <= 3", "fil"),
    "src5_filing_by_accession": sql("SELECT accession, cik, filed_at FROM fil", "fil"),
    "src7_raw_documents": r"SELECT item_id, sha256(regexp_replace(any_value(passage), '\s+', ' ', 'g') || chr(10)) AS sha256, false AS is_pdf FROM eval_passages WHERE item_id IS NOT NULL AND length(passage) > 0 GROUP BY 1",
    "snk18_published": sql("SELECT form_type, count(*) AS filings FROM fil GROUP BY 1", "fil"),
    "sca39_said_before": sql(_OVER + " SELECT mention_id, runs, found, share >= 0.5 AS carried FROM ov", "men", "par"),
}
