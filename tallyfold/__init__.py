"""Filing-memory analytics on Spark: declarative DataFrame operators over filings, paragraphs, facts and usage ledgers."""
