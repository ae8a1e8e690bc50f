"""Streaming queries, each run to the end of what is there."""

from __future__ import annotations

import uuid

from tallyfold.plans.model import latest, sql
from tallyfold.storage import shared_folder
from tallyfold.streaming import ledger


def _daily(s, d):
    name = f"daily_{uuid.uuid4().hex}"
    columns = ("created_at", "provider", "estimated_cost_usd", "status")
    rows = ledger.arrived(ledger.attempts(s, d).select("usage_id", "received_at", *columns), shared_folder(s), name)
    return ledger.by_day(latest(rows, "usage_id", "received_at", columns=columns))


QUERIES = {"ext_streamed_days": _daily}

SQL = {
    "ext_streamed_days": sql("SELECT CAST(created_at AS DATE) AS day, provider, CAST(sum(estimated_cost_usd) AS DECIMAL(38, 6)) AS cost, count(*) AS attempts, count(*) FILTER (status = 'failed') AS failed FROM usage1 GROUP BY 1, 2", "usage1"),
}
