"""Queries of the general problems: units told apart (p1) and snapshots compared (p5)."""

from __future__ import annotations

from tallyfold.operators import snapshots, units
from tallyfold.sources.tables import table

QUERIES = {
    "p1_found": lambda spark, d: units.found(table(spark, d, "extracted"), table(spark, d, "filings")),
    "p5_found": lambda spark, d: snapshots.found(table(spark, d, "card_revisions")),
}

SQL = {
    "p5_found": r"""
WITH fine AS (
  SELECT * FROM (
    SELECT card_id, document_id, as_of, facts, row_number() OVER (PARTITION BY card_id, document_id ORDER BY created_at DESC, revision DESC, revision_id DESC) AS rn
    FROM card_revisions WHERE facts IS NOT NULL AND json_valid(facts)
  ) WHERE rn = 1 AND json_type(facts) = 'ARRAY'
), seq AS (
  SELECT *, lag(document_id) OVER (PARTITION BY card_id ORDER BY as_of, document_id) AS before FROM fine
), items AS (
  SELECT card_id, document_id, unnest(from_json(facts, '["JSON"]')) AS f FROM fine
), facts AS (
  SELECT DISTINCT card_id, document_id, f->>'$.key' AS fact_key, f->>'$.status' AS status,
    coalesce('n' || TRY_CAST(CASE WHEN regexp_full_match(f->>'$.value', '[-+]?[0-9,]+(\.[0-9]*)?') THEN replace(f->>'$.value', ',', '') END AS DECIMAL(38, 12))::VARCHAR, 't' || trim(f->>'$.value')) AS value
  FROM items
), pairs AS (
  SELECT s.card_id, s.document_id, a.fact_key AS later_key, b.fact_key AS earlier_key,
    b.fact_key IS NULL OR a.value IS DISTINCT FROM b.value OR a.status IS DISTINCT FROM b.status AS differs
  FROM seq s JOIN facts a ON a.card_id = s.card_id AND a.document_id = s.document_id
  LEFT JOIN facts b ON b.card_id = s.card_id AND b.document_id = s.before AND b.fact_key = a.fact_key
  UNION ALL
  SELECT s.card_id, s.document_id, NULL, b.fact_key, true
  FROM seq s JOIN facts b ON b.card_id = s.card_id AND b.document_id = s.before
  WHERE NOT EXISTS (SELECT 1 FROM facts a WHERE a.card_id = s.card_id AND a.document_id = s.document_id AND a.fact_key = b.fact_key)
)
SELECT DISTINCT card_id, document_id, coalesce(later_key, earlier_key) AS fact_key,
  CASE WHEN earlier_key IS NULL THEN 'added' WHEN later_key IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM pairs JOIN seq USING (card_id, document_id) WHERE differs AND before IS NOT NULL
""",
}
