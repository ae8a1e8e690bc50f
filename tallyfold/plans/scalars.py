"""Scalar functions over the tables: identity, text, labels, dates, money.  Each query shows one function on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.plans import model

C = F.col


def _case(table: dict[str, str], c: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


_NORM = r"lower(trim(regexp_replace({c}, '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', ' ', 'g')))"
_WORDS = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_SLUG = "regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SAID = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
_FOLD = _NORM.replace("{c}", "translate({c}, '‘’“”–—' || chr(160), '''''\"\"-- ')")


def _key_sql(c: str) -> str:
    padded = f"(' ' || replace({_WORDS.format(c=c)}, ' ', '  ') || ' ')"
    for short, long in sorted(T.EXPANSIONS.items(), key=lambda kv: -kv[0].count(" ")):
        padded = f"replace({padded}, ' {short.replace(' ', '  ')} ', ' ' || chr(1) || '{long}' || chr(1) || ' ')".replace(f"'{long}'", "replace('" + long + "', ' ', chr(1))")
    padded = f"regexp_replace({padded}, ' ({'|'.join(T.ARTICLES)}) ', ' ', 'g')"
    return f"trim(regexp_replace(replace({padded}, chr(1), ' '), ' +', ' ', 'g'))"


def _page(c: str) -> str:
    return f"TRY_CAST(split_part(split_part({c}, '#', 1), '_', 1) AS INT)"


#: name: (view, key columns, column, the same in SQL)
_SPEC: dict[str, tuple[str, tuple[str, ...], Callable[[], Column], str]] = {}


def _add(name: str, view: str, keys: tuple[str, ...], column: Callable[[], Column], sql: str) -> None:
    _SPEC[name] = (view, keys, column, sql)


def _fill() -> None:
    par, ext, fil, org = ("block_id",), ("extracted_id",), ("document_id",), ("organization_id",)
    _add("sca1_normalised", "par", par, lambda: T.normalised(C("text")), _NORM.format(c="text"))
    _add("sca2_content_id", "par", par, lambda: T.content_id("blk", C("accession"), C("text")), f"'blk_' || substr(sha256(accession || chr(0) || '' || chr(0) || {_NORM.format(c='text')}), 1, 12)")
    _add("sca3_chunk_hash", "par", par, lambda: T.chunk_hash(C("document_id").cast("string"), C("accession"), C("page_number"), C("text")), f"sha256(document_id::VARCHAR || chr(0) || accession || chr(0) || coalesce(page_number::VARCHAR, '') || chr(0) || {_NORM.format(c='text')})")
    _add("sca4_positional_id", "par", par, lambda: T.positional_id(C("page_number"), C("ordinal")), "coalesce(page_number, 0)::VARCHAR || '_' || ordinal::VARCHAR")
    _add("sca5_fiscal_label", "fil", fil, lambda: T.fiscal_label(C("form_type"), C("filed_at")), "CASE WHEN form_type LIKE '10-K%' THEN 'FY' || year(filed_at)::VARCHAR WHEN form_type LIKE '10-Q%' THEN 'Q' || ((month(filed_at) - 1) // 3 + 1)::VARCHAR || ' ' || year(filed_at)::VARCHAR ELSE year(filed_at)::VARCHAR END")
    _add("sca6_token_estimate", "par", par, lambda: T.token_estimate(C("text")), "CAST(greatest(1, length(text) // 4) AS INT)")
    _add("sca12_paragraph_anchor", "par", par, lambda: F.concat(F.lit("p-"), C("paragraph_id")), "'p-' || paragraph_id")
    _add("sca14_paragraph_page", "par", par, lambda: T.paragraph_page(C("paragraph_id"), C("page_number")), f"CASE WHEN {_page('paragraph_id')} > 0 THEN {_page('paragraph_id')} ELSE page_number END")
    _add("sca15_base_paragraph", "ext", ext, lambda: T.base_paragraph(C("paragraph_id")), "split_part(paragraph_id, '#', 1)")
    _add("sca21_folded", "ext", ext, lambda: T.folded(C("quote")), _FOLD.format(c="quote"))
    _add("sca26_slug", "ext", ext, lambda: T.slug(C("name")), _SLUG.format(c="name"))
    flipped = r"trim(regexp_extract({b}, '^[^,]*,(.*)$', 1)) || ' ' || trim(split_part({b}, ',', 1))"
    bare = rf"regexp_replace(regexp_replace(trim(name), '^({T.HONORIFICS})\.?\s+', '', 'i'), '[,\s]+({T.SUFFIXES})\.?$', '', 'i')"
    _add("sca27_person", "ext", ext, lambda: T.person(C("name")), _WORDS.format(c=f"(CASE WHEN contains({bare}, ',') THEN {flipped.format(b=bare)} ELSE {bare} END)"))
    _add("sca28_metric", "ext", ext, lambda: T.metric(C("name")), _case(T.METRIC_ALIASES, _WORDS.format(c="name"), _WORDS.format(c="name")))
    phrase = _key_sql("name")
    key = f"replace(replace(replace({phrase}, ' ', '_'), 'artificial_intelligence', 'ai'), 'research_and_development', 'rd')"
    full = _case(T.ENTITY_ALIASES, phrase, f"CASE WHEN {key} = '' THEN 'unknown' ELSE {key} END")
    _add("sca30_entity_key", "ext", ext, lambda: T.entity_key(C("name")), full)
    _add("sca31_display_label", "ext", ext, lambda: T.display_label(T.entity_key(C("name")), C("name")), _case(T.KEY_LABELS, f"({full})", r"trim(regexp_replace(name, '[\s\x{a0}]+', ' ', 'g'))"))
    _add("sca32_collapsed", "ext", ext, lambda: T.collapsed(C("quote")), _NORM.format(c="quote").replace("lower(", "(", 1))
    said = _SAID.format(c="quote")
    _add("sca35_shingles", "ext", ext, lambda: F.array_join(F.sort_array(T.shingles(T.said(C("quote")))), "|"), f"array_to_string(list_sort(CASE WHEN len({said}) = 0 THEN [] ELSE list_distinct([array_to_string(list_slice({said}, i, i + 3), ' ') FOR i IN range(1, greatest(len({said}) - 2, 2))]) END), '|')")
    _add("sca37_words", "par", par, lambda: F.size(T.said(C("text"))), f"CAST(len({_SAID.format(c='text')}) AS INT)")
    _add("sca44_label", "fil", fil, lambda: F.concat_ws(" ", "fiscal_period", "form_type"), "concat_ws(' ', fiscal_period, form_type)")
    _add("sca45_amended", "fil", fil, lambda: C("form_type").endswith("/A"), "form_type LIKE '%/A'")
    _add("sca51_page_citation", "par", par, lambda: F.when(F.coalesce(C("page_number"), F.lit(0)) == 0, "—").otherwise(F.concat(F.lit("p. "), C("page_number").cast("string"))), "CASE WHEN coalesce(page_number, 0) = 0 THEN '—' ELSE 'p. ' || page_number::VARCHAR END")
    bare_acc = "replace(accession, '-', '')"
    _add("sca53_filing_folder", "fil", fil, lambda: F.concat(F.lit("data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), C("accession"), F.lit("-index.htm")), f"'data/' || regexp_replace(cik, '^0+', '') || '/' || {bare_acc} || '/' || accession || '-index.htm'")
    _add("sca54_accession_dashed", "fil", fil, lambda: F.concat_ws("-", F.substring(F.replace("accession", F.lit("-"), F.lit("")), 1, 10), F.substring(F.replace("accession", F.lit("-"), F.lit("")), 11, 2), F.substring(F.replace("accession", F.lit("-"), F.lit("")), 13, 20)), f"substr({bare_acc}, 1, 10) || '-' || substr({bare_acc}, 11, 2) || '-' || substr({bare_acc}, 13)")
    _add("sca57_version", "fil", fil, lambda: F.coalesce(F.unix_seconds(C("ingested_at").cast("timestamp")).cast("string"), F.lit("0")), "coalesce(CAST(epoch(ingested_at) AS BIGINT)::VARCHAR, '0')")
    _add("sca65_money", "ext", ext, lambda: F.when(C("value").isNotNull(), F.format_number(C("value").cast("decimal(30,0)"), 0)), "CASE WHEN value IS NOT NULL THEN format('{:,}', CAST(CAST(value AS DECIMAL(30, 0)) AS HUGEINT)) END")
    _add("sca67_key_hash", "org", org, lambda: F.sha2("slug", 256), "sha256(slug)")
    _add("sca68_key_prefix", "org", org, lambda: F.substring("organization_id", 1, 12), "substr(organization_id, 1, 12)")
    _add("sca70_tokens_up", "par", par, lambda: F.ceil(F.length(C("text")) / 4).cast("bigint"), "CAST(ceil(length(text) / 4) AS BIGINT)")
    _add("sca78_month_start", "use", ("usage_id",), lambda: F.date_trunc("month", C("created_at").cast("timestamp")).cast("date"), "CAST(date_trunc('month', created_at) AS DATE)")
    _add("sca84_clean_path", "fil", fil, lambda: F.regexp_replace("source_path", "[^A-Za-z0-9._/-]+", "_"), "regexp_replace(source_path, '[^A-Za-z0-9._/-]+', '_', 'g')")
    _add("sca88_percent", "ext", ext, lambda: F.when(C("confidence").isNotNull(), F.format_string("%.1f%%", F.round(C("confidence") * 100, 1))), "printf('%.1f%%', round(confidence * 100, 1))")
    _add("msc5_char_count", "par", par, lambda: F.length(C("text")), "CAST(length(text) AS INT)")
    _add("src6_accepted_at", "fil", fil, lambda: F.coalesce("published_at", F.col("filed_at").cast("timestamp_ntz")), "coalesce(published_at, CAST(filed_at AS TIMESTAMP))")
    _add("src8_is_pdf", "fil", fil, lambda: F.lower("source_path").endswith(".pdf") | (C("source_format") == "pdf"), "lower(source_path) LIKE '%.pdf' OR source_format = 'pdf'")
    _add("src18_looks_like_heading", "par", par, lambda: (F.size(F.split(F.trim(C("text")), r"\s+")) < 12) & ~F.rtrim(C("text")).rlike(r"[.?!]$"), r"len(regexp_split_to_array(trim(text), '\s+')) < 12 AND NOT regexp_matches(rtrim(text), '[.?!]$')")
    _add("prj2_heading_level", "par", par, lambda: F.when(F.length("text") > 120, None).when(C("text").rlike(r"(?i)^part [ivx]+\b"), 1).when(C("text").rlike(r"(?i)^item \d+[a-z]?"), 2), r"CASE WHEN length(text) > 120 THEN NULL WHEN regexp_matches(text, '(?i)^part [ivx]+\b') THEN 1 WHEN regexp_matches(text, '(?i)^item \d+[a-z]?') THEN 2 END")
    _add("sca89_parse_cite", "ext", ext, lambda: F.regexp_extract(F.concat_ws(":", C("document_id").cast("string"), "paragraph_id"), r"^(\d+)(?::(.+))?$", 2), r"regexp_extract(concat_ws(':', document_id::VARCHAR, paragraph_id), '^(\d+)(?::(.+))?$', 2)")
    _add("sca90_cite_param", "ext", ext, lambda: F.concat_ws(":", C("document_id").cast("string"), "paragraph_id"), "concat_ws(':', document_id::VARCHAR, paragraph_id)")
    _add("prd4_expanded", "use", ("usage_id",), lambda: (C("input_tokens") > 0) & (C("output_tokens") - C("input_tokens") >= 3) & (C("output_tokens") >= 1.25 * C("input_tokens")), "input_tokens > 0 AND output_tokens - input_tokens >= 3 AND output_tokens >= 1.25 * input_tokens")
    _add("prd6_comparable", "fil", fil, lambda: C("form_type").isin(*model_forms()) & ~C("form_type").endswith("/A"), "form_type IN ('10-K', '10-Q', '20-F', '40-F') AND form_type NOT LIKE '%/A'")


def model_forms() -> tuple[str, ...]:
    """Forms that are compared filing to filing."""
    return ("10-K", "10-Q", "20-F", "40-F")


_fill()

#: By view: the table, its key and the column that orders deliveries.
_READ = {"par": ("blocks", "ingested_at"), "ext": ("extracted", "created_at"), "fil": ("filings", "ingested_at"), "use": ("ai_usage_logs", "received_at"), "org": ("organizations", "created_at")}


def _query(view: str, keys: tuple[str, ...], column: Callable[[], Column]):
    """The function on every delivery, then the last one's result: only the columns that the function reads are scanned and sent."""
    name, order = _READ[view]
    return lambda spark, d: model.latest(model.table(spark, d, name).select(*keys, F.col(order).alias("delivered"), column().alias("result")), keys[0], "delivered", columns=("result",))


QUERIES = {name: _query(view, keys, column) for name, (view, keys, column, _) in _SPEC.items()}
SQL = {
    name: model.sql(f"SELECT {', '.join(keys)}, {sql} AS result FROM {'organizations' if view == 'org' else {'use': 'usage1'}.get(view, view)}", *([] if view == "org" else [{"use": "usage1"}.get(view, view)]))
    for name, (view, keys, _, sql) in _SPEC.items()
}
