"""Text, identity and label functions: columns to columns, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Honorifics and suffixes that are no part of a person's name.
HONORIFICS = "mr|mrs|ms|dr|prof"
SUFFIXES = "jr|sr|ii|iii|iv|phd|md"
#: Labels that are one metric.
METRIC_ALIASES = {
    "capex": "capital expenditures",
    "capital expenditure": "capital expenditures",
    "r d expense": "research and development expense",
    "rd expense": "research and development expense",
    "revenues": "revenue",
    "net revenue": "revenue",
    "total revenue": "revenue",
}
#: Tokens and pairs of tokens written out before a key is made.
EXPANSIONS = {
    "ai": "artificial intelligence",
    "a i": "artificial intelligence",
    "ml": "machine learning",
    "r d": "research and development",
    "capex": "capital expenditure",
    "opex": "operating expenditure",
    "ip": "intellectual property",
    "us": "united states",
    "u s": "united states",
    "usg": "united states government",
    "ev": "electric vehicle",
    "iot": "internet of things",
}
#: Words that may stand before a name.
ARTICLES = ("the", "a", "an", "our", "its", "their")
#: Whole labels that are one entity.
ENTITY_ALIASES = {
    "artificial intelligence infrastructure": "ai_infrastructure",
    "artificial intelligence infra": "ai_infrastructure",
    "data center infrastructure": "ai_infrastructure",
    "data centre infrastructure": "ai_infrastructure",
    "accelerated computing": "ai_infrastructure",
    "export control": "export_controls",
    "export restrictions": "export_controls",
    "china export restrictions": "export_controls",
    "capital expenditure": "capex",
    "share repurchase": "buybacks",
    "share repurchases": "buybacks",
    "stock repurchase program": "buybacks",
}
#: How some keys are shown.
KEY_LABELS = {
    "ai_infrastructure": "AI Infrastructure",
    "export_controls": "Export Controls",
    "capex": "Capital Expenditure",
    "buybacks": "Share Buybacks",
    "rd": "Research and Development",
}


def looked_up(table: dict[str, str], c: Column, otherwise: Column) -> Column:
    """`c` by a small fixed table, `otherwise` where it has no entry."""
    first, *rest = table.items()
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), rest, F.when(c == first[0], first[1])).otherwise(otherwise)


def collapsed(c: Column) -> Column:
    """Runs of white space (no-break spaces too) as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalised(c: Column) -> Column:
    """Collapsed and lower-cased: the form in which texts are compared and hashed."""
    return F.lower(collapsed(c))


def words_only(c: Column) -> Column:
    """Lower-cased words of ASCII letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def content_id(prefix: str, accession: Column, text: Column, salt: Column | None = None) -> Column:
    """A short content id within a filing; `salt` tells equal texts apart."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x00", accession, F.lit("") if salt is None else salt, normalised(text)), 256), 1, 12))


def chunk_hash(company: Column, accession: Column, page: Column, text: Column) -> Column:
    """Identity of a chunk: the same text on another page is another chunk; a null page is the empty page."""
    return F.sha2(F.concat_ws("\x00", company, accession, F.coalesce(page.cast("string"), F.lit("")), normalised(text)), 256)


def positional_id(page: Column, index: Column) -> Column:
    return F.concat_ws("_", F.coalesce(page, F.lit(0)).cast("string"), index.cast("string"))


def fiscal_label(form: Column, reported: Column) -> Column:
    """Annual reports by year, quarterly ones by quarter and year, others by year."""
    year, month = F.year(reported).cast("string"), F.month(reported)
    quarter = F.concat(F.lit("Q"), (F.floor((month - 1) / 3) + 1).cast("string"), F.lit(" "), year)
    return F.when(form.startswith("10-K"), F.concat(F.lit("FY"), year)).when(form.startswith("10-Q"), quarter).otherwise(year)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def base_paragraph(c: Column) -> Column:
    """A paragraph's id without the number of its part."""
    return F.split_part(c, F.lit("#"), F.lit(1))


def paragraph_page(c: Column, fallback: Column) -> Column:
    """The page in a paragraph's id; the fallback where the id has none above 0."""
    page = F.split_part(base_paragraph(c), F.lit("_"), F.lit(1)).try_cast("int")
    return F.when(page > 0, page).otherwise(fallback)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def person(c: Column) -> Column:
    """One form of a person's name: without honorific and suffix, first name first, lower case."""
    bare = F.regexp_replace(F.trim(c), rf"(?i)^({HONORIFICS})\.?\s+", "")
    bare = F.regexp_replace(bare, rf"(?i)[,\s]+({SUFFIXES})\.?$", "")
    flipped = F.concat_ws(" ", F.trim(F.regexp_extract(bare, r"^[^,]*,(.*)$", 1)), F.trim(F.split_part(bare, F.lit(","), F.lit(1))))
    return words_only(F.when(F.contains(bare, F.lit(",")), flipped).otherwise(bare))


def metric(c: Column) -> Column:
    plain = words_only(c)
    return looked_up(METRIC_ALIASES, plain, plain)


def entity_key(c: Column) -> Column:
    """A stable key of a label: abbreviations written out, articles dropped, aliases folded, words joined by underscores.

    Pairs of tokens are written out before single ones; tokens are padded on both sides, so that neighbours are
    replaced independently.
    """
    padded = F.concat(F.lit(" "), F.regexp_replace(words_only(c), " ", "  "), F.lit(" "))
    for short, long in sorted(EXPANSIONS.items(), key=lambda kv: -kv[0].count(" ")):
        padded = F.replace(padded, F.lit(" " + short.replace(" ", "  ") + " "), F.lit(" \x01" + long.replace(" ", "\x01") + "\x01 "))
    padded = F.regexp_replace(padded, r" (" + "|".join(ARTICLES) + r") ", " ")
    phrase = F.trim(F.regexp_replace(F.translate(padded, "\x01", " "), " +", " "))
    key = F.replace(F.replace(F.replace(phrase, F.lit(" "), F.lit("_")), F.lit("artificial_intelligence"), F.lit("ai")), F.lit("research_and_development"), F.lit("rd"))
    return looked_up(ENTITY_ALIASES, phrase, F.when(key == "", "unknown").otherwise(key))


def display_label(key: Column, fallback: Column) -> Column:
    return looked_up(KEY_LABELS, key, collapsed(fallback))


def folded(c: Column) -> Column:
    """Quotes, dashes and no-break spaces in their plain form, lower case, single spaces: how quotes are looked for."""
    return normalised(F.translate(c, "‘’“”–— ", "''\"\"-- "))


def said(c: Column) -> Column:
    """The words of a text in order (letters, digits and underscores of any script), lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def shingles(words: Column, width: int = 4) -> Column:
    """Distinct runs of `width` words; all words where there are no more than that, none of no words."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def has_name(text: Column, name: Column) -> Column:
    """Whether a name's words stand in a text, adjacent and whole."""
    inside = F.concat(F.lit(" "), F.array_join(said(text), " "), F.lit(" "))
    looked = F.array_join(said(name), " ")
    return (F.length(looked) > 0) & (F.instr(inside, F.concat(F.lit(" "), looked, F.lit(" "))) > 0)


def quote_located(quote: Column, paragraph: Column) -> Column:
    """Whether a quote stands in a paragraph, exactly or folded."""
    exact = F.instr(paragraph, quote) > 0
    return F.when((F.length(F.trim(quote)) > 0), exact | (F.instr(folded(paragraph), folded(quote)) > 0)).otherwise(False)


def direction(before: Column, after: Column) -> Column:
    """How a money text moved: rose, fell, held, or changed where one is no number."""
    number = lambda c: F.regexp_replace(F.regexp_replace(c, ",", ""), r"^\$+", "").try_cast("double")
    b, a = number(before), number(after)
    return F.when(a.isNull() | b.isNull(), "changed").when(a > b, "rose").when(a < b, "fell").otherwise("held")


def reading_order(paragraph_id: Column, page: Column, tie: Column) -> Column:
    """Where a cited paragraph stands in its filing: positional ids by page, index and part, others after them."""
    positional = paragraph_id.rlike(r"^\d+_\d+(#\d+)?$")
    part = lambda n: F.regexp_extract(paragraph_id, r"^(\d+)_(\d+)(?:#(\d+))?$", n)
    return F.struct(
        F.when(positional, 0).otherwise(1), F.when(positional, part(1).try_cast("int")).otherwise(F.coalesce(page, F.lit(0))),
        F.when(positional, part(2).try_cast("int")).otherwise(0), F.when(positional, F.coalesce(part(3).try_cast("int"), F.lit(0))).otherwise(0), F.coalesce(tie, F.lit(0)),
    )
