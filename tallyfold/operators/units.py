"""Quantities recorded in different units, brought to one common unit per kind of quantity.

One figure stands in many places: as the recorded ``value`` of a row under a unit spelling, as the number written in the
row's verbatim quote under a unit phrase, and again, for the same company, metric and period, in other filings.  Each
recorded spelling and each written phrase is a *source*.  Sources that hold one entity's figure are linked; from the
links of a pair a robust scale (median log ratio) and a robust offset (from quartiles) are estimated.  Known units, the
*anchors*, are phrases made of a unit's full name or sign and scale words only.  From them kinds and sizes are propagated
along the links, each estimate being snapped to a known conversion of the kind, so that every abbreviation and house
style (``mwh``, ``teur``, ``mm usd``, ``wks``) gets the unit its figures imply.

A spelling whose links disagree on the size (``USD`` beside "USD 12 million" and "USD 12,000") leaves the scale open; for
it, and for rows without a unit, the row's own text decides, its phrases sized by the same graph.

Defined results: rows that are not of the metric type, have no value (null, NaN, infinite) or no unit that can be told
give no row; a spelling that no anchor names and fewer than `support` links in agreement size counts as untold; a null or
empty text is a text without figures; rows delivered twice give equal rows, which a caller makes distinct; an empty table
gives an empty result; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.storage import written

#: Known conversions to the common unit of a kind: common = (value + shift) * num / den.
CONVERSIONS: tuple[tuple[str, str, str, str], ...] = (
    ("bp", "1", "1", "0"),
    ("bp", "100", "1", "0"),
    ("bp", "10000", "1", "0"),
    ("kwh", "1", "1", "0"),
    ("kwh", "1000", "1", "0"),
    ("kwh", "1000000", "1", "0"),
    ("kwh", "1000000000", "1", "0"),
    ("kwh", "1", "3.6", "0"),
    ("kwh", "1000", "3.6", "0"),
    ("kwh", "1000000", "3.6", "0"),
    ("m2", "0.09290304", "1", "0"),
    ("m2", "1", "1", "0"),
    ("m2", "1000000", "1", "0"),
    ("m2", "10000", "1", "0"),
    ("m2", "4046.8564224", "1", "0"),
    ("kg", "1000000", "1", "0"),
    ("kg", "907.18474", "1", "0"),
    ("kg", "1000", "1", "0"),
    ("kg", "0.45359237", "1", "0"),
    ("kg", "1", "1", "0"),
    ("hour", "1", "1", "0"),
    ("hour", "24", "1", "0"),
    ("hour", "168", "1", "0"),
    ("hour", "1", "60", "0"),
    ("hour", "1", "3600", "0"),
    ("celsius", "1", "1", "0"),
    ("celsius", "1", "1", "-273.15"),
    ("celsius", "5", "9", "-32"),
    ("USD", "1", "1", "0"),
    ("EUR", "1", "1", "0"),
    ("GBP", "1", "1", "0"),
    ("JPY", "1", "1", "0"),
    ("count", "1", "1", "0"),
)
#: The anchors: kind, pattern of a unit's full names and signs (after `plain`), and its conversion.
UNITS: tuple[tuple[str, str, str, str, str], ...] = (
    ("bp", r"basis points?", "1", "1", "0"),
    ("bp", r"percent|percentage points?", "100", "1", "0"),
    ("bp", r"(a )?ratio", "10000", "1", "0"),
    ("none", r"index points?|points?|scores?|stars?", "1", "1", "0"),
    ("kwh", r"kwh|kilowatt[ -]hours?", "1", "1", "0"),
    ("kwh", r"megawatt[ -]hours?", "1000", "1", "0"),
    ("kwh", r"gigawatt[ -]hours?", "1000000", "1", "0"),
    ("kwh", r"gigajoules?", "1000", "3.6", "0"),
    ("m2", r"square feet|square foot", "0.09290304", "1", "0"),
    ("m2", r"m2|square met(er|re)s?", "1", "1", "0"),
    ("m2", r"acres?", "4046.8564224", "1", "0"),
    ("kg", r"(us )?short tons?", "907.18474", "1", "0"),
    ("kg", r"tonnes?|metric tons?", "1000", "1", "0"),
    ("kg", r"pounds?(?! sterling)", "0.45359237", "1", "0"),
    ("kg", r"kg|kilograms?", "1", "1", "0"),
    ("hour", r"hours?", "1", "1", "0"),
    ("hour", r"days?", "24", "1", "0"),
    ("hour", r"weeks?", "168", "1", "0"),
    ("celsius", r"degrees celsius", "1", "1", "0"),
    ("USD", r"usd|us ?\$|\$|(us )?dollars?", "1", "1", "0"),
    ("EUR", r"eur|€|euros?", "1", "1", "0"),
    ("GBP", r"gbp|£|pounds? sterling|sterling", "1", "1", "0"),
    ("JPY", r"jpy|¥|yen", "1", "1", "0"),
    ("count", r"people|persons?|employees|units?|items?|pieces?", "1", "1", "0"),
)
#: Scale words.
SCALES: tuple[tuple[str, str], ...] = (("1000", r"thousands?"), ("1000000", r"millions?"), ("1000000000", r"billions?"), ("12", r"dozens?"))
#: Words around a unit that name none.
FILLERS = r"in|of|a|the|figures|reported|as|presented|calendar|from|summary|table"
#: Kinds with units that differ in their zero.
BENT = tuple(sorted({kind for kind, _, _, shift in CONVERSIONS if shift != "0"}))
#: Kinds whose bare unit leaves the scale open to the prose.
OPEN = ("USD", "EUR", "GBP", "JPY", "count")
PLACEHOLDERS = ("", "n/a", "na", "see text", "unknown", "none", "null", "-", "tbd", "?")

_SIGN = r"(?:us\$|[$€£¥]|usd|eur|gbp|jpy)"
_END, _START = r"(?![\p{L}\p{N}])", r"(?<![\p{L}\p{N}])"
_SCALE_WORD = r"thousand|million|billion|mn|bn|mm|mio\.?|mrd\.?|dozen"
_UNIT_WORDS = (
    r"basis points?|percent|per cent|%|pct|index points?|points?|U\.S\. dollars?|US dollars?|dollars?|euros?|yen|pounds sterling|"
    r"USD|EUR|GBP|JPY|(?:kilo|mega|giga|tera)watt[ -]hours?|[kMGT]Wh|gigajoules?|GJ|megajoules?|MJ|square feet|square met(?:er|re)s?|"
    r"sq\.? ?ft\.?|sqft|ft2|sqm|sq m|m2|m²|hectares?|ha|acres?|kilotonnes?|kt|(?:US )?short tons?|metric tons?|metric tonnes?|tonnes?|t|"
    r"lbs?|pounds?|kilogram(?:me)?s?|kg|hours?|hrs?|h|calendar days?|days?|weeks?|wks?|minutes?|min|seconds?|people|persons?|employees|"
    r"units?|items?|each|pieces|(?:degrees |°)(?:Celsius|Fahrenheit|C|F)"
)
#: A number with its written unit; numbers that name a year, a quarter or a note are none.
FIGURE = (
    r"(?i)(?:a ratio of )?(?:US\$|[$€£¥]|(?:USD|EUR|GBP|JPY) )?\s?(?<![\p{L}\p{N}.,])(?<!fiscal |the year |fiscal year |FY|Note )"
    r"\d[\d,]*(?:\.\d+)?(?: ?(?:" + _SCALE_WORD + r")(?:s of)?(?![\p{L}\p{N}]))?(?: ?(?:" + _UNIT_WORDS + r")(?![\p{L}\p{N}]))?"
    r"(?:(?: per |/| a )(?!cent)\p{L}+)?"
)
_NUMBER = r"((?<![\p{L}\p{N}.,])\d[\d,]*(?:\.\d+)?)"


def plain(c: Column) -> Column:
    """A unit's spelling in lower case with single spaces and without full stops; null for a placeholder."""
    s = F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[.]", "")), r"[\s ]+", " "))
    return F.when(~s.isin(*PLACEHOLDERS), s)


def _table(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """A constant array of structs, as one expression."""
    text = lambda v: f"{v!r}D" if isinstance(v, float) else f"r'{v}'"  # noqa: E731 (no value holds a quote)
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {text(v)}" for v, n in zip(r, names, strict=True)) + ")" for r in rows) + ")")


def dictionary(phrases: DataFrame, units: tuple[tuple[str, str, str, str, str], ...] = UNITS) -> DataFrame:
    """What each distinct plain phrase (`node`) says by itself: a unit, a scale, both, or neither.

    Adds `kind` (null unless named), `num`, `den`, `shift` (the conversion without scale), `scale` (null unless named),
    `whole` (nothing but unit, scale and fillers: the phrase is an anchor) and `excluded` (a figure per something, a score).
    """
    s = F.col("node")
    # a sign needs no edge, a word does
    bound = lambda p: "|".join(x if not x[-1].isalnum() and x[-1] not in "?)" else rf"{_START}(?:{x}){_END}" for x in _alternatives(p))
    known = _table([(k, bound(p), n, d, o) for k, p, n, d, o in units], ("kind", "pattern", "num", "den", "shift"))
    scales = _table([(size, bound(w)) for size, w in SCALES], ("size", "pattern"))
    first = phrases.withColumn("unit", F.get(F.filter(known, lambda z: F.rlike(s, z["pattern"])), 0)).withColumn("sc", F.get(F.filter(scales, lambda z: F.rlike(s, z["pattern"])), 0))
    words = "|".join(w for _, w in SCALES)
    rest = F.regexp_replace(F.regexp_replace(s, F.coalesce(F.col("unit.pattern"), F.lit("$^")), " "), rf"{_START}(?:{words}|{FILLERS}){_END}|[\s(),;-]+", "")
    # of a phrase with other words too, only a currency or a count is believed: "terawatt-hours" are no hours
    said = (rest == "") | F.col("unit.kind").isin(*OPEN)
    return first.select(
        "node", F.when(said, F.col("unit.kind")).alias("kind"), "unit.num", "unit.den", "unit.shift", F.col("sc.size").alias("scale"), (rest == "").alias("whole"),
        (s.rlike(r"per (?!cent)\p{L}|/ ?\p{L}{2}") | F.coalesce(said & (F.col("unit.kind") == "none"), F.lit(False))).alias("excluded"),
    )


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
    return [*out, pattern[start:]]


def _decimal(c: Column) -> Column:
    return c.cast("decimal(20,8)")


def figures(quote: Column) -> Column:
    """The numbers of a text with their written units: array of (number, phrase)."""
    return F.transform(
        F.regexp_extract_all(F.coalesce(quote, F.lit("")), F.lit(FIGURE), F.lit(0)),
        lambda m: F.struct(
            F.regexp_replace(F.regexp_extract(m, _NUMBER, 1), ",", "").try_cast("double").alias("x"),
            F.coalesce(plain(F.trim(F.regexp_replace(m, _NUMBER, " "))), F.lit("")).alias("w"),
        ),
    )


def _nearest(figs: Column, value: Column) -> Column:
    """The written figure of the row: equal to the value if there is one, else the nearest by ratio to a known scale."""
    known = [0.0, 3.0, 6.0, 9.0, 1.0791812460476248]  # log10 of 1, thousand, million, billion, dozen

    def off(f: Column) -> Column:
        ratio = F.log10(F.abs(value) / f["x"])
        return F.least(*[F.abs(F.abs(ratio) - k) + (0.001 if k else 0.0) for k in known])

    ranked = F.transform(
        F.filter(figs, lambda f: (f["x"] > 0)),
        lambda f: F.struct(F.coalesce(off(f), F.lit(99.0)).alias("off"), F.when(f["w"] == "", 1).otherwise(0).alias("bare"), f["x"].alias("x"), f["w"].alias("w")),
    )
    return F.array_min(ranked)


def _hint(c: str, pattern: str) -> Column:
    return plain(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), pattern, 1))


def _period(quote: Column, period: Column) -> Column:
    """Year and quarter that a row tells, from its quote or else its period; null without a year."""
    q, p = F.lower(F.coalesce(quote, F.lit(""))), F.lower(F.coalesce(period, F.lit("")))
    year = lambda c: F.nullif(F.regexp_extract(c, r"(?:fiscal(?: year)?|the year) 20(\d\d)", 1), F.lit(""))
    short = F.nullif(F.regexp_extract(p, r"(?:fy|fiscal|year|q[1-4]|[1-4]q|ended \p{L}+)[\s-]*(?:fy|year)?\s*(?:20)?(\d\d)(?!\d)", 1), F.lit(""))
    quarter = F.regexp_extract(F.concat_ws(" ", q, p), r"(first|second|third|fourth) quarter", 1)
    digit = F.regexp_extract(p, r"q([1-4])|([1-4])q", 0)
    named = F.when(quarter != "", F.element_at(F.create_map(*[F.lit(x) for x in ("first", "1", "second", "2", "third", "3", "fourth", "4")]), F.nullif(quarter, F.lit("")))).otherwise(F.regexp_replace(digit, "q", ""))
    return F.concat(F.coalesce(year(q), short), F.lit("/"), F.coalesce(named, F.lit("")))


def linked(df: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """Metric rows with their figure in both sources: recorded spelling `u`, written phrase `w`, and the other fields' hints.

    `entity` names company, metric and period where `filings` (document_id, cik) tells the company; rows of one entity
    state one figure, but for restatements.
    """
    rows = df
    if filings is not None:
        companies = filings.where(F.col("document_id").isNotNull()).groupBy(F.col("document_id").alias("__d")).agg(F.min("cik").alias("__cik"))
        if companies.count() <= 500_000:  # a dozen MB; beyond, the join shuffles
            companies = F.broadcast(companies)
        rows = df.join(companies, F.col("document_id") == F.col("__d"), "left")
    company = F.col("__cik") if filings is not None else F.lit(None).cast("string")
    metric = F.lower(F.trim(F.regexp_replace("name", r"\(.*\)", "")))
    rows = rows.select(
        F.col("extracted_id").alias("id"), F.col("value").cast("double").alias("value"), plain(F.col("unit")).alias("u"), F.col("quote").alias("quote"),
        F.concat_ws(" ; ", _hint("name", r"\((.*)\)"), _hint("period", r"[;,(](.*)"), plain(F.col("description"))).alias("hint"),
        F.lower(F.trim("entity_type")).alias("kind_of_row"), F.concat(company, F.lit("/"), metric, F.lit("/"), _period(F.col("quote"), F.col("period"))).alias("entity"),
    ).where((F.col("kind_of_row") == "metric") & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs(F.col("value")) < 1e300))
    return rows.withColumn("near", _nearest(figures(F.col("quote")), F.col("value"))).select(
        "id", "value", "u", F.nullif("hint", F.lit("")).alias("h"), F.col("near.x").alias("x"), F.nullif(F.col("near.w"), F.lit("")).alias("w"), F.col("near.off").alias("off"), "entity",
        F.coalesce(F.lower("quote").rlike(r"per share|a share|/share"), F.lit(False)).alias("rated"),
    )


def edges(links: DataFrame) -> DataFrame:
    """Pairs of sources `a`, `b` with their robust scale and offset: b's figure = scale * a's figure + offset.

    Sources are `R:` recorded spellings and `W:` written phrases.  A row links its own two; across filings the sources of
    an entity, each with the median of its figures there, are linked in a chain, so that an entity with many rows gives
    as many links as it has sources.  `log_scale` is the median log ratio and `spread` its interquartile range, for pure
    scales; `slope` and `offset` are from the quartiles of both figures.  Quantiles are approximate with a bounded buffer
    (accuracy 1,000), so a pair may hold any share of the rows.
    """
    rows = links.select(F.concat(F.lit("R:"), "u").alias("r"), F.concat(F.lit("W:"), "w").alias("w"), F.col("value").alias("v"), "x", "entity")
    own = rows.where(F.col("r").isNotNull() & F.col("w").isNotNull() & (F.col("x") > 0) & (F.col("v") != 0)).select(F.col("r").alias("a"), F.col("w").alias("b"), F.col("v").alias("ya"), (F.signum("v") * F.col("x")).alias("yb"))
    stands = rows.where(F.col("entity").isNotNull()).select("entity", F.explode(F.array(F.struct(F.col("r").alias("s"), F.abs("v").alias("y")), F.struct(F.col("w").alias("s"), F.col("x").alias("y")))).alias("p")).select("entity", "p.s", "p.y")
    stands = stands.where(F.col("s").isNotNull() & (F.col("y") > 0)).groupBy("entity", "s").agg(F.percentile_approx("y", 0.5, 100).alias("y"))
    chain = Window.partitionBy("entity").orderBy("s")  # an entity's distinct sources, however many rows it has
    across = stands.select(F.lag("s").over(chain).alias("a"), F.col("s").alias("b"), F.lag("y").over(chain).alias("ya"), F.col("y").alias("yb")).where(F.col("a").isNotNull())
    pairs = own.unionByName(across).withColumn("r", F.log10(F.col("yb") / F.col("ya")))
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q_{c}")
    e = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), quartiles("r"), quartiles("ya"), quartiles("yb"))
    slope = F.try_divide(F.col("q_yb")[2] - F.col("q_yb")[0], F.col("q_ya")[2] - F.col("q_ya")[0])
    return e.select("a", "b", "n", F.col("q_r")[1].alias("log_scale"), (F.col("q_r")[2] - F.col("q_r")[0]).alias("spread"), slope.alias("slope"), (F.col("q_yb")[1] - slope * F.col("q_ya")[1]).alias("offset"))


def _conversions() -> list[tuple[str, str, str, str, str, float, float]]:
    """kind, num, den, shift, scale, and the line a * value + b they stand for; of equal lines the one of the least scale."""
    out, seen = [], set()
    for scale in ("1", *[x[0] for x in SCALES]):
        for kind, num, den, shift in CONVERSIONS:
            a = float(num) / float(den) * float(scale)
            line = (kind, round(math.log10(a), 6), float(shift))
            if line not in seen and (scale != "12" or kind == "count") and (shift == "0" or scale == "1"):
                seen.add(line)
                out.append((kind, num, den, shift, scale, a, a * float(shift)))
    return out


SIZE = ("num", "den", "shift", "scale")


def _snap(kind: Column, a: Column, b: Column) -> Column:
    """The known conversion of the kind nearest to the line a * value + b: one percent in scale, and as near in offset."""
    known = _table([(k, math.log10(a_), b_, *r) for k, *r, a_, b_ in _conversions()], ("kind", "log", "b", *SIZE))
    near = F.filter(known, lambda z: (z["kind"] == kind) & (F.abs(F.log10(a) - z["log"]) < 0.0043) & (F.abs(b - z["b"]) <= 0.02 * F.abs(z["b"]) + 0.01))
    return F.array_min(F.transform(near, lambda z: F.struct(F.abs(F.log10(a) - z["log"]).alias("off"), z["num"].alias("num"), z["den"].alias("den"), z["shift"].alias("shift"), z["scale"].alias("scale"))))


def sources(links: DataFrame, units: tuple[tuple[str, str, str, str, str], ...] = UNITS, support: int = 3, words: DataFrame | None = None) -> DataFrame:
    """The source graph, propagated: id (`R:` or `W:` and the phrase), kind (null where links agree on the size only), num, den, shift, scale.

    Anchors start it.  In each round a source next to known ones is voted on by its links: a neighbour's line and the
    pair's scale and offset give the source's line, snapped to a known conversion; a phrase that is recorded and written
    alike votes for itself, unless its scale is open.  The size with at least `support`
    links and nine tenths of the votes holds, and so does the kind.  Rounds end when no source is new, so their number is
    bounded by that of the sources.  `words` is the `dictionary` of all phrases, if there is one already.  Sources whose links disagree get no size: that marks an open scale.
    """
    e = edges(links)
    e = written(e.where((F.col("a") != F.col("b")) & F.col("log_scale").isNotNull()), "unit-edges")
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("node", F.substring("id", 3, 1 << 20))
    read = nodes.join(dictionary(nodes.select("node").distinct(), units) if words is None else words, "node")
    read = written(read, "unit-nodes")
    usable = read.where(~F.col("excluded"))
    # a recorded spelling without a scale word may be of any scale in these kinds
    bare = F.col("id").startswith("R:") & F.col("kind").isin(*OPEN) & F.col("scale").isNull()
    known = usable.where(F.col("whole") & F.col("kind").isNotNull() & ~bare).select("id", "kind", "num", "den", "shift", F.coalesce("scale", F.lit("1")).alias("scale"))
    # both directions of each pair between usable sources: the source asked about, its neighbour, and the line between
    named = usable.select("id")
    line = e.join(named.withColumnRenamed("id", "a"), "a", "left_semi").join(named.withColumnRenamed("id", "b"), "b", "left_semi")
    out = line.select(F.col("a").alias("id"), F.col("b").alias("at"), "n", "spread", F.col("log_scale").alias("log"), "slope", "offset")
    back = line.select(F.col("b").alias("id"), F.col("a").alias("at"), "n", "spread", (-F.col("log_scale")).alias("log"), F.try_divide(F.lit(1.0), F.col("slope")).alias("slope"), F.try_divide(-F.col("offset"), F.col("slope")).alias("offset"))
    both = written(out.unionByName(back), "unit-lines")
    while True:
        size = F.col("num").cast("double") / F.col("den").cast("double") * F.col("scale").cast("double")
        votes = both.join(known.select("id"), "id", "left_anti").join(known.select(F.col("id").alias("at"), "kind", size.alias("size"), (size * F.col("shift").cast("double")).alias("shifted")).where(F.col("kind").isNotNull()), "at")
        # kinds whose units differ in their zero are lines, all others pure scales
        bent = F.col("kind").isin(*BENT)
        fits = F.when(bent, F.col("slope") > 0).otherwise(F.col("spread") < 0.02)
        steep = F.when(bent, F.col("size") * F.col("slope")).otherwise(F.col("size") * F.pow(F.lit(10.0), "log"))
        zero = F.when(bent, F.col("size") * F.col("offset") + F.col("shifted")).otherwise(0.0)
        votes = votes.where(fits).withColumn("s", _snap(F.col("kind"), steep, zero)).where(F.col("s").isNotNull())
        votes = votes.select("id", "kind", *[f"s.{c}" for c in SIZE], "n")
        twin = F.concat(F.when(F.col("id").startswith("R:"), "W:").otherwise("R:"), F.substring("id", 3, 1 << 20))
        twins = known.where(F.col("kind").isNotNull() & (~F.col("kind").isin(*OPEN) | (F.col("scale") != "1"))).select(twin.alias("id"), "kind", *SIZE, F.lit(support).cast("bigint").alias("n"))
        votes = votes.unionByName(twins.join(known.select("id"), "id", "left_anti").join(named, "id", "left_semi"))
        tally = votes.groupBy("id", "kind", *SIZE).agg(F.sum("n").alias("n"))
        line_of = F.struct((F.col("num").cast("double") / F.col("den").cast("double") * F.col("scale").cast("double")).alias("size"), "shift")
        by_size = tally.groupBy("id", line_of.alias("line")).agg(F.sum("n").alias("n"), F.max(F.struct("n", "kind", *SIZE)).alias("top")).groupBy("id").agg(F.max(F.struct("n", "top")).alias("t"), F.sum("n").alias("all"))
        new = by_size.where((F.col("t.n") >= support) & (F.col("t.n") >= 0.9 * F.col("all"))).select("id", F.when(F.col("t.top.n") >= 0.9 * F.col("all"), F.col("t.top.kind")).alias("kind"), *[F.col(f"t.top.{c}").alias(c) for c in SIZE])
        new = written(new, "unit-found")
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def harmonised(df: DataFrame, filings: DataFrame | None = None, units: tuple[tuple[str, str, str, str, str], ...] = UNITS, graph: bool = True) -> DataFrame:
    """Metric rows in the common unit of their kind: extracted_id, common_unit, common_value (nearest whole number).

    `df` needs document_id, extracted_id, entity_type, name, description, quote, period, value, unit; `filings`, where
    there are any, document_id and cik.  `graph` false leaves the anchors alone (to see what the graph decides).
    """
    links = written(linked(df, filings), "unit-links")
    words = written(dictionary(links.select(F.explode(F.array_compact(F.array("u", "w", "h"))).alias("node")).distinct(), units), "unit-dictionary")
    c = F.col
    own = words.select("node", "excluded", "whole", "kind", *[F.when(c("whole"), c(x)).alias(x) for x in SIZE])
    sized = sources(links, units, words=words).select("id", c("kind").alias("g_kind"), *[c(x).alias(f"g_{x}") for x in SIZE])
    if not graph:
        sized = sized.where("false")
    # a vocabulary of spellings, whose size is checked before it is sent to every task
    small = words.count() <= 200_000
    send = F.broadcast if small else lambda x: x

    def resolved(prefix: str) -> DataFrame:
        """Phrases of one side with kind, size and scale: as the anchors say, else as the graph says."""
        r = own.join(sized.where(c("id").startswith(prefix)).select(F.substring("id", 3, 1 << 20).alias("node"), "g_kind", *[f"g_{x}" for x in SIZE]), "node", "left")
        found_kind = F.coalesce(c("kind"), c("g_kind"))
        by_graph = ~c("whole") & c("g_num").isNotNull()
        is_open = found_kind.isin(*OPEN)
        scale = F.when(by_graph, F.when(c("g_scale") != "1", c("g_scale"))).otherwise(c("scale"))
        known = c("whole") | c("g_num").isNotNull()
        return r.select(
            "node", "excluded", c("kind").alias("named"), found_kind.alias("kind"), known.alias("known"), scale.alias("scale"),
            *[F.when(is_open, F.lit(v)).when(by_graph, c(f"g_{x}")).otherwise(c(x)).alias(x) for x, v in (("num", "1"), ("den", "1"), ("shift", "0"))],
        )

    rows = links
    for n, prefix in (("u", "R:"), ("w", "W:")):
        rows = rows.join(send(resolved(prefix).select(c("node").alias(n), *[c(f).alias(f"{n}_{f}") for f in ("named", "kind", "num", "den", "shift", "scale", "known", "excluded")])), n, "left")
    rows = rows.join(send(words.select(c("node").alias("h"), *[c(f).alias(f"h_{f}") for f in ("kind", "num", "den", "shift", "scale", "excluded")])), "h", "left")
    rows = rows.withColumns({f"{n}_excluded": F.coalesce(f"{n}_excluded", F.lit(False)) for n in ("u", "w", "h")})

    matched = F.coalesce(c("off") < 0.06, F.lit(False))
    # a spelling that names no kind itself takes the kind of the row's own text
    told = F.when(c("u_named").isNull() & matched, c("w_kind"))
    kind = F.coalesce(told, c("u_kind"), c("w_kind"), c("h_kind"))
    # how the recorded value stands to the written figure: the same number, or already multiplied out
    same = matched & (F.abs(F.log10(F.abs(c("value")) / c("x"))) < 0.06)
    one = F.lit("1")
    by_u = F.coalesce(c("u_known") & c("u_kind").isNotNull() & ~c("u_kind").isin(*OPEN), F.lit(False))
    scale = (
        F.when(c("u_scale").isNotNull(), c("u_scale"))
        .when(~kind.isin(*OPEN), F.when(by_u, one).otherwise(F.coalesce(c("w_scale"), one)))
        .when(c("w_scale").isNotNull() & (same | ~matched), c("w_scale"))
        .when(c("w_scale").isNotNull(), one)
        .when(matched & ~same, one)
        .otherwise(F.coalesce(c("h_scale"), one))
    )
    part = lambda f: F.when(by_u, c(f"u_{f}")).otherwise(F.coalesce(F.when(c("w_kind").isNotNull(), c(f"w_{f}")), c(f"u_{f}"), c(f"h_{f}")))
    num, den, shift = part("num"), part("den"), part("shift")
    # a phrase that nothing sizes leaves the row untold, unless the other side has the size
    untold = (~F.coalesce(c("w_known"), F.lit(True)) & c("u_scale").isNull() & ~by_u & matched & same) | (~F.coalesce(c("u_known"), F.lit(True)) & ~(c("u_kind").isin(*OPEN) & c("w_known") & matched))
    barred = c("u_excluded") | F.when(c("u_kind").isNull(), c("w_excluded") | c("rated") | c("h_excluded")).otherwise(F.lit(False))
    v = F.try_add(c("value").try_cast("decimal(24,8)"), shift.cast("decimal(10,4)")).cast("decimal(24,8)")
    whole = F.try_multiply(F.try_multiply(v, _decimal(num)).cast("decimal(28,8)"), scale.cast("decimal(10,0)"))
    whole = F.round(F.when(den == "1", whole).otherwise(F.try_divide(whole, den.cast("decimal(5,1)"))), 0).try_cast("bigint")
    rough = F.round((c("value") + shift.cast("double")) * num.cast("double") / den.cast("double") * scale.cast("double")).try_cast("bigint")
    result = rows.where(kind.isNotNull() & (kind != "none") & ~barred & ~F.coalesce(untold, F.lit(False))).select(
        c("id").alias("extracted_id"), kind.alias("common_unit"), F.coalesce(whole, rough).alias("common_value"),
    )
    return result.where(c("common_value").isNotNull())


#: The common units of `found`.
COMMON = ("USD", "EUR", "GBP", "JPY", "bp", "count", "m2", "kwh", "kg", "hour")


def found(df: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """The distinct harmonised figures in the units of `COMMON`."""
    return harmonised(df, filings).where(F.col("common_unit").isin(*COMMON)).distinct()
