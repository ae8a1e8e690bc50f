"""One consistent form for texts that look the same but differ in their characters.

A text is exploded to positioned elements: characters, each with those that join it.  The distinct elements are exploded
to positioned characters, joined with a broadcast table of decompositions and look-alikes (derived by rule from the
Unicode database, so its size has Unicode's bound), their combining marks are ordered by class and recomposed, and the
texts are rebuilt.  Runs of printable ASCII are already in the consistent form and stay one element.

The form: full- and half-width forms, ligatures and other joined forms are taken apart (raised and lowered digits,
fractions and circled characters are not, they read differently); accents are composed; invisible characters are
dropped; every kind of space is a space (line breaks and tabs stay); letters of another script with a Latin letter's
shape are that letter.  Null stays null and an empty text stays empty; the form of a form is itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.classes import expanded
from tallyfold.storage import written

#: Letters of other scripts, and of phonetic writing, beside the Latin letters of the same shape, as Unicode's
#: table of confusable characters (UTS #39) pairs them.
LOOKALIKES = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀ", "ABESIJKMHOPCTYXYGQWI"),
    ("аеѕіјорсухһԁԛԝӏ", "aesijopcyxhdqwl"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj"),
    ("οϲν", "ocv"),
    ("αρυ", "apu"),
    # Armenian
    ("ՕՍՏօհոս", "OUSohnu"),
    # Cherokee
    ("ᎠᎡᎢᎪᎫᎬᎳᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMGZRWVSLCPKB"),
    # Coptic
    ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲥ", "ABEHIKMNOPCTXoc"),
    # phonetic letters
    ("ɑɡ", "ag"),
)
#: The sorts of compatibility decomposition that change width or joining only.
JOINED = ("<wide>", "<narrow>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>", "<vertical>", "<small>")
#: Characters without a trace in print that are not of the category of format characters.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
ODD = re.compile(r"[^\x00-\x7f]")
PLAIN = r"^[\t\n\r -~]*$"


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in UNSEEN or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or "᠋" <= ch <= "᠍"


def _taken_apart(ch: str, looks: dict[str, str]) -> str:
    """The full decomposition of one character in the consistent form."""
    if _invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in looks:
        return looks[ch]
    parts = unicodedata.decomposition(ch).split()
    if not parts or (parts[0].startswith("<") and parts[0] not in JOINED):
        return ch
    if parts[0] == "<compat>" and "0020" in parts[1:]:
        return ch  # spacing accents: a space and a mark would read as two characters
    return "".join(_taken_apart(chr(int(p, 16)), looks) for p in parts if p[0] != "<")


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Every character whose consistent decomposition is not itself (Hangul syllables compose by rule and stay)."""
    looks = {a: b for left, right in LOOKALIKES for a, b in zip(left, right, strict=True)}
    out = {}
    for code in range(0x80, 0x110000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        to = _taken_apart(ch, looks)
        if to != ch:
            out[ch] = to
    return out


@lru_cache(1)
def _short() -> dict[str, str]:
    """The mapping composed again, for whole-string translation; marks are composed with their letters afterwards."""
    return {a: unicodedata.normalize("NFC", b) for a, b in mapping().items()}


def consistent_text(text: str) -> str:
    """The consistent form of one string: what `consistent` builds, for use inside Arrow batches of other operators."""
    if text.isascii():
        return text
    short = _short()
    return unicodedata.normalize("NFC", ODD.sub(lambda m: short.get(m[0], m[0]), text))


@lru_cache(1)
def compositions() -> tuple[dict[str, str], dict[str, str]]:
    """What two characters compose to, by the Unicode database: (all but Hangul, Hangul)."""
    plain, hangul = {}, {}
    for code in range(0xA0, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        parts = unicodedata.decomposition(ch).split()
        if 0xAC00 <= code <= 0xD7A3:
            lead, rest = divmod(code - 0xAC00, 588)
            vowel, tail = divmod(rest, 28)
            first = chr(0x1100 + lead) + chr(0x1161 + vowel)
            hangul[first if not tail else chr(code - tail) + chr(0x11A7 + tail)] = ch
        elif len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            plain["".join(chr(int(p, 16)) for p in parts)] = ch
    return plain, hangul


@lru_cache(1)
def joining() -> str:
    """A pattern for one of the characters that may change with those before them: they vanish, or begin with a mark or a second part.

    It covers marks and format characters by category, and the rest by rule; that some stand alone does no harm.
    """
    seconds = {pair[1] for pair in compositions()[0]} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    to, low, high = mapping(), [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        form = to.get(ch, ch)
        joins = not form or unicodedata.combining(form[0]) or form[0] in seconds
        # a runtime may know fewer marks outside the basic plane: they are named one by one
        if joins and (code >= 0x10000 or unicodedata.category(ch) not in ("Mn", "Mc", "Me", "Cf")):
            ranges = low if code < 0x3000 else high
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    listed = lambda ranges: "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)
    # few texts have the characters of the long list: it is looked at only where they can be
    return rf"(?:[\p{{M}}\p{{Cf}}{listed(low)}]|(?![\x{{0}}-\x{{2fff}}])[{listed(high)}])"


def _table(spark: SparkSession) -> DataFrame:
    """character, its decomposition as an array of (character, combining class); characters that are their own are left out."""
    rows = {ch: to for ch, to in mapping().items()} | {chr(c): chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c)) and chr(c) not in mapping()}
    data = pd.DataFrame({"c": list(rows), "to": list(rows.values()), "classes": ["".join(f"{unicodedata.combining(x):03d}" for x in to) for to in rows.values()]})
    table = spark.createDataFrame(data, "c string, to string, classes string")
    chars = F.regexp_extract_all("to", F.lit("(?s)."), F.lit(0))
    return table.select("c", F.transform(chars, lambda x, i: F.struct(x.alias("x"), F.substring("classes", 3 * i + 1, F.lit(3)).cast("int").alias("k"))).alias("parts"))


def resolved(elements: DataFrame) -> DataFrame:
    """element, to: the consistent form of each distinct element (a character with those that join it).

    Elements are exploded to positioned characters, joined with the broadcast mapping, their marks ordered by class
    within each starter, and composed again from left to right, unless a mark of the same or a higher class stands between.
    """
    plain, hangul = (F.from_json(F.lit(json.dumps(m)), "map<string,string>") for m in compositions())
    chars = elements.select("element", F.posexplode(F.regexp_extract_all("element", F.lit("(?s)."), F.lit(0))).alias("i", "c"))
    own = F.array(F.struct(F.col("c").alias("x"), F.lit(0).alias("k")))
    parts = chars.join(F.broadcast(_table(elements.sparkSession)), "c", "left").select("element", "i", F.posexplode_outer(F.coalesce("parts", own)).alias("j", "p"))
    parts = parts.select("element", "i", F.coalesce("j", F.lit(0)).alias("j"), "p.x", "p.k")
    upto = Window.partitionBy("element").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)  # one element
    placed = parts.withColumn("starter", F.count_if(F.col("k") == 0).over(upto))
    ordered = placed.groupBy("element").agg(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("starter", "k", "i", "j", "x")))).alias("all"))

    def step(acc: Column, p: Column) -> Column:
        pair = F.concat(acc["base"], p["x"])
        # jamo are looked up in their own table, which is long
        found = F.when(p["x"].between("\u1161", "\u11c2"), F.try_element_at(hangul, pair)).otherwise(F.try_element_at(plain, pair))
        met = F.when((acc["rest"] == "") | (acc["last"] < p["k"]), found)
        opens = p["k"] == 0
        return (
            F.when(met.isNotNull(), F.struct(acc["done"].alias("done"), met.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last")))
            .when(opens, F.struct(F.concat(acc["done"], acc["base"], acc["rest"]).alias("done"), p["x"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last")))
            .otherwise(F.struct(acc["done"].alias("done"), acc["base"].alias("base"), F.concat(acc["rest"], p["x"]).alias("rest"), p["k"].alias("last")))
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    built = F.aggregate("all", start, step, lambda acc: F.concat(acc["done"], acc["base"], acc["rest"]))
    return ordered.select("element", F.when(F.size("all") == 1, F.col("all")[0]["x"]).otherwise(built).alias("to"))


def consistent(df: DataFrame, key: str, text: str, out: str = "consistent") -> DataFrame:
    """`key` and the consistent form of `text` for each row of `df`, also of repeated rows and of different texts under one key.

    Only texts with a character outside printable ASCII are exploded: the others are their own form.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    plain = rows.where(F.col("__t").isNull() | F.col("__t").rlike(PLAIN)).select(F.col("__k").alias(key), F.col("__t").alias(out))
    odd = rows.where(~F.col("__t").rlike(PLAIN))
    # positioned elements: runs of printable ASCII, and any other character with those that join the one before them
    elements = F.regexp_extract_all("__t", F.lit(rf"[\t\n\r -~]{joining()}+|[\t\n\r -~]+(?!{joining()})|[^\t\n\r -~]{joining()}*"), F.lit(0))
    # rows of one key are told apart by their texts; a repeated row's elements are folded, and its form given as often
    exploded = odd.select("__k", F.xxhash64("__t").alias("h1"), F.hash("__t").alias("h2"), F.posexplode(elements).alias("pos", "element"))
    distinct = odd.select(F.explode(F.array_distinct(F.filter(elements, lambda e: ~e.rlike(PLAIN)))).alias("element")).distinct()
    forms = written(resolved(distinct), "consistent-elements")
    if forms.count() <= 500_000:  # some MB; beyond, the join shuffles
        forms = F.broadcast(forms)
    mapped = exploded.join(forms, "element", "left").select("__k", "h1", "h2", "pos", F.coalesce("to", "element").alias("to"))
    built = mapped.groupBy("__k", "h1", "h2").agg(F.array_sort(F.collect_list(F.struct("pos", "to"))).alias("all"), F.count_if(F.col("pos") == 0).cast("int").alias("rows"))
    once = F.when(F.col("rows") > 1, F.array_distinct("all")).otherwise(F.col("all"))
    built = built.select("__k", F.array_join(F.transform(once, lambda x: x["to"]), "").alias("joined"), F.explode(F.array_repeat(F.lit(1), F.col("rows"))))
    return plain.unionByName(built.select(F.col("__k").alias(key), F.col("joined").alias(out)))


def found(df: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: documents whose texts have one consistent form but aren't the same string.

    Rows with a null or empty text, or without an id, are no case.  Documents are first folded to distinct strings, so
    copies meet only where they make a pair of the result.
    """
    rows = df.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.struct("doc_id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")).alias("k"), "text")
    forms = consistent(rows, "k", "text").select("k.doc_id", F.struct("k.h1", "k.h2").alias("raw"), F.md5("consistent").alias("form"))
    forms = written(forms, "consistent-forms")
    strings = forms.groupBy("form", "raw").agg(F.count("*").alias("n"))
    several = strings.groupBy(F.col("form").alias("class")).agg(F.count("*").alias("n")).where("n > 1")
    strings = written(strings.join(several.select(F.col("class").alias("form")), "form", "left_semi"), "consistent-strings")
    # each pair of strings of one form once, then each string's documents; forms and strings with very many are split
    apart = expanded(strings.select(F.col("form").alias("a"), F.col("raw").alias("x")), "a", strings.select(F.col("form").alias("class"), F.col("raw").alias("id")), several, "y").where(F.col("x") < F.col("y"))
    named = F.struct("form", "raw")
    holders = forms.join(strings.select("form", "raw"), ["form", "raw"], "left_semi").select(named.alias("class"), F.col("doc_id").alias("id"))
    sizes = strings.where("n > 1").select(named.alias("class"), "n")
    pairs = apart.select(F.struct(F.col("a").alias("form"), F.col("x").alias("raw")).alias("a"), F.struct(F.col("a").alias("form"), F.col("y").alias("raw")).alias("b"))
    both = expanded(expanded(pairs, "a", holders, sizes, "p"), "b", holders, sizes, "q").where(F.col("p") != F.col("q"))
    return both.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).distinct()
