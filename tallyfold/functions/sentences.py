"""Sentences of prose, and quotes placed in them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words whose full stop ends no sentence (lower case, without the last stop), the longest quote kept as a sentence.
ABBREVIATIONS = frozenset(
    "u.s u.k e.u inc corp co ltd llc plc no nos e.g i.e etc vs approx mr ms mrs dr st jr sr jan feb mar apr jun jul aug sep sept oct nov dec fig sec art".split()
)
LONGEST_QUOTE = 600
#: What ends a sentence, what may close behind the end, and what may open the next one beside capitals and digits.
ENDS, CLOSERS, OPENERS = ".!?", "\"'”’)]", "\"“‘(["
PLAIN = str.maketrans("‘’“”–— ", "''\"\"-- ")
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _opens(ch: str) -> bool:
    return ch in OPENERS or (ch.isascii() and (ch.isupper() or ch.isdigit()))


def _abbreviated(text: str, stop: int) -> bool:
    """Whether the full stop at `stop` belongs to a known abbreviation or an initial."""
    at = stop
    while at and text[at - 1].isascii() and (text[at - 1].isalpha() or text[at - 1] == "."):
        at -= 1
    word = text[at:stop].strip(".").lower()
    return len(word) == 1 or word in ABBREVIATIONS


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, without outer white space.

    Every gap of white space is looked at from behind: it parts two sentences if what precedes it, past closing marks,
    is an end that no abbreviation explains, and what follows can open a sentence.
    """
    out, start = [], len(text) - len(text.lstrip())
    for gap in re.finditer(r"\s+", text):
        if gap.start() <= start or gap.end() == len(text) or not _opens(text[gap.end()]):
            continue
        last = gap.start() - 1
        while last > start and text[last] in CLOSERS:
            last -= 1
        if text[last] in ENDS and not (text[last] == "." and _abbreviated(text, last)):
            out.append((start, gap.start()))
            start = gap.end()
    end = len(text.rstrip())
    return [*out, (start, end)] if end > start else out


def _pattern(quote: str) -> re.Pattern | None:
    """A quote's words with any white space between them, plain marks, any case; an ellipsis stands for anything."""
    parts = [p.split() for p in re.split(r"\.{3,}|…", quote.translate(PLAIN))]
    parts = [r"\s+".join(map(re.escape, p)) for p in parts if p]
    return re.compile(r".*?".join(parts), re.I | re.S) if parts else None


def placed(quote: str | None, paragraph: str | None) -> tuple[int, int] | None:
    """Where a quote stands in a paragraph: as it is, else in plain marks, any case and spacing, else its parts in order."""
    if not quote or not quote.strip() or not paragraph:
        return None
    at = paragraph.find(quote.strip())
    if at >= 0:
        return at, at + len(quote.strip())
    pattern = _pattern(quote)
    m = pattern and pattern.search(paragraph.translate(PLAIN))
    return m.span() if m else None


def anchored(quote: str | None, paragraph: str | None) -> str | None:
    """The sentences of a paragraph that hold a quote, or the quoted span where they are too long."""
    span = placed(quote, paragraph)
    if span is None:
        return None
    inside = [s for s in spans(paragraph) if s[0] < span[1] and span[0] < s[1]]
    start, end = min([span[0], *[a for a, _ in inside]]), max([span[1], *[b for _, b in inside]])
    return paragraph[start:end] if end - start <= LONGEST_QUOTE else paragraph[slice(*span)]


def sentence_spans():
    """A column function: text -> array of (start, end)."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in spans(t)], na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, SPANS)


def anchors():
    """A column function: (quote, paragraph) -> the sentence that holds the quote."""

    def run(quotes: pd.Series, paragraphs: pd.Series) -> pd.Series:
        return pd.Series([anchored(q, p) for q, p in zip(quotes, paragraphs, strict=True)], dtype=object)

    run.__annotations__ = {"quotes": pd.Series, "paragraphs": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())
