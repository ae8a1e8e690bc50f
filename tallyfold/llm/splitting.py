"""Oversized items cut into pieces under a limit, at natural boundaries, with an overlap.

A text is a row of tokens (a word with the white space after it, by default measured in characters) with prefix sums of
their sizes, and a sorted array of boundaries: token positions where a paragraph, a sentence or a clause ends.  The end
of a piece is the last boundary under the limit, found by binary search; the next piece steps back by the overlap, to a
token's start.  A token that alone exceeds the limit is cut hard, never between a letter and its combining mark.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

TOKEN = re.compile(r"\S*\s+|\S+")
#: What ends a paragraph, a sentence and a clause, as the end of a token; the stronger is preferred.
ENDS = (
    ("paragraph", re.compile(r"\n\s*\n\s*$")),
    ("sentence", re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+$|\n\s*$")),
    ("clause", re.compile(r"[;:,—–][\"'”’»)\]]*\s+$")),
)
PIECES = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("cut", StringType())]))


def _hard(text: str, start: int, end: int) -> int:
    """The last place up to `end` that doesn't part a letter from its combining marks."""
    at = end
    while at > start + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️"):
        at -= 1
    return at if at > start + 1 else end


def tokens_of(text: str, limit: int, size: Callable[[str], int]) -> list[int]:
    """Ends of the tokens, those above the limit cut hard."""
    ends, at = [], 0
    for m in TOKEN.finditer(text):
        while size(text[at : m.end()]) > limit:
            low, high = at + 1, m.end()  # the longest start of the token that fits; sizes grow with length
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if size(text[at:mid]) <= limit else (low, mid - 1)
            at = _hard(text, at, low)
            ends.append(at)
        if at < m.end():
            at = m.end()
            ends.append(at)
    return ends


def pieces(text: str, limit: int, overlap: int, size: Callable[[str], int] = len, least: float = 0.5) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of each piece; offsets in code points.

    A stronger boundary is taken only where it leaves a piece of at least `least` of the limit.  Every piece has at most
    `limit`; two consecutive pieces share at most `overlap`, and less only as far as tokens don't divide.  A text under
    the limit is one piece, an empty text none.
    """
    if not text:
        return []
    ends = tokens_of(text, limit, size)
    starts = [0, *ends[:-1]]
    if size is len:
        sums = [0, *ends]
    else:
        sums = [0]
        for a, b in zip(starts, ends, strict=True):
            sums.append(sums[-1] + size(text[a:b]))
    bounds: dict[str, list[int]] = {kind: [] for kind, _ in ENDS}
    for i, (a, b) in enumerate(zip(starts, ends, strict=True), 1):
        for kind, pattern in ENDS:
            if pattern.search(text[max(a, b - 12) : b]):
                bounds[kind].append(i)
                break
    merged: list[tuple[str, list[int]]] = []  # boundaries of a kind and of all stronger ones
    for kind, _ in ENDS:
        merged.append((kind, sorted([*(merged[-1][1] if merged else []), *bounds[kind]])))
    out, first, done, count = [], 0, 0, len(ends)  # done: tokens that earlier pieces hold
    while True:
        last = bisect.bisect_right(sums, sums[first] + limit) - 1  # tokens first..last-1 fit
        if last >= count:
            out.append((sums_to(starts, ends, first), ends[-1], "end"))
            return out
        floor = bisect.bisect_left(sums, sums[first] + limit * least)
        cut, kind = last, "word" if text[ends[last - 1] - 1].isspace() else "hard"
        for k, strong in merged:
            i = bisect.bisect_right(strong, last) - 1
            if i >= 0 and strong[i] > done and strong[i] >= floor:
                cut, kind = strong[i], k
                break
        out.append((sums_to(starts, ends, first), ends[cut - 1], kind))
        # back by the overlap, but not so far that the next token doesn't fit
        back = max(bisect.bisect_left(sums, sums[cut] - overlap), bisect.bisect_left(sums, sums[cut + 1] - limit))
        first, done = max(first + 1, min(back, cut)), cut


def sums_to(starts: list[int], ends: list[int], token: int) -> int:
    """The offset where a token starts."""
    return starts[token] if token < len(starts) else ends[-1]


def cuts(limit: int, overlap: int, size: Callable[[str], int] = len):
    """A column function: text -> array of (start, end, cut)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be under the limit")

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "cut": k} for a, b, k in pieces(t, limit, overlap, size)], na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, PIECES)


def split(df: DataFrame, text: str, limit: int, overlap: int) -> DataFrame:
    """Rows of `df` whose text exceeds `limit` characters, one for each piece, with piece, piece_start, piece_end, piece_cut, piece_text.

    A null text has no piece.  Offsets and lengths are code points of the text as stored.
    """
    big = df.where(F.length(text) > limit)
    cut = big.withColumn("__cuts", cuts(limit, overlap)(F.col(text)))
    rows = cut.select("*", F.posexplode("__cuts").alias("piece", "__at")).drop("__cuts")
    inside: Column = F.substring(F.col(text), F.col("__at.start") + 1, F.col("__at.end") - F.col("__at.start"))
    return rows.withColumns({"piece_start": F.col("__at.start"), "piece_end": F.col("__at.end"), "piece_cut": F.col("__at.cut"), "piece_text": inside}).drop("__at")


def paragraph_pieces(blocks: DataFrame, sections: DataFrame, limit: int = 2400, overlap: int = 200) -> DataFrame:
    """block_id, accession, paragraph_id, path and the pieces of each oversized paragraph.

    Of a block delivered several times the last delivery counts.  A null section_ordinal, or one without a section, gives
    a null path; of a section delivered several times the longest path counts.  All columns are named, so extra ones
    of either table don't clash.
    """
    big = blocks.where(F.length("text") > limit).select("block_id", "document_id", "accession", "section_ordinal", "paragraph_id", "text", "ingested_at")
    # rows without a block_id can't be deliveries of one block: all stay
    last = Window.partitionBy("block_id", F.when(F.col("block_id").isNull(), F.xxhash64("accession", "paragraph_id", "text"))).orderBy(F.desc_nulls_last("ingested_at"), F.desc(F.xxhash64("text")))
    big = big.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "ingested_at")
    paths = sections.groupBy("document_id", F.col("ordinal").alias("section_ordinal")).agg(F.max_by("path", F.struct(F.size("path"), F.array_join("path", "\x01"))).alias("path"))
    rows = big.join(paths, ["document_id", "section_ordinal"], "left")
    return split(rows, "text", limit, overlap).drop("text")


def found(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """accession, paragraph_id of the paragraphs that were cut."""
    return paragraph_pieces(blocks, sections).select("accession", "paragraph_id").distinct()
