"""Passages of held-out test items found in training texts.

The items' texts, in the consistent form, are cut into aligned blocks of words, and one Aho-Corasick automaton holds
all blocks; each document is brought to the same form and scanned once.  A run of `shared` words of an item always
covers one whole aligned block of (shared + 1) // 2 words; from each block that the scan meets, the run is extended word
by word in both directions, so exactly the runs of at least `shared` words are reported.  Word positions are mapped
back to offsets in the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.consistent import consistent_text

WORD = re.compile(r"[^\W_]+")  # the longest runs of letters and digits
BLOCK_CHARS = 32 << 20  # characters of items in one automaton, about
CLUSTER = regex.compile(r"\X\p{Cf}*")
SCHEMA = "doc_id bigint, item_id bigint, part string, words int, start int, end int"


def line_of(text: str) -> str:
    """The words of a text in the consistent form, lower-cased, each between spaces."""
    form = consistent_text(text)
    if "İ" in form:  # the only letter whose lower case holds a character that is none: it stays in its word
        return " " + " ".join(w.lower() for w in WORD.findall(form)) + " "
    return " " + " ".join(WORD.findall(form.lower())) + " "


def words_of(text: str) -> list[str]:
    return line_of(text).split()


@dataclass
class Items:
    """The parts of the items in one automaton."""

    parts: list[tuple[int, str, list[str], int]]  # item, part, words, least run
    automaton: ahocorasick.Automaton

    @classmethod
    def build(cls, rows: list[tuple[int, str, str]], shared: int) -> Items:
        parts, blocks = [], {}
        for item, part, text in rows:
            words = words_of(text)
            # a part shorter than the run (a question) counts only as a whole
            least = min(shared, len(words))
            if not words:
                continue
            size = (least + 1) // 2
            for at in range(0, len(words) - size + 1, size):
                blocks.setdefault(" " + " ".join(words[at : at + size]) + " ", []).append((len(parts), at, size))
            parts.append((item, part, words, least))
        automaton = ahocorasick.Automaton()
        for block, places in blocks.items():
            automaton.add_word(block, places)
        if blocks:
            automaton.make_automaton()
        return cls(parts, automaton)

    def runs(self, line: str) -> Iterator[tuple[int, int, int]]:
        """(part, first word, words) of each maximal run of at least the part's least length in a document's `line_of`."""
        if not len(self.automaton):
            return
        seen, words = set(), None
        at, counted = -1, 0
        for end, places in self.automaton.iter(line):
            words = words or line.split()
            at += line.count(" ", counted, end)
            counted = end
            for part, place, size in places:
                _, _, theirs, least = self.parts[part]
                first = at - size + 1  # the document's word where the block starts
                i, j = first, place
                while i > 0 and j > 0 and words[i - 1] == theirs[j - 1]:
                    i, j = i - 1, j - 1
                m, n = first + size, place + size
                while m < len(words) and n < len(theirs) and words[m] == theirs[n]:
                    m, n = m + 1, n + 1
                if m - i >= least and (part, i, m) not in seen:
                    seen.add((part, i, m))
                    yield part, i, m - i


def original_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of the consistent form stands in the original text."""
    form = consistent_text(text)
    spans = [m.span() for m in WORD.finditer(form)]
    if form == text:
        return spans
    starts, ends = [], []
    for m in CLUSTER.finditer(text):
        for _ in consistent_text(m.group()):
            starts.append(m.start())
            ends.append(m.end())
    size = len(starts)
    return [(starts[min(a, size - 1)], ends[min(b, size) - 1]) for a, b in spans]


def scan(items: Items):
    """The scan of Arrow batches of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not isinstance(text, str):
                    continue
                spans = None
                for part, first, n in items.runs(line_of(text)):
                    spans = spans or original_spans(text)
                    item, name, _, _ = items.parts[part]
                    rows.append((doc, item, name, n, spans[first][0], spans[first + n - 1][1]))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "part", "words", "start", "end"])

    return run


class _Scan:
    """Builds the automaton once per Python worker from the items' text, which travels as one broadcast of bounded size."""

    built: dict[tuple, Items] = {}

    def __init__(self, rows: list[tuple[int, str, str]], shared: int, spark: SparkSession) -> None:
        self.shared, self.key, self.rows = shared, (uuid.uuid4().hex, shared), spark.sparkContext.broadcast(rows)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if self.key not in _Scan.built:
            _Scan.built = {self.key: Items.build(self.rows.value, self.shared)}
        yield from scan(_Scan.built[self.key])(batches)


def leaks(documents: DataFrame, items: DataFrame, shared: int = 15, block: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, part (`passage` or `question`), words of the run, start and end in the original text.

    A part shorter than `shared` words is reported only where it stands as a whole.  The items are the stated query set:
    they are taken in blocks of `block` characters, each of which is one automaton and one scan of the corpus, so what is
    broadcast and what a worker holds are bounded (a longer text is a block of its own).  Null or empty texts, passages
    and questions have no run; a document or item delivered twice gives equal rows.
    """
    spark = documents.sparkSession
    parts = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(F.map_from_arrays(F.array(F.lit("passage"), F.lit("question")), F.array("passage", "question"))).alias("part", "text"))
    parts = parts.where(F.length("text") > 0).distinct()
    corpus = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    out, rows, held = None, [], 0

    def scanned(out: DataFrame | None) -> DataFrame:
        hits = corpus.mapInPandas(_Scan(rows, shared, spark), SCHEMA)
        return hits if out is None else out.unionByName(hits)

    for r in parts.orderBy("item_id", "part").toLocalIterator():
        if rows and held + len(r.text) > block:
            out, rows, held = scanned(out), [], 0
        rows.append((r.item_id, r.part, r.text))
        held += len(r.text)
    return scanned(out) if rows or out is None else out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of the documents that hold at least 15 consecutive words of the item's passage.

    A passage of fewer words than that is in no document.
    """
    return leaks(documents, items).where((F.col("part") == "passage") & (F.col("words") >= 15)).select("doc_id", "item_id").distinct()
