"""Filing markup to sections, paragraphs and tables: one pass over the tokens of each document.

A document is a row; a scan of its tokens is inherently in order, so it runs in Python over Arrow batches, one document
at a time, and everything after it is columns again.  The scanner keeps a stack of open elements; what an element
contributes (nothing, cells, prose) is settled when it opens, so that a close needs only the stack.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<end>/)?(?P<tag>[A-Za-z][\w:.-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|(?P<text>[^<]+|<)", re.S)
#: Elements that end a paragraph, hold no prose, or never close; the longest heading.
BREAKING = frozenset("p div li br tr h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset("script style head ix:header ix:references ix:resources ix:hidden".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LONGEST_HEADING = 120
PART, ITEM = re.compile(r"part\s+[ivx]+\b", re.I), re.compile(r"item\s+\d+[a-z]?", re.I)
PAGE_BREAK = re.compile(r"(?:style|class)\s*=\s*[\"'][^\"']*page-break-(?:before|after)\s*:\s*always", re.I)
HIDDEN = re.compile(r"style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
ROWS = "document_id bigint, kind string, ordinal int, page int, paragraph_id string, section int, level int, title string, path array<string>, end_page int, text string, cells array<array<string>>"


def _tidy(text: str) -> str:
    return " ".join(text.split())


def heading_level(text: str) -> int | None:
    """1 for a part's heading, 2 for an item's, none for prose; a long line that begins alike is prose."""
    if len(text) > LONGEST_HEADING:
        return None
    return 1 if PART.match(text) else 2 if ITEM.match(text) else None


@dataclass
class Scan:
    """What has been read of one document."""

    page: int = 1
    rows: list[dict] = field(default_factory=list)
    prose: list[str] = field(default_factory=list)
    on_page: int = 0
    section: int | None = None
    path: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: {"section": 0, "block": 0, "table": 0})

    def emit(self, kind: str, **values) -> None:
        self.rows.append({"kind": kind, "ordinal": self.counts[kind], "page": self.page, "section": self.section, **values})
        self.counts[kind] += 1

    def end_paragraph(self) -> None:
        text = _tidy("".join(self.prose))
        self.prose = []
        if not text:
            return
        level = heading_level(text)
        if level is None:
            self.on_page += 1
            self.emit("block", paragraph_id=f"{self.page}_{self.on_page}", text=text)
            return
        self.path = [text] if level == 1 else [*self.path[:1], text] if self.path and PART.match(self.path[0]) else [text]
        self.section = self.counts["section"]
        self.emit("section", level=level, title=text, path=list(self.path))

    def turn_page(self) -> None:
        self.end_paragraph()
        self.page, self.on_page = self.page + 1, 0

    def end_table(self, rows: list[list[str]]) -> None:
        rows = [r for r in rows if any(r)]
        if rows and max(map(len, rows)) > 1:
            self.emit("table", cells=rows)
        elif rows:  # one column is layout, not data
            self.prose.append(" ".join(c for r in rows for c in r))
            self.end_paragraph()


def scanned(source: str) -> Scan:
    """Read one document.  Hidden and silent elements and all in them are skipped; a table in a table is part of it."""
    scan, stack = Scan(), []  # stack: (tag, what it silences)
    silent = tables = 0
    rows: list[list[str]] = []
    cell: list[str] | None = None
    for m in TOKEN.finditer(source):
        tag = m["tag"] and m["tag"].lower()
        if m["text"] is not None:
            if not silent and tables:
                if cell is not None:
                    cell.append(html.unescape(m["text"]))
            elif not silent:
                scan.prose.append(html.unescape(m["text"]))
        elif tag and not m["end"]:
            mute = tag in SILENT or bool(HIDDEN.search(m["rest"]))
            closed = tag in VOID or m["rest"].rstrip().endswith("/")
            if mute and not silent:
                scan.end_paragraph()
            if not closed:
                stack.append((tag, mute))
                silent += mute
            if silent or mute:
                continue
            if PAGE_BREAK.search(m["rest"]):
                scan.turn_page()
            if tag == "table" and not closed:
                if not tables:
                    scan.end_paragraph()
                    rows, cell = [], None
                tables += 1
            elif tables and tag == "tr":
                rows.append([])
            elif tables and tag in ("td", "th"):
                cell = []
            elif not tables and tag in BREAKING:
                scan.end_paragraph()
        elif tag and any(t == tag for t, _ in stack):
            while True:  # what was left open inside closes too
                top, mute = stack.pop()
                silent -= mute
                if not silent and not mute:
                    if tables and top in ("td", "th") and cell is not None:
                        if not rows:
                            rows.append([])
                        rows[-1].append(_tidy("".join(cell)))
                        cell = None
                    elif top == "table" and tables:
                        tables -= 1
                        if not tables:
                            scan.end_table(rows)
                    elif not tables and top in BREAKING:
                        scan.end_paragraph()
                if top == tag:
                    break
    scan.end_paragraph()
    return scan


def parsed_rows(document: int, source: str | None) -> list[dict]:
    """A document's rows; a section ends on the page where the next begins, the last on the last page."""
    scan = scanned(source or "")
    sections = [r for r in scan.rows if r["kind"] == "section"]
    for a, b in zip(sections, sections[1:], strict=False):
        a["end_page"] = b["page"]
    if sections:
        sections[-1]["end_page"] = scan.page
    return [{"document_id": document, **r} for r in scan.rows]


def parsed(df: DataFrame, document: str = "document_id", source: str = "html") -> DataFrame:
    """Sections, blocks and tables of each document of `df` (one row a document); null and empty markup has none."""
    columns = [c.strip().split(" ")[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for d, s in zip(batch["document_id"], batch["html"], strict=True) for r in parsed_rows(d, s)]
            if rows:
                out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})
                yield out.astype({c: "Int32" for c in ("ordinal", "page", "section", "level", "end_page")} | {"document_id": "Int64"})

    return df.selectExpr(f"{document} as document_id", f"{source} as html").mapInPandas(run, ROWS)
