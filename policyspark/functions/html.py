"""Page parsing: one tolerant pass over the markup per page, in Arrow batches.

``page_parts`` returns only the fields asked for, so that no text crosses the
Python boundary that the plan does not use.
"""

from __future__ import annotations

from collections.abc import Iterable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from policyspark.functions.text import col

# --- fixed values: elements without content / with non-text content ----------
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
OPAQUE_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
DROPPED_TAGS = frozenset(["script", "style", "noscript"])

LINK_TYPE = "array<struct<pos:int,href:string,url:string,anchor:string>>"
FIELD_TYPES = {
    "title": "string",            # text of the title element, null when blank
    "title_or_h1": "string",      # the same, else the first h1
    "text": "string",             # all text, whitespace collapsed to single spaces
    "text_spaced": "string",      # stripped text pieces joined by one space
    "text_lines": "string",       # one piece per line, without script/style/noscript
    "has_form": "boolean",
    "has_pdf_download": "boolean",
    "has_contact_email": "boolean",
    "links": LINK_TYPE,           # every a[href], anchor text from all descendants
    "anchors": LINK_TYPE,         # closed a[href] only, anchor text up to the next a
}


class _PageReader(HTMLParser):
    """Collects text pieces and links while tracking the open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[str, bool, bool]] = []   # text, readable, inside a dropped element
        self.spans: dict[str, list] = {}                 # first title / h1 -> [start, end] in pieces
        self.links: list[list] = []                      # href, start, end in pieces
        self.closed_links: list[tuple[str, str]] = []
        self.forms = False
        self._open: list[tuple[str, object]] = []
        self._count: dict[str, int] = {}
        self._pending: list[str] = []
        self._anchor: list | None = None

    def _inside(self, tags: Iterable[str]) -> bool:
        return any(self._count.get(t) for t in tags)

    def _flush(self) -> None:
        if self._pending:
            text = "".join(self._pending)
            self._pending = []
            self.pieces.append((text, not self._inside(OPAQUE_TAGS), self._inside(DROPPED_TAGS)))

    def handle_starttag(self, tag, attrs):
        self._flush()
        span = None
        at = len(self.pieces)
        if tag in ("title", "h1") and tag not in self.spans:
            span = self.spans[tag] = [at, None]
        if tag == "form" and not self._inside(DROPPED_TAGS):
            self.forms = True
        if tag == "a":
            hrefs = [v for k, v in attrs if k == "href"]
            self._anchor = [hrefs[-1] if hrefs else None, []]
            if hrefs and hrefs[-1] is not None:
                span = [hrefs[-1], at, None, self._inside(DROPPED_TAGS)]
                self.links.append(span)
            elif hrefs:
                span = ["", at, None, self._inside(DROPPED_TAGS)]
                self.links.append(span)
        if tag not in VOID_TAGS:
            self._open.append((tag, span))
            self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag == "a" and self._anchor is not None:
            href, parts = self._anchor
            if href:
                self.closed_links.append((href, " ".join(p for p in parts if p)))
            self._anchor = None
        while self._count.get(tag):
            name, span = self._open.pop()
            self._count[name] -= 1
            if span is not None:
                span[2 if name == "a" else 1] = len(self.pieces)
            if name == tag:
                break

    def handle_data(self, data):
        self._pending.append(data)
        if self._anchor is not None:
            self._anchor[1].append(data.strip())

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def finish(self) -> None:
        self.close()
        self._flush()

    def readable(self, start: int = 0, end: int | None = None) -> list[str]:
        return [text for text, ok, _ in self.pieces[start:end] if ok]

    def stripped(self, start: int = 0, end: int | None = None) -> list[str]:
        return [s for s in (t.strip() for t in self.readable(start, end)) if s]


def _absolute(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def read_page(html: str | None, base_url: str | None, fields: Iterable[str]) -> dict:
    """The requested parts of one page; all null for a missing page."""
    if not html:
        return {f: None for f in fields}
    reader = _PageReader()
    reader.feed(html)
    reader.finish()
    base = base_url or ""
    out: dict = {}
    title_span = reader.spans.get("title")
    for name in fields:
        if name == "title":
            out[name] = ("".join(reader.stripped(*title_span)) or None) if title_span else None
        elif name == "title_or_h1":
            raw = "".join(reader.readable(*title_span)) if title_span else ""
            if raw:
                out[name] = raw.strip()
            else:
                h1 = reader.spans.get("h1")
                out[name] = ("".join(reader.stripped(*h1)) if h1 else "") or None
        elif name == "text":
            out[name] = " ".join("\n".join(reader.readable()).split()) or None
        elif name == "text_spaced":
            out[name] = " ".join(reader.stripped())
        elif name == "text_lines":
            kept = [t.strip() for t, ok, dropped in reader.pieces if ok and not dropped]
            lines = "\n".join(k for k in kept if k).splitlines()
            out[name] = "\n".join(line for line in lines if line.strip())
        elif name == "has_form":
            out[name] = reader.forms
        elif name == "has_pdf_download":
            out[name] = any(
                _absolute(base, link[0]).lower().endswith(".pdf") for link in reader.links if not link[3]
            )
        elif name == "has_contact_email":
            out[name] = "mailto:" in html
        elif name == "links":
            out[name] = [
                {"pos": i, "href": href, "url": _absolute(base, href), "anchor": " ".join(reader.stripped(a, b))}
                for i, (href, a, b, _) in enumerate(reader.links)
            ]
        elif name == "anchors":
            out[name] = [
                {"pos": i, "href": href, "url": _absolute(base, href), "anchor": anchor}
                for i, (href, anchor) in enumerate(reader.closed_links)
            ]
    return out


def page_parts(html: Column | str, base_url: Column | str, fields: Iterable[str]) -> Column:
    """Struct column of the requested page fields (see ``FIELD_TYPES``)."""
    names = list(fields)
    unknown = [n for n in names if n not in FIELD_TYPES]
    if unknown:
        raise ValueError(f"unknown page fields: {unknown}")
    schema = "struct<" + ",".join(f"{n}:{FIELD_TYPES[n]}" for n in names) + ">"

    @F.pandas_udf(schema)
    def parse(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        rows = [read_page(p, b, names) for p, b in zip(pages, bases)]
        return pd.DataFrame(rows, columns=names)

    return parse(col(html), col(base_url))


def decode_page(content: Column | str) -> Column:
    """UTF-8 text of raw bytes, invalid sequences replaced instead of failing."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="replace"))

    return decode(col(content))


def digitalization_level(has_form: Column | str, has_pdf: Column | str, has_contact: Column | str) -> Column:
    return (
        F.when(col(has_form), "ONLINE_FORM")
        .when(col(has_pdf), "PDF_DOWNLOAD")
        .when(col(has_contact), "CONTACT_ONLY")
        .otherwise("UNKNOWN")
    )


def declared_digitalization(url: Column | str, html: Column | str, text: Column | str, levels: list[dict]) -> Column:
    """Highest level with any of its indicators; its negative texts switch a level off. Null if none."""
    from policyspark.functions.terms import any_term

    url, html, text = col(url), col(html), col(text)
    found = []
    for level in levels:
        suffix = F.lit(False)
        for ending in level.get("url_suffix", ()):
            suffix = suffix | F.coalesce(F.lower(url).endswith(ending), F.lit(False))
        hit = (
            suffix
            | any_term(url, level.get("url_contains", ()))
            | any_term(html, level.get("html_contains", ()))
            | any_term(text, level.get("text_contains", ()))
        )
        hit = hit & ~any_term(text, level.get("negative_text", ()))
        found.append(F.when(hit, F.lit(int(level["id"]))))
    return F.greatest(*found) if len(found) > 1 else found[0]
