"""Raw crawl records of either shape -> one extracted document shape."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions.html import page_parts
from policyspark.functions.terms import any_term
from policyspark.functions.text import cap, col, filled_after_strip, first_filled, first_not_blank, let
from policyspark.functions.urls import is_pdf, last_segment


def _columns(df: DataFrame):
    have = set(df.columns)

    def c(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    return c


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/.]\.([^./]+)$", 1))


def extracted_documents(raw: DataFrame, stored_html: str | None = None, pdf_text: str | None = None,
                        pdf_title: str | None = None) -> DataFrame:
    """Both raw formats -> municipality_id, url, title, text, doc_kind and metadata.

    ``stored_html`` names a column with the decoded page file of ``raw_path``
    (joined by the page source); ``pdf_text``/``pdf_title`` name columns of
    already extracted PDF content. The suffix of raw_path decides the kind,
    inline HTML is the fall-back. The page is parsed once, after the cheap
    routing, and leaves the plan right there.
    """
    c = _columns(raw)
    suffix = _suffix(c("raw_path"))
    has_path = F.coalesce(c("raw_path"), F.lit("")) != ""
    route = F.when(has_path & (suffix == "pdf"), "pdf").when(
        has_path & suffix.isin("html", "htm"), "stored").otherwise("inline")
    stored = F.col(stored_html) if stored_html else F.lit(None).cast("string")
    shaped = raw.select(
        first_filled(c("municipality_id").cast("string"), c("muni").cast("string")).alias("municipality_id"),
        first_filled(c("source_url"), c("url")).alias("url"),
        first_filled(c("mime_type"), c("ct")).alias("mime_type"),
        first_filled(c("http_status").cast("string"), c("status").cast("string")).try_cast("int").alias("http_status"),
        c("depth").alias("depth"), c("raw_path").alias("raw_path"), c("kept", "boolean").alias("kept"),
        *([c("document_id").alias("document_id")] if "document_id" in raw.columns else []),
        route.alias("__route"),
        F.when(route == "stored", stored).when(route == "inline", c("raw_content")).alias("__html"),
        F.when(route == "pdf", F.col(pdf_text) if pdf_text else F.lit(None).cast("string")).alias("__pdf_text"),
        F.when(route == "pdf", F.col(pdf_title) if pdf_title else F.lit(None).cast("string")).alias("__pdf_title"),
    )
    parsed = shaped.withColumn("__page", page_parts("__html", "url", ["title", "text"])).drop("__html")
    pdf = F.col("__route") == "pdf"
    title = F.when(pdf, filled_after_strip("__pdf_title")).otherwise(F.col("__page.title"))
    text = F.when(pdf, filled_after_strip(F.regexp_replace("__pdf_text", r"(?U)[\s\x1c-\x1f]+", " "))).otherwise(
        F.col("__page.text"))
    kind = F.when(pdf, "pdf").when(F.col("__route") == "stored", "html").otherwise(
        F.when(F.col("__page.text").isNotNull(), "html").otherwise("unknown"))
    return parsed.withColumns({"title": title, "text": text, "doc_kind": kind}).select(
        "municipality_id", *(["document_id"] if "document_id" in raw.columns else []), "url", "title", "text",
        "doc_kind", "mime_type", "http_status", "depth", "raw_path", "kept",
    )


def keep_extracted(documents: DataFrame) -> DataFrame:
    """Rows with a url and at least a text or a title."""
    def present(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    return documents.where(present("url") & (present("text") | present("title")))


def scope_documents(raw: DataFrame, pdf_text: str | None = None) -> DataFrame:
    """The scope-run extraction: MIME aliases, html/pdf/skip routing, empty PDFs kept."""
    c = _columns(raw)
    header = (
        F.col("headers")["Content-Type"] if "headers" in raw.columns else F.lit(None).cast("string")
    )
    mime = F.lower(first_filled(c("mime_type"), c("content_type"), header, default=""))
    url = first_filled(c("source_url"), c("url"), default="")
    base = raw.withColumns({
        "__mime": mime, "__url": url, "__html": F.coalesce(c("raw_content"), F.lit("")),
    }).withColumn("__pdf", is_pdf("__mime", "__url", "extract"))
    html = (F.col("__mime").startswith("text/html") | ~F.col("__pdf")) & (F.col("__html") != "")
    base = base.withColumn("__route", F.when(html, "html").when(F.col("__pdf"), "pdf")).where("__route is not null")
    base = base.withColumn(
        "__page", page_parts(F.when(F.col("__route") == "html", F.col("__html")), "__url", ["title_or_h1", "text_spaced"]))
    by_pdf = F.col("__route") == "pdf"
    text = F.when(by_pdf, F.coalesce(F.col(pdf_text) if pdf_text else F.lit(""), F.lit(""))).otherwise(
        F.coalesce("__page.text_spaced", F.lit("")))
    title = F.when(by_pdf, first_filled(c("title"), last_segment("__url"), default="")).otherwise(
        F.coalesce("__page.title_or_h1", F.lit("")))
    out = base.select(
        c("municipality_id").alias("municipality"), c("document_id").alias("document_id"),
        F.col("__url").alias("url"), title.alias("title"), text.alias("text"),
        F.when(by_pdf & (F.col("__mime") == ""), "application/pdf").otherwise(F.col("__mime")).alias("mime_type"),
        c("referrer_url").alias("referrer_url"), c("http_status").alias("http_status"),
        c("crawl_timestamp").alias("crawl_timestamp"), c("depth").alias("depth"), F.col("__pdf").alias("__pdf"),
    )
    return out.where(filled_after_strip("text").isNotNull() | F.col("__pdf")).drop("__pdf")


def labeler_fields(candidates: DataFrame, max_chars: int | None = None, batch_rules: bool = True) -> DataFrame:
    """(pick_text, pick_title, pick_url, pick_scope) of candidate records.

    ``batch_rules`` tries more text fields and ignores blank values; the other
    rule set takes text before snippet and decides before stripping.
    """
    c = _columns(candidates)
    if batch_rules:
        text = first_not_blank(*[c(n) for n in ("text", "snippet", "text_snippet", "evidence_snippet", "content")])
        scope = first_not_blank(c("municipality_id"), c("municipality"), c("scope"))
        url = first_not_blank(c("url"), c("source_url"))
    else:
        text = first_filled(c("text"), c("snippet"))
        scope = first_filled(c("municipality_id").cast("string"), c("municipality").cast("string"))
        url = filled_after_strip(first_filled(c("url"), c("source_url")))
    return candidates.withColumns({
        "pick_text": cap(F.coalesce(text, F.lit("")), max_chars),
        "pick_title": F.coalesce(filled_after_strip(c("title")), F.lit("")),
        "pick_url": url, "pick_scope": scope,
    })


@dataclass(frozen=True)
class PageFilter:
    """Declared page filters; empty lists and None switch a test off."""

    allowed_mime: Sequence[str] = ()
    disallowed_mime: Sequence[str] = ()
    min_chars: int | None = None
    max_chars: int | None = None
    include_fragments: Sequence[str] = ()
    exclude_fragments: Sequence[str] = ()
    remove_control_characters: bool = False


def _mime_pattern(kinds: Sequence[str]) -> str:
    return "^(" + "|".join(k.lower().replace(".", r"\.").replace("+", r"\+").replace("*", ".*") for k in kinds) + ")$"


def filter_pages(pages: DataFrame, rules: PageFilter, mime: str = "mime_type", url: str = "url",
                 text: str = "text") -> DataFrame:
    """Apply the declared filters, column tests before text tests."""
    out = pages
    kind = F.lower(F.coalesce(col(mime), F.lit(""))) if mime in pages.columns else None
    if kind is not None and rules.allowed_mime:
        out = out.where(kind.rlike(_mime_pattern(rules.allowed_mime)))
    if kind is not None and rules.disallowed_mime:
        out = out.where(~kind.rlike(_mime_pattern(rules.disallowed_mime)))
    link = F.lower(F.coalesce(F.col(url), F.lit("")))
    if rules.include_fragments:
        out = out.where(let(link, lambda u: any_term(u, rules.include_fragments)))
    if rules.exclude_fragments:
        out = out.where(~let(link, lambda u: any_term(u, rules.exclude_fragments)))
    if rules.remove_control_characters:
        out = out.withColumn(text, F.regexp_replace(text, r"[\p{Cntrl}&&[^\r\n\t]]", ""))
    if rules.min_chars is not None:
        out = out.where(F.length(text) >= rules.min_chars)
    if rules.max_chars is not None:
        out = out.where(F.length(text) <= rules.max_chars)
    return out


def inspect_documents(documents: DataFrame, order: str, limit: int, municipality: str | None = None,
                      contains: str | None = None, only_pdf: bool = False, preview_chars: int = 200) -> DataFrame:
    """First rows for manual inspection, with a flat text preview (the limit is the feature)."""
    c = _columns(documents)
    rows = documents
    if municipality:
        rows = rows.where(c("municipality") == municipality)
    if contains:
        rows = rows.where(F.concat(
            F.coalesce(c("title"), F.lit("")), F.lit(" "), F.coalesce(c("text"), F.lit(""))).contains(contains))
    if only_pdf:
        rows = rows.where(is_pdf(c("mime_type"), first_filled(c("url"), c("source_url")), "inspect"))
    flat = F.replace(F.coalesce(c("text"), F.lit("")), F.lit("\n"), F.lit(" "))
    return rows.withColumn("preview", F.substring(flat, 1, preview_chars)).orderBy(order).limit(limit)
