"""URL parts, link gates and link scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from policyspark.functions.terms import any_term, term_hits
from policyspark.functions.text import col, let
from policyspark.vocabulary import CRAWL_EXCLUDED_EXTENSIONS, SEED_KEYWORDS

# RFC 3986 appendix B; groups: 2 scheme, 4 authority, 5 path. Unlike the
# built-in URL parser it also yields the path of mailto: and relative links.
_URL = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)"


def authority(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _URL, 4)


def host(url: Column | str) -> Column:
    return F.lower(authority(url))


def path(url: Column | str) -> Column:
    """Path without the ;parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(col(url), _URL, 5), ";[^/]*$", "")


def without_query(url: Column | str) -> Column:
    return F.substring_index(col(url), "?", 1)


def last_segment(url: Column | str) -> Column:
    return F.substring_index(col(url), "/", -1)


def mime_head(content_type: Column | str) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(col(content_type), F.lit("")), ";", 1)))


def is_pdf(mime: Column | str | None, url: Column | str | None, variant: str = "inspect") -> Column:
    """PDF test in its four variants.

    ``inspect``/``extract``: MIME contains pdf or the URL without query ends in .pdf;
    ``crawl``: MIME equals application/pdf or the URL ends in .pdf;
    ``gated``: MIME contains pdf or the URL ends in .pdf.
    """
    mime = F.lower(F.coalesce(col(mime), F.lit(""))) if mime is not None else F.lit("")
    url = F.lower(F.coalesce(col(url), F.lit(""))) if url is not None else F.lit("")
    by_mime = mime == "application/pdf" if variant == "crawl" else mime.contains("pdf")
    target = without_query(url) if variant in ("inspect", "extract") else url
    return by_mime | target.endswith(".pdf")


def has_extension(url: Column | str, extensions: Sequence[str] = tuple(CRAWL_EXCLUDED_EXTENSIONS)) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(extensions) + r")$")


def is_internal(url: Column | str, base_authority: Column | str) -> Column:
    found = authority(url)
    return (found == "") | (found == col(base_authority))


def domain_allowed(url: Column | str, domains: Column | str) -> Column:
    """Exact host match; an empty or missing list allows every host."""
    domains = F.coalesce(col(domains), F.array().cast("array<string>"))
    return (F.size(domains) == 0) | F.array_contains(F.transform(domains, F.lower), host(url))


def keyword_gate(text: Column | str, keywords: Sequence[str]) -> Column:
    return let(F.lower(col(text)), lambda t: any_term(t, [k.lower() for k in keywords]))


def link_score(url: Column | str, anchor: Column | str, keywords: Sequence[str] = tuple(SEED_KEYWORDS)) -> Column:
    """Two points per keyword in the path, two per keyword in the anchor, two for umwelt+klima paths."""
    def path_points(target: Column) -> Column:
        bonus = F.when(target.rlike("umwelt.*klima|klima.*umwelt"), 2).otherwise(0)
        return F.size(term_hits(target, keywords)) * 2 + bonus

    return let(F.lower(path(url)), path_points) + F.size(term_hits(F.lower(col(anchor)), keywords)) * 2


def fetch_decision(status: Column, content_type: Column, allowed: Sequence[str]) -> tuple[Column, Column]:
    """(kept, reason) of a fetched page before caps: status first, then content type."""
    ok_type = content_type.isin([a.lower() for a in allowed])
    kept = F.when(status >= 400, False).when(~ok_type, False).otherwise(True)
    reason = F.when(status >= 400, F.lit(None).cast("string")).when(~ok_type, F.lit("ct_filtered"))
    return kept, reason
