"""Snippet candidates of extracted documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions.terms import KeywordRules, any_term, with_keyword_score
from policyspark.functions.text import candidate_id, col, first_filled, let, snippets
from policyspark.operators.ordinals import with_running_totals
from policyspark.session import cut_lineage
from policyspark.vocabulary import (
    MAX_SNIPPET_CHARS, MIN_SNIPPET_CHARS, SNIPPET_NEGATIVE, SNIPPET_POSITIVE,
)

LABEL_SLOTS = {
    "policy_area": "string", "instrument_type": "string", "target_sectors": "array<string>",
    "climate_dimension": "string", "governance_type": "string", "funding_available": "boolean",
}


def accepts(snippet: Column, lowered: Column, rules: KeywordRules | None = None,
            positive: Sequence[str] = tuple(SNIPPET_POSITIVE), negative: Sequence[str] = tuple(SNIPPET_NEGATIVE),
            min_chars: int = MIN_SNIPPET_CHARS) -> Column:
    """Long enough, no negative term, and a positive term or passing keyword rules."""
    # most snippets lack a positive term, so the negative list is tested last
    found = any_term(lowered, positive) if rules is None else rules.passes(lowered if rules.fold_case else snippet)
    return (F.length(snippet) >= min_chars) & found & ~any_term(lowered, negative)


def snippet_candidates(
    documents: DataFrame, rules: KeywordRules | None = None, *,
    positive: Sequence[str] = tuple(SNIPPET_POSITIVE), negative: Sequence[str] = tuple(SNIPPET_NEGATIVE),
    min_chars: int = MIN_SNIPPET_CHARS, max_chars: int = MAX_SNIPPET_CHARS,
    order: str | None = None,
) -> DataFrame:
    """One row per accepted snippet with its candidate id.

    Splitting, testing and numbering all happen inside the document's own row,
    so the whole operator is a map without any shuffle (and runs unchanged on a
    stream). With ``order`` set, documents sharing a (municipality, document)
    key continue each other's numbering in that order; that costs one pass of
    per-document counts.
    """
    have = set(documents.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    # A document without any id is named by its content: stable under re-reads,
    # unlike a read-order number.
    own_id = F.concat(F.lit("doc"), F.sha2(F.concat_ws("\n", c("url"), c("text")), 256))
    docs = documents.where(F.coalesce(F.col("text"), F.lit("")) != "").select(
        F.coalesce(first_filled(c("document_id").cast("string"), c("id").cast("string")), own_id).alias("document_id"),
        c("municipality_id").alias("municipality_id"),
        c("municipality").alias("municipality"),
        F.coalesce(c("title"), F.lit("")).alias("title"),
        first_filled(c("url"), c("source_url")).alias("url"),
        *([F.col(order).alias("__order")] if order else []),
        F.filter(
            F.transform(snippets("text", max_chars), lambda s: F.struct(s.alias("snippet"), F.lower(s).alias("low"))),
            lambda s: accepts(s["snippet"], s["low"], rules, positive, negative, min_chars),
        ).alias("__snippets"),
    )

    if order:
        docs = docs.withColumn("__key", F.coalesce(F.col("municipality_id").cast("string"), F.lit("")))
        # Accepted snippets are a small part of the texts: keep them, instead of
        # cutting every text again for the second pass.
        docs = with_running_totals(
            cut_lineage(docs), ["__key", "document_id"], ["__order"], {"__offset": F.size("__snippets").cast("long")},
        ).drop("__key", "__order")
    else:
        docs = docs.withColumn("__offset", F.lit(0).cast("long"))

    # The inner form would make the optimizer add "size(...) > 0" below the
    # generator, which computes every snippet list a second time.
    flat = docs.select("*", F.posexplode_outer("__snippets.snippet").alias("__pos", "snippet")).drop("__snippets")
    flat = flat.where(F.col("snippet").isNotNull())
    out = flat.withColumns({
        "candidate_id": candidate_id(
            F.col("municipality_id"), F.col("document_id"), F.col("__offset") + F.col("__pos")),
        "keyword_hit": F.lit(True) if rules is None else let(F.lower("snippet"), lambda t: any_term(t, positive)),
    })
    if rules is None:
        out = out.withColumns({
            "confidence_score": F.lit(0.0),
            "keyword_hits_general": F.array().cast("array<string>"),
            "keyword_hits_thematic": F.create_map().cast("map<string,array<string>>"),
            "keyword_negative_hits": F.lit(None).cast(
                "struct<general:array<string>,thematic:map<string,array<string>>>"),
        })
    else:
        out = with_keyword_score(out, "snippet", rules).drop("passes_filter")
    out = out.withColumns({name: F.lit(None).cast(kind) for name, kind in LABEL_SLOTS.items()})
    return out.select(
        "candidate_id", "document_id", "municipality_id", "municipality", "title", "snippet", "url",
        *LABEL_SLOTS, "keyword_hit", "confidence_score", "keyword_hits_general", "keyword_hits_thematic",
        "keyword_negative_hits",
    )


def keyword_grep(documents: DataFrame, terms: Sequence[str], preview_chars: int = 300) -> DataFrame:
    """Documents whose title or text holds one of the terms, the terms found and a flat preview."""
    from policyspark.functions.terms import term_hits

    haystack = F.lower(F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text"), F.lit(""))))
    hits = documents.withColumn("hit_words", term_hits(haystack, terms)).where(F.size("hit_words") > 0)
    flat = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(" "))
    return hits.withColumn("preview", F.substring(flat, 1, preview_chars))


def term_frequencies(documents: DataFrame, text: Column | str, terms: Sequence[str]) -> DataFrame:
    """Number of texts containing each term; counts are combined before the shuffle."""
    from policyspark.functions.terms import term_hits

    return (
        documents.select(F.explode_outer(term_hits(F.lower(col(text)), terms)).alias("term"))
        .where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
    )
