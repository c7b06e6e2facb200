"""Document type cascade and rule-based baseline labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark import vocabulary as V
from policyspark.functions.taxonomy import baseline_member, members_or
from policyspark.functions.terms import any_term, count_occurrences, literal_array, term_hits
from policyspark.functions.text import col, ellipsis, first_filled, let, strip


@dataclass(frozen=True)
class FilterConfig:
    """Term lists and thresholds of the document type cascade."""

    strong_terms: Sequence[str] = tuple(V.STRONG_TERMS)
    supporting_terms: Sequence[str] = tuple(V.SUPPORTING_TERMS)
    min_strong_hits: int = 2
    min_total_hits: int = 3
    min_length: int = 500
    negative_title_terms: Sequence[str] = tuple(V.NEGATIVE_TITLE_TERMS)
    negative_url_fragments: Sequence[str] = tuple(V.NEGATIVE_URL_FRAGMENTS)
    funding_terms: Sequence[str] = tuple(V.FUNDING_TERMS)
    require_funding_term: bool = False
    measure_terms: Sequence[str] = ()
    admin_terms: Sequence[str] = ()
    framework_terms: Sequence[str] = ()
    navigation_title_terms: Sequence[str] = tuple(V.NAVIGATION_TITLE_TERMS)
    navigation_url_fragments: Sequence[str] = tuple(V.NAVIGATION_URL_FRAGMENTS)
    imprint_title_terms: Sequence[str] = ()
    imprint_url_fragments: Sequence[str] = ()
    news_title_terms: Sequence[str] = tuple(V.NEWS_TITLE_TERMS)
    news_url_fragments: Sequence[str] = tuple(V.NEWS_URL_FRAGMENTS)


# reason -> (document type, relevant)
OUTCOMES = {
    "empty_text": ("noise", False),
    "too_short": ("noise", False),
    "imprint_or_dataprotection": ("legal_imprint", False),
    "navigation_page": ("info_navigation", False),
    "news_or_press": ("news_article", False),
    "negative_title_terms": ("noise", False),
    "negative_url_fragment": ("noise", False),
    "too_weak_climate_signal": ("noise", False),
    "no_funding_signal": ("noise", False),
    "climate_plus_funding_signal": ("policy_measure", True),
    "measure_terms_dominate": ("policy_measure", True),
    "admin_terms_dominate": ("policy_admin", True),
    "framework_terms_present": ("policy_framework", True),
    "climate_but_no_policy_signal": ("noise", False),
}


def classification(text: Column, title: Column, url: Column, config: FilterConfig = FilterConfig()) -> Column:
    """struct of ``CLASS_COLUMNS`` for one document.

    Every stage is bound once and only evaluates its term counts when no
    earlier, cheaper stage has decided; the expression grows linearly with the
    lists however it is filtered on later.
    """
    def lowered(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    def early(x: Column) -> Column:
        t, head, link = x["text"], x["title"], x["url"]
        return (
            F.when(t == "", "empty_text")
            .when(F.length(t) < config.min_length, "too_short")
            .when(any_term(head, config.imprint_title_terms) | any_term(link, config.imprint_url_fragments),
                  "imprint_or_dataprotection")
            .when(any_term(head, config.navigation_title_terms) | any_term(link, config.navigation_url_fragments),
                  "navigation_page")
            .when(any_term(head, config.news_title_terms) | any_term(link, config.news_url_fragments), "news_or_press")
            .when(any_term(head, config.negative_title_terms), "negative_title_terms")
            .when(any_term(link, config.negative_url_fragments), "negative_url_fragment")
        )

    def counted(open_row: Column, c: Column, terms: Sequence[str]) -> Column:
        return F.when(open_row, count_occurrences(c, terms)).otherwise(0)

    def after_early(x: Column, reason: Column) -> Column:
        open_row = reason.isNull()
        return let(
            F.struct(counted(open_row, x["text"], config.strong_terms).alias("strong"),
                     counted(open_row, x["text"], config.supporting_terms).alias("supporting")),
            lambda h: let(middle(x, reason, h), lambda m: after_middle(x, m, h)))

    def middle(x: Column, reason: Column, h: Column) -> Column:
        weak = (h["strong"] < config.min_strong_hits) | (h["strong"] + h["supporting"] < config.min_total_hits)
        out = F.when(reason.isNotNull(), reason).when(weak, "too_weak_climate_signal")
        if config.require_funding_term:
            funded = any_term(x["text"], config.funding_terms) | any_term(x["title"], config.funding_terms)
            out = out.when(~funded, "no_funding_signal")
        return out

    groups = {"measure": config.measure_terms, "admin": config.admin_terms, "framework": config.framework_terms}

    def after_middle(x: Column, reason: Column, h: Column) -> Column:
        open_row = reason.isNull()
        return let(
            F.struct(*[counted(open_row, x["text"], terms).alias(g) for g, terms in groups.items()]),
            lambda k: let(
                F.struct(*[
                    (k[g] + F.when(open_row & any_term(x["title"], terms), 2).otherwise(0)).alias(g)
                    for g, terms in groups.items()
                ]),
                lambda score: let(contest(reason, score), lambda r: result(r, h, k))))

    def contest(reason: Column, score: Column) -> Column:
        m, a, f = score["measure"], score["admin"], score["framework"]
        return (
            F.when(reason.isNotNull(), reason)
            .when((m == 0) & (a == 0) & (f == 0), "climate_plus_funding_signal")
            .when(m >= F.greatest(a, f, F.lit(1)), "measure_terms_dominate")
            .when(a >= F.greatest(m, f, F.lit(1)), "admin_terms_dominate")
            .when(f > 0, "framework_terms_present")
            .otherwise("climate_but_no_policy_signal")
        )

    types = F.create_map(*[x for r, (kind, _) in OUTCOMES.items() for x in (F.lit(r), F.lit(kind))])
    relevant = [r for r, (_, keep) in OUTCOMES.items() if keep]

    def result(reason: Column, h: Column, k: Column) -> Column:
        return F.struct(
            F.element_at(types, reason).alias("doc_type"), reason.isin(relevant).alias("is_policy_relevant"),
            reason.alias("reason"), h["strong"].alias("strong_hits"), h["supporting"].alias("supporting_hits"),
            *[k[g].alias(f"{g}_hits") for g in groups])

    fields = F.struct(lowered(text).alias("text"), lowered(title).alias("title"), lowered(url).alias("url"))
    return let(fields, lambda x: let(early(x), lambda reason: after_early(x, reason)))


def classify_documents(documents: DataFrame, config: FilterConfig = FilterConfig(), text: str = "text",
                       title: Column | str = "title", url: Column | str = "url") -> DataFrame:
    """Add doc_type, is_policy_relevant, reason and five hit counts."""
    tagged = documents.withColumn("__class", classification(F.col(text), col(title), col(url), config))
    return tagged.select(*documents.columns, "__class.*")


CLASS_COLUMNS = ["doc_type", "is_policy_relevant", "reason", "strong_hits", "supporting_hits", "measure_hits",
                 "admin_hits", "framework_hits"]


def relevant_documents(documents: DataFrame, config: FilterConfig = FilterConfig(), **columns) -> DataFrame:
    """Only the policy-relevant documents, in their input shape."""
    return classify_documents(documents, config, **columns).where("is_policy_relevant").select(*documents.columns)


def filter_stats(documents: DataFrame, config: FilterConfig = FilterConfig(), **columns) -> DataFrame:
    """One row: documents seen and documents kept."""
    return classify_documents(documents, config, **columns).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_policy_relevant").alias("kept"))


@dataclass(frozen=True)
class BaselineRules:
    """Ordered cascades of the baseline labels."""

    areas: Sequence[tuple[str, Sequence[str]]] = tuple(V.BASELINE_AREA_RULES)
    instruments: Sequence[tuple[str, Sequence[str]]] = tuple(V.BASELINE_INSTRUMENT_RULES)
    sectors: Sequence[tuple[str, Sequence[str]]] = tuple(V.BASELINE_SECTOR_RULES)
    mitigation: Sequence[str] = tuple(V.BASELINE_MITIGATION_TERMS)
    adaptation: Sequence[str] = tuple(V.BASELINE_ADAPTATION_TERMS)
    funding: Sequence[str] = tuple(V.BASELINE_FUNDING_TERMS)
    distinct_sectors: bool = False


def _cascade(found: Column, rules, default: str) -> tuple[Column, Column]:
    """(label, triggered terms) of the first rule with any hit; later rules stay silent."""
    label, hits = None, None
    for name, terms in rules:
        wanted = literal_array(terms)
        overlap = F.arrays_overlap(found, wanted)
        label = F.when(overlap, name) if label is None else label.when(overlap, name)
        mine = F.array_intersect(wanted, found)
        hits = F.when(overlap, mine) if hits is None else hits.when(overlap, mine)
    return label.otherwise(default), hits.otherwise(literal_array([]))


def baseline_labels(candidates: DataFrame, rules: BaselineRules = BaselineRules()) -> DataFrame:
    """Rule-based measure row per candidate."""
    have = set(candidates.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    title = F.coalesce(c("title"), F.lit(""))
    body = first_filled(c("snippet"), c("text"), default="")
    base = candidates.select(
        first_filled(c("candidate_id").cast("string"), c("id").cast("string"), default="").alias("candidate_id"),
        first_filled(c("municipality_id").cast("string"), c("municipality").cast("string")).alias("municipality_id"),
        c("municipality").alias("municipality"),
        c("document_id").alias("document_id"),
        c("document_id").alias("source_document_id"),
        first_filled(c("url"), c("source_url")).alias("source_url"),
        title.alias("__title"),
        strip(F.concat(title, F.lit("\n"), body)).alias("__full"),
    ).withColumn("__text", F.lower("__full"))
    t = F.col("__text")

    # The long text is scanned once per distinct term; all rules then work on
    # the short list of terms found.
    lists = [terms for _, terms in (*rules.areas, *rules.instruments, *rules.sectors)]
    lists += [rules.mitigation, rules.adaptation, rules.funding]
    every_term = list(dict.fromkeys(term for terms in lists for term in terms))
    base = base.withColumn("__found", term_hits(t, every_term)).drop("__text")
    found = F.col("__found")

    def has(terms: Sequence[str]) -> Column:
        return F.arrays_overlap(found, literal_array(terms))

    area, area_hits = _cascade(found, rules.areas, "other")
    instrument, instrument_hits = _cascade(found, rules.instruments, "other")
    mitigates, adapts = has(rules.mitigation), has(rules.adaptation)
    sectors = F.array_compact(F.array(*[F.when(has(terms), F.lit(name)) for name, terms in rules.sectors]))
    if rules.distinct_sectors:
        sectors = F.array_distinct(sectors)
    always = [t for _, terms in rules.sectors for t in terms]
    always += [*rules.mitigation, *rules.adaptation, *rules.funding]
    triggered = F.concat(area_hits, instrument_hits, F.array_intersect(found, literal_array(always)))
    labelled = base.withColumns({
        "policy_area": baseline_member(area, "policy_area"),
        "instrument_type": baseline_member(instrument, "instrument_type"),
        "target_sectors": members_or(sectors, "baseline", "target_sector", "cross_sectoral"),
        "climate_dimension": F.when(mitigates & adapts, "both").when(mitigates, "mitigation")
        .when(adapts, "adaptation").otherwise("unspecified"),
        "governance_type": F.lit("local_municipality"),
        "funding_available": has(rules.funding),
        "baseline_keywords": F.array_sort(F.array_distinct(triggered)),
    })
    return labelled.withColumns({
        "measure_title": first_filled("__title", ellipsis("__full", 120), default=""),
        "keyword_hit": F.size("baseline_keywords") > 0,
        "label_source": F.lit(V.BASELINE_LABEL_SOURCE),
        "confidence_score": F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.1) * F.size("baseline_keywords")),
    }).select(
        "candidate_id", "municipality_id", "municipality", "document_id", "source_document_id", "source_url",
        "measure_title", "policy_area", "instrument_type", "target_sectors", "climate_dimension",
        "governance_type", "funding_available", "baseline_keywords", "keyword_hit", "label_source",
        "confidence_score",
    )
