"""Analysis table and export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark import vocabulary as V
from policyspark.functions.text import compose_id, first_filled, one_line, prefix
from policyspark.operators.joins import lookup
from policyspark.operators.ordinals import with_row_number


def _columns(df: DataFrame):
    have = set(df.columns)

    def c(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    return c


def _flag(c: Column) -> Column:
    """Boolean of a boolean or text column; null and unreadable text are false."""
    return F.coalesce(c.try_cast("boolean"), F.lit(False))


def analysis_table(
    measures: DataFrame, documents: DataFrame, municipalities: DataFrame, scope: str, *,
    order: str = "ord", document_order: str = "ord", municipality_order: str = "ord",
    country_code: str = "DE", state_code: str = "BY", extraction_version: str = "doc_extractor_v1",
    classification_version: str = V.BASELINE_LABEL_SOURCE, excerpt_chars: int = 500,
) -> DataFrame:
    """measures joined with their documents and municipalities in the 28-column analysis shape.

    Look-ups are by (municipality_id, document_id) and municipality_id, the
    last row per key counts. ``order`` is the input position of a measure and
    drives measure_local_id.
    """
    keys = ["municipality_id", "document_id"]
    d, mu = _columns(documents), _columns(municipalities)
    docs = documents.select(
        *keys, F.col(document_order).alias("__d_order"),
        *[d(n).alias(f"__d_{n}") for n in ("crawl_timestamp", "depth", "referrer_url", "http_status", "mime_type")],
        d("title").alias("__d_title"),
        # only the excerpt travels, never the document text
        prefix(F.coalesce(d("text"), F.lit("")), excerpt_chars).alias("__d_excerpt"),
        d("keyword_hit", "boolean").try_cast("boolean").alias("__d_hit"),
    )
    names = municipalities.select(
        "municipality_id", F.col(municipality_order).alias("__m_order"),
        first_filled(mu("municipality_name"), mu("name"), mu("municipality_id")).alias("__m_name"),
    )
    m = _columns(measures)
    base = measures.dropna(subset=keys)
    numbered = with_row_number(base, keys, [order], "measure_local_id")
    joined = lookup(lookup(numbered, docs, keys, "__d_order"), names, ["municipality_id"], "__m_order")
    title = F.coalesce(F.col("__d_title"), F.lit(""))
    out = {
        "scope": F.lit(scope), "country_code": F.lit(country_code), "state_code": F.lit(state_code),
        "municipality_name": F.coalesce("__m_name", F.lit("")),
        "measure_uid": compose_id(
            F.lit(scope), F.col("municipality_id").cast("string"), F.col("document_id").cast("string"),
            F.col("measure_local_id").cast("string")),
        "source_url": F.coalesce(m("source_url"), F.lit("")),
        "crawl_timestamp": F.col("__d_crawl_timestamp"), "depth": F.col("__d_depth"),
        "referrer_url": F.col("__d_referrer_url"), "http_status": F.col("__d_http_status"),
        "mime_type": F.col("__d_mime_type"), "document_title": title,
        "measure_title": first_filled(m("measure_title"), title, default=""),
        "text_excerpt": F.coalesce("__d_excerpt", F.lit("")),
        "policy_area": first_filled(m("policy_area"), default="unspecified"),
        "instrument_type": first_filled(m("instrument_type"), default="other"),
        "target_sectors": F.coalesce(m("target_sectors", "array<string>"), F.array().cast("array<string>")),
        "climate_dimension": first_filled(m("climate_dimension"), default="unspecified"),
        "governance_type": first_filled(m("governance_type"), default="local_municipality"),
        "funding_available": _flag(m("funding_available")),
        "label_source": first_filled(m("label_source"), default=classification_version),
        "confidence_score": F.coalesce(m("confidence_score").try_cast("double"), F.lit(0.0)),
        "extraction_version": F.lit(extraction_version),
        "classification_version": F.lit(classification_version),
        "keyword_hit": F.coalesce(m("keyword_hit").try_cast("boolean"), F.col("__d_hit"), F.lit(False)),
    }
    return joined.withColumns(out).select(*V.ANALYSIS_COLUMNS)


def analysis_csv_shape(analysis: DataFrame) -> DataFrame:
    return analysis.withColumn("target_sectors", F.array_join("target_sectors", "|")).select(*V.ANALYSIS_COLUMNS)


def measure_csv_shape(measures: DataFrame) -> DataFrame:
    """The fixed 13 columns, absent ones null, the keyword list as one text."""
    c = _columns(measures)
    out = []
    for name in V.MEASURE_CSV_COLUMNS:
        value = c(name)
        if name in measures.columns and measures.schema[name].dataType.simpleString().startswith("array"):
            value = F.array_join(value, ", ")
        out.append(value.alias(name))
    return measures.select(*out)


def labeling_csv_shape(documents: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Columns for manual labelling: flat text (its first ``max_chars`` characters, if given) and five empty label columns."""
    c = _columns(documents)
    flat = one_line(F.coalesce(c("text"), F.lit("")))
    values = {n: F.coalesce(c(n).cast("string"), F.lit("")) for n in V.LABELING_COLUMNS}
    values["url"] = first_filled(c("url"), c("source_url"), default="")
    values["text"] = prefix(flat, max_chars) if max_chars else flat
    return documents.select(
        *[v.alias(n) for n, v in values.items()], *[F.lit("").alias(n) for n in V.LABELING_EMPTY_COLUMNS])


def with_gold_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.lit("") for n in V.GOLD_COLUMNS})


def measure_records(candidates: DataFrame, index: int = 0) -> DataFrame:
    """One measure per candidate: id = candidate id plus ::m{index}, description = snippet."""
    c = _columns(candidates)
    return candidates.select(
        compose_id(F.col("candidate_id"), F.lit(f"m{index}")).alias("measure_id"), "candidate_id", "document_id",
        c("municipality_id").alias("municipality_id"), c("municipality").alias("municipality"),
        F.coalesce(c("title"), F.lit("")).alias("title"),
        F.coalesce(c("snippet"), F.lit("")).alias("description"), c("url").alias("url"),
        *[c(n).alias(n) for n in ("policy_area", "instrument_type", "target_sectors", "climate_dimension",
                                  "governance_type", "funding_available")],
    )


def candidate_records(candidates: DataFrame, debug: bool = False) -> DataFrame:
    """Typed candidate rows: defaults, casts, parsed labels (member names with ``debug``)."""
    from policyspark.functions.taxonomy import label_bundle

    c = _columns(candidates)
    typed = candidates.withColumns({
        "title": F.coalesce(c("title"), F.lit("")), "snippet": F.coalesce(c("snippet"), F.lit("")),
        "keyword_hit": _flag(c("keyword_hit")),
        "confidence_score": F.coalesce(c("confidence_score").try_cast("double"), F.lit(0.0)),
    })
    return label_bundle(typed, debug=debug)
