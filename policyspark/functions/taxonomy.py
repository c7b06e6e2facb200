"""Closed vocabularies: membership, parsing, fall-backs, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.functions.text import col, filled_after_strip, let, strip
from policyspark.vocabulary import BASELINE_FALLBACKS, INSTRUMENT_ALIASES, TAXONOMIES


def choices(scheme: str, dimension: str) -> list[str]:
    return list(TAXONOMIES[scheme][dimension])


def taxonomy_table(spark: SparkSession, labels: dict | None = None) -> DataFrame:
    """Dimension table (scheme, dimension, id, name, position[, label])."""
    rows = [
        (scheme, dimension, value, value.upper(), position)
        for scheme, dimensions in (labels or TAXONOMIES).items()
        for dimension, values in dimensions.items()
        for position, value in enumerate(values)
    ]
    return spark.createDataFrame(rows, "scheme string, dimension string, id string, name string, position int")


def is_member(c: Column | str, scheme: str, dimension: str) -> Column:
    """False, not null, for null input."""
    return F.coalesce(col(c).isin(choices(scheme, dimension)), F.lit(False))


def member_or(c: Column | str, scheme: str, dimension: str, fallback: str) -> Column:
    return F.when(is_member(c, scheme, dimension), col(c)).otherwise(F.lit(fallback))


def members_or(labels: Column | str, scheme: str, dimension: str, fallback: str) -> Column:
    kept = F.filter(col(labels), lambda x: x.isin(choices(scheme, dimension)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fallback)))


def baseline_member(c: Column | str, dimension: str) -> Column:
    return member_or(c, "baseline", dimension, BASELINE_FALLBACKS[dimension])


def label_key(c: Column | str) -> Column:
    """Machine-readable key: lower case, everything but a-z0-9 as single underscores."""
    return F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def parse_label(c: Column | str, scheme: str, dimension: str, default: str | None = None) -> Column:
    """Exact id, else normalised id, else member name; ``default`` when nothing fits."""
    values = choices(scheme, dimension)
    fallback = F.lit(default).cast("string")

    def by_key(key: Column) -> Column:
        # member names are the ids in upper case, so their keys are the ids
        return F.when(key.isin(values), key).otherwise(fallback)

    return let(
        filled_after_strip(c),
        lambda raw: F.when(raw.isNull(), fallback).when(raw.isin(values), raw).otherwise(let(label_key(raw), by_key)))


def parse_labels(labels: Column | str, scheme: str, dimension: str) -> Column:
    """Parse each element; drop what does not fit and repeats, keep the order."""
    parsed = F.transform(col(labels), lambda x: parse_label(x, scheme, dimension))
    return F.coalesce(F.array_distinct(F.array_compact(parsed)), F.array().cast("array<string>"))


def parse_label_text(c: Column | str, scheme: str, dimension: str) -> Column:
    """The same for one comma or semicolon separated string."""
    return parse_labels(F.split(col(c), "[;,]+"), scheme, dimension)


def label_names(c: Column | str) -> Column:
    """Member names of ids (upper case), for debug output."""
    return F.upper(col(c))


def instrument_from_alias(c: Column | str) -> Column:
    """Canonical instrument id of a free label, null when unknown."""
    key = F.lower(strip(c))
    canonical = choices("canonical", "instrument_type")
    pairs = [x for alias, target in INSTRUMENT_ALIASES.items() for x in (F.lit(alias), F.lit(target))]
    return F.when(key.isin(canonical), key).otherwise(F.element_at(F.create_map(*pairs), key))


LABEL_DIMENSIONS = {
    "policy_area": "policy_area", "instrument_type": "instrument_type",
    "climate_dimension": "climate_dimension", "governance_type": "governance_type",
    "funding_available": "funding_available",
}


def label_bundle(df: DataFrame, scheme: str = "enum", debug: bool = False) -> DataFrame:
    """Parse the six label columns of a record table; missing columns become null/empty."""
    present = set(df.columns)
    out = {
        name: parse_label(name, scheme, dim) if name in present else F.lit(None).cast("string")
        for name, dim in LABEL_DIMENSIONS.items()
    }
    out["target_sectors"] = (
        parse_labels("target_sectors", scheme, "target_sector") if "target_sectors" in present
        else F.array().cast("array<string>")
    )
    if debug:
        out = {n: F.transform(c, F.upper) if n == "target_sectors" else F.upper(c) for n, c in out.items()}
    return df.withColumns(out)
