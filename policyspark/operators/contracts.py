"""Contract checks: every row gets the list of rules it violates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark import vocabulary as V
from policyspark.functions.taxonomy import choices, is_member


def _violations(checks: Sequence[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in checks]))


GATE_DIMENSIONS = ["policy_field", "measure_type", "target_group", "jurisdiction_level"]
GATE_EVIDENCE = ["short_title", "actor", "instrument", "rationale", "evidence_quotes"]


def gate_violations(answers: DataFrame, text: str | None = None, max_title: int = 120, max_quote: int = 200,
                    max_quotes: int = 3) -> DataFrame:
    """Add ``violations`` for gate answers.

    Confidences lie in [0, 1]; a non-measure carries no taxonomy or evidence
    value; a measure has one closed label per dimension, a short title, and
    one to three short quotes that occur verbatim in ``text``.
    """
    measure = F.coalesce(F.col("is_policy_measure"), F.lit(False))

    def outside(name: str) -> Column:
        c = F.col(name)
        return F.coalesce(F.isnan(c) | (c < 0) | (c > 1), F.lit(False))

    quotes = F.coalesce("evidence_quotes", F.array().cast("array<string>"))
    checks = [
        ("gate_missing", F.col("is_policy_measure").isNull()),
        ("relevance_confidence_range", F.col("relevance_confidence").isNull() | outside("relevance_confidence")),
        ("classification_confidence_range", outside("classification_confidence")),
        ("measure_without_classification_confidence", measure & F.col("classification_confidence").isNull()),
    ]
    checks += [(f"{d}_vocabulary", measure & ~is_member(d, "gate", d)) for d in GATE_DIMENSIONS]
    checks += [
        (f"{n}_not_null", F.col("is_policy_measure").eqNullSafe(F.lit(False)) & F.col(n).isNotNull())
        for n in [*GATE_DIMENSIONS, "classification_confidence", *GATE_EVIDENCE]
    ]
    checks += [
        ("short_title_length", F.coalesce(F.length("short_title") > max_title, F.lit(False))),
        ("quote_count", measure & ((F.size(quotes) < 1) | (F.size(quotes) > max_quotes))),
        ("quote_length", F.exists(quotes, lambda q: F.length(q) > max_quote)),
    ]
    if text is not None:
        body = F.coalesce(F.col(text), F.lit(""))
        checks.append(("quote_not_verbatim", F.exists(quotes, lambda q: ~F.contains(body, q))))
    return answers.withColumn("violations", _violations(checks))


# --- fixed values: declared type -> Spark type used for the readability test --
_CASTS = {"number": "double", "integer": "bigint", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


def measure_violations(measures: DataFrame, fields: Mapping[str, tuple[str, bool]] | None = None,
                       scheme: str = "measure_v1") -> DataFrame:
    """Add ``violations``: required fields, readable types and enum membership per row."""
    have = set(measures.columns)
    checks = []
    for name, (kind, required) in (fields or V.MEASURE_FIELDS).items():
        if name not in have:
            if required:
                checks.append((f"{name}:required", F.lit(True)))
            continue
        c = F.col(name)
        is_text = measures.schema[name].dataType.simpleString() == "string"
        if required:
            checks.append((f"{name}:required", c.isNull() | ((c == "") if is_text else F.lit(False))))
        if kind.startswith("list:enum:"):
            allowed = choices(scheme, kind.removeprefix("list:enum:"))
            checks.append((f"{name}:enum", F.coalesce(F.exists(c, lambda x: ~x.isin(allowed)), F.lit(False))))
        elif kind.startswith("enum:"):
            checks.append((f"{name}:enum", c.isNotNull() & ~is_member(c, scheme, kind.removeprefix("enum:"))))
        elif kind in _CASTS and is_text:
            checks.append((f"{name}:type", c.isNotNull() & c.try_cast(_CASTS[kind]).isNull()))
    return measures.withColumn("violations", _violations(checks))


def duplicate_keys(measures: DataFrame, key: str = "measure_id") -> DataFrame:
    """Primary key values that occur more than once (hash aggregation, combined map-side)."""
    return measures.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def violation_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("violations").alias("violation")).groupBy("violation").agg(
        F.count(F.lit(1)).alias("n"))
