"""Aggregates behind the report figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions.text import col, strip
from policyspark.operators.ordinals import top_per_key

# --- fixed values: words of binary labels ------------------------------------
LABEL_WORDS = {"true": 1, "false": 0, "yes": 1, "no": 0, "y": 1, "n": 0}


def with_binary_label(df: DataFrame, column: str, name: str) -> DataFrame:
    """Nullable 0/1 column of a label column.

    Booleans map directly. If any value of the column is a number, numbers are
    rounded half to even and everything else is null; otherwise yes/no words
    are mapped. Whether numbers occur is one aggregate over the column.
    """
    kind = df.schema[column].dataType.simpleString()
    value = F.col(column)
    if kind == "boolean":
        return df.withColumn(name, value.cast("int"))
    if kind != "string":
        return df.withColumn(name, F.bround(value.cast("double")).cast("int"))
    number = value.try_cast("double")
    any_number = df.agg(F.coalesce(F.bool_or(number.isNotNull()), F.lit(False)).alias("x")).scalar()
    words = F.create_map(*[x for w, v in LABEL_WORDS.items() for x in (F.lit(w), F.lit(v))])
    return df.withColumn(
        name,
        F.when(any_number, F.bround(number).cast("int")).otherwise(F.element_at(words, F.lower(strip(value)))))


def dataset_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    sizes = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, sizes)


def label_balance(stages: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(stage, n_pos, n_neg, n_na); a stage without a label column is all NA."""
    def one(name: str, df: DataFrame, label: str | None) -> DataFrame:
        value = F.col(label) if label else F.lit(None).cast("int")
        return df.agg(
            F.count_if(value == 1).alias("n_pos"), F.count_if(value == 0).alias("n_neg"),
            F.count_if(value.isNull()).alias("n_na"),
        ).select(F.lit(name).alias("stage"), "n_pos", "n_neg", "n_na")

    return reduce(DataFrame.unionByName, [one(n, df, label) for n, (df, label) in stages.items()])


def coverage_counts(df: DataFrame, label: str) -> DataFrame:
    """negative / positive / abstain counts of a tri-state label in one row."""
    v = F.col(label)
    return df.agg(F.count_if(v == 0).alias("n_neg"), F.count_if(v == 1).alias("n_pos"),
                  F.count_if(v.isNull()).alias("n_abstain"))


def histogram(df: DataFrame, group: Column | str, value: Column | str, bins: int) -> DataFrame:
    """(group, bin, lo, hi, n): equal-width bins over each group's own range, the last one closed.

    A group's range with a single value is widened by 0.5 on both sides. The
    values of a group are counted before they meet its range.
    """
    base = df.select(col(group).alias("grp"), col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    ranges = base.groupBy("grp").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    single = F.col("lo") == F.col("hi")
    ranges = ranges.select(F.col("grp").alias("__grp"), F.struct(
        F.when(single, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(single, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).alias("r"))
    values = base.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = values.join(ranges, F.col("grp").eqNullSafe(F.col("__grp")))
    place = (F.col("v") - F.col("r.lo")) * bins / (F.col("r.hi") - F.col("r.lo"))
    counted = ranged.select(
        "grp", F.least(F.floor(place), F.lit(bins - 1)).cast("int").alias("bin"), "r", "n",
    ).groupBy("grp", "bin", "r").agg(F.sum("n").alias("n"))
    width = (F.col("r.hi") - F.col("r.lo")) / bins
    return counted.select(
        "grp", "bin", (F.col("r.lo") + F.col("bin") * width).alias("lo"),
        (F.col("r.lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def text_length_histogram(texts: Mapping[str, tuple[DataFrame, str]], bins: int = 40) -> DataFrame:
    lengths = [
        df.select(F.lit(name).alias("dataset"), F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("chars"))
        for name, (df, c) in texts.items()
    ]
    return histogram(reduce(DataFrame.unionByName, lengths), "dataset", "chars", bins)


def rule_score_histogram(weak: DataFrame, bins: int = 30) -> DataFrame:
    """Numeric rule scores per label class."""
    kind = (
        F.when(F.col("rule_label") == 1, "Positive").when(F.col("rule_label") == 0, "Negative")
        .when(F.col("rule_label").isNull(), "Abstain")
    )
    scored = weak.select(kind.alias("class"), F.col("rule_score").try_cast("double").alias("score"))
    return histogram(scored.where(F.col("class").isNotNull()), "class", "score", bins)


def rule_frequencies(weak: DataFrame, column: str = "matched_rules", sep: str = ";", top: int | None = 15) -> DataFrame:
    """(rule, n): separated rule names, stripped, blanks dropped, most frequent first."""
    rules = weak.select(F.explode(F.split(F.col(column).cast("string"), f"\\Q{sep}\\E")).alias("raw"))
    counts = (
        rules.select(strip("raw").alias("rule")).where(F.col("rule") != "")
        .groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts if top is None else counts.orderBy(F.col("n").desc(), "rule").limit(top)


def annotation_progress(df: DataFrame, label: str) -> DataFrame:
    tagged = with_binary_label(df, label, "__y")
    y = F.col("__y")
    return tagged.agg(
        F.count_if(y.isNotNull()).alias("n_annotated"), F.count_if(y.isNull()).alias("n_pending"),
        F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))


def municipality_support(df: DataFrame, label: str, municipality: str, top: int = 20) -> DataFrame:
    """Labelled rows per municipality with positives and negatives, largest first."""
    labelled = df.where(F.col(label).isNotNull() & F.col(municipality).isNotNull())
    return labelled.groupBy(F.col(municipality).alias("municipality")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
    ).orderBy(F.col("support").desc(), "municipality").limit(top)


def value_counts(df: DataFrame, columns: Sequence[str], limits: Mapping[str, int] | None = None) -> DataFrame:
    """(field, value, n) for each column; a limit keeps the most frequent values of that column."""
    limits = limits or {}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")
    counts = df.select(pairs).where(F.col("p.value").isNotNull()).groupBy("p.field", "p.value").agg(
        F.count(F.lit(1)).alias("n"))
    if not limits:
        return counts
    free = counts.where(~F.col("field").isin(list(limits)))
    parts = [
        top_per_key(counts.where(F.col("field") == f), ["field"], [F.col("n").desc(), F.col("value")], n)
        for f, n in limits.items()
    ]
    return reduce(DataFrame.unionByName, parts, free)
