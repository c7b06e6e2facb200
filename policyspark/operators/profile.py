"""Measure profile: missing rates, top values, confidence buckets and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions.text import category
from policyspark.operators.ordinals import top_per_key, upper_median, with_running_totals
from policyspark.session import cut_lineage
from policyspark.vocabulary import PROFILE_FIELDS

# --- fixed values: label, lower edge, upper edge (exclusive) -----------------
CONFIDENCE_BUCKETS = [
    ("[0.00,0.20)", 0.00, 0.20), ("[0.20,0.40)", 0.20, 0.40), ("[0.40,0.60)", 0.40, 0.60),
    ("[0.60,0.80)", 0.60, 0.80), ("[0.80,1.00]", 0.80, 1.01),
]


def _is_missing(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(True)
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind == "string":
        return c.isNull() | (c == "")
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def missing_rates(measures: DataFrame, fields: Sequence[str] = tuple(PROFILE_FIELDS),
                  broken: str | None = None) -> DataFrame:
    """(field, missing, pct): absent, null, '' or empty list; one pass over the table.

    ``broken`` flags lines that could not be parsed: they count in the
    denominator only.
    """
    readable = ~F.col(broken) if broken else F.lit(True)
    counts = measures.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(readable & _is_missing(measures, f)).alias(f) for f in fields],
    )
    long = counts.unpivot(["total"], list(fields), "field", "missing")
    return long.select(
        "field", "missing",
        F.when(F.col("total") > 0, F.col("missing") / F.col("total") * 100.0).otherwise(0.0).alias("pct"))


def top_values(measures: DataFrame, fields: Sequence[str], k: int = 10, total: Column | None = None) -> DataFrame:
    """(field, value, n, pct, rank): most frequent values per field, ties by value."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), category(f).alias("value")) for f in fields
    ])).alias("pair")
    counts = measures.select(pairs).groupBy("pair.field", "pair.value").agg(F.count(F.lit(1)).alias("n"))
    n_rows = total if total is not None else measures.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = top_per_key(counts, ["field"], [F.col("n").desc(), F.col("value")], k, "rank")
    return ranked.withColumn("pct", F.col("n") / n_rows * 100.0)


def confidence_buckets(measures: DataFrame, column: str = "confidence_score") -> DataFrame:
    """(bucket, n, pct) over all numeric confidences; values outside every bucket count in the base only."""
    value = F.col(column).try_cast("double")
    counts = measures.select(value.alias("c")).agg(
        F.count("c").alias("base"),
        *[F.count_if((F.col("c") >= lo) & (F.col("c") < hi)).alias(name) for name, lo, hi in CONFIDENCE_BUCKETS],
    )
    long = counts.unpivot(["base"], [f"`{b[0]}`" for b in CONFIDENCE_BUCKETS], "bucket", "n")
    return long.select(
        "bucket", "n",
        F.when(F.col("base") > 0, F.col("n") / F.col("base") * 100.0).otherwise(0.0).alias("pct"))


def confidence_stats(measures: DataFrame, column: str = "confidence_score") -> DataFrame:
    """n, min, upper median and max of the numeric confidences.

    Runs at once: the median takes several passes, so the numbers alone are
    kept in the checkpoint folder and whatever gave them is computed once.
    """
    values = cut_lineage(measures.select(F.col(column).try_cast("double").alias("c")))
    ends = values.agg(F.count("c").alias("n"), F.min("c").alias("min"), F.max("c").alias("max"))
    return ends.withColumn("p50", upper_median(values, "c").scalar()).select("n", "min", "p50", "max")


def profile_state(measures: DataFrame, fields: Sequence[str], categories: Sequence[str], broken: str | None = None,
                  confidence: str = "confidence_score") -> DataFrame:
    """(kind, field, value, n): what a profile needs to know of some rows, as counts that add up.

    Kinds: ``rows`` (all lines), ``missing`` per field, ``value`` per category
    field, and ``number`` per confidence. Profiles of parts are merged by
    :func:`merged_state`, so a new part is read once and old ones not at all.
    """
    readable = ~F.col(broken) if broken else F.lit(True)
    number = F.col(confidence).try_cast("double")
    none = F.lit(None).cast("string")

    def entry(kind: str, name: str, value: Column, there: Column) -> Column:
        return F.when(there, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"), value.alias("value")))

    entries = [entry("rows", "", none, F.lit(True))]
    entries += [entry("missing", f, none, readable & _is_missing(measures, f)) for f in fields]
    entries += [entry("value", f, category(f), readable) for f in categories]
    entries.append(entry("number", confidence, number.cast("string"), readable & number.isNotNull()))
    return measures.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.kind", "e.field", "e.value").agg(
        F.count(F.lit(1)).alias("n"))


def merged_state(*states: DataFrame) -> DataFrame:
    """The state of all rows together."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    return whole.groupBy("kind", "field", "value").agg(F.sum("n").alias("n"))


def profile_of_state(state: DataFrame, fields: Sequence[str], categories: Sequence[str], k: int = 10) -> dict[str, DataFrame]:
    """The tables of :func:`missing_rates`, :func:`top_values`, :func:`confidence_buckets` and :func:`confidence_stats`, exactly."""
    total = state.where("kind = 'rows'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).scalar()
    spark = state.sparkSession
    names = spark.createDataFrame([(f,) for f in fields], "name string")
    counted = state.where("kind = 'missing'")
    missing = names.join(counted, F.col("name") == F.col("field"), "left").select(
        F.col("name").alias("field"), F.coalesce("n", F.lit(0)).alias("missing"))
    values = state.where(F.col("kind") == "value").where(F.col("field").isin(list(categories))).select("field", "value", "n")
    numbers = state.where("kind = 'number'").select(F.col("value").cast("double").alias("c"), "n")
    whole = numbers.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("base"),
        *[F.coalesce(F.sum(F.when((F.col("c") >= lo) & (F.col("c") < hi), F.col("n"))), F.lit(0)).alias(name)
          for name, lo, hi in CONFIDENCE_BUCKETS])
    share = F.when(F.col("base") > 0, F.col("n") / F.col("base") * 100.0).otherwise(0.0)
    ends = numbers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("c").alias("min"), F.max("c").alias("max"))
    below = with_running_totals(numbers, [], ["c"], {"before": F.col("n")})
    wanted = F.floor(ends.select("n").scalar() / 2)
    middle = below.where((F.col("before") <= wanted) & (wanted < F.col("before") + F.col("n"))).agg(F.max("c").alias("p50"))
    return {
        "missing": missing.withColumn("pct", F.when(total > 0, F.col("missing") / total * 100.0).otherwise(0.0)),
        "top_values": top_per_key(values, ["field"], [F.col("n").desc(), F.col("value")], k, "rank").withColumn(
            "pct", F.col("n") / total * 100.0),
        "buckets": whole.unpivot(["base"], [f"`{b[0]}`" for b in CONFIDENCE_BUCKETS], "bucket", "n").select(
            "bucket", "n", share.alias("pct")),
        "stats": ends.withColumn("p50", middle.select("p50").scalar()).select("n", "min", "p50", "max"),
    }


def row_counters(df: DataFrame, status: Column) -> DataFrame:
    """(status, n) of a per-row status expression."""
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def measure_count(df: DataFrame, scope: str, mode: str, input_file: str = "") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("num_measures")).select(
        F.lit(scope).alias("scope"), F.lit(mode).alias("mode"), "num_measures", F.lit(input_file).alias("input_file"))


SAMPLE_COLUMNS = ["candidate_id", "municipality_id", "confidence_score", "policy_area", "instrument_type",
                  "target_sector"]


#: The columns of which :func:`sample_view` shows one.
SAMPLE_SOURCES = ["measure_title", "title", "url", "source_url"]


def sample_view(measures: DataFrame) -> DataFrame:
    """The columns shown for sampled rows, with title and url fall-backs."""
    from policyspark.functions.text import first_filled

    have = set(measures.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    return measures.select(
        *[c(n).alias(n) for n in SAMPLE_COLUMNS],
        first_filled(c("measure_title"), c("title")).alias("measure_title"),
        first_filled(c("url"), c("source_url")).alias("url"),
    )
