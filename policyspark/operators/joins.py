"""Look-up joins with explicit null, duplicate and skew behaviour.

No join here carries a broadcast hint: whether a side is small enough is left
to the size checks of the planner and of adaptive execution. Rows whose key is
null can never match; they are spread over many partitions instead of meeting
in the one that null hashes to. Hot non-null keys are split by adaptive skew
handling, which is possible because the look-up side is unique per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from policyspark.operators.ordinals import last_per_key

def _key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Hash of the key; of a few numbers of the row instead where a key part is null.

    As part of the join key it sends rows that cannot match to many partitions.
    Only small columns are hashed, so that no text has to be read for it.
    """
    incomplete = F.lit(False)
    for k in keys:
        incomplete = incomplete | F.col(k).isNull()
    numbers = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, NumericType)]
    return F.when(incomplete, F.xxhash64(*keys, *numbers[:2])).otherwise(F.xxhash64(*keys))


def _keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join on ``keys`` (same names and types on both sides); right keys are dropped."""
    right = right.select(*[c for c in right.columns if c not in keys],
                         *[F.col(k).alias(f"__r_{k}") for k in keys], F.xxhash64(*keys).alias("__r_hash"))
    left = left.withColumn("__hash", _key_hash(left, keys))
    match = F.col("__hash") == F.col("__r_hash")
    for k in keys:
        match = match & (F.col(k) == F.col(f"__r_{k}"))
    joined = left.join(right, match, how)
    return joined.drop("__hash", "__r_hash", *[f"__r_{k}" for k in keys])


def lookup(facts: DataFrame, table: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """facts LEFT JOIN table on ``keys``; of repeated table keys the last by ``order`` counts.

    Without ``order`` the caller vouches for unique keys. Column names other
    than the keys must not collide.
    """
    types = {f.name: f.dataType for f in facts.schema.fields}
    table = table.withColumns({k: F.col(k).cast(types[k]) for k in keys}).dropna(subset=list(keys))
    if order is not None:
        table = last_per_key(table, keys, order).drop(*([] if order in keys else [order]))
    return _keyed_join(facts, table, keys, "left")


def without(facts: DataFrame, excluded: DataFrame, key: str, excluded_key: str | None = None) -> DataFrame:
    """Anti join on one key compared as text; null and empty keys are always kept."""
    ids = excluded.select(F.col(excluded_key or key).cast("string").alias(key))
    ids = ids.where(F.col(key).isNotNull() & (F.col(key) != ""))
    tagged = facts.withColumn("__key", F.col(key).cast("string"))
    return _keyed_join(tagged, ids.withColumnRenamed(key, "__key"), ["__key"], "left_anti").drop("__key")


def only(facts: DataFrame, included: DataFrame, key: str) -> DataFrame:
    """Semi join on one key compared as text."""
    ids = included.select(F.col(key).cast("string").alias("__key"))
    tagged = facts.withColumn("__key", F.col(key).cast("string"))
    return _keyed_join(tagged, ids, ["__key"], "left_semi").drop("__key")


def merge_labels(documents: DataFrame, labels: DataFrame, id_columns: Sequence[str],
                 order: str | None = None) -> DataFrame:
    """documents LEFT JOIN labels with the label columns nested as struct ``labels``.

    Keys are compared as text on both sides, NaN labels become null, documents
    without labels keep a null struct, the last label row per key counts.
    """
    missing = [c for c in id_columns if c not in labels.columns]
    if missing:
        raise ValueError(f"id columns {missing} not among the label columns {labels.columns}")
    floats = {f.name for f in labels.schema.fields if f.dataType.simpleString() in ("double", "float")}
    names = [c for c in labels.columns if c not in id_columns and c != order]
    packed = labels.select(
        *[F.col(k).cast("string").alias(f"__k{i}") for i, k in enumerate(id_columns)],
        F.struct(*[
            (F.when(~F.isnan(c), F.col(c)) if c in floats else F.col(c)).alias(c) for c in names
        ]).alias("labels"),
        *([F.col(order).alias("__order")] if order else []),
    )
    keys = [f"__k{i}" for i in range(len(id_columns))]
    keyed = documents.withColumns({f"__k{i}": F.col(k).cast("string") for i, k in enumerate(id_columns)})
    return lookup(keyed, packed, keys, "__order" if order else None).drop(*keys)


def merge_statistics(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("docs_total"),
                      F.count_if(F.col("labels").isNotNull()).alias("docs_labeled"))


def with_gold_text(predictions: DataFrame, gold: DataFrame, text: str, key: str = "candidate_id") -> DataFrame:
    """predictions LEFT JOIN the gold text; a prediction without text fails the job."""
    side = gold.select(F.col(key).cast("string").alias(key), F.col(text))
    joined = lookup(predictions.withColumn(key, F.col(key).cast("string")), side, [key])
    present = F.assert_true(F.col(text).isNotNull(), F.lit("prediction without gold text"))
    return joined.withColumn(text, F.when(present.isNull(), F.col(text)))


def align_by_position(inputs: Column | str, results: Column | str) -> Column:
    """Pairs of two arrays up to the shorter one: array<struct<input, result>>."""
    inputs = F.col(inputs) if isinstance(inputs, str) else inputs
    results = F.col(results) if isinstance(results, str) else results
    n = F.least(F.size(inputs), F.size(results))
    return F.arrays_zip(F.slice(inputs, 1, n).alias("input"), F.slice(results, 1, n).alias("result"))
