"""Deterministic samples, splits and heads.

Random draws are replaced by seeded hashes of the row id: the same rows are
chosen under every partitioning and after every retry. Selections of a known
size over unbounded groups search the cut-off by hash slice instead of sorting
the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from policyspark.functions.model_output import example_block
from policyspark.operators.ordinals import row_hash, uniform_slice, with_row_number
from policyspark.session import parallelism


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def seeded_sample(df: DataFrame, id_column: str, n: int, seed: int = 42, portable: bool = False) -> DataFrame:
    """``n`` rows by hash order; everything when ``n`` is not positive or not smaller than the table."""
    if n <= 0:
        return df
    return df.orderBy(row_hash(id_column, seed, portable), F.col(id_column)).limit(n)


def lowest(df: DataFrame, column: str, order: str, k: int, keep_rows: int | None = None) -> DataFrame:
    """k rows with the smallest number in ``column`` (non-numeric counts as -1), stable in ``order``."""
    base = df if keep_rows is None else df.orderBy(order).limit(keep_rows)
    number = F.coalesce(F.col(column).try_cast("double"), F.lit(-1.0))
    return base.orderBy(number, F.col(order)).limit(k)


def test_sizes(df: DataFrame, label: str, test_frac: float) -> DataFrame:
    """Rows per label and how many of them go to the test side.

    The total is ceil(fraction * rows); labels get their share by largest
    remainder. Works on one row per label.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    wanted = F.ceil(F.round(total * F.lit(test_frac), 9))
    share = F.col("n") * wanted / total
    sized = counts.withColumns({"wanted": wanted, "floor": F.floor(share), "rest": share - F.floor(share)})
    missing = F.col("wanted") - F.sum("floor").over(everything)
    rank = F.row_number().over(everything.orderBy(F.col("rest").desc(), F.col("label")))
    return sized.select("label", "n", (F.col("floor") + F.when(rank <= missing, 1).otherwise(0)).alias("n_test"))


def stratified_split(df: DataFrame, id_column: str, label: str, test_frac: float = 0.3, seed: int = 42,
                     name: str = "split", portable: bool = False) -> DataFrame:
    """Tag every row 'train' or 'test', keeping the label shares.

    Within a label rows are ordered by a seeded hash of their id. A label can
    hold most of the table, so the order is cut into uniform hash slices.
    """
    slices = parallelism(df.sparkSession)
    hashed = df.withColumns({"__hash": row_hash(id_column, seed, portable), "__label": F.col(label)})
    ranked = with_row_number(
        hashed, ["__label"], ["__hash", id_column], "__rank", slice_by=uniform_slice(F.col("__hash"), slices))
    sizes = test_sizes(df, label, test_frac).select(F.col("label").alias("__l"), "n_test")
    tagged = ranked.join(sizes, F.col("__label").eqNullSafe(F.col("__l")), "left")
    return tagged.withColumn(name, F.when(F.col("__rank") < F.col("n_test"), "test").otherwise("train")).drop(
        "__hash", "__label", "__rank", "__l", "n_test")


def split_summary(split: DataFrame, label: str, name: str = "split") -> DataFrame:
    """Sizes and positives of both sides in one row."""
    def n(side: str) -> Column:
        return F.count_if(F.col(name) == side)

    def pos(side: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(name) == side, F.col(label))), F.lit(0)).cast("long")

    return split.agg(n("train").alias("n_train"), n("test").alias("n_test"), pos("train").alias("pos_train"),
                     pos("test").alias("pos_test"))


def balanced_head(df: DataFrame, label: str, order: str, n: int | None, ensure_positive: bool = True) -> DataFrame:
    """First rows in order: max(1, n // 4) positives if there are as many, then negatives up to n."""
    if n is None or n <= 0:
        return df
    if not ensure_positive:
        return first_rows(df, order, n)
    quota = max(1, n // 4)
    positives = df.where(F.col(label) == 1).orderBy(order).limit(quota)
    have = positives.agg(F.count(F.lit(1)).alias("n")).scalar()
    rank = "__rank"
    negatives = df.where(F.col(label) == 0).orderBy(order).limit(n)
    # at most n rows from here on
    negatives = negatives.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)))
    negatives = negatives.where(F.col(rank) <= F.lit(n) - have).drop(rank)
    return positives.unionByName(negatives)


def few_shot_block(train: DataFrame, text: str, label: str, id_column: str, k_pos: int = 3, k_neg: int = 3,
                   seed: int = 42, max_chars: int | None = None, portable: bool = False) -> DataFrame:
    """One row: the rendered examples, k_pos positives then k_neg negatives in hash order."""
    def pick(value: int, k: int) -> DataFrame:
        chosen = train.where(F.col(label) == value)
        picked = chosen.select(
            F.lit(1 - value).alias("part"), row_hash(id_column, seed, portable).alias("rank"), F.col(id_column).alias("id"),
            F.col(text).alias("text"), F.col(label).alias("label"),
        ).orderBy("rank", "id").limit(k)
        return picked.select("part", "rank", "id", example_block(F.col("text"), F.col("label"), max_chars).alias("example"))

    examples = pick(1, k_pos).unionByName(pick(0, k_neg))
    ordered = F.array_sort(F.collect_list(F.struct("part", "rank", "id", "example")))
    block = F.array_join(F.transform(ordered, lambda e: e["example"]), "\n")
    return examples.agg(F.rtrim(F.regexp_replace(block, r"\s+$", "")).alias("block"))
