"""Running totals, ordinals and selections that never put one group into one task.

Input order matters in several places (ids, caps, last-wins). It is always an
explicit column. A plain window over a group would pull the whole group into
one task; a municipality or label may own a third of all rows, so the table is
cut into slices of key and order: slice totals are summed with map-side
combine, prefix sums run over the few slice totals per group, and the ordinary
window only ever sees one slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window

from policyspark.session import parallelism

_SLICE = "__slice"
_GROUP = "__group"


# Rows looked at for each cut between slices.
SAMPLED_PER_SLICE = 40


def slice_cuts(df: DataFrame, columns: Sequence[str], slices: int | None = None) -> list[Row]:
    """Rows of ``columns`` that cut the table, sorted by them, into about equal slices.

    The columns are the key and the whole order, so a hot key, a constant or
    an all-null first order column are cut like any other. Looks at a sample
    of bounded size, drawn by a hash of the row; runs one job.
    """
    slices = slices or parallelism(df.sparkSession)
    some = (df.select(*columns).orderBy(F.xxhash64(*columns, F.lit("cut")), *columns)
            .limit(slices * SAMPLED_PER_SLICE).orderBy(*columns).collect())
    step = max(1, len(some) // slices)
    return list(dict.fromkeys(some[i] for i in range(step, len(some), step)))


def before_point(df: DataFrame, columns: Sequence[str], values: Sequence) -> Column:
    """Whether a row sorts before a point, nulls first, column by column."""
    out = F.lit(False)
    for name, value in reversed(list(zip(columns, values))):
        own = F.col(name)
        if value is None:
            out = own.isNull() & out
        else:
            point = F.lit(value).cast(df.schema[name].dataType)
            out = own.isNull() | (own < point) | ((own == point) & out)
    return out


def slice_column(df: DataFrame, columns: Sequence[str], cuts: Sequence[Row]) -> Column:
    """How many cuts a row does not sort before, nulls first: found by halving.

    Only as many columns are looked at as tell the cuts apart.
    """
    width = next((w for w in range(1, len(columns)) if len({tuple(c[:w]) for c in cuts}) == len(cuts)), len(columns))
    points = sorted({tuple(c[:width]): i for i, c in enumerate(cuts)}.items(), key=lambda p: p[1])

    def halved(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(before_point(df, columns, points[middle][0]), halved(low, middle)).otherwise(halved(middle + 1, high))

    return halved(0, len(points))


def uniform_slice(hash_column: Column, slices: int) -> Column:
    """Slice of a uniformly distributed 64-bit hash, in hash order and without looking at the data."""
    unit = hash_column.cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    return F.least(F.lit(slices - 1), F.floor(unit * slices).cast("int"))


def with_running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column],
    inclusive: bool = False, slice_by: Column | None = None,
) -> DataFrame:
    """Add per-key running sums of ``totals`` in ``order``, which must be a total order within a key.

    The table is cut into slices of (key, order); sums of each key and slice
    are added up before the shuffle, prefix sums run over a key's few slices,
    and the window only sees one key in one slice. Finding the cuts runs a job
    at once; ``slice_by``, any expression that is monotone in the order within
    a key, saves it and keeps the operator lazy. Totals are exclusive of the
    row itself unless ``inclusive``.
    """
    if slice_by is None:
        columns = list(dict.fromkeys([*keys, *order]))
        slice_by = slice_column(df, columns, slice_cuts(df, columns))
    add = {f"__v_{name}": value for name, value in totals.items()}
    # The key travels as one struct: null parts compare equal, and join and
    # window agree on (group, slice), so the rows are shuffled once for both.
    group = F.struct(*([F.col(k) for k in keys] or [F.lit(0).alias("all")]))
    sliced = df.withColumns({_GROUP: group, _SLICE: slice_by, **add})

    parts = sliced.groupBy(_GROUP, _SLICE).agg(*[F.sum(v).alias(v) for v in add])
    before = Window.partitionBy(_GROUP).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col(_GROUP).alias("__k_group"), F.col(_SLICE).alias("__k_slice"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__o{v}") for v in add],
    )
    match = (F.col(_GROUP) == F.col("__k_group")) & (F.col(_SLICE) == F.col("__k_slice"))
    local = Window.partitionBy(_GROUP, _SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    out = sliced.join(offsets, match).withColumns({
        name: F.coalesce(F.sum(f"__v_{name}").over(local), F.lit(0)) + F.col(f"__o__v_{name}")
        for name in totals
    })
    return out.drop(_GROUP, _SLICE, *add, *[f"__o{v}" for v in add], "__k_slice", "__k_group")


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number",
                    start: int = 0, **slicing) -> DataFrame:
    """Consecutive number per key in ``order`` (starting at ``start``)."""
    out = with_running_totals(df, keys, order, {name: F.lit(1).cast("long")}, **slicing)
    return out.withColumn(name, (F.col(name) + start).cast("long"))


def with_read_order_ids(df: DataFrame, order: str, name: str = "document_id", prefix: str = "doc") -> DataFrame:
    """Fill missing or empty ids with ``doc{n}``, n being the 1-based position of the row in ``order``.

    Every row takes a number, also those that keep their id. Ids of this kind
    change when rows are added in front; content ids do not.
    """
    numbered = with_row_number(df, [], [order], "__n", start=1)
    own = F.nullif(F.col(name).cast("string"), F.lit(""))
    return numbered.withColumn(name, F.coalesce(own, F.concat(F.lit(prefix), F.col("__n").cast("string")))).drop("__n")


def with_batch_number(df: DataFrame, order: Sequence[str], size: int, name: str = "batch") -> DataFrame:
    """Fixed-size batches in input order."""
    numbered = with_row_number(df, [], order, name)
    return numbered.withColumn(name, F.floor(F.col(name) / size).cast("long"))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the greatest ``order`` per key, combined map-side."""
    return _extreme_per_key(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the smallest ``order`` per key, combined map-side."""
    return _extreme_per_key(df, keys, order, F.min_by)


def _extreme_per_key(df, keys, order, pick):
    keys = list(keys)
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row"))
    return chosen.select(*keys, "__row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                name: str | None = None) -> DataFrame:
    """First ``n`` rows per key; each map task forwards at most ``n`` rows of a key."""
    rank = name or "__rank"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(rank) <= n)
    return kept if name else kept.drop(rank)


#: Accuracy of the quantiles that bracket an exact rank: their rank is off by at most n / ACCURACY.
ACCURACY = 10_000


def upper_median(df: DataFrame, column: str, name: str = "p50") -> DataFrame:
    """One row with ``sorted(values)[n // 2]`` of a numeric column (null for no values).

    Approximate quantiles bracket the rank; one more pass counts the values
    below the bracket, and only the values inside it (a few in ten thousand,
    equal ones counted together) are ranked. Runs two jobs at once.
    """
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL")
    half, slack = 0.5, 2.0 / ACCURACY
    n, bracket = values.agg(F.count("value"), F.percentile_approx("value", [half - slack, half + slack], ACCURACY)).first()
    if not n:
        return values.agg(F.max("value").alias(name))
    low, high = (F.lit(b).cast(df.schema[column].dataType) for b in bracket)
    below = values.agg(F.count_if(F.col("value") < low)).first()[0]
    inside = values.where((F.col("value") >= low) & (F.col("value") <= high)).groupBy("value").agg(F.count("value").alias("n"))
    ranked = with_running_totals(inside, [], ["value"], {"__below": F.col("n")})
    wanted = n // 2 - below
    return ranked.where((F.col("__below") <= wanted) & (wanted < F.col("__below") + F.col("n"))).agg(F.max("value").alias(name))


def row_hash(id_column: Column | str, seed: int, portable: bool = False) -> Column:
    """Seeded uniform 64-bit hash of an id: the same under every partitioning.

    The portable form (MD5, slower) orders ids the way any SQL engine can:
    by the first 15 hex digits of md5('seed:id').
    """
    text = (F.col(id_column) if isinstance(id_column, str) else id_column).cast("string")
    if not portable:
        return F.xxhash64(F.lit(seed), text)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") - F.lit(1 << 59)) * 16
