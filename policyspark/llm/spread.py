"""Joins with a table of one row per key, where one key may hold any share of the rows on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a key are dealt into.
PARTS = 64


def joined_spread(rows: DataFrame, key: str, once: DataFrame, by: str) -> DataFrame:
    """rows joined with ``once``, which has one row per ``key``.

    Rows of a key are dealt into parts by a hash of the column ``by``. The
    parts that occur (64 rows of a key at most) meet ``once`` first and carry
    its columns to the rows by (key, part).
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    carried = dealt.select(key, "_part").distinct().join(once, key)
    return dealt.join(carried, [key, "_part"]).drop("_part")
