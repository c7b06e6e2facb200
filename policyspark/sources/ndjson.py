"""Newline-delimited JSON with explicit handling of bad lines and missing files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from policyspark.functions.text import strip


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the file system that owns the path; globs allowed."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path as plain file operations of tasks take it, where Hadoop's local file system owns it (a shared mount, on a cluster); else None."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(target).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def as_schema(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def parse_lines(lines: DataFrame, schema: StructType | str, value: str = "value", keep_broken: bool = False,
                keep: Sequence[str] = ()) -> DataFrame:
    """Lines -> rows of ``schema``; blank lines are skipped.

    Lines that are not one JSON object are dropped, or kept with ``_broken``
    true and null fields. A plain JSON reader would explode top-level arrays
    into rows instead.
    """
    schema = as_schema(schema)
    body = lines.select(*keep, strip(value).alias("__line")).where(F.col("__line") != "")
    marked = StructType([*schema.fields]).add("_corrupt", "string")
    parsed = body.select(
        *keep, F.col("__line").startswith("{").alias("__object"),
        F.from_json("__line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
    )
    ok: Column = F.col("__object") & F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    if keep_broken:
        flagged = parsed.withColumn("_broken", ~F.coalesce(ok, F.lit(False)))
        return flagged.select(
            *keep, "_broken",
            *[F.when(~F.col("_broken"), F.col(f"r.`{f.name}`")).alias(f.name) for f in schema.fields])
    return parsed.where(ok).select(*keep, *[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])


def read_ndjson(spark: SparkSession, path: str, schema: StructType | str, on_bad: str = "drop",
                on_missing: str = "fail", with_position: bool = False) -> DataFrame:
    """Read NDJSON files.

    on_bad: 'drop' bad lines, 'fail' the job, or 'flag' them in ``_broken``.
    on_missing: 'fail' or 'empty'. ``with_position`` adds ``ord``, a number in
    the order of file paths and lines that is unique but not consecutive.
    """
    schema = as_schema(schema)
    if not path_exists(spark, path):
        if on_missing == "empty":
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    lines = positioned_lines(spark, path) if with_position else spark.read.text(path)
    kept = ["ord"] if with_position else []
    if on_bad != "fail":
        return parse_lines(lines, schema, keep_broken=on_bad == "flag", keep=kept)
    parsed = parse_lines(lines, schema, keep_broken=True, keep=kept)
    checked = F.when(F.col("_broken"), F.raise_error(F.lit(f"{path}: a line is not one JSON object"))).otherwise(F.lit(True))
    return parsed.where(checked.cast("boolean")).drop("_broken")


def positioned_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord): lines numbered by the rank of their file, its parts in order, and the line in its part.

    Tasks take parts of files by size, so the number of a task says nothing
    about file order. The ranks are a row per part of a file.
    """
    part = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    lines = spark.read.text(path).select("value", *part, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__line"))
    ranks = spark.read.text(path).select(*part).distinct().withColumn(
        "__rank", F.row_number().over(Window.orderBy("__file", "__start")).cast("long"))
    return lines.join(ranks, ["__file", "__start"]).select("value", (F.col("__rank") * F.lit(1 << 33) + F.col("__line")).alias("ord"))


def line_counters(lines: DataFrame, value: str = "value") -> DataFrame:
    """rows_total, empty_lines and parse_errors of raw lines in one pass."""
    body = strip(value)
    blank = body == ""
    bad = ~blank & ~(body.startswith("{") & F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False)))
    return lines.agg(F.count_if(~blank).alias("rows_total"), F.count_if(blank).alias("empty_lines"),
                     F.count_if(bad).alias("parse_errors"))
