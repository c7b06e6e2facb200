"""Writers: NDJSON, CSV, JSON reports, partitioned tables and write modes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from policyspark.sources.ndjson import local_folder, path_exists
from policyspark.operators.export import analysis_csv_shape, labeling_csv_shape, measure_csv_shape


def write_ndjson(df: DataFrame, path: str, append: bool = False, partition_by: str | None = None) -> None:
    """One JSON object per line with explicit nulls."""
    writer = df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)


def write_mode(force: bool = False, dry_run: bool = False) -> str | None:
    """Spark save mode: skip when present, overwrite with force, nothing for a dry run."""
    return None if dry_run else ("overwrite" if force else "ignore")


def write_table(df: DataFrame, path: str, force: bool = False, dry_run: bool = False,
                partition_by: str | None = None) -> int | None:
    """Write Parquet under the skip/force/dry-run rules; a dry run returns the row count."""
    mode = write_mode(force, dry_run)
    if mode is None:
        return df.count()
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return None


def write_crawl_index(index: DataFrame, path: str) -> None:
    """Append index rows of one superset shape, partitioned by municipality."""
    write_ndjson(index, path, append=True, partition_by="muni")


def csv_options(writer: DataFrameWriter, header: bool = True) -> DataFrameWriter:
    """Doubled quotes; values keep their outer whitespace, nulls are empty."""
    return writer.options(header=header, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False,
                          ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """A folder of CSV files with doubled quotes."""
    csv_options(df.write.mode("overwrite"), header).csv(path)


def publish(df: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """One named file: the rows are written by one task next to it, and a rename puts the file in its place at once.

    For reports, whose rows are few. Readers see the old file or the new one;
    what a failed or repeated attempt has written is removed.
    """
    context = df.sparkSession.sparkContext
    hadoop, conf = context._jvm.org.apache.hadoop, context._jsc.hadoopConfiguration()
    target, draft = hadoop.fs.Path(path), f"{path}.{uuid.uuid4().hex}.draft"
    fs, draft_path = target.getFileSystem(conf), hadoop.fs.Path(draft)
    try:
        write(df.coalesce(1).write.mode("overwrite"), draft)
        (part,) = [f.getPath() for f in fs.listStatus(draft_path) if f.getPath().getName().startswith("part-")]
        if fs.exists(target) and fs.getFileStatus(target).isDirectory():
            fs.delete(target, True)  # an older report that was a folder
        rename = context._gateway.new_array(context._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = context._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), rename)
    finally:
        fs.delete(draft_path, True)


def write_analysis_csv(analysis: DataFrame, path: str) -> None:
    """Schema-ordered CSV; an empty table writes no header."""
    write_csv(analysis_csv_shape(analysis), path, header=not analysis.isEmpty())


def write_measure_csv(measures: DataFrame, path: str) -> None:
    write_csv(measure_csv_shape(measures), path)


def write_labeling_csv(documents: DataFrame, path: str, max_chars: int | None = None) -> None:
    write_csv(labeling_csv_shape(documents, max_chars), path)


def write_report_json(row: DataFrame, path: str) -> None:
    """A one-row report as a single JSON file of that name."""
    publish(row, path, lambda writer, to: writer.option("ignoreNullFields", False).json(to))


def write_predictions_csv(predictions: DataFrame, path: str, columns: list[str] | None = None, named: bool = False) -> None:
    """Predictions in the original column order; abstained labels become empty. A folder of files, or one named file."""
    rows = predictions.select(*(columns or predictions.columns))
    if named:
        publish(rows, path, lambda writer, to: csv_options(writer).csv(to))
    else:
        write_csv(rows, path)


def write_content_store(store: DataFrame, path: str) -> None:
    """Content-addressed pages, one row per digest, partitioned by municipality.

    Digests that the folder already holds are not written again. The pages of
    a municipality are written by several tasks, by digest. Two runs at once
    may both add a page; :func:`read_content_store` gives it once.
    """
    spark = store.sparkSession
    if path_exists(spark, f"{path}/*"):
        held = spark.read.parquet(path).select(F.col("municipality_id").cast("string").alias("__m"), F.col("digest").alias("__d"))
        store = store.join(held, F.col("municipality_id").cast("string").eqNullSafe(F.col("__m"))
                           & (F.col("digest") == F.col("__d")), "left_anti")
    spread = store.repartition("municipality_id", F.substring("digest", 1, 1))
    spread.write.mode("append").partitionBy("municipality_id").parquet(path)


def read_content_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored pages, one row per municipality and digest, however many runs have added it."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("municipality_id", "digest")]
    once = rows.groupBy("municipality_id", "digest").agg(F.min(F.struct(*rest)).alias("page"))
    return once.select("municipality_id", "digest", "page.*").select(*rows.columns)


def page_name(url: Column | str) -> Column:
    """Name of a page in the paths that :func:`write_page_files` gives; null for a page without url."""
    return F.sha2(url, 256)


def write_page_files(pages: DataFrame, folder: str) -> None:
    """Columns url and html as .htm files with ``page=<page_name>`` in their path, a line a page.

    Rows of one url share a file where one task holds them; null and empty
    pages are empty files. Where Hadoop's local file system has no native
    library, Spark's writer starts about six processes and threads a file, so
    tasks write there by themselves: a draft first, which a rename puts in its
    place, so that repeated attempts of a task leave whole files.
    """
    target = local_folder(pages.sparkSession, folder)
    named = pages.select(page_name("url").alias("page"), "html")
    if target is None:
        named.write.partitionBy("page").options(
            sep="\u0001", quote="", escape="", escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
            emptyValue="", extension="htm").csv(folder)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        open_page, draft, file, n_files = None, "", None, 0

        def close() -> int:
            if file is None:
                return 0
            file.close()
            os.replace(draft, f"{os.path.dirname(draft)}/page={open_page}-{part:05d}.htm")
            return 1

        try:
            for batch in batches:
                for page, html in zip(batch.column("page").to_pylist(), batch.column("html")):  # one page at a time leaves Arrow
                    page = "__HIVE_DEFAULT_PARTITION__" if page is None else page
                    if page != open_page:
                        n_files += close()
                        at = f"{target}/start={page[:2]}"
                        os.makedirs(at, exist_ok=True)
                        open_page, draft = page, f"{at}/.{page}-{attempt}"
                        file = open(draft, "wb")
                    if line := html.as_py():
                        file.write(line + b"\n")
            n_files += close()
        finally:
            if file is not None:
                file.close()
        yield pa.RecordBatch.from_pydict({"n_files": pa.array([n_files], pa.int64())})

    os.makedirs(target)
    sorted_pages = named.select("page", F.col("html").cast("binary").alias("html")).sortWithinPartitions("page")
    sorted_pages.mapInArrow(write, "n_files long").write.format("noop").mode("overwrite").save()


def write_operating_points(points: DataFrame, path: str) -> None:
    """The files table_metrics.csv and, next to it, table_metrics_rounded.csv, its text form."""
    from policyspark.operators.gate import two_decimals

    publish(points, f"{path}/table_metrics.csv", lambda writer, to: csv_options(writer).csv(to))
    ratios = ["coverage", "precision", "recall_classified", "f1_classified", "recall_overall", "accuracy_classified"]
    rounded = points.withColumns({c: two_decimals(F.col(c)) for c in ratios})
    publish(rounded, f"{path}/table_metrics_rounded.csv", lambda writer, to: csv_options(writer).csv(to))
