"""Incremental runs: append/resume as Structured Streaming over the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from policyspark import schemas
from policyspark.functions.terms import KeywordRules
from policyspark.operators.harmonise import extracted_documents, keep_extracted
from policyspark.operators.snippets import snippet_candidates
from policyspark.sources.ndjson import parse_lines, path_exists


def stream_lines(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lenient NDJSON stream: bad lines are dropped exactly as in the batch reader."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_lines(reader.load(folder), schema)


def stream_extracted(spark: SparkSession, index_folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Raw crawl records (either shape) of a growing folder -> extracted documents. Stateless."""
    raw = stream_lines(spark, index_folder, schemas.RAW_ANY, files_per_trigger)
    return keep_extracted(extracted_documents(raw))


def stream_candidates(documents: DataFrame, rules: KeywordRules | None = None, **options) -> DataFrame:
    """Snippet candidates of a document stream; numbering is per document row, so no state is kept."""
    return snippet_candidates(documents, rules, **options)


def append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Exactly-once append of a stateless stream to a Parquet table."""
    writer = stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FirstTime(StatefulProcessor):
    """Lets the first row of a key through and remembers the key; of several in one batch the least counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda row: tuple((value is not None, str(value)) for value in row))
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.seen.update((True,))

    def close(self) -> None:
        pass


def blank(key: str) -> Column:
    return F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""


def first_rows(stream: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """The first row of every id of a stream that is not among the ids of ``known``, whatever came in earlier batches.

    The ids that have passed are keyed state, which costs a batch nothing for
    ids it does not hold; ``known`` enters it once, when the checkpoint is new. Rows with a
    null or blank id have nothing to be told apart by: all of them pass, stateless.
    """
    named = stream.where(~blank(key))
    seeds = None if known is None else known.where(~blank(key)).select(key).distinct().groupBy(key)
    passed = named.groupBy(key).transformWithState(FirstTime(), stream.schema, "Append", "None", seeds)
    return passed.unionByName(stream.where(blank(key)))


def write_once(sink: str, transform: Callable[[DataFrame], DataFrame]):
    """foreachBatch function: a batch has a folder of its own, so one that is repeated after a failure replaces itself."""
    def run(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        transform(batch).write.mode("overwrite").parquet(f"{sink}/run={query_id}/batch={batch_id}")

    return run


def rows_of_others(spark: SparkSession, sink: str, checkpoint: str, key: StructField) -> DataFrame | None:
    """Ids that other runs than that of the checkpoint have written; a batch that is repeated must not meet its own rows."""
    if not path_exists(spark, sink):
        return None
    rows = spark.read.schema(StructType([key, StructField("run", StringType())])).parquet(sink)
    if not path_exists(spark, f"{checkpoint}/metadata"):
        return rows
    own = spark.read.json(f"{checkpoint}/metadata").first()["id"]
    return rows.where(F.col("run") != own)


def labelled(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of a sink of :func:`label_stream`."""
    return spark.read.parquet(sink).drop("run", "batch")


def label_stream(candidates: DataFrame, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame],
                 key: str = "candidate_id", available_now: bool = True) -> StreamingQuery:
    """Incremental labelling of a candidate stream into a table, resumable at any point.

    An id is labelled once: repeats in a batch or in later ones are dropped by
    keyed state (RocksDB), and ids that the sink holds when a checkpoint begins
    are its initial state. Rows of null or blank ids are labelled each time
    they arrive. A failure at any point, also between writing a batch and
    committing it, neither loses nor repeats a row: the batch runs again from
    the state before it and replaces its own folder. Two streams may share a
    sink, one after the other. ``sink`` is a table partitioned by run and batch.
    """
    spark = candidates.sparkSession
    known = rows_of_others(spark, sink, checkpoint, candidates.schema[key])
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        writer = first_rows(candidates, key, known).writeStream.foreachBatch(write_once(sink, transform)).option(
            "checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
