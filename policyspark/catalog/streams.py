"""Queries that run a stream to its end and read its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.catalog import query
from policyspark.catalog.documents import SNIPPETS_SQL
from policyspark.catalog.inputs import DOCUMENTS_SQL, NEGATIVE, POSITIVE, document_shape, table
from policyspark.catalog.web import CLEAN_SQL, unescape
from policyspark.operators.harmonise import extracted_documents, keep_extracted
from policyspark.operators.labeling import label_candidates
from policyspark.session import scratch_folder
from policyspark.streaming.incremental import append_stream, label_stream, labelled, stream_candidates


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a file stream.

    The pattern matches the table alone. A stream takes a plain path for a folder, which one file is not.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(spark, name)
    append_stream(rows, f"{folder}/table", f"{folder}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/table")  # a stream without rows writes no file


@query("stream_candidates", sql=f"""WITH {DOCUMENTS_SQL}, {SNIPPETS_SQL}
  SELECT municipality_id || '::' || document_id || '::p' || pos AS candidate_id, snippet FROM flat""")
def stream_candidates_query(spark, sf_dir):
    found = stream_candidates(document_shape(stream(spark, sf_dir, "documents")), positive=POSITIVE, negative=NEGATIVE)
    return drained(spark, found.select("candidate_id", "snippet"), "candidates")


@query("stream_extracted", sql=rf"""WITH {CLEAN_SQL}
  SELECT url, trim(regexp_replace({unescape("regexp_replace(c, '<[^>]*>', chr(10), 'g')")}, '\s+', ' ', 'g')) AS text, 'html' AS doc_kind FROM clean""")
def stream_extracted_query(spark, sf_dir):
    raw = stream(spark, sf_dir, "pages").select(F.lit("m").alias("muni"), "url", F.col("html").alias("raw_content"))
    docs = keep_extracted(extracted_documents(raw))
    return drained(spark, docs.select("url", "text", "doc_kind"), "extracted")


@query("stream_labels", sql="""SELECT CAST(doc_id AS VARCHAR) AS candidate_id,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'earlier' ELSE 'llm' END AS label_source FROM documents""")
def stream_labels_query(spark, sf_dir):
    """Resumable labelling: the sink already holds the labelled ids, the stream adds the others, a replay adds nothing."""
    folder = scratch_folder(spark, "labels")
    table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("candidate_id"), F.lit("earlier").alias("label_source")).write.parquet(
        f"{folder}/table/run=earlier/batch=0")
    candidates = stream(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), "text")

    def label(rows: DataFrame) -> DataFrame:
        measured = label_candidates(rows, lambda prompts: ["{}"] * len(prompts), max_chars=None)
        return measured.select("candidate_id", "label_source")

    for run in ("first", "replay"):
        label_stream(candidates, f"{folder}/table", f"{folder}/{run}", label).awaitTermination()
    return labelled(spark, f"{folder}/table")


@query("stream_labels_repeats", sql="""
  SELECT CAST(source AS VARCHAR) AS candidate_id, 1::BIGINT AS n FROM documents WHERE trim(source) <> '' GROUP BY source
  UNION ALL SELECT NULL, count(*) FROM documents WHERE doc_id % 10 = 0 HAVING count(*) > 0""")
def stream_labels_repeats(spark, sf_dir):
    """Ids that come hundreds of times in a batch are labelled once, rows without an id each once, whatever is replayed."""
    folder = scratch_folder(spark, "repeats")
    docs = stream(spark, sf_dir, "documents")
    candidates = docs.select(F.col("source").alias("candidate_id"), "text").unionByName(
        docs.where("doc_id % 10 = 0").select(F.lit(None).cast("string").alias("candidate_id"), "text"))

    def label(rows: DataFrame) -> DataFrame:
        return label_candidates(rows, lambda prompts: ["{}"] * len(prompts), max_chars=None).select("candidate_id", "label_source")

    for _ in range(2):  # the second run finds nothing new
        label_stream(candidates, f"{folder}/table", f"{folder}/state", label).awaitTermination()
    return labelled(spark, f"{folder}/table").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
