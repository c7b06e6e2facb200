"""Batch labeling by a user-supplied function, with resume and error rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from policyspark.functions.model_output import (
    annotation_defaults, error_row_columns, first_json_object, gate_answer, gate_prompt, render_prompt,
    with_mapped_answer,
)
from policyspark.functions.text import first_filled, one_line
from policyspark.operators.gate import primary_decision
from policyspark.operators.harmonise import labeler_fields
from policyspark.operators.joins import without
from policyspark.session import cut_lineage
from policyspark.sources.ndjson import path_exists
from policyspark.vocabulary import ANNOTATION_COLUMNS

Labeler = Callable[[list[str]], Sequence[str | None]]


def ask(prompts: DataFrame, labeler: Labeler, prompt: str = "prompt", answer: str = "answer",
        batch_size: int = 32) -> DataFrame:
    """Run ``labeler`` over the prompt column in batches; one answer per row, keyed by the row itself.

    The labeler gets a list of prompts and returns as many answers. A batch
    that raises, or that returns another number of answers, is retried prompt
    by prompt, and a prompt that still fails gets a null answer and the reason
    in ``{answer}_error``, so one bad row never costs another. Rows keep their
    own keys, nothing is matched by position across batches.

    Runs at once: the answers are kept in the checkpoint folder, so whatever
    reads them later asks no prompt a second time.
    """
    schema = StructType([*prompts.schema.fields, StructField(answer, StringType()), StructField(f"{answer}_error", StringType())])

    def single(text: str) -> tuple[str | None, str | None]:
        try:
            got = list(labeler([text]))
            return (got[0], None) if got else (None, "no answer")
        except Exception as error:  # a labeler is foreign code: one failure must not cost the others
            return None, f"{type(error).__name__}: {error}"

    def answers(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got = list(labeler(texts))
            if len(got) == len(texts):
                return [(g, None) for g in got]
        except Exception:  # each prompt is asked alone below and keeps its own error
            pass
        return [single(t) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an Arrow batch may hold 64 MB of prompts: only a slice of it becomes Python texts, and rows leave as they came
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                out = answers(part.column(prompt).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array([o[k] for o in out], pa.string(), from_pandas=True) for k in (0, 1)]], names=schema.names)

    return cut_lineage(prompts.mapInArrow(run, schema))


def ask_in_waves(prompts: DataFrame, labeler: Labeler, ledger: str, key: str, prompt: str = "prompt", answer: str = "answer",
                 waves: int = 16, batch_size: int = 32) -> DataFrame:
    """As :func:`ask`, with answers that outlive a failed run: ``ledger`` is a table of them by id and prompt.

    Prompts are dealt into ``waves`` by a hash of their id; a wave is asked and
    committed to the ledger at once, and prompts that the ledger holds are not
    asked again. So a run that fails is started again with the same ledger and
    repeats the running wave at most. A row is known by ``key`` and its prompt:
    a changed prompt is asked anew. Rows that repeat both share one answer. A null key or prompt is a
    value like any other. Rows of a failed prompt (null answer) count as answered.
    """
    spark = prompts.sparkSession
    name, text = F.col(key).cast("string"), F.col(prompt).cast("string")
    identity = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in (name, text)]), 256)
    rows = cut_lineage(prompts.withColumn("__id", identity))
    asked = rows.select("__id", prompt).dropDuplicates(["__id"])
    shape = StructType([StructField("__id", StringType()), StructField(answer, StringType()), StructField(f"{answer}_error", StringType())])

    def answered() -> DataFrame:
        return spark.read.schema(shape).parquet(ledger) if path_exists(spark, ledger) else spark.createDataFrame([], shape)

    for wave in range(waves):
        todo = asked.where(F.pmod(F.xxhash64("__id"), F.lit(waves)) == wave).join(answered(), "__id", "left_anti")
        if todo.isEmpty():
            continue
        got = ask(todo, labeler, prompt, answer, batch_size)
        got.select(*shape.names).write.mode("append").parquet(ledger)
    return rows.join(answered(), "__id", "left").drop("__id")


def rule_labeler(prompts: list[str]) -> list[str]:
    """A deterministic stand-in labeler: a measure when the prompt names a funding or legal word."""
    out = []
    for prompt in prompts:
        lowered = prompt.lower()
        hit = any(word in lowered for word in ("förder", "zuschuss", "satzung", "richtlinie"))
        out.append(json.dumps({
            "is_policy_measure": hit, "label": int(hit), "relevance_confidence": 0.9 if hit else 0.7,
            "confidence": 0.9 if hit else 0.7, "policy_field": "governance" if hit else None,
            "measure_type": "subsidy" if hit else None, "rationale": "rule",
        }))
    return out


def label_candidates(
    candidates: DataFrame, labeler: Labeler, template: str = "", *, done: DataFrame | None = None,
    order: str | None = None, max_items: int | None = None, max_chars: int | None = None, batch_rules: bool = False,
    model: str = "rule", provider: str = "local", profile: str | None = None, label_source: str = "llm",
) -> DataFrame:
    """candidates -> measure rows.

    Ids in ``done`` are skipped, then at most ``max_items`` rows (in ``order``)
    are taken, rows without text are dropped, and every other row yields
    exactly one measure row; a row without an answer becomes an error row.
    """
    todo = candidates if done is None else without(candidates, done, "candidate_id")
    if max_items is not None:
        todo = todo.orderBy(order).limit(max_items) if order else todo.limit(max_items)
    have = set(candidates.columns)

    def c(name: str):
        return F.col(name) if name in have else F.lit(None).cast("string")

    picked = labeler_fields(todo, max_chars, batch_rules)
    slim = picked.select(
        first_filled(c("candidate_id").cast("string"), c("id").cast("string")).alias("candidate_id"),
        c("document_id").cast("string").alias("document_id"), "pick_text", "pick_title", "pick_url", "pick_scope",
    )
    slim = slim.where("pick_text != ''")
    # in batch form a batch has no single scope, so none is shown to the labeler
    shown_scope = F.lit(None).cast("string") if batch_rules else F.col("pick_scope")
    prompts = slim.withColumn("prompt", render_prompt(template, "pick_text", "pick_title", "pick_url", shown_scope))
    answered = ask(prompts, labeler).drop("prompt").withColumn(
        "answer_json", F.when(F.col("answer").isNotNull(), first_json_object("answer")))
    mapped = with_mapped_answer(answered, "answer_json", "pick_text", "pick_title", "pick_url", shown_scope, label_source)
    failed = F.col("answer").isNull()
    errors = error_row_columns("pick_text", "pick_title", "pick_url", shown_scope, "llm_error")
    for name in ("policy_field", "measure_type", "target_group", "jurisdiction_level", "short_title"):
        mapped = mapped.withColumn(name, F.lit(None).cast("string"))
    merged = mapped.withColumns({name: F.when(failed, value).otherwise(F.col(name)) for name, value in errors.items()})
    out = merged.withColumns({
        "municipality_id": F.col("pick_scope"), "url": F.col("pick_url"),
        "llm_model": F.lit(model), "llm_provider": F.lit(provider), "llm_profile": F.lit(profile).cast("string"),
    })
    if batch_rules:
        out = out.withColumn("title", first_filled("title", "pick_title", default=""))
    return out.drop("answer", "answer_error", "answer_json", "pick_text", "pick_title", "pick_url", "pick_scope")


def stub_measures(candidates: DataFrame, label_source: str = "llm_stub") -> DataFrame:
    """Error-shaped rows for a disabled or dry-run labeler."""
    picked = labeler_fields(candidates, None, False)
    return picked.withColumns(
        error_row_columns("pick_text", "pick_title", "pick_url", "pick_scope", label_source)).drop(
        "pick_text", "pick_title", "pick_url", "pick_scope")


def gate_predictions(
    gold_test: DataFrame, labeler: Labeler, text: str, label: str, examples: str | None = None,
    max_chars: int | None = None, abstain_conf: float = 0.6,
) -> DataFrame:
    """candidate_id, gold_label, pred_label, abstained, confidence, rationale, raw."""
    body = F.substring(text, 1, max_chars) if max_chars and max_chars > 0 else F.col(text)
    prompts = gold_test.select(
        F.col("candidate_id").cast("string").alias("candidate_id"), F.col(label).cast("int").alias("gold_label"),
        gate_prompt(body, examples).alias("prompt"))
    answered = ask(prompts, labeler).drop("prompt").withColumn("__a", gate_answer("answer"))
    pred, abstained = primary_decision("__a.label", "__a.confidence", abstain_conf)
    return answered.select(
        "candidate_id", "gold_label", pred.alias("pred_label"), abstained.alias("abstained"),
        F.col("__a.confidence").alias("confidence"), one_line("__a.rationale").alias("rationale"),
        one_line(F.coalesce("answer", F.lit("")), "escape").alias("raw"))


def annotate(rows: DataFrame, labeler: Labeler, prompt: str = "prompt",
             columns: Sequence[str] = tuple(ANNOTATION_COLUMNS)) -> DataFrame:
    """Fill the annotation columns; rows that already carry is_policy_relevant pass through unchanged."""
    keep = [c for c in rows.columns if c not in (*columns, prompt)]
    missing = {c: F.lit(None).cast("string") for c in columns if c not in rows.columns}
    base = rows.withColumns(missing)
    set_already = F.coalesce(F.trim("is_policy_relevant"), F.lit("")) != ""
    finished = base.where(set_already).select(*keep, *columns)
    open_rows = base.where(~set_already).drop(*columns)
    answered = ask(open_rows, labeler, prompt)
    labels = answered.withColumn(
        "__labels", F.coalesce(F.from_json(first_json_object("answer"), "map<string,string>"),
                               F.create_map().cast("map<string,string>")))
    labelled = labels.withColumns(annotation_defaults("__labels", columns)).select(*keep, *columns)
    return finished.unionByName(labelled)
