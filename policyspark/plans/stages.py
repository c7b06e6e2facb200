"""End-to-end plans: each takes and returns DataFrames; those that ask a labeler ask it at once and once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark.functions.terms import KeywordRules
from policyspark.functions.text import pick_column
from policyspark.operators import profile, report
from policyspark.operators.classify import BaselineRules, baseline_labels
from policyspark.operators.export import analysis_table
from policyspark.operators.gate import gate_metrics, post_gate
from policyspark.operators.harmonise import extracted_documents, keep_extracted
from policyspark.operators.joins import with_gold_text
from policyspark.operators.labeling import Labeler, gate_predictions, label_candidates
from policyspark.operators.sampling import balanced_head, few_shot_block, lowest, seeded_sample, stratified_split
from policyspark.operators.snippets import snippet_candidates
from policyspark.session import cut_lineage
from policyspark.vocabulary import MUNICIPALITY_ALIASES, PROFILE_FIELDS, TEXT_ALIASES


def extract(raw: DataFrame, **columns) -> DataFrame:
    """Raw records -> extracted documents."""
    return keep_extracted(extracted_documents(raw, **columns))


def candidates(documents: DataFrame, rules: KeywordRules | None = None, **options) -> DataFrame:
    """Extracted documents -> snippet candidates."""
    return snippet_candidates(documents, rules, **options)


def label(candidate_rows: DataFrame, labeler: Labeler, **options) -> DataFrame:
    """Candidates -> labelled measures (resumable with ``done``)."""
    return label_candidates(candidate_rows, labeler, **options)


def baseline(candidate_rows: DataFrame, rules: BaselineRules = BaselineRules()) -> DataFrame:
    """Candidates -> baseline measures."""
    return baseline_labels(candidate_rows, rules)


def analysis(measures: DataFrame, documents: DataFrame, municipalities: DataFrame, scope: str, **options) -> DataFrame:
    """Measures -> analysis table."""
    return analysis_table(measures, documents, municipalities, scope, **options)


def inspect(measures: DataFrame, order: str, id_column: str = "candidate_id", top_k: int = 10,
            show_lowest: int = 10, show_random: int = 10, keep_rows: int | None = None, seed: int = 42,
            broken: str | None = None) -> dict[str, DataFrame]:
    """The measure profile as named tables.

    With ``broken`` set, unparsable lines count in the base of the percentages
    and nowhere else. Runs at once: the columns that the tables need are kept
    in the checkpoint folder, so the measures are computed once for all of them.
    """
    needed = {*PROFILE_FIELDS, *profile.SAMPLE_COLUMNS, *profile.SAMPLE_SOURCES, order, id_column, broken}
    measures = cut_lineage(measures.select(*[F.col(f"`{c}`") for c in measures.columns if c in needed]))
    rows = measures if broken is None else measures.where(~F.col(broken))
    for name in PROFILE_FIELDS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    fields = [f for f in PROFILE_FIELDS if f != "confidence_score"]
    total = measures.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = rows if keep_rows is None else rows.orderBy(order).limit(keep_rows)
    return {
        "missing": profile.missing_rates(measures, broken=broken),
        "top_values": profile.top_values(rows, fields, top_k, total),
        "buckets": profile.confidence_buckets(rows),
        "stats": profile.confidence_stats(rows),
        "lowest": profile.sample_view(lowest(rows, "confidence_score", order, show_lowest, keep_rows)),
        "random": profile.sample_view(seeded_sample(kept, id_column, show_random, seed)),
    }


def regate(predictions: DataFrame, gold: DataFrame, text: str = "text_for_annotation", pos_conf: float = 0.9,
           abstain_conf: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Predictions and gold texts -> post-gated predictions and their metrics."""
    joined = with_gold_text(predictions, gold, text)
    gated = post_gate(joined, text, pos_conf, abstain_conf)
    return gated.select(*predictions.columns), gate_metrics(gated)


def gate_evaluation(gold: DataFrame, labeler: Labeler, text: str = "text_for_annotation",
                    label_column: str = "gold_is_policy_measure", seed: int = 42, test_frac: float = 0.3,
                    few_shot: bool = False, k_pos: int = 3, k_neg: int = 3, max_chars: int | None = None,
                    max_test_n: int | None = None, ensure_pos: bool = False,
                    abstain_conf: float = 0.6, portable: bool = False) -> tuple[DataFrame, DataFrame]:
    """Gold table -> gate predictions on the test side and their metrics.

    Examples come from the training side only. The rendered block is the one
    value that passes through the driver: k_pos + k_neg capped texts.
    """
    split = stratified_split(gold, "candidate_id", label_column, test_frac, seed, portable=portable)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test").drop("split")
    examples = None
    if few_shot:
        examples = few_shot_block(train, text, label_column, "candidate_id", k_pos, k_neg, seed, max_chars, portable).first()[0]
    chosen = balanced_head(test, label_column, "candidate_id", max_test_n, ensure_pos)
    predictions = gate_predictions(chosen, labeler, text, label_column, examples, max_chars, abstain_conf)
    return predictions, gate_metrics(predictions)


def report_tables(pool: DataFrame, weak: DataFrame, gold: DataFrame, annotation: DataFrame,
                  extra: DataFrame) -> dict[str, DataFrame]:
    """The aggregates of the report, one table per figure; absent columns leave their table out."""
    out: dict[str, DataFrame] = {"dataset_sizes": report.dataset_sizes({
        "unlabeled_pool": pool, "weak_rules_labels": weak, "goldstandard_gold": gold,
        "annotation_master": annotation, "annotation_extra30": extra,
    })}
    gold_label = pick_column(gold.columns, ["gold_is_policy_measure", "is_policy_measure"])

    def tagged(df: DataFrame, column: str | None) -> tuple[DataFrame, str | None]:
        if column is None or column not in df.columns:
            return df, None
        return report.with_binary_label(df, column, "__label"), "__label"

    out["label_balance"] = report.label_balance({
        "Gold": tagged(gold, gold_label),
        "Weak rules": (weak, "rule_label" if "rule_label" in weak.columns else None),
        "Annotation master": tagged(annotation, "is_policy_measure"),
    })
    texts = {
        name: (df, pick_column(df.columns, TEXT_ALIASES))
        for name, df in {"unlabeled_pool": pool, "weak_rules_labels": weak, "goldstandard_gold": gold}.items()
    }
    texts = {name: pair for name, pair in texts.items() if pair[1]}
    if texts:
        out["text_lengths"] = report.text_length_histogram(texts)
    if "rule_label" in weak.columns:
        out["weak_coverage"] = report.coverage_counts(weak, "rule_label")
    if {"rule_label", "rule_score"} <= set(weak.columns):
        out["rule_scores"] = report.rule_score_histogram(weak)
    if "matched_rules" in weak.columns:
        out["top_rules"] = report.rule_frequencies(weak)
        if "rule_label" in weak.columns:
            out["top_rules_positive"] = report.rule_frequencies(weak.where(F.col("rule_label") == 1))
    if "is_policy_measure" in annotation.columns:
        out["annotation_progress"] = report.annotation_progress(annotation, "is_policy_measure")
    extra_label = pick_column(extra.columns, ["annotated_is_policy_measure", "is_policy_measure"])
    if extra_label:
        out["annotation_progress_extra"] = report.annotation_progress(extra, extra_label)
    municipality = pick_column(gold.columns, MUNICIPALITY_ALIASES)
    if municipality and gold_label:
        labelled, name = tagged(gold, gold_label)
        out["municipality_support"] = report.municipality_support(labelled, name, municipality)
    return out

