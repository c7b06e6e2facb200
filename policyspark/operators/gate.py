"""Evidence gate, abstention rules, abstention-aware metrics and threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions.text import col, let, to_number
from policyspark.vocabulary import DECLARED_EVIDENCE_PATTERNS, EVIDENCE_WORDS


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?U)" + pattern)


def has_evidence(text: Column | str, words: dict[str, str] | None = None) -> Column:
    """(money and funding) or legal or (decision and (legal or funding or implementation))."""
    words = words or EVIDENCE_WORDS

    def decide(lowered: Column) -> Column:
        found = {name: _matches(lowered, pattern) for name, pattern in words.items()}
        return (
            found["legal"]
            | (found["money"] & found["funding"])
            | (found["decision"] & (found["funding"] | found["implementation"]))
        )

    return let(F.lower(F.coalesce(col(text), F.lit(""))), decide)


def declared_evidence(text: Column | str, patterns: dict[str, str] | None = None) -> Column:
    """Names of the declared evidence patterns that match."""
    def names(lowered: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(_matches(lowered, pattern), F.lit(name))
            for name, pattern in (patterns or DECLARED_EVIDENCE_PATTERNS).items()
        ]))

    return let(F.lower(F.coalesce(col(text), F.lit(""))), names)


def primary_decision(label: Column | str, confidence: Column | str, abstain_conf: float = 0.6) -> tuple[Column, Column]:
    """(pred_label, abstained): abstain on -1 or low confidence, else 1 or 0."""
    label, confidence = col(label), col(confidence)
    abstained = (label == -1) | (confidence < abstain_conf)
    return F.when(~abstained, F.when(label == 1, 1).otherwise(0)), abstained


def _regate(pred: Column, abstained: Column, accepted: Column, low: Column) -> tuple[Column, Column]:
    rejected = (pred == 1) & ~accepted
    rejected = F.coalesce(rejected, F.lit(False))
    fresh_abstain = rejected | (~abstained & low)
    return F.when(~fresh_abstain, pred), abstained | fresh_abstain


def post_gate(predictions: DataFrame, text: Column | str, pos_conf: float = 0.9, abstain_conf: float = 0.6,
              words: dict[str, str] | None = None) -> DataFrame:
    """Re-decide predictions: positives need evidence and confidence, everything needs confidence.

    The stored confidence stays as it is; rows that already abstained keep
    their label unless it is an unsupported positive.
    """
    confidence = F.coalesce(to_number(F.col("confidence")), F.lit(0.0))
    pred = to_number(F.col("pred_label")).cast("int")
    staged = predictions.withColumns({
        "__evidence": has_evidence(text, words), "__conf": confidence, "__pred": pred,
        "__abst": F.col("abstained").cast("boolean"),
    })
    c = F.col("__conf")
    new_pred, new_abstained = _regate(
        F.col("__pred"), F.col("__abst"), F.col("__evidence") & (c >= pos_conf), c < abstain_conf)
    return staged.withColumns({"pred_label": new_pred, "abstained": new_abstained}).select(*predictions.columns)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0)).cast("double")


def _metric_columns(weight: Column | None = None) -> list[Column]:
    def count(condition: Column) -> Column:
        if weight is None:
            return F.count_if(condition)
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("long")

    live = ~F.col("abstained")
    gold, pred = F.col("gold_label"), F.col("pred_label")
    return [
        count(F.lit(True)).alias("n_total"),
        count(live).alias("n_classified"),
        count(~live).alias("n_abstain"),
        count(live & (gold == 1) & (pred == 1)).alias("tp"),
        count(live & (gold == 0) & (pred == 0)).alias("tn"),
        count(live & (gold == 0) & (pred == 1)).alias("fp"),
        count(live & (gold == 1) & (pred == 0)).alias("fn"),
        count(gold == 1).alias("pos_total"),
        count((gold == 1) & (pred == 1)).alias("tp_total"),
    ]


def _with_ratios(counts: DataFrame) -> DataFrame:
    c = F.col
    with_parts = counts.withColumns({
        "coverage": _ratio(c("n_classified"), c("n_total")),
        "precision": _ratio(c("tp"), c("tp") + c("fp")),
        "recall": _ratio(c("tp"), c("tp") + c("fn")),
        "f1": _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        "accuracy_classified": _ratio(c("tp") + c("tn"), c("n_classified")),
        "recall_overall": _ratio(c("tp_total"), c("pos_total")),
    })
    return with_parts


METRIC_COLUMNS = ["n_total", "n_classified", "n_abstain", "coverage", "tp", "tn", "fp", "fn", "precision",
                  "recall", "f1", "accuracy_classified", "pos_total", "tp_total", "recall_overall"]


def gate_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and ratios of gold_label/pred_label/abstained, one row (or one per ``by`` key)."""
    counts = predictions.groupBy(*by).agg(*_metric_columns())
    return _with_ratios(counts).select(*by, *METRIC_COLUMNS)


def plain_metrics(predictions: DataFrame) -> DataFrame:
    """The metrics without abstention: n, confusion counts, precision, recall, f1, accuracy."""
    scored = gate_metrics(predictions.withColumn("abstained", F.lit(False)))
    return scored.select(
        F.col("n_total").alias("n"), "tp", "tn", "fp", "fn", "precision", "recall", "f1",
        F.col("accuracy_classified").alias("accuracy"),
    )


def metrics_from_confusion(table: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of tp/tn/fp/fn columns (missing columns count as 0)."""
    have = set(table.columns)
    base = table.withColumns({
        k: F.coalesce(F.col(k).cast("long"), F.lit(0)) if k in have else F.lit(0).cast("long")
        for k in ("tp", "tn", "fp", "fn")
    })
    c = F.col
    return base.withColumns({
        "precision": _ratio(c("tp"), c("tp") + c("fp")),
        "recall": _ratio(c("tp"), c("tp") + c("fn")),
        "f1": _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        "accuracy": _ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")),
    })


def threshold_sweep(predictions: DataFrame, text: Column | str, pos_confs: Sequence[float],
                    abstain_conf: float = 0.6, words: dict[str, str] | None = None) -> DataFrame:
    """Post-gated metrics for every threshold from a single scan.

    A threshold only asks how many of the sorted thresholds a confidence
    reaches. The rows are counted per (label, prediction, evidence, ..., that
    number) first; the thresholds are then applied to those few counts, never
    to the rows.
    """
    cuts = sorted(set(float(p) for p in pos_confs))
    confidence = F.coalesce(to_number(F.col("confidence")), F.lit(0.0))
    reached = sum((F.when(confidence >= p, 1).otherwise(0) for p in cuts), F.lit(0))
    profile = predictions.select(
        F.col("gold_label").cast("int").alias("gold_label"),
        to_number(F.col("pred_label")).cast("int").alias("__pred"),
        F.col("abstained").cast("boolean").alias("__abst"),
        has_evidence(text, words).alias("__evidence"),
        (confidence < abstain_conf).alias("__low"),
        reached.alias("__reached"),
    ).groupBy("gold_label", "__pred", "__abst", "__evidence", "__low", "__reached").agg(
        F.count(F.lit(1)).alias("__n"))
    settings = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(p).alias("pos_conf")) for i, p in enumerate(cuts)])
    swept = profile.select("*", F.explode(settings).alias("__s"))
    pred, abstained = _regate(
        F.col("__pred"), F.col("__abst"), F.col("__evidence") & (F.col("__reached") >= F.col("__s.rank")),
        F.col("__low"))
    swept = swept.select(
        F.col("__s.pos_conf").alias("pos_conf"), "gold_label", pred.alias("pred_label"),
        abstained.alias("abstained"), "__n")
    counts = swept.groupBy("pos_conf").agg(*_metric_columns(F.col("__n")))
    return _with_ratios(counts).select("pos_conf", *METRIC_COLUMNS)


def operating_points(metrics: DataFrame, setting: Column | str) -> DataFrame:
    """Report table of metric rows: counts default to 0, ratios to NaN."""
    have = set(metrics.columns)

    def number(name: str, *others: str, whole: bool) -> Column:
        picks = [F.col(c) for c in (name, *others) if c in have]
        kind, default = ("long", F.lit(0)) if whole else ("double", F.lit(float("nan")))
        return F.coalesce(*[p.cast(kind) for p in picks], default.cast(kind)).alias(name)

    return metrics.select(
        col(setting).alias("setting"),
        number("n_total", "n", whole=True), number("n_classified", "n", whole=True),
        number("n_abstain", whole=True), number("coverage", whole=False),
        *[number(k, whole=True) for k in ("tp", "tn", "fp", "fn")],
        number("precision", whole=False),
        number("recall", whole=False).alias("recall_classified"), number("f1", whole=False).alias("f1_classified"),
        number("recall_overall", whole=False), number("accuracy_classified", whole=False),
    )


def two_decimals(c: Column | str) -> Column:
    """Text with two decimals, empty for null, NaN and infinities."""
    c = col(c)
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, F.format_string("%.2f", c)).otherwise("")


def log_metrics(log_text: Column | str, key: str) -> Column:
    """Map of the dictionary that follows ``key`` in a log text, null when absent."""
    import re

    found = F.regexp_extract(col(log_text), re.escape(key).replace("\\ ", " ") + r"\s*(\{.*\})", 1)
    return F.from_json(F.nullif(found, F.lit("")), "map<string,double>", {"allowSingleQuotes": "true"})
