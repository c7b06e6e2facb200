"""Weak-label bootstrap: pool statistics, leakage filter, training set, text classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyspark.functions.text import let
from policyspark.operators.gate import plain_metrics
from policyspark.operators.joins import without
from policyspark.operators.sampling import split_summary, stratified_split
from policyspark.session import cut_lineage, kept_table


def weak_pool_stats(pool: DataFrame, label: str = "rule_label") -> DataFrame:
    """n_total, n_pos, n_neg, n_abstain and coverage of a tri-state label."""
    value = F.col(label)
    counts = pool.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(value == 1).alias("n_pos"),
        F.count_if(value == 0).alias("n_neg"), F.count_if(value.isNull()).alias("n_abstain"),
    )
    labelled = F.col("n_pos") + F.col("n_neg")
    return counts.withColumn(
        "coverage", F.when(F.col("n_total") > 0, labelled / F.col("n_total")).otherwise(F.lit(0.0)))


def confident_weak_labels(pool: DataFrame, min_pos_score: float = 3, max_neg_score: float = 0) -> DataFrame:
    """Labelled weak rows; with a score column positives need a high and negatives a low score."""
    label = F.col("rule_label")
    kept = pool.where(label.isin(0, 1))
    if "rule_score" in pool.columns:
        score = F.col("rule_score")
        kept = kept.where(((label == 1) & (score >= min_pos_score)) | ((label == 0) & (score <= max_neg_score)))
    return kept


def without_test_rows(pool: DataFrame, gold_test: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The pool minus every id of the gold test side."""
    return without(pool, gold_test, key)


def training_set(gold_train: DataFrame, pool: DataFrame, text: str = "text",
                 gold_label: str = "gold_is_policy_measure", min_pos_score: float = 3, max_neg_score: float = 0,
                 drop_gold_repeats: bool = False) -> DataFrame:
    """UNION ALL of gold rows and confident weak rows as (candidate_id, text, label).

    Weak rows that repeat a gold train row stay unless ``drop_gold_repeats``.
    """
    weak = confident_weak_labels(pool, min_pos_score, max_neg_score)
    if drop_gold_repeats:
        weak = without(weak, gold_train, "candidate_id")
    gold_part = gold_train.select(
        F.col("candidate_id").cast("string").alias("candidate_id"), F.col(text).cast("string").alias(text),
        F.col(gold_label).cast("int").alias("label"))
    weak_part = weak.select(
        F.col("candidate_id").cast("string").alias("candidate_id"), F.col("text").cast("string").alias(text),
        F.col("rule_label").cast("int").alias("label"))
    return gold_part.unionByName(weak_part)


def with_class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Balanced weights n / (classes * n_class) from one aggregate over the labels."""
    counts = df.groupBy(F.col(label).cast("int").alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    size = counts.agg(F.sum("__n").alias("t"), F.count(F.lit(1)).alias("k")).select(F.col("t") / F.col("k")).scalar()
    joined = df.join(counts, F.col(label).cast("int").eqNullSafe(F.col("__l")), "left")
    return joined.withColumn(weight, size / F.col("__n")).drop("__l", "__n")


#: Texts that are looked at for frequent terms, and the share of them that a frequent term is in.
FREQUENT_SAMPLE, FREQUENT_SHARE = 1000, 0.05


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of the column ``texts``, counted inside the row: words and pairs of neighbouring words in lower case."""
    def words(t: Column) -> Column:
        return F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))

    def pairs(w: Column) -> Column:
        fewer = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), fewer), F.slice(w, F.lit(2), fewer), lambda a, b: F.concat_ws(" ", a, b))

    terms = F.flatten(F.transform("texts", lambda t: let(words(t), lambda w: F.concat(w, pairs(w)))))
    ordered = texts.select(key, F.sort_array(terms).alias("t")).where("size(t) > 0")
    # where runs of equal terms start, and one place beyond the last
    starts = F.concat(
        F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2))), F.array(F.size("t") + 1))
    runs = ordered.select(key, "t", starts.alias("s")).select(key, F.explode(F.zip_with(
        F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
        lambda a, b: F.struct(F.get("t", a - 1).alias("term"), (b - a).cast("long").alias("tf")))).alias("r"))
    return runs.select(key, "r.term", "r.tf")


def tfidf_weights(rows: DataFrame, key: str, text: str, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(key, term, weight): the features of :func:`train_classifier` as a table, one row per text and term.

    Terms are words of two characters and more and pairs of neighbouring
    words, in lower case; weights are tf * (ln((n + 1) / (df + 1)) + 1), each
    text normed to length 1. Null texts count as empty, and ``key`` is unique.

    Terms are counted inside the row. Their rows travel twice: to their term,
    for its document frequency, and back to their text, for its length. Terms
    that are frequent in a sample of texts (a bounded list) do not travel to
    one task: their frequencies are combined before the shuffle, at once, and
    kept in the checkpoint folder.
    """
    texts = rows.groupBy(key).agg(F.collect_list(F.coalesce(text, F.lit(""))).alias("texts"))
    tf = term_counts(texts, key)
    n_rows = rows.count()
    n = F.lit(n_rows)
    sample = rows.select(key, F.array(F.coalesce(text, F.lit(""))).alias("texts")).orderBy(F.xxhash64(key)).limit(FREQUENT_SAMPLE)
    least = max(2, FREQUENT_SHARE * min(FREQUENT_SAMPLE, n_rows))
    seen = kept_table(term_counts(sample, key).groupBy("term").count().where(F.col("count") >= least).select("term"), "frequent")
    frequencies = kept_table(tf.join(seen, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    frequent = tf.join(frequencies, "term")
    others = tf.join(seen, "term", "left_anti").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
    kept = frequent.select(key, "term", "tf", "df").unionByName(others).where((F.col("df") >= min_df) & (F.col("df") <= n * max_df))
    raw = kept.where(F.col(key).isNotNull()).select(key, "term", (F.col("tf") * (F.log((n + 1) / (F.col("df") + 1)) + 1)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


#: Numbers that terms are hashed to: the length of every vector that the driver holds, whatever the vocabulary.
BUCKETS = 1 << 18


def train_classifier(train: DataFrame, text: str = "text", label: str = "label", min_df: int = 2,
                     max_df: float = 0.95, iterations: int = 100, c: float = 1.0, buckets: int = BUCKETS,
                     partitions: int | None = None):
    """Fit TF-IDF over words and word pairs and a balanced logistic regression; returns a PipelineModel.

    Terms are hashed to ``buckets`` numbers; those that share one share their
    counts, document frequency and coefficient. The weights are tf * (ln((n + 1) / (df + 1)) + 1)
    where the bucket's document frequency lies within ``min_df`` and
    ``max_df``, else 0; rows are l2-normalised. ML's IDF lacks the final + 1,
    so the weights are applied as an element-wise product. Nothing that the
    driver holds grows with the vocabulary: document frequencies, weights,
    coefficients and the optimiser's history are vectors over the buckets.
    ``partitions`` deals the rows out first; small tables come in few.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
    from pyspark.ml.linalg import Vectors

    rows = with_class_weights(train.withColumn(label, F.col(label).cast("int")), label).select(text, label, "weight")
    rows = rows.repartition(partitions) if partitions else rows
    prepare = PipelineModel([
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="__words", outputCol="__pairs"),
        SQLTransformer(statement="SELECT *, concat(__words, __pairs) AS __terms FROM __THIS__"),
        HashingTF(inputCol="__terms", outputCol="__tf", numFeatures=buckets),
    ])
    # the counts are read for the document frequencies and in every iteration
    counted = cut_lineage(prepare.transform(rows).select("__tf", label, "weight"))
    # a pass sends vectors over the buckets from every partition: there are as many as cores, however many rows
    counted = counted.coalesce(max(1, counted.sparkSession.sparkContext.defaultParallelism))
    n = counted.count()
    inverse = IDF(inputCol="__tf", outputCol="__idf").fit(counted).idf.toArray()
    df = np.rint((n + 1) * np.exp(-inverse) - 1)
    kept = (df >= min_df) & (df <= max_df * n)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(np.where(kept, inverse + 1.0, 0.0)), inputCol="__tf", outputCol="__tfidf")
    unit = Normalizer(p=2.0, inputCol="__tfidf", outputCol="__features")
    regression = LogisticRegression(
        featuresCol="__features", labelCol=label, weightCol="weight", maxIter=iterations,
        regParam=1.0 / (c * max(1, n)), standardization=False,
    ).fit(unit.transform(scale.transform(counted)))
    return PipelineModel([*prepare.stages, scale, unit, regression])


def predict_table(model, df: DataFrame, label: str, key: str = "candidate_id") -> DataFrame:
    """candidate_id, gold_label, pred_label, score."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    return scored.select(
        F.col(key).cast("string").alias(key), F.col(label).cast("int").alias("gold_label"),
        F.col("prediction").cast("int").alias("pred_label"),
        vector_to_array("probability")[1].alias("score"),
    )


def bootstrap_inputs(gold: DataFrame, pool: DataFrame, text: str = "text", label: str = "gold_is_policy_measure",
                     seed: int = 42, test_frac: float = 0.3, min_pos_score: float = 3, max_neg_score: float = 0,
                     portable: bool = False) -> dict[str, DataFrame]:
    """What the experiment trains and tests on: split, gold_train, gold_test, clean_pool (without test rows) and train."""
    split = stratified_split(gold, "candidate_id", label, test_frac, seed, portable=portable)
    gold_train = split.where(F.col("split") == "train").drop("split")
    gold_test = split.where(F.col("split") == "test").drop("split")
    clean_pool = without_test_rows(pool, gold_test)
    train = training_set(gold_train, clean_pool, text, label, min_pos_score, max_neg_score)
    return {"split": split, "gold_train": gold_train, "gold_test": gold_test, "clean_pool": clean_pool, "train": train}


def bootstrap_sizes(inputs: dict[str, DataFrame], pool: DataFrame, label: str = "gold_is_policy_measure") -> DataFrame:
    """One row: sizes and positives of both sides of the split, the pool before and after the leakage filter, the training set."""
    train = inputs["train"].agg(F.count(F.lit(1)).alias("n_bootstrap"), F.count_if(F.col("label") == 1).alias("pos_bootstrap"))
    before = weak_pool_stats(pool).select(F.col("n_total").alias("n_pool"))
    after = weak_pool_stats(inputs["clean_pool"]).select(F.col("n_total").alias("n_clean_pool"))
    out = split_summary(inputs["split"], label)
    for part in (before, after, train):  # one row each
        out = out.withColumns({c: part.select(c).scalar() for c in part.columns})
    return out


def bootstrap_experiment(gold: DataFrame, pool: DataFrame, text: str = "text",
                         label: str = "gold_is_policy_measure", seed: int = 42, test_frac: float = 0.3,
                         min_pos_score: float = 3, max_neg_score: float = 0, portable: bool = False, **options) -> dict[str, DataFrame]:
    """Split, baseline, leakage filter, retrain, and both evaluations on the gold test side.

    The split is kept in the checkpoint folder and each prediction is made once.
    """
    gold = cut_lineage(gold)
    inputs = bootstrap_inputs(gold, pool, text, label, seed, test_frac, min_pos_score, max_neg_score, portable)
    inputs["gold_test"] = cut_lineage(inputs["gold_test"])
    baseline = train_classifier(inputs["gold_train"], text, label, **options)
    bootstrapped = train_classifier(inputs["train"], text, "label", **options)
    baseline_predictions = cut_lineage(predict_table(baseline, inputs["gold_test"], label))
    bootstrap_predictions = cut_lineage(predict_table(bootstrapped, inputs["gold_test"], label))
    return {
        "split_meta": split_summary(inputs["split"], label).withColumns({"seed": F.lit(seed), "test_frac": F.lit(test_frac)}),
        "weak_before": weak_pool_stats(pool),
        "weak_after": weak_pool_stats(inputs["clean_pool"]),
        "baseline_predictions": baseline_predictions,
        "bootstrap_predictions": bootstrap_predictions,
        "baseline_metrics": plain_metrics(baseline_predictions),
        "bootstrap_metrics": plain_metrics(bootstrap_predictions),
    }
