"""Queries over predictions and weak labels: gate, metrics, sweeps, splits, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark.catalog import query
from policyspark.catalog.inputs import (
    DOCUMENTS_SQL, EVIDENCE, EVIDENCE_SQL, METRICS_SQL, PREDICTIONS_SQL, WEAK_SQL, documents, gated_sql, predictions,
    ratios_sql, rounded, sql_word, table, weak_pool,
)
from policyspark.functions.model_output import gate_prompt, render_prompt
from policyspark.functions.text import pick_column
from policyspark.operators import bootstrap, gate, joins, labeling, sampling
from policyspark.plans import stages
from policyspark.session import parallelism
from policyspark.vocabulary import GATE_JSON_INSTRUCTIONS, ID_ALIASES, MUNICIPALITY_ALIASES, TEXT_ALIASES

POS_CONF = 0.3


def gold(spark, sf_dir) -> DataFrame:
    """documents JOIN labels as the gold table."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    docs = documents(spark, sf_dir).select("document_id", "doc_id", "municipality_id", "text")
    return docs.join(labels, F.col("doc_id") == F.col("l_id")).select(
        F.col("document_id").alias("candidate_id"), "doc_id", "municipality_id", "text", "toxic",
        F.col("quality").alias("gold_is_policy_measure"))


GOLD_SQL = """gold AS (SELECT CAST(d.doc_id AS VARCHAR) AS candidate_id, d.doc_id, d.source AS municipality_id, d.text,
  l.quality AS label, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


@query("evidence_gate", sql=f"WITH {DOCUMENTS_SQL} SELECT doc_id, {EVIDENCE_SQL} AS evidence FROM docs")
def evidence_gate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", gate.has_evidence("text", EVIDENCE).alias("evidence"))


@query("evidence_default_words", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT {sql_word('satzung|verordnung|richtlinie|pflicht|verpflichtend')} AS evidence, count(*) AS n FROM docs GROUP BY ALL""")
def evidence_default_words(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(gate.has_evidence("text").alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


@query("declared_evidence", sql=f"""WITH {DOCUMENTS_SQL}, flags AS (
    SELECT doc_id, {sql_word('licensed|pas')} AS a, {sql_word('ther|thth|die')} AS b, {sql_word('wh|ou|und')} AS c FROM docs)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN a THEN 'legal' END, CASE WHEN b THEN 'decision' END,
    CASE WHEN c THEN 'implementation' END], lambda x: x IS NOT NULL), '|') AS patterns FROM flags""")
def declared_evidence(spark, sf_dir):
    chosen = {k: EVIDENCE[k] for k in ("legal", "decision", "implementation")}
    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(gate.declared_evidence("text", chosen), "|").alias("patterns"))


@query("primary_decisions", sql=f"""WITH {PREDICTIONS_SQL}, l AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id % 3 END AS label FROM preds)
  SELECT candidate_id, label = -1 OR confidence < 0.6::DOUBLE AS abstained,
    CAST(CASE WHEN label = -1 OR confidence < 0.6::DOUBLE THEN NULL WHEN label = 1 THEN 1 ELSE 0 END AS INT) AS pred_label FROM l""")
def primary_decisions(spark, sf_dir):
    p = predictions(spark, sf_dir)
    label = F.when(F.col("doc_id") % 4 == 0, -1).otherwise(F.col("doc_id") % 3)
    pred, abstained = gate.primary_decision(label, "confidence")
    return p.select("candidate_id", abstained.alias("abstained"), pred.alias("pred_label"))


def regated(spark, sf_dir, pos_conf=POS_CONF) -> DataFrame:
    return gate.post_gate(predictions(spark, sf_dir), "text", pos_conf, 0.6, EVIDENCE)


@query("post_gate_decisions", sql=f"""WITH {gated_sql(str(POS_CONF))}
  SELECT candidate_id, CAST(gold_label AS INT) AS gold_label, CAST(pred_label AS INT) AS pred_label, abstained,
         round(confidence, 6) AS confidence FROM gated""")
def post_gate_decisions(spark, sf_dir):
    return rounded(regated(spark, sf_dir).select("candidate_id", "gold_label", "pred_label", "abstained", "confidence"))


@query("gate_metrics", sql=f"WITH {gated_sql(str(POS_CONF))}, m AS ({METRICS_SQL.format(by='', source='gated', group='')}) {ratios_sql()}")
def gate_metrics(spark, sf_dir):
    return rounded(gate.gate_metrics(regated(spark, sf_dir)))


@query("gate_metrics_per_source", sql=f"""WITH {gated_sql(str(POS_CONF))},
  m AS ({METRICS_SQL.format(by='municipality_id,', source='gated', group='GROUP BY municipality_id')})
  {ratios_sql('municipality_id,')}""")
def gate_metrics_per_source(spark, sf_dir):
    return rounded(gate.gate_metrics(regated(spark, sf_dir), ["municipality_id"]))


SWEEP = [0.2, 0.4, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95]


def _sweep_sql(final: str | None = None) -> str:
    cuts = ", ".join(f"({p}::DOUBLE)" for p in SWEEP)
    return f"""WITH {PREDICTIONS_SQL}, cuts(pos_conf) AS (VALUES {cuts}), ev AS (SELECT *, {EVIDENCE_SQL} AS evidence FROM preds),
      s1 AS (SELECT *, COALESCE(pred_label = 1 AND (NOT evidence OR confidence < pos_conf), false) AS rejected FROM ev, cuts),
      s2 AS (SELECT *, rejected OR (NOT abstained AND confidence < 0.6::DOUBLE) AS fresh FROM s1),
      gated AS (SELECT pos_conf, gold_label, CASE WHEN fresh THEN NULL ELSE pred_label END AS pred_label,
        abstained OR fresh AS abstained FROM s2),
      m AS ({METRICS_SQL.format(by='pos_conf,', source='gated', group='GROUP BY pos_conf')}) {final or ratios_sql('pos_conf,')}"""


@query("gate_sweep", sql=_sweep_sql())
def gate_sweep(spark, sf_dir):
    return rounded(gate.threshold_sweep(predictions(spark, sf_dir), "text", SWEEP, 0.6, EVIDENCE))


@query("operating_points", sql=_sweep_sql(
    "SELECT 'pos_conf=' || pos_conf AS setting, CAST(n_total AS BIGINT) AS n_total, "
    "CAST(n_classified AS BIGINT) AS n_classified, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
    "printf('%.2f', n_classified::DOUBLE / n_total) AS coverage, "
    "printf('%.2f', CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END) AS precision, "
    "printf('%.2f', CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END) AS recall_classified FROM m"))
def operating_points(spark, sf_dir):
    swept = gate.threshold_sweep(predictions(spark, sf_dir), "text", SWEEP, 0.6, EVIDENCE)
    points = gate.operating_points(swept, F.concat(F.lit("pos_conf="), F.col("pos_conf").cast("string")))
    text = {c: gate.two_decimals(c) for c in ("coverage", "precision", "recall_classified")}
    return points.withColumns(text).select("setting", "n_total", "n_classified", "tp", "fp", *text)


@query("plain_metrics", sql=f"""WITH {WEAK_SQL}, p AS (
    SELECT l.quality AS g, w.rule_label AS p FROM weak w JOIN labels l ON l.doc_id = w.doc_id WHERE w.rule_label IS NOT NULL),
  m AS (SELECT count(*) AS n, sum((g=1 AND p=1)::INT) AS tp, sum((g=0 AND p=0)::INT) AS tn, sum((g=0 AND p=1)::INT) AS fp,
    sum((g=1 AND p=0)::INT) AS fn FROM p)
  SELECT n, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
    round(CASE WHEN tp+fp > 0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp+fn > 0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2*tp+fp+fn > 0 THEN (2*tp)::DOUBLE/(2*tp+fp+fn) ELSE 0 END, 6) AS f1,
    round((tp+tn)::DOUBLE/n, 6) AS accuracy FROM m""")
def plain_metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold_label"))
    p = weak_pool(spark, sf_dir).where(F.col("rule_label").isNotNull()).join(labels, "doc_id")
    return rounded(gate.plain_metrics(p.select("gold_label", F.col("rule_label").alias("pred_label"))))


@query("confusion_metrics", sql="""WITH c AS (SELECT p_brand,
    sum((p_size > 25 AND p_retailprice > 950)::INT) AS tp, sum((p_size <= 25 AND p_retailprice <= 950)::INT) AS tn,
    sum((p_size > 25 AND p_retailprice <= 950)::INT) AS fp, sum((p_size <= 25 AND p_retailprice > 950)::INT) AS fn
    FROM part GROUP BY p_brand)
  SELECT p_brand, round(CASE WHEN tp+fp > 0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp+fn > 0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2*tp+fp+fn > 0 THEN (2*tp)::DOUBLE/(2*tp+fp+fn) ELSE 0 END, 6) AS f1,
    round(CASE WHEN tp+tn+fp+fn > 0 THEN (tp+tn)::DOUBLE/(tp+tn+fp+fn) ELSE 0 END, 6) AS accuracy FROM c""")
def confusion_metrics(spark, sf_dir):
    big, dear = F.col("p_size") > 25, F.col("p_retailprice") > 950
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count_if(big & dear).alias("tp"), F.count_if(~big & ~dear).alias("tn"),
        F.count_if(big & ~dear).alias("fp"), F.count_if(~big & dear).alias("fn"))
    return rounded(gate.metrics_from_confusion(counts).select("p_brand", "precision", "recall", "f1", "accuracy"))


@query("log_metrics", sql="""SELECT c_nationkey, count(*)::DOUBLE AS n, sum((c_acctbal > 0)::INT)::DOUBLE AS tp
  FROM customer GROUP BY c_nationkey""")
def log_metrics(spark, sf_dir):
    """Metric dictionaries written into log lines and read back."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("tp"))
    log = F.concat(F.lit("INFO start\nBaseline (holdout): {'n': "), F.col("n").cast("string"), F.lit(", 'tp': "),
                   F.col("tp").cast("string"), F.lit("}\nINFO end"))
    read = gate.log_metrics(log, "Baseline (holdout):")
    return counts.select("c_nationkey", read["n"].alias("n"), read["tp"].alias("tp"))


@query("weak_pool_stats", sql=f"""WITH {WEAK_SQL}
  SELECT count(*) AS n_total, CAST(sum(coalesce((rule_label = 1)::INT, 0)) AS BIGINT) AS n_pos,
    CAST(sum(coalesce((rule_label = 0)::INT, 0)) AS BIGINT) AS n_neg, CAST(sum((rule_label IS NULL)::INT) AS BIGINT) AS n_abstain,
    round(sum((rule_label IS NOT NULL)::INT)::DOUBLE / count(*), 6) AS coverage FROM weak""")
def weak_pool_stats(spark, sf_dir):
    return rounded(bootstrap.weak_pool_stats(weak_pool(spark, sf_dir)))


@query("leakage_anti_join", sql=f"""WITH {WEAK_SQL}
  SELECT w.candidate_id, w.rule_label FROM weak w
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1)""")
def leakage_anti_join(spark, sf_dir):
    test = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("candidate_id"))
    return bootstrap.without_test_rows(weak_pool(spark, sf_dir), test).select("candidate_id", "rule_label")


@query("bootstrap_trainset", sql=f"""WITH {WEAK_SQL}, {GOLD_SQL}
  SELECT candidate_id, text, CAST(label AS INT) AS label FROM gold WHERE toxic = 0
  UNION ALL SELECT candidate_id, text, CAST(rule_label AS INT) FROM weak
  WHERE ((rule_label = 1 AND rule_score >= 3) OR (rule_label = 0 AND rule_score <= 0))
    AND doc_id NOT IN (SELECT doc_id FROM gold WHERE toxic = 1)""")
def bootstrap_trainset(spark, sf_dir):
    g = gold(spark, sf_dir)
    test, train = g.where("toxic = 1"), g.where("toxic = 0")
    return bootstrap.training_set(train, bootstrap.without_test_rows(weak_pool(spark, sf_dir), test))


@query("class_weights", sql="""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
  SELECT doc_id, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight
  FROM labels JOIN c USING (quality)""")
def class_weights(spark, sf_dir):
    return rounded(bootstrap.with_class_weights(table(spark, sf_dir, "labels"), "quality").select("doc_id", "weight"))


@query("split_sizes", sql="""WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality),
  s AS (SELECT label, n, ceil(round(sum(n) OVER () * 0.3::DOUBLE, 9)) AS wanted, sum(n) OVER () AS total FROM c),
  f AS (SELECT *, floor(n * wanted / total) AS fl, n * wanted / total - floor(n * wanted / total) AS rest FROM s),
  r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS rk, sum(fl) OVER () AS got FROM f)
  SELECT label, n, CAST(fl + CASE WHEN rk <= wanted - got THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM r""")
def split_sizes(spark, sf_dir):
    return sampling.test_sizes(table(spark, sf_dir, "labels"), "quality", 0.3)


@query("split_summary", sql="""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
  t AS (SELECT quality, n, CAST(floor(n * ceil(round(sum(n) OVER () * 0.3::DOUBLE, 9)) / sum(n) OVER ()) AS BIGINT) AS fl,
    n * ceil(round(sum(n) OVER () * 0.3::DOUBLE, 9)) / sum(n) OVER () % 1 AS rest,
    ceil(round(sum(n) OVER () * 0.3::DOUBLE, 9)) AS wanted FROM c),
  z AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality) <= wanted - sum(fl) OVER () THEN 1 ELSE 0 END AS n_test FROM t)
  SELECT CAST(sum(n - n_test) AS BIGINT) AS n_train, CAST(sum(n_test) AS BIGINT) AS n_test,
    CAST(sum((n - n_test) * quality) AS BIGINT) AS pos_train, CAST(sum(n_test * quality) AS BIGINT) AS pos_test FROM z""")
def split_summary(spark, sf_dir):
    split = sampling.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality")
    return sampling.split_summary(split, "quality")


def _rank_sql(key: str) -> str:
    return f"substr(md5('42:' || {key}), 1, 15), {key}"


SPLIT_SQL = f"""sizes AS (SELECT quality, n, ceil(round(sum(n) OVER () * 0.3::DOUBLE, 9)) AS wanted, sum(n) OVER () AS total
    FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)),
  shares AS (SELECT *, floor(n * wanted / total) AS fl, n * wanted / total - floor(n * wanted / total) AS rest FROM sizes),
  tests AS (SELECT quality, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality) <= wanted - sum(fl) OVER () THEN 1 ELSE 0 END AS n_test
    FROM shares),
  split AS (SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {_rank_sql('doc_id')}) <= n_test
    THEN 'test' ELSE 'train' END AS split FROM labels JOIN tests USING (quality))"""


@query("stratified_split", sql=f"WITH {SPLIT_SQL} SELECT doc_id, quality, split FROM split")
def stratified_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return sampling.stratified_split(labels, "doc_id", "quality", portable=True).select("doc_id", "quality", "split")


@query("class_balanced_head", sql="""
  (SELECT doc_id, quality FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 10)
  UNION ALL (SELECT doc_id, quality FROM labels WHERE quality = 0 ORDER BY doc_id LIMIT 30)""")
def class_balanced_head(spark, sf_dir):
    return sampling.balanced_head(table(spark, sf_dir, "labels"), "quality", "doc_id", 40).select("doc_id", "quality")


@query("seeded_sample", sql=f"SELECT doc_id, source FROM documents ORDER BY {_rank_sql('doc_id')} LIMIT 50")
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(table(spark, sf_dir, "documents"), "doc_id", 50, portable=True).select("doc_id", "source")


@query("few_shot_block", sql=f"""WITH {GOLD_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_rank_sql('candidate_id')}) AS k FROM gold)
  SELECT rtrim(string_agg('EXAMPLE' || chr(10) || 'TEXT:' || chr(10) || text || chr(10) || 'OUTPUT:' || chr(10) || '{{"label": ' || label
    || ', "confidence": 0.9, "rationale": "example"}}' || chr(10), chr(10) ORDER BY label DESC, k), chr(10)) AS block FROM p WHERE k <= 3""")
def few_shot_block(spark, sf_dir):
    return sampling.few_shot_block(
        gold(spark, sf_dir), "text", "gold_is_policy_measure", "candidate_id", max_chars=0, portable=True)


@query("gold_text_join", sql=f"""WITH {PREDICTIONS_SQL}
  SELECT candidate_id, length(t) AS chars FROM preds""")
def gold_text_join(spark, sf_dir):
    p = predictions(spark, sf_dir).select("candidate_id", "gold_label", "pred_label")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), "text")
    return joins.with_gold_text(p, texts, "text").select("candidate_id", F.length("text").alias("chars"))


@query("resume_candidates", sql="""
  SELECT CASE WHEN d.doc_id % 50 = 0 THEN NULL WHEN d.doc_id % 51 = 0 THEN '' ELSE CAST(d.doc_id AS VARCHAR) END AS candidate_id,
    d.doc_id FROM documents d WHERE d.doc_id % 50 = 0 OR d.doc_id % 51 = 0 OR d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_candidates(spark, sf_dir):
    """Ids that already have an answer are skipped; rows without an id always stay."""
    d = F.col("doc_id")
    candidates = table(spark, sf_dir, "documents").select(
        F.when(d % 50 == 0, F.lit(None).cast("string")).when(d % 51 == 0, "").otherwise(d.cast("string")).alias("candidate_id"),
        "doc_id")
    return joins.without(candidates, table(spark, sf_dir, "labels"), "candidate_id", "doc_id")


@query("prompt_render", sql=f"""SELECT conv_id, turn, 'Titel: ' || role || chr(10) || 'Text: {{' || text || '}}' AS prompt,
    'Text {{json}}' || chr(10) || chr(10) || 'DOCUMENT_TITLE: ' || role || chr(10) || 'DOCUMENT_URL: ' || chr(10) || 'SCOPE: ' ||
      chr(10) || 'DOCUMENT_TEXT:' || chr(10) || text AS appended,
    '{GATE_JSON_INSTRUCTIONS}' || chr(10) || chr(10) || 'TEXT:' || chr(10) || text AS gate FROM conversations""")
def prompt_render(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    return c.select(
        "conv_id", "turn", render_prompt("Titel: {title}\nText: {{{text}}}", "text", "role", none, none).alias("prompt"),
        render_prompt("Text {json}", "text", "role", none, none).alias("appended"), gate_prompt("text").alias("gate"))


def _stand_in(prompts: list[str]) -> list[str]:
    """A labeler whose answer follows from the prompt length."""
    return [
        f'Sure: {{"label": {len(p) % 3 - 1}, "confidence": {len(p) % 10 / 10}, "rationale": "n\\n{len(p) % 7}"}} done' for p in prompts
    ]


@query("labeler_roundtrip", sql=f"""WITH p AS (SELECT doc_id, l.quality,
    length('{GATE_JSON_INSTRUCTIONS}' || '..' || 'TEXT:.' || text) AS n
    FROM documents JOIN labels l USING (doc_id)),
  a AS (SELECT *, n % 3 - 1 AS label, (n % 10)::DOUBLE / 10 AS confidence FROM p)
  SELECT CAST(doc_id AS VARCHAR) AS candidate_id, quality AS gold_label,
    CAST(CASE WHEN label = -1 OR confidence < 0.6::DOUBLE THEN NULL WHEN label = 1 THEN 1 ELSE 0 END AS INT) AS pred_label,
    label = -1 OR confidence < 0.6::DOUBLE AS abstained, round(confidence, 6) AS confidence, 'n ' || (n % 7) AS rationale FROM a""")
def labeler_roundtrip(spark, sf_dir):
    out = labeling.gate_predictions(gold(spark, sf_dir), _stand_in, "text", "gold_is_policy_measure", max_chars=0)
    return rounded(out.select("candidate_id", "gold_label", "pred_label", "abstained", "confidence", "rationale"))


@query("gate_evaluation_zero_shot", sql=f"""WITH {SPLIT_SQL}, t AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality,
    length('{GATE_JSON_INSTRUCTIONS}' || '..' || 'TEXT:.' || text) AS n FROM split JOIN documents USING (doc_id) WHERE split = 'test'),
  r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY id) AS k FROM t),
  head AS (SELECT * FROM r WHERE (quality = 1 AND k <= 25) OR (quality = 0 AND k <= 100 - least(25, (SELECT sum(quality) FROM t)))),
  a AS (SELECT quality AS gold_label, n % 3 - 1 = -1 OR (n % 10)::DOUBLE / 10 < 0.6::DOUBLE AS abstained, n % 3 - 1 AS label FROM head),
  preds AS (SELECT gold_label, abstained, CASE WHEN abstained THEN NULL WHEN label = 1 THEN 1 ELSE 0 END AS pred_label FROM a),
  m AS ({METRICS_SQL.format(by='', source='preds', group='')}) {ratios_sql()}""")
def gate_evaluation_zero_shot(spark, sf_dir):
    """Split, balanced head of the test side (the head is the feature), labeler, metrics."""
    _, metrics = stages.gate_evaluation(
        gold(spark, sf_dir), _stand_in, "text", max_chars=0, max_test_n=100, ensure_pos=True, portable=True)
    return rounded(metrics)


@query("gate_evaluation_few_shot", sql=f"""WITH {SPLIT_SQL},
  ex AS (SELECT d.text, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY {_rank_sql('doc_id')}) AS k
    FROM split JOIN documents d USING (doc_id) WHERE split = 'train'),
  blk AS (SELECT rtrim(string_agg('EXAMPLE' || chr(10) || 'TEXT:' || chr(10) || text || chr(10) || 'OUTPUT:' || chr(10) || '{{"label": ' || label
    || ', "confidence": 0.9, "rationale": "example"}}' || chr(10), chr(10) ORDER BY label DESC, k), chr(10)) AS block FROM ex WHERE k <= 3),
  t AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality,
    length('Labeled examples:.' || block || '..' || '{GATE_JSON_INSTRUCTIONS}' || '..' || 'TEXT:.' || text) AS n
    FROM split JOIN documents USING (doc_id), blk WHERE split = 'test'),
  a AS (SELECT quality AS gold_label, n % 3 - 1 = -1 OR (n % 10)::DOUBLE / 10 < 0.6::DOUBLE AS abstained, n % 3 - 1 AS label FROM t),
  preds AS (SELECT gold_label, abstained, CASE WHEN abstained THEN NULL WHEN label = 1 THEN 1 ELSE 0 END AS pred_label FROM a),
  m AS ({METRICS_SQL.format(by='', source='preds', group='')}) {ratios_sql()}""")
def gate_evaluation_few_shot(spark, sf_dir):
    """Split, examples from the training side, labeler over the whole test side, metrics."""
    _, metrics = stages.gate_evaluation(gold(spark, sf_dir), _stand_in, "text", few_shot=True, portable=True)
    return rounded(metrics)


@query("regate_metrics", sql=f"WITH {gated_sql('0.9')}, m AS ({METRICS_SQL.format(by='', source='gated', group='')}) {ratios_sql()}".replace(
    EVIDENCE_SQL, sql_word('satzung|verordnung|richtlinie|pflicht|verpflichtend')))
def regate_metrics(spark, sf_dir):
    """The whole re-gating run with default words and thresholds, texts joined from the gold table."""
    p = predictions(spark, sf_dir).select("candidate_id", "gold_label", "pred_label", "abstained", "confidence")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), "text")
    return rounded(stages.regate(p, texts, "text")[1])


@query("weak_columns", sql="""SELECT 'text' AS text_column, 'doc_id' AS id_column, CAST(NULL AS VARCHAR) AS municipality_column,
  count(*) AS n FROM documents""")
def weak_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(pick_column(d.columns, TEXT_ALIASES)).alias("text_column"),
        F.lit(pick_column(d.columns, ID_ALIASES)).alias("id_column"),
        F.lit(pick_column(d.columns, MUNICIPALITY_ALIASES)).cast("string").alias("municipality_column"), "n")


@query("tfidf_weights", sql=rf"""WITH {GOLD_SQL}, w AS (SELECT candidate_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]{{2,}}') AS w FROM gold),
  terms AS (SELECT candidate_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
  tf AS (SELECT candidate_id, term, count(*) AS tf FROM terms GROUP BY ALL), size AS (SELECT count(*) AS n FROM gold),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= (SELECT n FROM size) * 0.95::DOUBLE),
  r AS (SELECT candidate_id, term, tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS raw FROM tf JOIN df USING (term), size)
  SELECT candidate_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY candidate_id)), 6) AS weight FROM r""")
def tfidf_weights(spark, sf_dir):
    """The features of the text classifier over all labelled documents."""
    return rounded(bootstrap.tfidf_weights(gold(spark, sf_dir), "candidate_id", "text"))


def weak_rows(spark, sf_dir) -> DataFrame:
    return weak_pool(spark, sf_dir).select("candidate_id", "text", "rule_label", "rule_score")


@query("bootstrap_sizes", sql=f"""WITH {SPLIT_SQL}, {WEAK_SQL},
  clean AS (SELECT * FROM weak WHERE doc_id NOT IN (SELECT doc_id FROM split WHERE split = 'test')),
  train AS (SELECT quality AS label FROM split WHERE split = 'train' UNION ALL SELECT rule_label FROM clean
    WHERE (rule_label = 1 AND rule_score >= 3) OR (rule_label = 0 AND rule_score <= 0))
  SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
    coalesce(sum(quality) FILTER (split = 'train'), 0)::BIGINT AS pos_train, coalesce(sum(quality) FILTER (split = 'test'), 0)::BIGINT AS pos_test,
    (SELECT count(*) FROM weak) AS n_pool, (SELECT count(*) FROM clean) AS n_clean_pool, (SELECT count(*) FROM train) AS n_bootstrap,
    (SELECT count(*) FROM train WHERE label = 1) AS pos_bootstrap FROM split""")
def bootstrap_sizes(spark, sf_dir):
    pool = weak_rows(spark, sf_dir)
    return bootstrap.bootstrap_sizes(bootstrap.bootstrap_inputs(gold(spark, sf_dir), pool, portable=True), pool)


@query("prediction_rows", sql=f"""WITH {SPLIT_SQL}
  SELECT CAST(doc_id AS VARCHAR) AS candidate_id, CAST(quality AS INT) AS gold_label, TRUE AS follows_score, TRUE AS is_share
  FROM split WHERE split = 'test'""")
def prediction_rows(spark, sf_dir):
    """The prediction table of a gold-only classifier: one row per test row; labels follow scores, which are shares."""
    inputs = bootstrap.bootstrap_inputs(gold(spark, sf_dir), weak_rows(spark, sf_dir), portable=True)
    model = bootstrap.train_classifier(inputs["gold_train"], "text", "gold_is_policy_measure", iterations=5, partitions=parallelism(spark))
    rows = bootstrap.predict_table(model, inputs["gold_test"], "gold_is_policy_measure")
    return rows.select("candidate_id", "gold_label", (F.col("pred_label") == (F.col("score") > 0.5).cast("int")).alias("follows_score"),
                       F.col("score").between(0, 1).alias("is_share"))


@query("text_classifier")
def text_classifier(spark, sf_dir):
    """Bootstrap experiment: metrics of the gold-only and the bootstrapped classifier."""
    out = bootstrap.bootstrap_experiment(
        gold(spark, sf_dir), weak_rows(spark, sf_dir), iterations=20, partitions=parallelism(spark))
    return out["baseline_metrics"].withColumn("model", F.lit("baseline")).unionByName(
        out["bootstrap_metrics"].withColumn("model", F.lit("bootstrap")))
