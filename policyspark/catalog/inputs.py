"""How the benchmark tables play the roles of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.operators.classify import BaselineRules, FilterConfig
from policyspark.functions.terms import KeywordRules, ThemeTerms


#: Tables of long texts.
TEXTS = ("documents", "pages", "conversations", "benchmark")
#: Session setting: number of partitions that rows of text tables are dealt into after the scan.
SPREAD = "spark.policyspark.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table. A file of one row group is one task; ``SPREAD``, where the caller sets it, deals its texts out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None) if name in TEXTS else None
    return df.repartition(int(spread)) if spread else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shape(table(spark, sf_dir, "documents"))


def document_shape(docs: DataFrame) -> DataFrame:
    """documents as extracted documents: source is the municipality, the first line the title."""
    return docs.select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("municipality_id"),
        F.col("source").alias("municipality"), F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("lang"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("url"),
        "text", "doc_id", "lang", "n_chars",
    )


DOCUMENTS_SQL = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, source AS municipality_id,
         split_part(text, chr(10), 1) AS title,
         'https://' || source || '.example/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url,
         text, lower(text) AS t, lower(split_part(text, chr(10), 1)) AS tl, doc_id, lang, n_chars
  FROM documents)"""

# The fixtures hold invented prose, so the term lists are substrings that occur in it.
POSITIVE = ["thtion", "thwh", "eaux", "ung d"]
NEGATIVE = ["license", "cookie"]
FILTER = FilterConfig(
    strong_terms=("thtion", "thwh", "eau"), supporting_terms=("ation", "nicht", "the "), min_length=500,
    measure_terms=("thble", "queau"), admin_terms=("there", "ierre"), framework_terms=("lang", "enti"),
    navigation_title_terms=("startseite", "ththn"), navigation_url_fragments=("/es/9",),
    news_title_terms=("news", "anat"), news_url_fragments=("/fr/7",),
    negative_title_terms=("kontakt", "is "), negative_url_fragments=("/de/5",),
    imprint_title_terms=("impressum", "du "), imprint_url_fragments=("/en/42",),
)
RULES = KeywordRules(
    positive=("ation", "thtion", "thwh"), negative=("license", "worthless"),
    themes={
        "alpha": ThemeTerms(("eaux", "thble", "thtion"), ("zzz",)),
        "beta": ThemeTerms(("nicht", "thble"), ("ninght",)),
        "gamma": ThemeTerms(("queau", "there"), ()),
    },
    min_general=1, min_themes=1,
)
BASELINE = BaselineRules(
    areas=(("cross_sectoral", ("thtion", "thwhst")), ("buildings", ("eaux", "eaum")), ("mobility", ("nicht", "lich"))),
    instruments=(("strategy_plan", ("thble", "theas")), ("regulation_standard", ("pflicht", "queau")),
                 ("public_procurement", ("ung d", "der "))),
    sectors=(("households", ("there", "thing")), ("transport", ("bus", "auto")), ("industry", ("ierre",)),
             ("households", ("haus", "thand"))),
    mitigation=("ation", "emission"), adaptation=("ondr", "hitze"), funding=("license", "thble"),
)
# Evidence words as plain words; the SQL spells the word boundary out.
EVIDENCE = {
    "money": r"\b(nd|st|ing|eau)\b", "funding": r"\b(ble|tion|der)\b", "legal": r"\b(licensed|pas)\b",
    "decision": r"\b(ther|thth|die)\b", "implementation": r"\b(wh|ou|und)\b",
}


def sql_word(words: str, column: str = "t") -> str:
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


EVIDENCE_SQL = (
    f"({sql_word('licensed|pas')} OR ({sql_word('nd|st|ing|eau')} AND {sql_word('ble|tion|der')}) "
    f"OR ({sql_word('ther|thth|die')} AND ({sql_word('ble|tion|der')} OR {sql_word('wh|ou|und')})))"
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents JOIN labels as predictions: gold is the quality label, the rest follows from ids."""
    docs = documents(spark, sf_dir)
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    joined = docs.join(gold, F.col("doc_id") == F.col("l_id"))
    abstained = F.col("doc_id") % 11 == 0
    return joined.select(
        F.col("document_id").alias("candidate_id"), "doc_id", "municipality_id", "text",
        F.col("quality").alias("gold_label"),
        F.when(abstained & (F.col("doc_id") % 2 == 0), F.lit(None).cast("int"))
        .otherwise((F.col("doc_id") % 3 != 0).cast("int")).alias("pred_label"),
        abstained.alias("abstained"), ((F.col("n_chars") % 101) / 100.0).alias("confidence"),
    )


PREDICTIONS_SQL = f"""{DOCUMENTS_SQL}, preds AS (
  SELECT d.document_id AS candidate_id, d.doc_id, d.municipality_id, d.t, l.quality AS gold_label,
         CASE WHEN d.doc_id % 11 = 0 AND d.doc_id % 2 = 0 THEN NULL
              WHEN d.doc_id % 3 <> 0 THEN 1 ELSE 0 END AS pred_label,
         d.doc_id % 11 = 0 AS abstained, (d.n_chars % 101)::DOUBLE / 100.0::DOUBLE AS confidence
  FROM docs d JOIN labels l ON l.doc_id = d.doc_id)"""


def gated_sql(pos_conf: str, abstain_conf: str = "0.6") -> str:
    """CTEs preds, gated with the post-gate decision."""
    return f"""{PREDICTIONS_SQL}, ev AS (SELECT *, {EVIDENCE_SQL} AS evidence FROM preds),
  s1 AS (SELECT *, COALESCE(pred_label = 1 AND (NOT evidence OR confidence < {pos_conf}::DOUBLE), false) AS rejected FROM ev),
  s2 AS (SELECT *, rejected OR (NOT abstained AND confidence < {abstain_conf}::DOUBLE) AS fresh FROM s1),
  gated AS (SELECT candidate_id, doc_id, municipality_id, gold_label, confidence,
         CASE WHEN fresh THEN NULL ELSE pred_label END AS pred_label, abstained OR fresh AS abstained FROM s2)"""


def weak_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a weak pool: tri-state rule label, score and matched rules from ids and lengths."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    return docs.select(
        d.cast("string").alias("candidate_id"), "text", "source", "doc_id",
        F.when(d % 5 == 0, 1).when(d % 5 < 3, 0).alias("rule_label"),
        (F.col("n_chars") % 7).cast("double").alias("rule_score"),
        F.concat(F.lit("r"), (d % 4).cast("string"), F.lit("; r"), (d % 9).cast("string"), F.lit(" ; ;"),
                 F.col("lang")).alias("matched_rules"),
    )


WEAK_SQL = """weak AS (
  SELECT CAST(doc_id AS VARCHAR) AS candidate_id, text, source, doc_id,
         CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 5 < 3 THEN 0 END AS rule_label,
         (n_chars % 7)::DOUBLE AS rule_score,
         'r' || (doc_id % 4) || '; r' || (doc_id % 9) || ' ; ;' || lang AS matched_rules
  FROM documents)"""

METRICS_SQL = """
  SELECT {by} count(*) AS n_total, sum((NOT abstained)::INT) AS n_classified, sum(abstained::INT) AS n_abstain,
    sum((NOT abstained AND gold_label = 1 AND coalesce(pred_label,-1) = 1)::INT) AS tp,
    sum((NOT abstained AND gold_label = 0 AND coalesce(pred_label,-1) = 0)::INT) AS tn,
    sum((NOT abstained AND gold_label = 0 AND coalesce(pred_label,-1) = 1)::INT) AS fp,
    sum((NOT abstained AND gold_label = 1 AND coalesce(pred_label,-1) = 0)::INT) AS fn,
    sum((gold_label = 1)::INT) AS pos_total,
    sum((gold_label = 1 AND coalesce(pred_label,-1) = 1)::INT) AS tp_total
  FROM {source} {group}"""


def ratios_sql(cols: str = "") -> str:
    def r(num: str, den: str) -> str:
        return f"round(CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den}) ELSE 0 END, 6)"

    return f"""SELECT {cols} CAST(n_total AS BIGINT) AS n_total, CAST(n_classified AS BIGINT) AS n_classified,
      CAST(n_abstain AS BIGINT) AS n_abstain, {r('n_classified', 'n_total')} AS coverage,
      CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
      {r('tp', 'tp+fp')} AS precision, {r('tp', 'tp+fn')} AS recall, {r('2*tp', '2*tp+fp+fn')} AS f1,
      {r('tp+tn', 'n_classified')} AS accuracy_classified, CAST(pos_total AS BIGINT) AS pos_total,
      CAST(tp_total AS BIGINT) AS tp_total, {r('tp_total', 'pos_total')} AS recall_overall FROM m"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles of a result, so that both engines print the same digits."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)
