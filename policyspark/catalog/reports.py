"""Queries behind profile and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark.catalog import query
from policyspark.catalog.documents import BASELINE_SQL, baseline_measures
from policyspark.catalog.inputs import WEAK_SQL, rounded, table, weak_pool
from policyspark.operators import export, profile, report, sampling
from policyspark.plans import stages
from policyspark.session import scratch_folder

FIELDS = ["policy_area", "instrument_type", "climate_dimension"]


def profile_rows(spark, sf_dir) -> DataFrame:
    """Baseline measures with holes: broken lines, null and blank areas, texts as confidences."""
    d = F.col("candidate_id").cast("long")
    broken = d % 23 == 0
    m = baseline_measures(spark, sf_dir).withColumns({
        "doc_id": d, "_broken": broken,
        "policy_area": F.when(d % 7 == 0, F.lit(None).cast("string")).when(d % 11 == 0, "").otherwise(F.col("policy_area")),
        "target_sector": F.when(F.size("target_sectors") > 1, F.col("target_sectors")).otherwise(F.array().cast("array<string>")),
        "confidence_score": F.when(d % 13 == 0, "n/a").otherwise((F.col("confidence_score") + d % 3 * 0.1).cast("string")),
    })
    return m


PROFILE_SQL = f"""{BASELINE_SQL}, prof AS (SELECT doc_id, doc_id % 23 = 0 AS broken,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE policy_area END AS policy_area,
    instrument_type, climate_dimension, target_sectors, municipality_id, measure_title,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE confidence_score + (doc_id % 3)::DOUBLE * 0.1::DOUBLE END AS conf,
    doc_id % 13 = 0 AS text_conf FROM base),
  rd AS (SELECT * FROM prof WHERE NOT broken), tot AS (SELECT count(*) AS n FROM prof)"""


@query("missing_rates", sql=f"""WITH {PROFILE_SQL}
  SELECT * FROM (VALUES ('policy_area'), ('instrument_type'), ('target_sector'), ('digitalization_level')) f(field),
  LATERAL (SELECT CAST(coalesce(CASE field WHEN 'policy_area' THEN (SELECT count(*) FROM rd WHERE policy_area IS NULL OR policy_area = '')
      WHEN 'target_sector' THEN (SELECT count(*) FROM rd WHERE NOT contains(target_sectors, '|'))
      WHEN 'digitalization_level' THEN (SELECT count(*) FROM rd) ELSE 0 END, 0) AS BIGINT) AS missing) x,
  LATERAL (SELECT round(x.missing::DOUBLE / (SELECT n FROM tot) * 100.0::DOUBLE, 6) AS pct) y""")
def missing_rates(spark, sf_dir):
    return rounded(profile.missing_rates(
        profile_rows(spark, sf_dir), ["policy_area", "instrument_type", "target_sector", "digitalization_level"], "_broken"))


def _top_sql(k: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS field, coalesce(nullif(trim({f}), ''), 'null') AS value FROM rd" for f in FIELDS)
    return f"""WITH {PROFILE_SQL}, v AS ({parts}), c AS (SELECT field, value, count(*) AS n FROM v GROUP BY field, value),
      r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
      SELECT field, value, n, CAST(rank AS INT) AS rank, round(n::DOUBLE / (SELECT n FROM tot) * 100.0::DOUBLE, 6) AS pct
      FROM r WHERE rank <= {k}"""


@query("top_values", sql=_top_sql(3))
def top_values(spark, sf_dir):
    rows = profile_rows(spark, sf_dir)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rounded(profile.top_values(rows.where(~F.col("_broken")), FIELDS, 3, total))


@query("confidence_buckets", sql=f"""WITH {PROFILE_SQL}, edges(bucket, lo, hi) AS (VALUES ('[0.00,0.20)', 0.0::DOUBLE, 0.2::DOUBLE),
    ('[0.20,0.40)', 0.2::DOUBLE, 0.4::DOUBLE), ('[0.40,0.60)', 0.4::DOUBLE, 0.6::DOUBLE), ('[0.60,0.80)', 0.6::DOUBLE, 0.8::DOUBLE),
    ('[0.80,1.00]', 0.8::DOUBLE, 1.01::DOUBLE)), c AS (SELECT conf FROM rd WHERE conf IS NOT NULL)
  SELECT bucket, (SELECT count(*) FROM c WHERE conf >= lo AND conf < hi) AS n,
    round((SELECT count(*) FROM c WHERE conf >= lo AND conf < hi)::DOUBLE / (SELECT count(*) FROM c) * 100.0::DOUBLE, 6) AS pct FROM edges""")
def confidence_buckets(spark, sf_dir):
    return rounded(profile.confidence_buckets(profile_rows(spark, sf_dir).where(~F.col("_broken"))))


@query("confidence_stats", sql=f"""WITH {PROFILE_SQL}, c AS (SELECT conf, row_number() OVER (ORDER BY conf) - 1 AS rn, count(*) OVER () AS n
    FROM rd WHERE conf IS NOT NULL)
  SELECT max(n) AS n, round(min(conf), 6) AS min, round(max(CASE WHEN rn = n // 2 THEN conf END), 6) AS p50, round(max(conf), 6) AS max FROM c""")
def confidence_stats(spark, sf_dir):
    return rounded(profile.confidence_stats(profile_rows(spark, sf_dir).where(~F.col("_broken"))))


@query("amount_stats", sql="""WITH c AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS rn, count(*) OVER () AS n FROM lineitem)
  SELECT max(n) AS n, round(min(v), 6) AS min, round(max(CASE WHEN rn = n // 2 THEN v END), 6) AS p50, round(max(v), 6) AS max FROM c""")
def amount_stats(spark, sf_dir):
    """The same statistics over a column with almost as many values as rows."""
    return rounded(profile.confidence_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("lowest_confidence", sql=f"""WITH {PROFILE_SQL}
  SELECT doc_id, round(coalesce(conf, -1), 6) AS confidence FROM rd ORDER BY coalesce(conf, -1), doc_id LIMIT 15""")
def lowest_confidence(spark, sf_dir):
    rows = profile_rows(spark, sf_dir).where(~F.col("_broken"))
    low = sampling.lowest(rows, "confidence_score", "doc_id", 15)
    return rounded(low.select("doc_id", F.coalesce(F.col("confidence_score").try_cast("double"), F.lit(-1.0)).alias("confidence")))


@query("sample_view", sql=f"""WITH {PROFILE_SQL}
  SELECT CAST(doc_id AS VARCHAR) AS candidate_id, municipality_id, measure_title FROM rd ORDER BY doc_id LIMIT 20""")
def sample_view(spark, sf_dir):
    rows = profile_rows(spark, sf_dir).where(~F.col("_broken"))
    return profile.sample_view(sampling.first_rows(rows, "doc_id", 20)).select("candidate_id", "municipality_id", "measure_title")


@query("row_counters", sql=f"""WITH {PROFILE_SQL}
  SELECT CASE WHEN broken THEN 'parse_error' WHEN text_conf THEN 'no_number' ELSE 'read' END AS status, count(*) AS n FROM prof GROUP BY ALL""")
def row_counters(spark, sf_dir):
    d = F.col("doc_id")
    return profile.row_counters(profile_rows(spark, sf_dir), F.when(F.col("_broken"), "parse_error").when(
        d % 13 == 0, "no_number").otherwise("read"))


@query("measure_count", sql=f"""WITH {BASELINE_SQL}
  SELECT 'scope' AS scope, 'baseline' AS mode, count(*) AS num_measures, 'measures' AS input_file FROM base""")
def measure_count(spark, sf_dir):
    return profile.measure_count(baseline_measures(spark, sf_dir), "scope", "baseline", "measures")


@query("dataset_sizes", sql="""SELECT 'pool' AS dataset, count(*) AS n_rows FROM documents UNION ALL SELECT 'gold', count(*) FROM labels
  UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'lines', count(*) FROM lineitem""")
def dataset_sizes(spark, sf_dir):
    names = {"pool": "documents", "gold": "labels", "pages": "pages", "lines": "lineitem"}
    return report.dataset_sizes({k: table(spark, sf_dir, t) for k, t in names.items()})


@query("label_balance", sql=f"""WITH {WEAK_SQL}
  SELECT 'Gold' AS stage, CAST(sum((quality = 1)::INT) AS BIGINT) AS n_pos, CAST(sum((quality = 0)::INT) AS BIGINT) AS n_neg, 0::BIGINT AS n_na FROM labels
  UNION ALL SELECT 'Weak rules', CAST(sum((coalesce(rule_label, 2) = 1)::INT) AS BIGINT), CAST(sum((coalesce(rule_label, 2) = 0)::INT) AS BIGINT),
    CAST(sum((rule_label IS NULL)::INT) AS BIGINT) FROM weak
  UNION ALL SELECT 'Pages', 0::BIGINT, 0::BIGINT, count(*) FROM pages""")
def label_balance(spark, sf_dir):
    return report.label_balance({
        "Gold": (table(spark, sf_dir, "labels"), "quality"), "Weak rules": (weak_pool(spark, sf_dir), "rule_label"),
        "Pages": (table(spark, sf_dir, "pages"), None)})


@query("text_length_hist", sql="""WITH l AS (SELECT 'documents' AS dataset, length(text) AS v FROM documents
    UNION ALL SELECT 'conversations', length(text) FROM conversations UNION ALL SELECT 'pages', length(html) FROM pages),
  r AS (SELECT dataset, min(v) AS lo, max(v) AS hi FROM l GROUP BY dataset),
  b AS (SELECT dataset, lo, hi, least(CAST(floor((v - lo)::DOUBLE * 40 / (hi - lo)) AS INT), 39) AS bin FROM l JOIN r USING (dataset))
  SELECT dataset AS grp, bin, round(lo + bin * ((hi - lo)::DOUBLE / 40), 4) AS lo, round(lo + (bin + 1) * ((hi - lo)::DOUBLE / 40), 4) AS hi,
    count(*) AS n FROM b GROUP BY dataset, bin, b.lo, b.hi""")
def text_length_hist(spark, sf_dir):
    return rounded(report.text_length_histogram({
        "documents": (table(spark, sf_dir, "documents"), "text"), "conversations": (table(spark, sf_dir, "conversations"), "text"),
        "pages": (table(spark, sf_dir, "pages"), "html")}), 4)


@query("weak_coverage", sql=f"""WITH {WEAK_SQL} SELECT CAST(sum((coalesce(rule_label, 2) = 0)::INT) AS BIGINT) AS n_neg,
  CAST(sum((coalesce(rule_label, 2) = 1)::INT) AS BIGINT) AS n_pos, CAST(sum((rule_label IS NULL)::INT) AS BIGINT) AS n_abstain FROM weak""")
def weak_coverage(spark, sf_dir):
    return report.coverage_counts(weak_pool(spark, sf_dir), "rule_label")


@query("rule_score_hist", sql=f"""WITH {WEAK_SQL}, l AS (SELECT CASE rule_label WHEN 1 THEN 'Positive' WHEN 0 THEN 'Negative' ELSE 'Abstain' END AS grp,
    rule_score AS v FROM weak), r AS (SELECT grp, min(v) AS lo, max(v) AS hi FROM l GROUP BY grp)
  SELECT grp, least(CAST(floor((v - lo) * 30 / (hi - lo)) AS INT), 29) AS bin, count(*) AS n FROM l JOIN r USING (grp) GROUP BY ALL""")
def rule_score_hist(spark, sf_dir):
    return report.rule_score_histogram(weak_pool(spark, sf_dir)).select("grp", "bin", "n")


@query("rule_frequencies", sql=f"""WITH {WEAK_SQL}, r AS (SELECT trim(unnest(string_split(matched_rules, ';'))) AS rule FROM weak)
  SELECT rule, count(*) AS n FROM r WHERE rule <> '' GROUP BY rule ORDER BY n DESC, rule LIMIT 15""")
def rule_frequencies(spark, sf_dir):
    return report.rule_frequencies(weak_pool(spark, sf_dir))


@query("rule_frequencies_positive", sql=f"""WITH {WEAK_SQL}, r AS (SELECT trim(unnest(string_split(matched_rules, ';'))) AS rule FROM weak WHERE rule_label = 1)
  SELECT rule, count(*) AS n FROM r WHERE rule <> '' GROUP BY rule""")
def rule_frequencies_positive(spark, sf_dir):
    return report.rule_frequencies(weak_pool(spark, sf_dir).where("rule_label = 1"), top=None)


@query("binary_labels", sql="""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INT) AS by_word,
    CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS INT) AS by_number,
    CAST(o_orderstatus = 'F' AS INT) AS by_flag FROM orders""")
def binary_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "FALSE").when(k % 4 == 2, "maybe").alias("words"),
        F.when(k % 3 == 0, "x").when(k % 3 == 1, "0.6").otherwise("0.5").alias("numbers"),
        (F.col("o_orderstatus") == "F").alias("flag"))
    for source, name in (("words", "by_word"), ("numbers", "by_number"), ("flag", "by_flag")):
        o = report.with_binary_label(o, source, name)
    return o.select("o_orderkey", "by_word", "by_number", "by_flag")


@query("annotation_progress", sql="""SELECT CAST(sum((doc_id % 4 < 2)::INT) AS BIGINT) AS n_annotated, CAST(sum((doc_id % 4 >= 2)::INT) AS BIGINT) AS n_pending,
  CAST(sum((doc_id % 4 = 0)::INT) AS BIGINT) AS n_pos, CAST(sum((doc_id % 4 = 1)::INT) AS BIGINT) AS n_neg FROM documents""")
def annotation_progress(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.when(d % 4 == 0, "y").when(d % 4 == 1, "n").alias("label"))
    return report.annotation_progress(docs, "label")


@query("source_label_support", sql="""SELECT d.source AS municipality, count(*) AS support, CAST(sum((l.quality = 1)::INT) AS BIGINT) AS n_pos,
  CAST(sum((l.quality = 0)::INT) AS BIGINT) AS n_neg FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source
  ORDER BY support DESC, municipality LIMIT 20""")
def source_label_support(spark, sf_dir):
    gold = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return report.municipality_support(gold, "quality", "source")


@query("value_counts", sql="""SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang
  UNION ALL (SELECT 'source', source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10)""")
def value_counts(spark, sf_dir):
    return report.value_counts(table(spark, sf_dir, "documents"), ["lang", "source"], {"source": 10})


@query("measure_value_counts", sql=f"""WITH {BASELINE_SQL} SELECT 'policy_area' AS field, policy_area AS value, count(*) AS n FROM base GROUP BY 2
  UNION ALL SELECT 'instrument_type', instrument_type, count(*) FROM base GROUP BY 2""")
def measure_value_counts(spark, sf_dir):
    m = export.measure_records(baseline_measures(spark, sf_dir))
    return report.value_counts(m, ["policy_area", "instrument_type"])


@query("inspect_profile", sql=f"""WITH {PROFILE_SQL}, c AS (SELECT conf, row_number() OVER (ORDER BY conf) - 1 AS rn, count(*) OVER () AS n
    FROM rd WHERE conf IS NOT NULL), edges(bucket, lo, hi) AS (VALUES ('[0.00,0.20)', 0.0::DOUBLE, 0.2::DOUBLE),
    ('[0.20,0.40)', 0.2::DOUBLE, 0.4::DOUBLE), ('[0.40,0.60)', 0.4::DOUBLE, 0.6::DOUBLE), ('[0.60,0.80)', 0.6::DOUBLE, 0.8::DOUBLE),
    ('[0.80,1.00]', 0.8::DOUBLE, 1.01::DOUBLE)), v AS (SELECT instrument_type AS value, count(*) AS n FROM rd GROUP BY 1)
  SELECT 'buckets' AS section, bucket AS key, (SELECT count(*) FROM c WHERE conf >= lo AND conf < hi)::DOUBLE AS n FROM edges
  UNION ALL SELECT 'missing', 'policy_area', (SELECT count(*) FROM rd WHERE policy_area IS NULL OR policy_area = '')::DOUBLE
  UNION ALL SELECT 'missing', 'target_sector', (SELECT count(*) FROM rd WHERE NOT contains(target_sectors, '|'))::DOUBLE
  UNION ALL SELECT 'top_values', value, n::DOUBLE FROM v QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 10
  UNION ALL SELECT 'stats', 'n', (SELECT count(*) FROM c)::DOUBLE
  UNION ALL SELECT 'stats', 'p50', (SELECT round(max(conf), 6) FROM c WHERE rn = n // 2)
  UNION ALL SELECT 'lowest', CAST(doc_id AS VARCHAR), NULL FROM (SELECT doc_id FROM rd ORDER BY coalesce(conf, -1), doc_id LIMIT 10)
  UNION ALL SELECT 'random', 'rows', least(10, (SELECT count(*) FROM rd))::DOUBLE""")
def inspect_profile(spark, sf_dir):
    """The whole profile run: every table of it, in one shape."""
    parts = stages.inspect(profile_rows(spark, sf_dir), "doc_id", broken="_broken")
    number = F.col("n").cast("double").alias("n")
    out = [
        parts["buckets"].select(F.lit("buckets").alias("section"), F.col("bucket").alias("key"), number),
        parts["missing"].where("field IN ('policy_area', 'target_sector')").select(
            F.lit("missing"), "field", F.col("missing").cast("double")),
        parts["top_values"].where("field = 'instrument_type'").select(F.lit("top_values"), "value", number),
        parts["stats"].select(F.lit("stats"), F.lit("n"), number),
        parts["stats"].select(F.lit("stats"), F.lit("p50"), F.round("p50", 6)),
        parts["lowest"].select(F.lit("lowest"), "candidate_id", F.lit(None).cast("double")),
        parts["random"].agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("random"), F.lit("rows"), "n"),
    ]
    return reduce(DataFrame.union, out)


@query("pipeline_report", sql=f"""WITH {WEAK_SQL}, l AS (SELECT *, doc_id % 4 AS r FROM documents)
  SELECT 'dataset_sizes' AS part, 'unlabeled_pool' AS key, count(*) AS n FROM documents
  UNION ALL SELECT 'dataset_sizes', 'weak_rules_labels', count(*) FROM weak
  UNION ALL SELECT 'dataset_sizes', 'goldstandard_gold', count(*) FROM labels
  UNION ALL SELECT 'dataset_sizes', 'annotation_master', count(*) FROM documents
  UNION ALL SELECT 'dataset_sizes', 'annotation_extra30', count(*) FROM labels
  UNION ALL SELECT 'label_balance', 'Gold', count(*) FILTER (quality = 1) FROM labels
  UNION ALL SELECT 'label_balance', 'Weak rules', count(*) FILTER (rule_label = 1) FROM weak
  UNION ALL SELECT 'label_balance', 'Annotation master', count(*) FILTER (r = 0) FROM l
  UNION ALL SELECT 'weak_coverage', 'n_abstain', count(*) FILTER (rule_label IS NULL) FROM weak
  UNION ALL SELECT 'annotation_progress', 'n_annotated', count(*) FILTER (r < 2) FROM l
  UNION ALL SELECT 'annotation_progress_extra', 'n_pos', count(*) FILTER (toxic = 1) FROM labels
  UNION ALL SELECT 'text_lengths', 'weak_rules_labels', count(*) FROM weak
  UNION ALL (SELECT 'top_rules', rule, count(*) AS n FROM (SELECT trim(unnest(string_split(matched_rules, ';'))) AS rule FROM weak)
    WHERE rule <> '' GROUP BY rule ORDER BY n DESC, rule LIMIT 15)""")
def pipeline_report(spark, sf_dir):
    """The whole report run: one line for each of its tables and groups."""
    d = F.col("doc_id")
    docs, labels, weak = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weak_pool(spark, sf_dir)
    annotation = docs.select("doc_id", "text", F.when(d % 4 == 0, "y").when(d % 4 == 1, "n").alias("is_policy_measure"))
    out = stages.report_tables(docs, weak, labels.withColumnRenamed("quality", "gold_is_policy_measure"), annotation,
                               labels.select("doc_id", F.col("toxic").alias("is_policy_measure")))

    def lines(part: str, key, n, rows: DataFrame | None = None) -> DataFrame:
        return (rows if rows is not None else out[part]).select(F.lit(part).alias("part"), key.alias("key"), n.cast("long").alias("n"))

    lengths = out["text_lengths"].where("grp = 'weak_rules_labels'").groupBy("grp").agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionByName, [
        lines("dataset_sizes", F.col("dataset"), F.col("n_rows")), lines("label_balance", F.col("stage"), F.col("n_pos")),
        lines("weak_coverage", F.lit("n_abstain"), F.col("n_abstain")),
        lines("annotation_progress", F.lit("n_annotated"), F.col("n_annotated")),
        lines("annotation_progress_extra", F.lit("n_pos"), F.col("n_pos")), lines("text_lengths", F.col("grp"), F.col("n"), lengths),
        lines("top_rules", F.col("rule"), F.col("n"))])


@query("profile_incremental", sql=f"""WITH {PROFILE_SQL}, c AS (SELECT conf, row_number() OVER (ORDER BY conf) - 1 AS rn, count(*) OVER () AS n
    FROM rd WHERE conf IS NOT NULL), v AS (SELECT instrument_type AS value, count(*) AS n FROM rd GROUP BY 1)
  SELECT 'missing' AS section, 'policy_area' AS key, (SELECT count(*) FROM rd WHERE policy_area IS NULL OR policy_area = '')::DOUBLE AS n
  UNION ALL SELECT 'missing', 'instrument_type', 0::DOUBLE
  UNION ALL SELECT 'missing_pct', 'policy_area', round((SELECT count(*) FROM rd WHERE policy_area IS NULL OR policy_area = '')::DOUBLE
    / (SELECT n FROM tot) * 100.0::DOUBLE, 6)
  UNION ALL SELECT 'top_values', value, n::DOUBLE FROM v QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 10
  UNION ALL SELECT 'buckets', '[0.20,0.40)', (SELECT count(*) FROM c WHERE conf >= 0.2::DOUBLE AND conf < 0.4::DOUBLE)::DOUBLE
  UNION ALL SELECT 'stats', 'n', (SELECT count(*) FROM c)::DOUBLE
  UNION ALL SELECT 'stats', 'p50', (SELECT round(max(conf), 6) FROM c WHERE rn = n // 2)
  UNION ALL SELECT 'stats', 'max', (SELECT round(max(conf), 6) FROM c)""")
def profile_incremental(spark, sf_dir):
    """A stored profile of the even documents, brought up to date by the odd ones alone, is the profile of all."""
    path = scratch_folder(spark, "profile")
    rows = profile_rows(spark, sf_dir)
    fields, categories = ["policy_area", "instrument_type"], ["instrument_type"]
    for half in (0, 1):
        profile.profile_state(rows.where(F.col("doc_id") % 2 == half), fields, categories, "_broken").write.parquet(f"{path}/{half}")
    state = profile.merged_state(*[spark.read.parquet(f"{path}/{half}") for half in (0, 1)])
    out = profile.profile_of_state(state, fields, categories)
    number = F.col("n").cast("double").alias("n")
    return reduce(DataFrame.union, [
        out["missing"].select(F.lit("missing").alias("section"), F.col("field").alias("key"), F.col("missing").cast("double").alias("n")),
        out["missing"].where("field = 'policy_area'").select(F.lit("missing_pct"), "field", F.round("pct", 6)),
        out["top_values"].select(F.lit("top_values"), "value", number),
        out["buckets"].where("bucket = '[0.20,0.40)'").select(F.lit("buckets"), "bucket", number),
        out["stats"].select(F.lit("stats"), F.lit("n"), number), out["stats"].select(F.lit("stats"), F.lit("p50"), F.round("p50", 6)),
        out["stats"].select(F.lit("stats"), F.lit("max"), F.round("max", 6))])
