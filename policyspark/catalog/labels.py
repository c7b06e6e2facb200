"""Queries over label strings and labeler answers: vocabularies, parsing, mapping, contracts, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.catalog import query
from policyspark.catalog.documents import BASELINE_SQL, baseline_measures
from policyspark.catalog.inputs import DOCUMENTS_SQL, documents, joined, rounded, table
from policyspark.functions import model_output as M
from policyspark.functions import taxonomy as X
from policyspark.functions.text import clamp_unit
from policyspark.operators import contracts, export, joins, labeling
from policyspark.operators.ordinals import with_batch_number
from policyspark.vocabulary import ANNOTATION_COLUMNS, INSTRUMENT_ALIASES, TAXONOMIES


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def sql_array(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


AREAS = TAXONOMIES["enum"]["policy_area"]
SECTORS = TAXONOMIES["enum"]["target_sector"]


def label_rows(spark, sf_dir) -> DataFrame:
    """orders as label spellings: an id of the vocabulary, written in one of six ways, by order key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    area = F.element_at(F.array(*[F.lit(a) for a in AREAS]), (k % len(AREAS) + 1).cast("int"))
    spaced = F.replace(area, F.lit("_"), F.lit(" & "))
    style = k % 7
    raw = (
        F.when(style == 0, area).when(style == 1, F.upper(F.replace(area, F.lit("_"), F.lit("-"))))
        .when(style == 2, F.concat(F.lit("  "), spaced)).when(style == 3, F.initcap(spaced))
        .when(style == 4, F.col("o_orderpriority")).when(style == 5, F.lit(" ")).otherwise(F.lit(None).cast("string"))
    )
    return o.select("o_orderkey", raw.alias("raw"))


LABEL_ROWS_SQL = f"""rows AS (SELECT o_orderkey, o_orderpriority, {sql_array(AREAS)}[o_orderkey % {len(AREAS)} + 1] AS area FROM orders),
  raws AS (SELECT o_orderkey, area, CASE o_orderkey % 7 WHEN 0 THEN area WHEN 1 THEN upper(replace(area, '_', '-'))
    WHEN 2 THEN '  ' || replace(area, '_', ' & ') WHEN 3 THEN replace(area, '_', ' & ')
    WHEN 4 THEN o_orderpriority WHEN 5 THEN ' ' END AS raw FROM rows)"""
KEY_SQL = "trim(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '_')"


@query("enum_parse", sql=f"""WITH {LABEL_ROWS_SQL}
  SELECT o_orderkey, CASE WHEN {KEY_SQL} IN {sql_list(AREAS)} THEN {KEY_SQL} END AS parsed,
    coalesce(CASE WHEN {KEY_SQL} IN {sql_list(AREAS)} THEN {KEY_SQL} END, 'other') AS with_default, {KEY_SQL} AS label_key,
    upper(CASE WHEN {KEY_SQL} IN {sql_list(AREAS)} THEN {KEY_SQL} END) AS member_name FROM raws""")
def enum_parse(spark, sf_dir):
    rows = label_rows(spark, sf_dir)
    parsed = X.parse_label("raw", "enum", "policy_area")
    return rows.select(
        "o_orderkey", parsed.alias("parsed"), X.parse_label("raw", "enum", "policy_area", "other").alias("with_default"),
        X.label_key("raw").alias("label_key"), X.label_names(parsed).alias("member_name"))


def sector_text(k: Column) -> Column:
    sectors = F.array(*[F.lit(s) for s in SECTORS])

    def pick(n) -> Column:
        return F.element_at(sectors, (F.pmod(n, F.lit(len(SECTORS))) + 1).cast("int"))

    return F.concat(F.upper(F.replace(pick(k), F.lit("_"), F.lit(" & "))), F.lit("; "), pick(k * 3), F.lit(",,"),
                    F.lit("xx,"), pick(k))


@query("enum_list_parse", sql=f"""WITH r AS (SELECT c_custkey, {sql_array(SECTORS)} AS s FROM customer)
  SELECT c_custkey, CASE WHEN c_custkey % 8 = (c_custkey * 3) % 8 THEN s[c_custkey % 8 + 1]
    ELSE s[c_custkey % 8 + 1] || '|' || s[(c_custkey * 3) % 8 + 1] END AS sectors FROM r""")
def enum_list_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", joined(
        X.parse_label_text(sector_text(F.col("c_custkey")), "enum", "target_sector")).alias("sectors"))


@query("instrument_aliases", sql=f"""WITH r AS (SELECT p_partkey,
    {sql_array([*INSTRUMENT_ALIASES, *TAXONOMIES['canonical']['instrument_type'], 'unknown thing'])}[p_partkey % 14 + 1] AS raw FROM part)
  SELECT p_partkey, CASE WHEN raw IN {sql_list(TAXONOMIES['canonical']['instrument_type'])} THEN raw
    WHEN raw IN ('subsidy', 'förderung', 'foerderung') THEN 'financial_incentive' WHEN raw = 'standard' THEN 'regulation'
    WHEN raw = 'other' THEN 'information_outreach' END AS instrument FROM r""")
def instrument_aliases(spark, sf_dir):
    names = [*INSTRUMENT_ALIASES, *TAXONOMIES["canonical"]["instrument_type"], "unknown thing"]
    raw = F.element_at(F.array(*[F.lit(f" {n.upper()} ") for n in names]), (F.col("p_partkey") % 14 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.instrument_from_alias(raw).alias("instrument"))


@query("taxonomy_members", sql=f"""WITH {BASELINE_SQL}
  SELECT doc_id, policy_area IN {sql_list(TAXONOMIES['canonical']['policy_area'])} AS canonical_area,
    coalesce(CASE WHEN policy_area IN {sql_list(TAXONOMIES['measure_v1']['policy_area'])} THEN policy_area END, 'other') AS declared_area
  FROM base""")
def taxonomy_members(spark, sf_dir):
    m = baseline_measures(spark, sf_dir)
    return m.select(
        F.col("document_id").cast("long").alias("doc_id"),
        X.is_member("policy_area", "canonical", "policy_area").alias("canonical_area"),
        X.member_or("policy_area", "measure_v1", "policy_area", "other").alias("declared_area"))


@query("taxonomy_usage", sql=f"""WITH {BASELINE_SQL}, dim(id, position) AS (VALUES
    {', '.join(f"('{v}', {i})" for i, v in enumerate(TAXONOMIES['baseline']['policy_area']))})
  SELECT id, position, count(doc_id) AS n FROM dim LEFT JOIN base ON policy_area = id GROUP BY id, position""")
def taxonomy_usage(spark, sf_dir):
    """Every member of a vocabulary with its number of measures; counted before the join."""
    counts = baseline_measures(spark, sf_dir).groupBy(F.col("policy_area").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    dim = X.taxonomy_table(spark).where("scheme = 'baseline' AND dimension = 'policy_area'")
    return dim.join(counts, "id", "left").select("id", "position", F.coalesce("n", F.lit(0)).alias("n"))


# --- labeler answers ----------------------------------------------------------

def answers(spark, sf_dir) -> DataFrame:
    """conversations as labeler answers: JSON in prose, alias keys, explicit nulls, broken text."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    confidence = ((n % 100) / 100.0).cast("string")
    quoted = F.to_json(F.struct(F.col("role").alias("title"), F.substring("text", 1, 40).alias("description")))
    inner = F.expr("substring(j, 2, length(j) - 2)")
    base = c.withColumn("j", quoted)
    body = (
        F.when(kind == 0, F.concat(F.lit('{"policy_field": "energy", "relevance_confidence": '), confidence, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('Answer: {"policy_area": null, "policy_field": "energy", '), inner,
                                  F.lit(', "confidence_score": '), confidence, F.lit('} trailing {')))
        .when(kind == 2, F.concat(F.lit('{"measure_type": "subsidy", "note": "a } brace", "x": {"y": 1}, '), inner, F.lit("}")))
        .when(kind == 3, F.lit("no json at all"))
        .when(kind == 4, F.concat(F.lit('{"target_group": "citizens", "jurisdiction_level": "eu", "is_policy_measure": true, '),
                                  F.lit('"evidence_quotes": ["a", "b"], "classification_confidence": '), confidence, F.lit("}")))
        .otherwise(F.lit('[{"policy_field": "waste"}]'))
    )
    return base.select("conv_id", "turn", "role", "text", kind.alias("kind"), body.alias("answer")).drop("j")


ANSWERS_SQL = """a AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 6 AS kind,
   (length(text) % 100)::DOUBLE / 100.0::DOUBLE AS conf FROM conversations)"""


@query("response_map", sql=f"""WITH {ANSWERS_SQL}
  SELECT conv_id, turn, CASE kind WHEN 1 THEN role WHEN 2 THEN role ELSE 'fallback' END AS title,
    CASE WHEN kind IN (1, 2) AND substr(text, 1, 40) <> '' THEN substr(text, 1, 40) ELSE substr(text, 1, 300) END AS snippet,
    CASE WHEN kind = 0 THEN 'energy' END AS policy_area, CASE WHEN kind = 2 THEN 'subsidy' END AS instrument_type,
    CASE WHEN kind = 4 THEN 'citizens' END AS target_sector, CASE WHEN kind = 4 THEN 'eu' END AS funding_program_level,
    round(CASE WHEN kind IN (0, 1, 4) THEN conf ELSE 0 END, 6) AS confidence_score,
    CASE WHEN kind = 4 THEN true END AS is_policy_measure, CASE WHEN kind = 4 THEN 'a|b' END AS quotes, 'llm' AS label_source FROM a""")
def response_map(spark, sf_dir):
    found = answers(spark, sf_dir).withColumn("body", F.col("text")).withColumn("json", M.first_json_object("answer"))
    mapped = M.with_mapped_answer(found, "json", "body", F.lit("fallback"), F.lit(None).cast("string"), F.lit("scope"))
    return rounded(mapped.select(
        "conv_id", "turn", "title", "snippet", "policy_area", "instrument_type", "target_sector", "funding_program_level",
        "confidence_score", "is_policy_measure", joined("evidence_quotes").alias("quotes"), "label_source"))


@query("first_json_object", sql=f"""WITH {ANSWERS_SQL}
  SELECT conv_id, turn, kind NOT IN (3, 5) AS found, CASE WHEN kind = 1 THEN role WHEN kind = 2 THEN role END AS title FROM a""")
def first_json_object(spark, sf_dir):
    found = answers(spark, sf_dir).withColumn("json", M.first_json_object("answer"))
    return found.select("conv_id", "turn", (F.col("json") != "{}").alias("found"),
                        F.get_json_object("json", "$.title").alias("title"))


@query("gate_answers", sql="""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE -1 END AS INT) AS label,
    round(CASE WHEN event_id % 5 IN (0, 2) THEN (event_id % 100)::DOUBLE / 100 ELSE 0 END, 6) AS confidence,
    CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'parse_error' END AS rationale FROM events""")
def gate_answers(spark, sf_dir):
    """Gate answers made of events: complete, without confidence, without label, broken, none."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 5
    conf = ((F.col("event_id") % 100) / 100.0).cast("string")
    answer = (
        F.when(kind == 0, F.concat(F.lit('ok {"label": 1, "confidence": '), conf, F.lit(', "rationale": " '), "event_type", F.lit('"} end')))
        .when(kind == 1, F.lit('{"label": 0}'))
        .when(kind == 2, F.concat(F.lit('{"confidence": '), conf, F.lit("}")))
        .when(kind == 3, F.lit('{"label": oops}')).otherwise("no json")
    )
    a = e.select("event_id", M.gate_answer(answer).alias("a"))
    return rounded(a.select("event_id", "a.label", "a.confidence", "a.rationale"))


@query("label_source_rows", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT document_id AS candidate_id, municipality_id, CASE WHEN d.doc_id % 4 = 0 THEN 'llm_error' ELSE 'llm' END AS label_source,
    CASE WHEN d.doc_id % 4 <> 0 THEN 'governance' END AS policy_area,
    round(CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE 0.25 END::DOUBLE, 6) AS confidence_score,
    substr(trim(text, ' ' || chr(10)), 1, 300) AS snippet, 'm1' AS llm_model
  FROM docs d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def label_source_rows(spark, sf_dir):
    """Resumable labelling: done ids are skipped, a failing prompt becomes an error row and costs no other row."""
    docs = documents(spark, sf_dir).withColumn("candidate_id", F.col("document_id"))

    def fragile(prompts: list[str]) -> list[str]:
        ids = [int(p.split("|", 1)[0].rsplit("/", 1)[1]) for p in prompts]
        if any(i % 4 == 0 for i in ids):
            raise RuntimeError("cannot answer")
        return ['{"policy_field": "governance", "relevance_confidence": 0.25}' for _ in ids]

    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("candidate_id"))
    out = labeling.label_candidates(docs, fragile, "{url}|{text}", done=done, model="m1")
    return rounded(out.select(
        "candidate_id", "municipality_id", "label_source", "policy_area", "confidence_score", "snippet", "llm_model"))


@query("stub_measures", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT document_id, 'llm_dry_run' AS label_source, nullif(trim(title, ' ' || chr(10)), '') AS title,
    substr(trim(text, ' ' || chr(10)), 1, 300) AS snippet, url AS source_url, 0.0::DOUBLE AS confidence_score FROM docs""")
def stub_measures(spark, sf_dir):
    return labeling.stub_measures(documents(spark, sf_dir), "llm_dry_run").select(
        "document_id", "label_source", "title", "snippet", "source_url", "confidence_score")


@query("annotation_defaults", sql=f"""SELECT conv_id, turn,
    CASE WHEN turn % 3 = 0 THEN 'done' WHEN turn % 3 = 1 THEN 'yes' ELSE 'uncertain' END AS is_policy_relevant,
    CASE WHEN turn % 3 = 0 THEN NULL ELSE 'unknown' END AS sector, CASE WHEN turn % 3 = 0 THEN NULL ELSE '' END AS notes,
    CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN '7' ELSE 'unknown' END AS doc_type FROM conversations""")
def annotation_defaults(spark, sf_dir):
    """Labelled rows pass through; answers get their gaps filled."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "done").alias("is_policy_relevant"),
                    F.concat(F.lit("p"), (F.col("turn") % 3).cast("string")).alias("prompt"))

    def labeler(prompts):
        return ['{"is_policy_relevant": "yes", "doc_type": 7, "notes": null}' if p == "p1" else None for p in prompts]

    out = labeling.annotate(rows, labeler)
    return out.select("conv_id", "turn", *[n for n in ANNOTATION_COLUMNS if n in (
        "is_policy_relevant", "sector", "notes", "doc_type")])


@query("free_labels", sql="""WITH r AS (SELECT p_partkey, ['Förderung', 'Strategie', 'REGULATION', 'procurement', 'economic_incentive', 'xyz', ''][p_partkey % 7 + 1] AS raw,
    ['Ja', 'no', 'TRUE', '0', 'maybe'][p_partkey % 5 + 1] AS fund, p_size::DOUBLE / 25 AS conf FROM part)
  SELECT p_partkey, CASE raw WHEN 'REGULATION' THEN 'regulation_standard' WHEN 'economic_incentive' THEN 'economic_incentive'
      WHEN 'xyz' THEN 'other' WHEN '' THEN 'other' END AS instrument,
    CASE raw WHEN 'Förderung' THEN 'economic_incentive' WHEN 'Strategie' THEN 'planning_strategy' WHEN 'REGULATION' THEN 'regulation_standard'
      WHEN 'procurement' THEN 'public_procurement_operations' WHEN 'economic_incentive' THEN 'economic_incentive' ELSE 'other' END AS corrected,
    fund IN ('Ja', 'TRUE') AS funding, round(greatest(0, least(1, conf)), 6) AS confidence FROM r""")
def free_labels(spark, sf_dir):
    from policyspark.vocabulary import INSTRUMENT_HEURISTICS_CORRECTED

    p = table(spark, sf_dir, "part")
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Förderung", "Strategie", "REGULATION", "procurement", "economic_incentive", "xyz", "")]),
                       (F.col("p_partkey") % 7 + 1).cast("int"))
    fund = F.element_at(F.array(*[F.lit(x) for x in ("Ja", "no", "TRUE", "0", "maybe")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return rounded(p.select(
        "p_partkey", M.free_instrument(raw).alias("instrument"),
        M.free_instrument(raw, INSTRUMENT_HEURISTICS_CORRECTED).alias("corrected"), M.funding_flag(fund).alias("funding"),
        clamp_unit(F.col("p_size") / 25).alias("confidence")))


@query("normalised_measures", sql="""WITH r AS (SELECT c_custkey, lower(c_mktsegment) AS seg, c_acctbal / 5000 AS conf FROM customer)
  SELECT c_custkey, 'Customer' AS measure_title, 'other' AS policy_area,
    CASE WHEN contains(seg, 'house') THEN 'households_residents' WHEN contains(seg, 'mobil') THEN 'transport_operators' ELSE '' END AS target_sectors,
    CASE WHEN c_custkey % 2 = 0 THEN 'mitigation' END AS climate_dimension, false AS funding_available,
    round(greatest(0, least(1, conf)), 6) AS confidence_score, c_custkey % 3 = 0 AS keyword_hit FROM r""")
def normalised_measures(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select(
        "c_custkey", F.lit("").alias("measure_title"), F.col("c_mktsegment").alias("policy_area"),
        F.col("c_mktsegment").alias("target_sector"),
        F.when(F.col("c_custkey") % 2 == 0, " Mitigation ").otherwise("cooling").alias("climate_dimension"),
        (F.col("c_acctbal") / 5000).cast("string").alias("confidence_score"),
        (F.col("c_custkey") % 3 == 0).cast("string").alias("keyword_hit"), F.lit("maybe").alias("funding_available"))
    out = M.normalised_measure(raw, F.lit("Customer"), corrected=True)
    return rounded(out.select(
        "c_custkey", "measure_title", "policy_area", joined("target_sectors").alias("target_sectors"), "climate_dimension",
        "funding_available", "confidence_score", "keyword_hit"))


# --- contracts ----------------------------------------------------------------

@query("gate_contract", sql="""WITH a AS (SELECT event_id, event_id % 3 <> 0 AS measure,
    CASE WHEN event_id % 4 = 0 THEN 'energy' WHEN event_id % 4 = 1 THEN 'bogus' END AS field, value / 20 AS conf, event_type FROM events),
  v AS (SELECT event_id, [
    CASE WHEN conf < 0 OR conf > 1 THEN 'relevance_confidence_range' END,
    CASE WHEN measure THEN 'measure_without_classification_confidence' END,
    CASE WHEN measure AND coalesce(field, '') <> 'energy' THEN 'policy_field_vocabulary' END,
    CASE WHEN measure THEN 'measure_type_vocabulary' END, CASE WHEN measure THEN 'target_group_vocabulary' END,
    CASE WHEN measure THEN 'jurisdiction_level_vocabulary' END,
    CASE WHEN NOT measure AND field IS NOT NULL THEN 'policy_field_not_null' END,
    CASE WHEN NOT measure THEN 'short_title_not_null' END, CASE WHEN NOT measure THEN 'evidence_quotes_not_null' END,
    CASE WHEN event_type = 'error' THEN 'quote_not_verbatim' END] AS x FROM a)
  SELECT event_id, array_to_string(list_filter(x, lambda e: e IS NOT NULL), ',') AS violations FROM v""")
def gate_contract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    a = e.select(
        "event_id", (F.col("event_id") % 3 != 0).alias("is_policy_measure"), (F.col("value") / 20).alias("relevance_confidence"),
        F.when(F.col("event_id") % 4 == 0, "energy").when(F.col("event_id") % 4 == 1, "bogus").alias("policy_field"),
        *[none.alias(c) for c in ("measure_type", "target_group", "jurisdiction_level", "actor", "instrument", "rationale")],
        F.lit(None).cast("double").alias("classification_confidence"), F.col("event_type").alias("short_title"),
        F.array(F.when(F.col("event_type") == "error", "fault").otherwise(F.col("event_type"))).alias("evidence_quotes"),
        F.concat(F.lit("the event is "), "event_type").alias("text"))
    return contracts.gate_violations(a, "text").select("event_id", joined("violations", ",").alias("violations"))


@query("gate_contract_counts", sql="""SELECT 'relevance_confidence_range' AS violation, count(*) AS n FROM events
  WHERE value / 20 < 0 OR value / 20 > 1 HAVING count(*) > 0""")
def gate_contract_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    a = e.select(
        F.lit(False).alias("is_policy_measure"), (F.col("value") / 20).alias("relevance_confidence"),
        *[none.alias(c) for c in ("policy_field", "measure_type", "target_group", "jurisdiction_level", "short_title", "actor",
                                  "instrument", "rationale")],
        F.lit(None).cast("double").alias("classification_confidence"), F.lit(None).cast("array<string>").alias("evidence_quotes"))
    return contracts.violation_counts(contracts.gate_violations(a))


@query("measure_contract", sql=f"""WITH {BASELINE_SQL}
  SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 10 = 0 THEN 'snippet:required' END,
    CASE WHEN policy_area NOT IN {sql_list(TAXONOMIES['measure_v1']['policy_area'])} THEN 'policy_area:enum' END,
    CASE WHEN instrument_type NOT IN {sql_list(TAXONOMIES['measure_v1']['instrument_type'])} THEN 'instrument_type:enum' END,
    CASE WHEN climate_dimension NOT IN {sql_list(TAXONOMIES['measure_v1']['climate_dimension'])} THEN 'climate_dimension:enum' END,
    CASE WHEN doc_id % 7 = 0 THEN 'budget_total_eur:type' END], lambda x: x IS NOT NULL), ',') AS violations FROM base""")
def measure_contract(spark, sf_dir):
    d = F.col("candidate_id").cast("long")
    m = baseline_measures(spark, sf_dir).select(
        F.col("candidate_id").alias("measure_id"), "municipality_id", F.lit("DE").alias("country_code"),
        F.lit("scope").alias("source_scope"), "source_document_id", "policy_area", "instrument_type", "climate_dimension",
        F.when(d % 10 == 0, "").otherwise("x").alias("snippet"), F.when(d % 7 == 0, "much").otherwise("100.5").alias("budget_total_eur"))
    checked = contracts.measure_violations(m)
    return checked.select(F.col("measure_id").cast("long").alias("doc_id"), joined("violations", ",").alias("violations"))


@query("duplicate_keys", sql="SELECT text AS measure_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return contracts.duplicate_keys(table(spark, sf_dir, "documents").select(F.col("text").alias("measure_id")))


# --- export -------------------------------------------------------------------

def municipalities(spark, sf_dir) -> DataFrame:
    """nation as municipalities; every second one twice, the later row counts."""
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("municipality_id"),
                    F.lit("old").alias("name"), F.lit(0).alias("ord")).where(F.col("n_nationkey") % 2 == 0)
    return rows.unionByName(n.where("n_nationkey < 15").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("municipality_id"),
        F.col("n_name").alias("name"), F.lit(1).alias("ord")))


ANALYSIS_SQL = f"""{BASELINE_SQL}, muni AS (SELECT 'src' || n_nationkey AS mid,
    CASE WHEN n_nationkey < 15 THEN n_name ELSE 'old' END AS mname FROM nation WHERE n_nationkey < 15 OR n_nationkey % 2 = 0),
  numbered AS (SELECT b.*, row_number() OVER (PARTITION BY b.municipality_id, b.lang2 ORDER BY b.doc_id) - 1 AS local_id FROM
    (SELECT base.*, documents.lang AS lang2 FROM base JOIN documents USING (doc_id)) b),
  last_doc AS (SELECT source, lang, max(doc_id) AS last_id FROM documents GROUP BY source, lang),
  joined AS (SELECT n.*, m.mname, d.text AS dtext, split_part(d.text, chr(10), 1) AS dtitle, d.doc_id % 2 = 0 AS dhit
    FROM numbered n LEFT JOIN muni m ON m.mid = n.municipality_id
    LEFT JOIN last_doc l ON l.source = n.municipality_id AND l.lang = n.lang2 AND l.lang <> 'es'
    LEFT JOIN documents d ON d.doc_id = l.last_id)"""


def analysis(spark, sf_dir) -> DataFrame:
    """Measures keyed by (source, lang): every key is shared by many measures and many documents."""
    docs = documents(spark, sf_dir)
    measures = baseline_measures(spark, sf_dir).withColumn("ord", F.col("candidate_id").cast("long"))
    langs = docs.select(F.col("doc_id").alias("ord"), "lang")
    measures = measures.join(langs, "ord").withColumn("document_id", F.col("lang")).drop("keyword_hit", "lang")
    extracted = docs.where("lang <> 'es'").select(
        "municipality_id", F.col("lang").alias("document_id"), "title", "text", F.col("doc_id").alias("ord"),
        (F.col("doc_id") % 2 == 0).alias("keyword_hit"), F.lit("text/html").alias("mime_type"))
    return export.analysis_table(measures, extracted, municipalities(spark, sf_dir), "scope")


@query("measure_export", sql=f"""WITH {ANALYSIS_SQL}
  SELECT 'scope::' || municipality_id || '::' || lang2 || '::' || local_id AS measure_uid, coalesce(mname, '') AS municipality_name,
    CAST(local_id AS BIGINT) AS measure_local_id, source_url, coalesce(dtitle, '') AS document_title, measure_title,
    substr(coalesce(dtext, ''), 1, 500) AS text_excerpt, policy_area, target_sectors, funding_available,
    CASE WHEN dtext IS NOT NULL THEN 'text/html' END AS mime_type, round(confidence_score, 6) AS confidence_score,
    coalesce(dhit, false) AS keyword_hit, label_source FROM joined""")
def measure_export(spark, sf_dir):
    out = export.analysis_csv_shape(analysis(spark, sf_dir))
    return rounded(out.select(
        "measure_uid", "municipality_name", "measure_local_id", "source_url", "document_title", "measure_title", "text_excerpt",
        "policy_area", "target_sectors", "funding_available", "mime_type", "confidence_score", "keyword_hit", "label_source"))


@query("labels_merge", sql="""SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def labels_merge(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("document_id").alias("id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    merged = joins.merge_labels(docs, labels, ["id"])
    return merged.select("doc_id", "labels.quality", "labels.toxic", F.col("labels").isNotNull().alias("labelled"))


@query("labels_merge_statistics", sql="""SELECT (SELECT count(*) FROM documents) AS docs_total, count(*) AS docs_labeled FROM labels""")
def labels_merge_statistics(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    return joins.merge_statistics(joins.merge_labels(docs, table(spark, sf_dir, "labels"), ["doc_id"]))


@query("labeling_export", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT municipality_id AS municipality, document_id, url, title, substr(replace(text, chr(10), ' '), 1, 1500) AS text, '' AS mime_type,
    '' AS label_is_policy_relevant, '' AS label_policy_scope, '' AS label_instrument_type, '' AS label_target_sector, '' AS label_notes FROM docs""")
def labeling_export(spark, sf_dir):
    return export.labeling_csv_shape(documents(spark, sf_dir), 1500)


@query("measure_csv", sql=f"""WITH {BASELINE_SQL}
  SELECT municipality_id, document_id, source_url, measure_title, NULL::VARCHAR AS measure_type, NULL::VARCHAR AS sector,
    NULL::VARCHAR AS target_group, NULL::VARCHAR AS amount_min, NULL::VARCHAR AS amount_max, NULL::VARCHAR AS application_mode,
    NULL::VARCHAR AS digitalization_level, NULL::VARCHAR AS extraction_mode, baseline_keywords FROM base""")
def measure_csv(spark, sf_dir):
    return export.measure_csv_shape(baseline_measures(spark, sf_dir))


@query("gold_template", sql="""SELECT doc_id, '' AS is_measure_gold, '' AS measure_type_gold, '' AS sector_gold, '' AS comment_gold
  FROM documents ORDER BY doc_id LIMIT 50""")
def gold_template(spark, sf_dir):
    """The first 50 rows with empty gold columns (the head is the feature)."""
    from policyspark.operators.sampling import first_rows

    return export.with_gold_columns(first_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50))


@query("candidate_records", sql=f"""WITH {LABEL_ROWS_SQL}
  SELECT CAST(o_orderkey AS VARCHAR) || '::m0' AS measure_id, CASE WHEN {KEY_SQL} IN {sql_list(AREAS)} THEN {KEY_SQL} END AS policy_area,
    'snippet ' || o_orderkey AS description, NULL::VARCHAR AS instrument_type, '' AS target_sectors FROM raws""")
def candidate_records(spark, sf_dir):
    rows = label_rows(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("candidate_id"), F.lit("d").alias("document_id"),
        F.concat(F.lit("snippet "), F.col("o_orderkey").cast("string")).alias("snippet"), F.col("raw").alias("policy_area"))
    out = export.measure_records(export.candidate_records(rows))
    return out.select("measure_id", "policy_area", "description", "instrument_type", joined("target_sectors").alias("target_sectors"))


@query("label_bundles", sql=f"""WITH r AS (SELECT c_custkey, {sql_array(SECTORS)} AS s, {sql_array(AREAS)} AS a FROM customer)
  SELECT c_custkey, upper(a[c_custkey % {len(AREAS)} + 1]) AS policy_area, upper(s[c_custkey % 8 + 1]) AS target_sectors,
    CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' END AS funding_available, NULL::VARCHAR AS governance_type FROM r""")
def label_bundles(spark, sf_dir):
    """The label bundle of records with free spellings, in its debug form."""
    k = F.col("c_custkey")
    area = F.element_at(F.array(*[F.lit(a) for a in AREAS]), (k % len(AREAS) + 1).cast("int"))
    sector = F.element_at(F.array(*[F.lit(s) for s in SECTORS]), (k % len(SECTORS) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(F.replace(area, F.lit("_"), F.lit(" "))).alias("policy_area"),
        F.array(sector, F.lit("?"), F.upper(sector)).alias("target_sectors"),
        F.when(k % 2 == 0, "TRUE").otherwise("perhaps").alias("funding_available"))
    out = X.label_bundle(rows, debug=True)
    return out.select("c_custkey", "policy_area", joined("target_sectors").alias("target_sectors"), "funding_available", "governance_type")


@query("annotation_prompts", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT doc_id, trim('Annotate.' || chr(10) || '- municipality: ' || municipality_id || chr(10) || '- title: ' || title || chr(10) || chr(10)
    || text, ' ' || chr(10)) AS prompt FROM docs""")
def annotation_prompts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", M.annotation_prompt("Annotate.", ["municipality", "title"]).alias("prompt"))


@query("aligned_batches", sql="""WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS batch FROM orders),
  b AS (SELECT batch, list(o_orderkey ORDER BY o_orderkey) AS k FROM r GROUP BY batch)
  SELECT batch, len(k) - 1 AS n, k[1] AS first_input, 'a' || k[2] AS first_result FROM b WHERE len(k) > 1""")
def aligned_batches(spark, sf_dir):
    """Batches of 16 whose results are one short: pairs up to the shorter side."""
    numbered = with_batch_number(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 16)
    orders = numbered.groupBy("batch").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    results = F.transform(F.slice("k", 2, 1 << 30), lambda x: F.concat(F.lit("a"), x.cast("string")))
    pairs = orders.select("batch", joins.align_by_position(F.col("k"), results).alias("p")).where(F.size("p") > 0)
    return pairs.select("batch", F.size("p").cast("long").alias("n"), F.col("p")[0]["input"].alias("first_input"),
                        F.col("p")[0]["result"].alias("first_result"))
