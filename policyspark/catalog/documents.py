"""Queries over documents: snippets, keyword scores, classification, baseline labels, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.catalog import query
from policyspark.catalog.inputs import (
    BASELINE, DOCUMENTS_SQL, FILTER, NEGATIVE, POSITIVE, RULES, document_shape, documents, joined, rounded, table,
)
from policyspark.functions import text as T
from policyspark.functions.terms import KeywordRules, listed_hits, literal_array, table_counts, table_matches, term_hits, with_keyword_score
from policyspark.functions.urls import last_segment
from policyspark.operators import classify, harmonise, ordinals, snippets
from policyspark.sources import tables
from policyspark.sources.ndjson import line_counters, parse_lines


def quoted(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def has_sql(column: str, terms) -> str:
    """OR of substring tests."""
    if not terms:
        return "false"
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def count_sql(column: str, terms) -> str:
    if not terms:
        return "0"
    return "(" + " + ".join(
        f"((length({column}) - length(replace({column}, '{t}', ''))) // {len(t)})" for t in terms) + ")"


def hits_sql(column: str, terms) -> str:
    return f"list_filter({quoted(sorted(terms))}, lambda w: contains({column}, w))"


# Greedy packing as a fold over the sentences: [finished pieces, current piece].
_SENTENCES_SQL = r"string_split(regexp_replace(p, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))"
_FOLD_SQL = f"""list_reduce(list_transform({_SENTENCES_SQL}, lambda s: ['', s]), lambda a, x:
  CASE WHEN length(a[2]) + 1 + length(x[2]) <= 900 THEN [a[1], a[2] || ' ' || x[2]]
       ELSE [a[1] || a[2] || chr(2), x[2]] END)"""
PACK_SQL = f"string_split(array_to_string({_FOLD_SQL}, ''), chr(2))"
SNIPPETS_SQL = rf"""snips AS (
  SELECT *, flatten(list_transform(list_filter(list_transform(
      regexp_split_to_array(text, '\n\s*\n'), lambda q: trim(regexp_replace(q, '\s+', ' ', 'g'))),
      lambda q: q <> ''), lambda p: {PACK_SQL})) AS all_snippets FROM docs),
accepted AS (
  SELECT *, list_filter(all_snippets, lambda s: length(s) >= 150
      AND NOT {has_sql('lower(s)', NEGATIVE)} AND {has_sql('lower(s)', POSITIVE)}) AS good FROM snips),
flat AS (SELECT *, unnest(good) AS snippet, generate_subscripts(good, 1) - 1 AS pos FROM accepted)"""


def _candidates(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return snippets.snippet_candidates(documents(spark, sf_dir), positive=POSITIVE, negative=NEGATIVE, **options)


@query("snippet_candidates", sql=f"""WITH {DOCUMENTS_SQL}, {SNIPPETS_SQL}
  SELECT municipality_id || '::' || document_id || '::p' || pos AS candidate_id, document_id, municipality_id,
         title, snippet, url, true AS keyword_hit, 0.0::DOUBLE AS confidence_score FROM flat""")
def snippet_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select(
        "candidate_id", "document_id", "municipality_id", "title", "snippet", "url", "keyword_hit", "confidence_score")


@query("candidates_per_source", sql=f"""WITH {DOCUMENTS_SQL}, {SNIPPETS_SQL}
  SELECT municipality_id, count(*) AS n_candidates, CAST(sum(length(snippet)) AS BIGINT) AS n_chars
  FROM flat GROUP BY municipality_id""")
def candidates_per_source(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("municipality_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sum(F.length("snippet")).alias("n_chars"))


@query("snippets_of_repeated_keys", sql=f"""WITH {DOCUMENTS_SQL}, {SNIPPETS_SQL},
  numbered AS (SELECT *, row_number() OVER (PARTITION BY municipality_id, lang ORDER BY doc_id, pos) - 1 AS n FROM flat)
  SELECT municipality_id || '::' || lang || '::p' || n AS candidate_id, doc_id_text AS owner, length(snippet) AS chars
  FROM (SELECT *, document_id AS doc_id_text FROM numbered)""")
def snippets_of_repeated_keys(spark, sf_dir):
    """Documents share the key (source, lang); numbering continues over them in doc_id order."""
    docs = documents(spark, sf_dir)
    keyed = docs.withColumns({"url": F.col("document_id"), "document_id": F.col("lang")})
    out = snippets.snippet_candidates(keyed, positive=POSITIVE, negative=NEGATIVE, order="doc_id")
    return out.select("candidate_id", F.col("url").alias("owner"), F.length("snippet").alias("chars"))


@query("snippets_with_rules", sql=f"""WITH {DOCUMENTS_SQL}, {SNIPPETS_SQL.split('accepted AS')[0].rstrip().rstrip(',')},
  each AS (SELECT document_id, municipality_id, unnest(all_snippets) AS snippet,
           generate_subscripts(all_snippets, 1) AS pos FROM snips),
  scored AS (SELECT *, lower(snippet) AS low FROM each WHERE length(snippet) >= 150),
  passing AS (SELECT *, {hits_sql('low', RULES.positive)} AS g, {hits_sql('low', RULES.themes['alpha'].include)} AS a,
      {hits_sql('low', RULES.themes['beta'].include)} AS b, {hits_sql('low', RULES.themes['gamma'].include)} AS c
    FROM scored WHERE NOT {has_sql('low', NEGATIVE)} AND NOT {has_sql('low', RULES.negative + ('zzz', 'ninght'))})
  SELECT municipality_id || '::' || document_id || '::p'
      || (row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1) AS candidate_id,
    {has_sql('low', POSITIVE)} AS keyword_hit, array_to_string(g, '|') AS general_hits, array_to_string(a, '|') AS alpha,
    array_to_string(b, '|') AS beta, array_to_string(c, '|') AS gamma,
    round(least(1.0::DOUBLE, 0.1::DOUBLE + 0.05::DOUBLE * (len(g) + len(a) + len(b) + len(c))), 6) AS confidence_score
  FROM passing WHERE len(g) >= 1 AND len(a) + len(b) + len(c) >= 1""")
def snippets_with_rules(spark, sf_dir):
    out = snippets.snippet_candidates(documents(spark, sf_dir), RULES, positive=POSITIVE, negative=NEGATIVE)
    theme = {t: F.coalesce(joined(F.col("keyword_hits_thematic")[t]), F.lit("")) for t in RULES.themes}
    return rounded(out.select(
        "candidate_id", "keyword_hit", joined("keyword_hits_general").alias("general_hits"),
        *[c.alias(t) for t, c in theme.items()], "confidence_score"))


@query("keyword_scores", sql=f"""WITH {DOCUMENTS_SQL}, s AS (
    SELECT doc_id, {hits_sql('t', RULES.positive)} AS g, {hits_sql('t', RULES.themes['alpha'].include)} AS a,
      {hits_sql('t', RULES.themes['beta'].include)} AS b, {hits_sql('t', RULES.themes['gamma'].include)} AS c,
      {hits_sql('t', RULES.negative)} AS neg, {hits_sql('t', ('zzz',))} AS na, {hits_sql('t', ('ninght',))} AS nb FROM docs)
  SELECT doc_id, array_to_string(g, '|') AS general_hits, array_to_string(a, '|') AS alpha,
    array_to_string(b, '|') AS beta, array_to_string(c, '|') AS gamma, array_to_string(neg, '|') AS negative_general,
    len(g) >= 1 AND ((len(a) > 0)::INT + (len(b) > 0)::INT + (len(c) > 0)::INT) >= 1
      AND len(neg) = 0 AND len(na) = 0 AND len(nb) = 0 AS passes_filter,
    round(least(1.0::DOUBLE, 0.1::DOUBLE + 0.05::DOUBLE * (len(g) + len(a) + len(b) + len(c))), 6) AS confidence_score
  FROM s""")
def keyword_scores(spark, sf_dir):
    scored = with_keyword_score(documents(spark, sf_dir), "text", RULES)
    return rounded(scored.select(
        "doc_id", joined("keyword_hits_general").alias("general_hits"),
        *[F.coalesce(joined(F.col("keyword_hits_thematic")[t]), F.lit("")).alias(t) for t in RULES.themes],
        joined("keyword_negative_hits.general").alias("negative_general"), "passes_filter", "confidence_score"))


@query("keyword_rules_from_table", sql=f"""WITH {DOCUMENTS_SQL}, terms AS (
    SELECT DISTINCT lower(n_name) AS term FROM nation UNION SELECT DISTINCT lower(r_name) FROM region
    UNION SELECT DISTINCT substr(lower(p_type), 1, 3) FROM part)
  SELECT doc_id, count(*) AS n_hits FROM docs JOIN terms ON contains(t, term) GROUP BY doc_id""")
def keyword_rules_from_table(spark, sf_dir):
    """Rules loaded from a table of terms built from nation, region and part names."""
    terms = (
        table(spark, sf_dir, "nation").select(F.lower("n_name").alias("term"))
        .union(table(spark, sf_dir, "region").select(F.lower("r_name")))
        .union(table(spark, sf_dir, "part").select(F.substring(F.lower("p_type"), 1, 3)))
    )
    docs = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("t"))
    return table_matches(docs, terms, "doc_id", "t").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"))


@query("keyword_hits_by_term", sql=f"""WITH {DOCUMENTS_SQL}, terms AS (
    SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> '')
  SELECT term, count(*) AS n_docs FROM docs JOIN terms ON contains(t, term) GROUP BY term""")
def keyword_hits_by_term(spark, sf_dir):
    """All words of the benchmark as a term table."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term"))
    docs = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("t"))
    return table_matches(docs, terms, "doc_id", "t").groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


@query("keyword_hits_positions", sql=f"""WITH {DOCUMENTS_SQL}, terms AS (
    SELECT DISTINCT substr(w, 1, 4) AS term FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> '')
  SELECT doc_id, term, (length(t) - length(replace(t, term, ''))) // length(term) AS n FROM docs JOIN terms ON contains(t, term)""")
def keyword_hits_positions(spark, sf_dir):
    """How often each beginning of a benchmark word occurs in each document, occurrences not overlapping."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).select(
        F.substring("w", 1, 4).alias("term"))
    docs = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("t"))
    return table_counts(docs, terms, "doc_id", "t")


@query("keyword_rules_from_config", sql=f"""WITH {DOCUMENTS_SQL}, rules AS (
    SELECT 'general' AS grp, 'positive' AS polarity, lower(n_name) AS term FROM nation WHERE n_nationkey < 5
    UNION SELECT 'general', 'positive', substr(lower(r_name), 1, 2) FROM region
    UNION SELECT 'general', 'negative', lower(n_name) FROM nation
    UNION SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END, 'include', substr(lower(p_type), 1, 3) FROM part),
  hits AS (SELECT doc_id, grp, polarity, count(*) AS n FROM docs JOIN rules ON contains(t, term) GROUP BY ALL)
  SELECT doc_id, coalesce(sum(n) FILTER (polarity = 'positive'), 0)::BIGINT AS n_general,
    count(*) FILTER (polarity = 'include') AS n_themes, coalesce(sum(n) FILTER (polarity = 'negative'), 0)::BIGINT AS n_negative,
    coalesce(sum(n) FILTER (polarity = 'positive'), 0) >= 1 AND count(*) FILTER (polarity = 'include') >= 1
      AND coalesce(sum(n) FILTER (polarity = 'negative'), 0) = 0 AS passes_filter
  FROM docs LEFT JOIN hits USING (doc_id) GROUP BY doc_id""")
def keyword_rules_from_config(spark, sf_dir):
    """Rules of a configuration table (group, polarity, term), made of nation, region and part names."""
    rules = table(spark, sf_dir, "nation").where("n_nationkey < 5").selectExpr(
        "'general' AS `group`", "'positive' AS polarity", "lower(n_name) AS term")
    rules = rules.union(table(spark, sf_dir, "region").selectExpr("'general'", "'positive'", "substr(lower(r_name), 1, 2)"))
    rules = rules.union(table(spark, sf_dir, "nation").selectExpr("'general'", "'negative'", "lower(n_name)"))
    rules = rules.union(table(spark, sf_dir, "part").selectExpr(
        "IF(p_partkey % 2 = 0, 'even', 'odd')", "'include'", "substr(lower(p_type), 1, 3)").distinct())
    scored = with_keyword_score(documents(spark, sf_dir), "text", KeywordRules.from_table(rules))
    return scored.select(
        "doc_id", F.size("keyword_hits_general").cast("long").alias("n_general"),
        F.size("keyword_hits_thematic").cast("long").alias("n_themes"),
        F.size("keyword_negative_hits.general").cast("long").alias("n_negative"), "passes_filter")


@query("keyword_grep", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT doc_id, array_to_string({hits_sql("(tl || chr(10) || t)", ["license", "thwh", "vipa"])}, ', ') AS hit_words,
         substr(replace(text, chr(10), ' '), 1, 300) AS preview
  FROM docs WHERE {has_sql("(tl || chr(10) || t)", ["license", "thwh", "vipa"])}""")
def keyword_grep(spark, sf_dir):
    found = snippets.keyword_grep(documents(spark, sf_dir), ["license", "thwh", "vipa"])
    return found.select("doc_id", joined("hit_words", ", ").alias("hit_words"), "preview")


@query("normalised_text", sql=r"""
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat,
    len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))),
        lambda p: p <> '')) AS n_paragraphs,
    CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS short,
    replace(replace(text, chr(13), ' '), chr(10), ' ') AS one_line, sha256(text) AS digest
  FROM documents""")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.collapse_spaces("text").alias("flat"), F.size(T.paragraphs("text")).cast("long").alias("n_paragraphs"),
        T.ellipsis("text", 120).alias("short"), T.one_line("text").alias("one_line"), T.digest("text").alias("digest"))


def _classification_sql(c: classify.FilterConfig = FILTER, docs: str = DOCUMENTS_SQL) -> str:
    strong, support = count_sql("t", c.strong_terms), count_sql("t", c.supporting_terms)
    return f"""{docs}, e AS (SELECT doc_id, t, tl, lower(url) AS u, CASE
        WHEN t = '' THEN 'empty_text' WHEN length(t) < {c.min_length} THEN 'too_short'
        WHEN {has_sql('tl', c.imprint_title_terms)} OR {has_sql('lower(url)', c.imprint_url_fragments)} THEN 'imprint_or_dataprotection'
        WHEN {has_sql('tl', c.navigation_title_terms)} OR {has_sql('lower(url)', c.navigation_url_fragments)} THEN 'navigation_page'
        WHEN {has_sql('tl', c.news_title_terms)} OR {has_sql('lower(url)', c.news_url_fragments)} THEN 'news_or_press'
        WHEN {has_sql('tl', c.negative_title_terms)} THEN 'negative_title_terms'
        WHEN {has_sql('lower(url)', c.negative_url_fragments)} THEN 'negative_url_fragment' END AS early FROM docs),
      h AS (SELECT *, CASE WHEN early IS NULL THEN {strong} ELSE 0 END AS strong_hits,
        CASE WHEN early IS NULL THEN {support} ELSE 0 END AS supporting_hits FROM e),
      m AS (SELECT *, coalesce(early, CASE WHEN strong_hits < 2 OR strong_hits + supporting_hits < 3
        THEN 'too_weak_climate_signal' END) AS mid FROM h),
      k AS (SELECT *, CASE WHEN mid IS NULL THEN {count_sql('t', c.measure_terms)} ELSE 0 END AS measure_hits,
        CASE WHEN mid IS NULL THEN {count_sql('t', c.admin_terms)} ELSE 0 END AS admin_hits,
        CASE WHEN mid IS NULL THEN {count_sql('t', c.framework_terms)} ELSE 0 END AS framework_hits FROM m),
      sc AS (SELECT *, measure_hits + CASE WHEN {has_sql('tl', c.measure_terms)} THEN 2 ELSE 0 END AS ms,
        admin_hits + CASE WHEN {has_sql('tl', c.admin_terms)} THEN 2 ELSE 0 END AS ads,
        framework_hits + CASE WHEN {has_sql('tl', c.framework_terms)} THEN 2 ELSE 0 END AS fs FROM k),
      r AS (SELECT *, coalesce(mid, CASE WHEN ms = 0 AND ads = 0 AND fs = 0 THEN 'climate_plus_funding_signal'
        WHEN ms >= greatest(ads, fs, 1) THEN 'measure_terms_dominate'
        WHEN ads >= greatest(ms, fs, 1) THEN 'admin_terms_dominate'
        WHEN fs > 0 THEN 'framework_terms_present' ELSE 'climate_but_no_policy_signal' END) AS reason FROM sc),
      cls AS (SELECT doc_id, CASE reason WHEN 'imprint_or_dataprotection' THEN 'legal_imprint'
        WHEN 'navigation_page' THEN 'info_navigation' WHEN 'news_or_press' THEN 'news_article'
        WHEN 'climate_plus_funding_signal' THEN 'policy_measure' WHEN 'measure_terms_dominate' THEN 'policy_measure'
        WHEN 'admin_terms_dominate' THEN 'policy_admin' WHEN 'framework_terms_present' THEN 'policy_framework'
        ELSE 'noise' END AS doc_type,
        reason IN ('climate_plus_funding_signal', 'measure_terms_dominate', 'admin_terms_dominate',
                   'framework_terms_present') AS is_policy_relevant, reason,
        CAST(strong_hits AS BIGINT) AS strong_hits, CAST(supporting_hits AS BIGINT) AS supporting_hits,
        CAST(measure_hits AS BIGINT) AS measure_hits, CAST(admin_hits AS BIGINT) AS admin_hits,
        CAST(framework_hits AS BIGINT) AS framework_hits FROM r)"""


@query("doc_classification", sql=f"WITH {_classification_sql()} SELECT * FROM cls")
def doc_classification(spark, sf_dir):
    out = classify.classify_documents(documents(spark, sf_dir), FILTER)
    hits = [c for c in classify.CLASS_COLUMNS if c.endswith("_hits")]
    return out.select("doc_id", "doc_type", "is_policy_relevant", "reason", *[F.col(h).cast("long").alias(h) for h in hits])


@query("doc_filter_stats", sql=f"""WITH {_classification_sql()}
  SELECT count(*) AS total, CAST(sum(is_policy_relevant::INT) AS BIGINT) AS kept FROM cls""")
def doc_filter_stats(spark, sf_dir):
    return classify.filter_stats(documents(spark, sf_dir), FILTER)


@query("relevant_documents", sql=f"""WITH {_classification_sql()}
  SELECT d.doc_id, d.municipality_id, d.title FROM docs d JOIN cls USING (doc_id) WHERE is_policy_relevant""")
def relevant_documents(spark, sf_dir):
    return classify.relevant_documents(documents(spark, sf_dir), FILTER).select("doc_id", "municipality_id", "title")


@query("doc_classification_default_terms", sql=f"""WITH {DOCUMENTS_SQL}, e AS (SELECT doc_id, CASE
    WHEN t = '' THEN 'empty_text' WHEN length(t) < 500 THEN 'too_short'
    WHEN {has_sql('tl', classify.FilterConfig().navigation_title_terms)} THEN 'navigation_page'
    WHEN {has_sql('lower(url)', classify.FilterConfig().navigation_url_fragments)} THEN 'navigation_page'
    WHEN {has_sql('tl', classify.FilterConfig().news_title_terms)} THEN 'news_or_press'
    WHEN {has_sql('lower(url)', classify.FilterConfig().news_url_fragments)} THEN 'news_or_press'
    WHEN {has_sql('tl', classify.FilterConfig().negative_title_terms)} THEN 'negative_title_terms'
    WHEN {count_sql('t', classify.FilterConfig().strong_terms)} < 2 THEN 'too_weak_climate_signal'
    ELSE 'other' END AS reason FROM docs)
  SELECT reason, count(*) AS n FROM e GROUP BY reason""")
def doc_classification_default_terms(spark, sf_dir):
    """The default German lists over all texts; the invented prose stays below the climate signal."""
    out = classify.classify_documents(documents(spark, sf_dir))
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _baseline_sql(rules: classify.BaselineRules = BASELINE, docs: str = DOCUMENTS_SQL) -> str:
    def cascade(cases, default: str) -> tuple[str, str]:
        label = "CASE " + " ".join(f"WHEN {has_sql('f', ts)} THEN '{n}'" for n, ts in cases) + f" ELSE '{default}' END"
        hits = "CASE " + " ".join(f"WHEN {has_sql('f', ts)} THEN {hits_sql('f', ts)}" for _, ts in cases) + " ELSE [] END"
        return label, hits

    area, area_hits = cascade(rules.areas, "other")
    instrument, instrument_hits = cascade(rules.instruments, "other")
    sectors = "list_concat(" * (len(rules.sectors) - 1)
    parts = [f"CASE WHEN {has_sql('f', ts)} THEN ['{n}'] ELSE [] END" for n, ts in rules.sectors]
    sectors += parts[0] + "".join(f", {p})" for p in parts[1:])
    every = [t for _, ts in rules.sectors for t in ts] + [*rules.mitigation, *rules.adaptation, *rules.funding]
    return f"""{docs}, full_text AS (SELECT *, lower(trim(title || chr(10) || text, ' ' || chr(10))) AS f,
         trim(title || chr(10) || text, ' ' || chr(10)) AS ft FROM docs),
      b AS (SELECT *, {area} AS policy_area, {instrument} AS instrument_type, {sectors} AS sectors,
        {has_sql('f', rules.mitigation)} AS mit, {has_sql('f', rules.adaptation)} AS ada,
        {has_sql('f', rules.funding)} AS funding_available,
        list_sort(list_distinct(list_concat(list_concat({area_hits}, {instrument_hits}), {hits_sql('f', every)}))) AS kw
        FROM full_text),
      base AS (SELECT doc_id, document_id, municipality_id, url AS source_url,
        CASE WHEN title <> '' THEN title WHEN length(ft) > 120 THEN substr(ft, 1, 120) || '...' ELSE ft END AS measure_title,
        policy_area, instrument_type,
        CASE WHEN len(sectors) = 0 THEN 'cross_sectoral' ELSE array_to_string(sectors, '|') END AS target_sectors,
        CASE WHEN mit AND ada THEN 'both' WHEN mit THEN 'mitigation' WHEN ada THEN 'adaptation' ELSE 'unspecified' END
          AS climate_dimension, 'local_municipality' AS governance_type, funding_available,
        array_to_string(kw, ', ') AS baseline_keywords, len(kw) > 0 AS keyword_hit,
        'baseline_rules_v1' AS label_source,
        least(1.0::DOUBLE, 0.2::DOUBLE + 0.1::DOUBLE * len(kw)) AS confidence_score FROM b)"""


BASELINE_SQL = _baseline_sql()


def baseline_measures(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify.baseline_labels(docs.withColumn("candidate_id", F.col("document_id")), BASELINE)


@query("baseline_labels", sql=f"""WITH {BASELINE_SQL}
  SELECT document_id AS candidate_id, municipality_id, source_url, measure_title, policy_area, instrument_type,
    target_sectors, climate_dimension, governance_type, funding_available, baseline_keywords, keyword_hit,
    label_source, round(confidence_score, 6) AS confidence_score FROM base""")
def baseline_labels(spark, sf_dir):
    out = baseline_measures(spark, sf_dir).withColumns({
        "target_sectors": joined("target_sectors"), "baseline_keywords": joined("baseline_keywords", ", ")})
    return rounded(out.select(
        "candidate_id", "municipality_id", "source_url", "measure_title", "policy_area", "instrument_type",
        "target_sectors", "climate_dimension", "governance_type", "funding_available", "baseline_keywords",
        "keyword_hit", "label_source", "confidence_score"))


@query("baseline_default_terms", sql=f"""WITH {DOCUMENTS_SQL}, f AS (SELECT lower(title || chr(10) || text) AS f FROM docs)
  SELECT CASE {' '.join(f"WHEN {has_sql('f', ts)} THEN '{n}'" for n, ts in classify.BaselineRules().areas)} ELSE 'other' END AS policy_area,
    CASE {' '.join(f"WHEN {has_sql('f', ts)} THEN '{n}'" for n, ts in classify.BaselineRules().instruments)} ELSE 'other' END AS instrument_type,
    {has_sql('f', classify.BaselineRules().funding)} AS funding_available, count(*) AS n
  FROM f GROUP BY ALL""")
def baseline_default_terms(spark, sf_dir):
    out = classify.baseline_labels(documents(spark, sf_dir))
    return out.groupBy("policy_area", "instrument_type", "funding_available").agg(F.count(F.lit(1)).alias("n"))


#: Default terms that the invented prose lacks; two thirds of the documents get two strong ones and three of any list.
STRONG = list(classify.FilterConfig().strong_terms)
ANY_TERM = sorted({t for rules in (classify.BaselineRules(),) for _, ts in (*rules.areas, *rules.instruments, *rules.sectors) for t in ts}
                  | {*classify.BaselineRules().mitigation, *classify.BaselineRules().adaptation, *classify.BaselineRules().funding,
                     *classify.FilterConfig().supporting_terms, "zuschuss von 5000 euro", "satzung", "beschluss", "verpflichtend"})
PLANTS = ((STRONG, 1), (STRONG, 7), (ANY_TERM, 1), (ANY_TERM, 11), (ANY_TERM, 29))
PLANTED_SQL = DOCUMENTS_SQL.replace("FROM documents)", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' ' || "
                                    + " || ' ' || ".join(f"({quoted(terms)})[doc_id * {k} % {len(terms)} + 1]" for terms, k in PLANTS)
                                    + " END AS text) FROM documents) AS documents)")


def planted(spark, sf_dir) -> DataFrame:
    words = [F.element_at(literal_array(terms), (F.col("doc_id") * k % len(terms) + 1).cast("int")) for terms, k in PLANTS]
    docs = table(spark, sf_dir, "documents")
    return document_shape(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(
        F.concat_ws(" ", "text", *words))))


@query("doc_classification_planted", sql=f"WITH {_classification_sql(classify.FilterConfig(), PLANTED_SQL)} SELECT * FROM cls")
def doc_classification_planted(spark, sf_dir):
    """The default German lists over texts that hold their terms."""
    out = classify.classify_documents(planted(spark, sf_dir))
    hits = [c for c in classify.CLASS_COLUMNS if c.endswith("_hits")]
    return out.select("doc_id", "doc_type", "is_policy_relevant", "reason", *[F.col(h).cast("long").alias(h) for h in hits])


@query("baseline_planted", sql=f"""WITH {_baseline_sql(classify.BaselineRules(), PLANTED_SQL)}
  SELECT document_id AS candidate_id, policy_area, instrument_type, target_sectors, climate_dimension, funding_available,
    baseline_keywords, keyword_hit, round(confidence_score, 6) AS confidence_score FROM base""")
def baseline_planted(spark, sf_dir):
    """The default cascades over texts that hold their terms."""
    docs = planted(spark, sf_dir)
    out = classify.baseline_labels(docs.withColumn("candidate_id", F.col("document_id"))).withColumns({
        "target_sectors": joined("target_sectors"), "baseline_keywords": joined("baseline_keywords", ", ")})
    return rounded(out.select("candidate_id", "policy_area", "instrument_type", "target_sectors", "climate_dimension",
                              "funding_available", "baseline_keywords", "keyword_hit", "confidence_score"))


@query("labeler_fields", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT doc_id, trim(text, ' ' || chr(10)) AS pick_text, trim(title, ' ' || chr(10)) AS pick_title,
    url AS pick_url, municipality_id AS pick_scope FROM docs""")
def labeler_fields(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnsRenamed({"text": "content", "url": "source_url"})
    blank = docs.withColumns({"text": F.lit("  "), "url": F.lit(None).cast("string")})
    return harmonise.labeler_fields(blank).select("doc_id", "pick_text", "pick_title", "pick_url", "pick_scope")


@query("labeler_fields_single", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT doc_id, trim(text, ' ' || chr(10)) AS pick_text, trim(title, ' ' || chr(10)) AS pick_title,
    url AS pick_url, municipality_id AS pick_scope FROM docs""")
def labeler_fields_single(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnRenamed("url", "source_url").withColumn("snippet", F.lit("unused"))
    return harmonise.labeler_fields(docs, None, batch_rules=False).select(
        "doc_id", "pick_text", "pick_title", "pick_url", "pick_scope")


@query("inspect_documents", sql=f"""WITH {DOCUMENTS_SQL}
  SELECT doc_id, municipality_id, substr(replace(text, chr(10), ' '), 1, 200) AS preview FROM docs
  WHERE contains(title || ' ' || text, 'Que ') ORDER BY doc_id LIMIT 25""")
def inspect_documents(spark, sf_dir):
    return harmonise.inspect_documents(documents(spark, sf_dir), "doc_id", 25, contains="Que ").select(
        "doc_id", "municipality_id", "preview")


@query("last_per_key", sql="""
  SELECT source, lang, doc_id, n_chars FROM documents
  QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1""")
def last_per_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return ordinals.last_per_key(docs, ["source", "lang"], "doc_id")


@query("local_ids", sql="""
  SELECT l_orderkey, l_linenumber, l_returnflag,
    'scope::' || l_returnflag || '::' || (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) AS measure_uid
  FROM lineitem""")
def local_ids(spark, sf_dir):
    """Consecutive numbers inside three groups that each hold a third of the table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    numbered = ordinals.with_row_number(
        lines, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "n")
    return numbered.select("l_orderkey", "l_linenumber", "l_returnflag", T.compose_id(
        F.lit("scope"), "l_returnflag", F.col("n").cast("string")).alias("measure_uid"))


@query("running_caps", sql="""
  WITH r AS (SELECT event_id, event_type, value,
      coalesce(sum((value >= 10)::INT) OVER (PARTITION BY event_type ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
  SELECT event_id, event_type, CAST(before AS BIGINT) AS before FROM r WHERE before < 500""")
def running_caps(spark, sf_dir):
    """Rows seen before the cap of 500 qualifying earlier rows per group is reached."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    run = ordinals.with_running_totals(
        events, ["event_type"], ["event_id"], {"before": (F.col("value") >= 10).cast("long")})
    return run.where(F.col("before") < 500).select("event_id", "event_type", "before")


@query("batches", sql="""
  SELECT b AS batch, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
  FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS b FROM orders) GROUP BY b""")
def batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return ordinals.with_batch_number(orders, ["o_orderkey"], 64).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("lenient_json_lines", sql="""
  SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum
  FROM events WHERE event_id % 10 < 7 GROUP BY event_type""")
def lenient_json_lines(spark, sf_dir):
    """Lines made of events: objects, blanks, arrays and broken text; only the objects survive."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    obj = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit("}"))
    line = F.when(m < 7, obj).when(m == 7, "   ").when(m == 8, F.concat(F.lit("["), obj, F.lit("]"))).otherwise(
        F.concat(F.lit("not json "), obj))
    rows = parse_lines(e.select(line.alias("value")), "type string, props struct<k:bigint>")
    return rows.groupBy(F.col("type").alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("props.k").alias("k_sum"))


@query("line_counters", sql="""
  SELECT CAST(sum((event_id % 10 <> 7)::INT) AS BIGINT) AS rows_total, CAST(sum((event_id % 10 = 7)::INT) AS BIGINT) AS empty_lines,
    CAST(sum((event_id % 10 > 7)::INT) AS BIGINT) AS parse_errors FROM events""")
def line_counters_query(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    line = F.when(m < 7, F.col("props")).when(m == 7, " \t").when(m == 8, "[1]").otherwise("{broken")
    return line_counters(e.select(line.alias("value")))


@query("iso_timestamps", sql="""
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS crawl_timestamp FROM events""")
def iso_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.iso_utc("ts").alias("crawl_timestamp"))


@query("matched_terms", sql=f"""
  SELECT conv_id, turn, array_to_string({hits_sql('lower(text)', ['the ', 'que', 'der ', 'ation'])}, '|') AS terms
  FROM conversations""")
def matched_terms(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", joined(term_hits(F.lower("text"), sorted(["the ", "que", "der ", "ation"]))).alias("terms"))


@query("category_values", sql="""
  SELECT o_orderkey, coalesce(nullif(trim(substr(o_orderpriority, 2, 1 + o_orderkey % 4)), ''), 'null') AS category,
    try_cast(substr(o_orderpriority, 1, 1 + CAST(o_orderkey % 2 AS INT)) AS DOUBLE) AS number,
    regexp_replace(o_orderpriority, '^.*/', '') AS segment FROM orders""")
def category_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        T.category(F.col("o_orderpriority").substr(F.lit(2), (F.lit(1) + F.col("o_orderkey") % 4).cast("int"))).alias("category"),
        T.to_number(F.col("o_orderpriority").substr(F.lit(1), (F.lit(1) + F.col("o_orderkey") % 2).cast("int"))).alias("number"),
        last_segment("o_orderpriority").alias("segment"))


@query("read_order_ids", sql="""
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' || doc_id ELSE 'doc' || row_number() OVER (ORDER BY doc_id) END AS document_id
  FROM documents""")
def read_order_ids(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 3 == 0, F.concat(F.lit("own"), d.cast("string"))).when(d % 3 == 1, "").alias("document_id"))
    return ordinals.with_read_order_ids(docs, "doc_id").select("doc_id", "document_id")


@query("municipality_rows", sql="""
  SELECT 'c' || c_custkey AS municipality_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'c' || c_custkey END AS name,
    CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'c' || c_custkey END AS official_name, 'https://' || c_custkey AS base_url,
    CAST(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 10 END AS INT) AS population, 'municipalities.csv' AS source
  FROM customer WHERE c_custkey % 5 <> 0""")
def municipality_rows(spark, sf_dir):
    """customers as raw municipality rows; rows without a base url are dropped, names and source default."""
    k = F.col("c_custkey")
    s = k.cast("string")
    raw = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), s).alias("municipality_id"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("name"),
        F.when(k % 5 != 0, F.concat(F.lit("https://"), s)).alias("base_url"),
        F.when(k % 4 != 0, (k * 10).cast("string")).otherwise("").alias("population"))
    return tables.municipality_rows(raw).select("municipality_id", "name", "official_name", "base_url", "population", "source")


@query("discovered_seeds", sql="""
  SELECT 'u' || user_id AS municipality_id, max(event_id) || ' b' AS seeds FROM events WHERE event_id % 3 <> 0 GROUP BY user_id""")
def discovered_seeds(spark, sf_dir):
    """events as seed records: nulls inside a list are dropped, the last complete record per user counts."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("municipality_id"), F.col("event_id").alias("ord"),
        F.when(F.col("event_id") % 3 != 0, F.array(
            F.col("event_id").cast("string"), F.lit(None).cast("string"), F.lit("b"))).alias("discovered_seeds"))
    return tables.discovered_seeds(rows).select("municipality_id", joined("discovered_seeds", " ").alias("seeds"))


@query("crawl_targets", sql="""
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE s_name END AS muni, 'https://' || s_suppkey AS url,
    CASE WHEN s_suppkey % 2 = 0 THEN 'a.de' ELSE '' END AS domains FROM supplier""")
def crawl_targets(spark, sf_dir):
    """suppliers as crawl targets under their alternative field names."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.when(k % 3 != 0, F.col("s_name")).alias("name"), F.concat(F.lit("https://"), k.cast("string")).alias("start_url"),
        F.when(k % 2 == 0, "a.de").otherwise("").alias("domains"))
    return tables.target_rows(rows).select("muni", "url", joined("allowed_domains", " ").alias("domains"))


# 1,024 terms by a rule, in an order that is not sorted; two of them listed twice.
SYLLABLES = ("th", "er", "an", "in", "on", "re", "nd", "ha", "en", "ou", "ed", "ti", "es", "or", "at", "st", "ea", "nt", "ing", "ble",
             "wh", "sh", "ly", "tion", "ch", "eau", "der", "qu", "le", "ai", "que", "vi")
LONG_LIST = tuple(b + a for a in SYLLABLES for b in SYLLABLES) + ("ther", "anin")


@query("keyword_scores_long_list", sql=f"""SELECT doc_id, len(hits) AS n_hits, array_to_string(hits, '|') AS hits
  FROM (SELECT doc_id, list_filter([{", ".join(f"'{t}'" for t in LONG_LIST)}], lambda x: contains(lower(text), x)) AS hits FROM documents)""")
def keyword_scores_long_list(spark, sf_dir):
    """A list of over a thousand terms: hits in list order, repeats as given."""
    hits = table(spark, sf_dir, "documents").select("doc_id", listed_hits(F.lower("text"), LONG_LIST).alias("h"))
    return hits.select("doc_id", F.size("h").cast("long").alias("n_hits"), joined("h").alias("hits"))


@query("running_total_constant_order", sql="""SELECT doc_id, source, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM documents""")
def running_total_constant_order(spark, sf_dir):
    """A running total whose first order column says nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.lit(1).alias("same"))
    return ordinals.with_running_totals(docs, ["source"], ["same", "doc_id"], {"chars_before": F.col("n_chars")}).select(
        "doc_id", "source", "chars_before")
