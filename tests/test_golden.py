"""Hand-derived expectations for single rows."""

import pytest
from pyspark.sql import functions as F

from policyspark.functions import html as H
from policyspark.functions import model_output as M
from policyspark.functions import taxonomy as X
from policyspark.functions import text as T
from policyspark.functions.terms import KeywordRules, count_occurrences, with_keyword_score
from policyspark.operators import classify, export, gate, joins, ordinals, profile, report, snippets
from policyspark.operators.bootstrap import confident_weak_labels
from policyspark.sources.ndjson import parse_lines


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def col_of(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", column.alias("r")).orderBy("i").collect()]


def test_baseline_funding_sentence(spark):
    text = "Die Stadt fördert Balkonkraftwerke mit einem Zuschuss von 100 Euro pro Haushalt."
    row = classify.baseline_labels(spark.createDataFrame(
        [("c1", "Balkon-PV Förderung", text)], "candidate_id string, title string, text string")).first()
    assert row.policy_area == "other" and row.instrument_type == "subsidy_funding_program"
    assert row.target_sectors == ["households"] and row.climate_dimension == "unspecified"
    assert row.funding_available and row.baseline_keywords == ["förderung", "haushalt", "zuschuss"]
    assert row.confidence_score == pytest.approx(0.5) and row.measure_title == "Balkon-PV Förderung"
    assert row.governance_type == "local_municipality" and row.keyword_hit


def test_baseline_repeated_sector_and_silent_later_rules(spark):
    row = classify.baseline_labels(spark.createDataFrame(
        [("c", "", "klimaplan sanierung eigenheim bürger")], "candidate_id string, title string, snippet string")).first()
    assert row.policy_area == "cross_sectoral" and row.target_sectors == ["households", "households"]
    assert "sanierung" not in row.baseline_keywords and row.measure_title == "klimaplan sanierung eigenheim bürger"


@pytest.mark.parametrize("text, want", [
    ("Die Stadt fördert Balkonkraftwerke mit einem Zuschuss von 100 Euro pro Haushalt.", True),
    ("kosten 100 € budget", False), ("beschluss zur sanierung", True), ("beschluss gefasst", False), ("pflicht", True),
    ("mittelüber 5 euro", False), (None, False), ("", False), ("5 mio. mittel", True), ("x mio.y mittel", True),
])
def test_evidence(spark, text, want):
    assert one(spark, gate.has_evidence("t"), t=("string", text)) is want


def test_declared_evidence(spark):
    got = one(spark, gate.declared_evidence("t"), t=("string", "Die Förderung beträgt 5 Euro, Beschluss in  Kraft"))
    assert got == ["resolution", "funded_amount", "in_force"]


RULES = KeywordRules.from_mapping({
    "general": {"positive": ["klimaschutz", "klimaplan"], "negative": ["karriere"]},
    "thematic": {
        "energy": {"include": ["energieberatung", "solar"], "exclude": ["stromausfall"]},
        "buildings": {"include": ["energieberatung"]}, "information_advice": {"include": ["energieberatung", "kampagne"]},
        "waste": {"include": ["abfall"]},
    },
})


def test_keyword_score(spark):
    df = spark.createDataFrame([("Klimaschutz und Energieberatung",), ("klimaschutz karriere solar",)], "t string")
    a, b = with_keyword_score(df, "t", RULES).orderBy(F.col("t").desc()).collect()[::-1]
    assert a.keyword_hits_general == ["klimaschutz"]
    assert a.keyword_hits_thematic == {k: ["energieberatung"] for k in ("energy", "buildings", "information_advice")}
    assert a.passes_filter and a.confidence_score == pytest.approx(0.1 + 0.05 * 4)
    assert not b.passes_filter and b.keyword_negative_hits.general == ["karriere"]


def test_rules_from_table_equal_rules_from_mapping(spark):
    rows = [("general", "positive", t) for t in RULES.positive] + [("general", "negative", t) for t in RULES.negative]
    rows += [(g, p, t) for g, th in RULES.themes.items() for p, ts in (("include", th.include), ("exclude", th.exclude)) for t in ts]
    got = KeywordRules.from_table(spark.createDataFrame(rows, "group string, polarity string, term string"))
    assert got.positive == RULES.positive and got.themes == RULES.themes and got.negative == RULES.negative


def classified(spark, text, title="", url="", config=classify.FilterConfig()):
    df = spark.createDataFrame([(text, title, url)], "text string, title string, url string")
    return classify.classify_documents(df, config).first()


def test_classification_cascade(spark):
    long = "x" * 500
    assert classified(spark, None).reason == "empty_text"
    short = classified(spark, "klima " * 83)
    assert (short.reason, short.doc_type, short.strong_hits) == ("too_short", "noise", 0)
    nav = classified(spark, long + " klimaschutz klima energie", "Startseite")
    assert (nav.doc_type, nav.reason, nav.strong_hits) == ("info_navigation", "navigation_page", 0)
    signal = classified(spark, long + " klimaschutz energie")
    assert (signal.strong_hits, signal.supporting_hits, signal.doc_type) == (2, 1, "policy_measure")
    assert signal.reason == "climate_plus_funding_signal" and signal.is_policy_relevant
    assert classified(spark, long + " klimaschutz").reason == "too_weak_climate_signal"
    assert classified(spark, long, url="https://x/energie/a").reason == "navigation_page"
    assert classified(spark, long, "Newsletter").reason == "news_or_press"
    assert classified(spark, long, "Notruf").reason == "negative_title_terms"
    assert classified(spark, long, url="https://facebook.com/x").reason == "negative_url_fragment"
    strict = classify.FilterConfig(require_funding_term=True)
    assert classified(spark, long + " klimaschutz energie", config=strict).reason == "no_funding_signal"
    assert classified(spark, long + " klimaschutz energie", "Förderung", config=strict).is_policy_relevant
    typed = classify.FilterConfig(measure_terms=["programm"], admin_terms=["satzung"], framework_terms=["konzept"])
    body = long + " klimaschutz energie "
    assert classified(spark, body + "programm", config=typed).reason == "measure_terms_dominate"
    assert classified(spark, body + "programm", "Satzung", config=typed).doc_type == "policy_admin"
    assert classified(spark, body, "Konzept", config=typed).doc_type == "policy_framework"
    assert classified(spark, body + "konzept konzept programm", config=typed).doc_type == "policy_framework"
    assert classified(spark, long, "Impressum", config=classify.FilterConfig(imprint_title_terms=["impressum"])).doc_type == "legal_imprint"


def test_nested_terms_count_twice(spark):
    assert one(spark, count_occurrences("t", ["klima", "klimaschutz", "aa"]), t=("string", "klimaschutz aaaaa")) == 4


def test_sentence_packing(spark):
    long = "Dies ist ein Satz, der ganz bestimmt laenger als vierzig Zeichen ist."
    text = f"Erster Satz. Zweiter Satz ist laenger! Dritter? Vierter Satz hier. {long} Fuenf."
    got = one(spark, T.sentence_packs("t", 40), t=("string", text))
    assert got == ["Erster Satz. Zweiter Satz ist laenger!", "Dritter? Vierter Satz hier.", long, "Fuenf."]


def test_paragraphs_and_spaces(spark):
    assert one(spark, T.paragraphs("t"), t=("string", " a\xa0b\n \t\n\x1c\n\nc  d \n e\n\n")) == ["a b", "c d e"]
    assert one(spark, T.snippets("t"), t=("string", None)) == []
    assert one(spark, T.collapse_spaces("t"), t=("string", "\x1fa\x85 b　")) == "a b"
    assert one(spark, T.strip("t"), t=("string", "  x y\x1e\n")) == "x y"


def test_post_gate(spark):
    rows = [(1, 0.84, "pflicht", False), (1, 0.85, "pflicht", False), (1, 0.99, "nix", False), (0, 0.59, "", False),
            (0, 0.6, "", False), (1, 0.99, "pflicht", True), (None, 0.99, "pflicht", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, pred_label int, confidence double, t string, abstained boolean")
    out = [(r.pred_label, r.abstained) for r in gate.post_gate(df, "t", 0.85, 0.6).orderBy("i").collect()]
    assert out == [(None, True), (1, False), (None, True), (None, True), (0, False), (1, True), (None, False)]


def metric_rows(spark, rows):
    return spark.createDataFrame(rows, "gold_label int, pred_label int, abstained boolean")


def test_published_metrics(spark):
    rows = [(1, 1, False)] * 3 + [(0, 0, False)] * 23 + [(0, 1, False)] * 18 + [(0, None, True)]
    m = gate.gate_metrics(metric_rows(spark, rows)).first()
    assert (m.n_total, m.n_classified, m.n_abstain, m.tp, m.tn, m.fp, m.fn) == (45, 44, 1, 3, 23, 18, 0)
    got = [round(x, 4) for x in (m.coverage, m.precision, m.recall, m.f1, m.recall_overall, m.accuracy_classified)]
    assert got == [0.9778, 0.1429, 1.0, 0.25, 1.0, 0.5909]


def test_post_gated_metrics_of_the_published_table(spark):
    for tp, coverage, precision, overall in ((1, 0.5333, 1.0, 0.3333), (0, 0.5111, 0.0, 0.0)):
        rows = [(1, 1, False)] * tp + [(0, 0, False)] * 23 + [(1, None, True)] * (3 - tp) + [(0, None, True)] * 19
        m = gate.gate_metrics(metric_rows(spark, rows)).first()
        assert round(m.coverage, 4) == coverage and m.precision == precision and round(m.recall_overall, 4) == overall


def test_confusion_metrics(spark):
    df = spark.createDataFrame([(6, 140, 1, 3), (2, 110, 31, 7)], "tp int, tn int, fp int, fn int")
    a, b = gate.metrics_from_confusion(df).orderBy(F.col("tp").desc()).collect()
    assert round(a.precision, 4) == 0.8571 and round(a.recall, 4) == 0.6667 and round(a.accuracy, 4) == 0.9733
    assert round(b.precision, 4) == 0.0606 and round(b.recall, 4) == 0.2222


def test_nothing_classified(spark):
    m = gate.gate_metrics(metric_rows(spark, [(1, None, True), (0, None, True)])).first()
    assert (m.coverage, m.precision, m.recall, m.f1, m.accuracy_classified, m.pos_total) == (0, 0, 0, 0, 0, 1)


def test_confidence_buckets_and_median(spark):
    values = [-0.1, 0.0, 0.2, 0.8, 1.0, 1.005, 1.01]
    df = spark.createDataFrame([(v,) for v in values], "confidence_score double")
    got = {r.bucket: r.n for r in profile.confidence_buckets(df).collect()}
    assert got == {"[0.00,0.20)": 1, "[0.20,0.40)": 1, "[0.40,0.60)": 0, "[0.60,0.80)": 0, "[0.80,1.00]": 3}
    assert sum(r.pct for r in profile.confidence_buckets(df).collect()) == pytest.approx(500 / 7)
    four = spark.createDataFrame([(v,) for v in (0.4, 0.1, 0.3, 0.2)], "v double")
    assert ordinals.upper_median(four, "v").first()[0] == 0.3


def test_label_parsing(spark):
    parse = X.parse_label("v", "enum", "policy_area")
    assert col_of(spark, ["Energy & Buildings", "ENERGY-BUILDINGS", " energy / buildings", "xx", " ", None], parse) == [
        "energy_buildings"] * 3 + [None] * 3
    got = col_of(spark, ["Households & Residents; Businesses / Industry,households_residents,xx", None],
                 X.parse_label_text("v", "enum", "target_sector"))
    assert got == [["households_residents", "businesses_industry"], []]
    assert col_of(spark, ["Förderung", "standard", "other", "xyz", " REGULATION "], X.instrument_from_alias("v")) == [
        "financial_incentive", "regulation", "information_outreach", None, "regulation"]


def mapped(spark, answer):
    df = spark.createDataFrame([(answer,)], "a string").withColumn("j", M.first_json_object("a"))
    none = F.lit(None).cast("string")
    return M.with_mapped_answer(df, "j", F.lit("text"), F.lit("title"), none, none).first()


def test_response_aliases(spark):
    row = mapped(spark, '{"policy_field":"energy"}')
    assert row.policy_area == "energy" and row.confidence_score == 0.0 and row.title == "title" and row.snippet == "text"
    assert mapped(spark, '{"policy_area":null,"policy_field":"energy"}').policy_area is None
    assert mapped(spark, '{"confidence_score":null,"classification_confidence":0.7}').confidence_score == 0.7


@pytest.mark.parametrize("answer, want", [
    ('text {"a":"}"} tail {', '{"a":"}"}'), ("no json", "{}"), ("[1]", "{}"), ('{"a": 1}', '{"a": 1}'), (None, "{}"),
    ('x {"a": {"b": "\\"}"}} y', '{"a": {"b": "\\"}"}}'), ("{bad} {\"a\":1}", "{}"), ('{"open": 1', "{}"),
])
def test_first_json_object(spark, answer, want):
    assert one(spark, M.first_json_object("a"), a=("string", answer)) == want


def test_gate_answers(spark):
    rows = ['{"label": 1, "confidence": 0.9, "rationale": "ok\\nx"}', "nothing", 'a {"label": 1} b', '{"label": null}', "{x}"]
    got = [(r["label"], r["confidence"], r["rationale"]) for r in col_of(spark, rows, M.gate_answer("v"))]
    assert got == [(1, 0.9, "ok\nx"), (-1, 0.0, "parse_error"), (1, 0.0, ""), (-1, 0.0, "parse_error"), (-1, 0.0, "parse_error")]


def test_primary_rule(spark):
    df = spark.createDataFrame([(0, -1, 0.9), (1, 2, 0.9), (2, 1, 0.59), (3, 1, 0.6)], "i int, l int, c double")
    pred, abstained = gate.primary_decision("l", "c", 0.6)
    rows = df.select("i", pred.alias("p"), abstained.alias("a")).orderBy("i").collect()
    assert [(r.p, r.a) for r in rows] == [(None, True), (0, False), (None, True), (1, False)]


@pytest.mark.parametrize("page, want", [
    ("<form></form>", "ONLINE_FORM"), ('<a href="x.PDF">f</a>', "PDF_DOWNLOAD"), ('<a href="mailto:a@b">m</a>', "CONTACT_ONLY"),
    ("<p>x</p>", "UNKNOWN"), ("<noscript><form></form></noscript>", "UNKNOWN"),
])
def test_page_features(spark, page, want):
    df = spark.createDataFrame([(page, "https://a.de/")], "h string, u string").select(
        H.page_parts("h", "u", ["has_form", "has_pdf_download", "has_contact_email"]).alias("p")).select("p.*")
    assert df.select(H.digitalization_level("has_form", "has_pdf_download", "has_contact_email")).first()[0] == want


def test_candidate_ids(spark):
    good, bad = "programm " * 20, "kurz"
    text = f"{good}\n\n{bad}\n\n{good}"
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    assert sorted(r[0] for r in snippets.snippet_candidates(df).select("candidate_id").collect()) == ["unknown::d::p0", "unknown::d::p1"]


def test_document_without_id_gets_a_content_id(spark):
    df = spark.createDataFrame([("u", "programm " * 20)], "url string, text string")
    a = snippets.snippet_candidates(df).first().candidate_id
    assert a == snippets.snippet_candidates(df.repartition(3)).first().candidate_id and a.startswith("unknown::doc")


def test_last_document_wins(spark):
    docs = spark.createDataFrame([("m", "d", "old", 1), ("m", "d", "new", 2)], "municipality_id string, document_id string, title string, ord int")
    measures = spark.createDataFrame([("m", "d", 1), ("m", "d", 2), (None, "d", 3)], "municipality_id string, document_id string, ord int")
    munis = spark.createDataFrame([("m", "Name", 1)], "municipality_id string, name string, ord int")
    rows = export.analysis_table(measures, docs, munis, "s").orderBy("measure_local_id").collect()
    assert [(r.measure_uid, r.document_title, r.municipality_name) for r in rows] == [
        ("s::m::d::0", "new", "Name"), ("s::m::d::1", "new", "Name")]
    assert rows[0].policy_area == "unspecified" and rows[0].target_sectors == [] and rows[0].label_source == "baseline_rules_v1"


@pytest.mark.parametrize("values, kind, want", [
    (["yes", "No", "maybe"], "string", [1, 0, None]), (["1", "0.6", "x"], "string", [1, 1, None]),
    ([True, False], "boolean", [1, 0]), ([0.5, 1.5, 2.5], "double", [0, 2, 2]),
])
def test_binary_labels(spark, values, kind, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    assert [r.y for r in report.with_binary_label(df, "v", "y").orderBy("i").collect()] == want


def test_ndjson_lines(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("  ",), ("not json",), ("[1]",), ('{"a": ',)], "value string")
    assert [r.a for r in parse_lines(lines, "a int").collect()] == [1]
    flagged = parse_lines(lines, "a int", keep_broken=True)
    assert flagged.count() == 4 and flagged.where("_broken").count() == 3


def test_weak_filter(spark):
    rows = [(1, 3.0), (1, 2.0), (0, 0.0), (0, 1.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "rule_label int, rule_score double")
    assert sorted((r.rule_label, r.rule_score) for r in confident_weak_labels(df).collect()) == [(0, 0.0), (1, 3.0)]
    assert confident_weak_labels(df.drop("rule_score")).count() == 4


def test_two_decimals(spark):
    assert col_of(spark, [0.126, float("nan"), None, float("inf")], gate.two_decimals("v"), "double") == ["0.13", "", "", ""]


def test_operating_point_defaults(spark):
    row = gate.operating_points(spark.createDataFrame([("a", 5)], "s string, n int"), "s").first()
    assert (row.n_total, row.n_classified, row.tp) == (5, 5, 0) and row.coverage != row.coverage


def test_missing_gold_text_fails(spark):
    p = spark.createDataFrame([("1",), ("2",)], "candidate_id string")
    g = spark.createDataFrame([(1, "t")], "candidate_id int, txt string")
    with pytest.raises(Exception, match="prediction without gold text"):
        joins.with_gold_text(p, g, "txt").collect()


def test_align_by_position(spark):
    df = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "x array<int>, y array<string>")
    got = df.select(joins.align_by_position("x", "y").alias("r")).first().r
    assert [tuple(p) for p in got] == [(1, "a"), (2, "b")]


def test_label_bundle_debug(spark):
    df = spark.createDataFrame([("Energy-Buildings", ["businesses_industry", "?"])], "policy_area string, target_sectors array<string>")
    row = X.label_bundle(df, debug=True).first()
    assert row.policy_area == "ENERGY_BUILDINGS" and row.target_sectors == ["BUSINESSES_INDUSTRY"] and row.funding_available is None
