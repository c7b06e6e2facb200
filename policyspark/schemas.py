"""Record schemas of the stages (DDL)."""

MUNICIPALITY = (
    "municipality_id string, official_name string, name string, state string, base_url string, "
    "admin_level string, population int, confidence_domain string, llm_rationale_domain string, source string"
)
RAW_DOCUMENT = (
    "municipality_id string, document_id string, source_url string, referrer_url string, mime_type string, "
    "http_status int, raw_content string, raw_path string, crawl_timestamp string, keyword_hit boolean, depth int"
)
# status is a number or the word 'error', so it is read as text
CRAWL_INDEX = (
    "muni string, url string, depth int, status string, ct string, kept boolean, reason string, "
    "raw_path string, error string"
)
RAW_ANY = (
    "municipality_id string, muni string, document_id string, source_url string, url string, "
    "referrer_url string, mime_type string, ct string, http_status string, status string, "
    "raw_content string, raw_path string, crawl_timestamp string, keyword_hit boolean, depth int, "
    "kept boolean, reason string, error string"
)
EXTRACTED = (
    "municipality_id string, document_id string, url string, title string, text string, doc_kind string, "
    "mime_type string, http_status int, depth int, raw_path string, kept boolean"
)
CANDIDATE = (
    "candidate_id string, document_id string, municipality_id string, municipality string, title string, "
    "snippet string, url string, policy_area string, instrument_type string, target_sectors array<string>, "
    "climate_dimension string, governance_type string, funding_available boolean, keyword_hit boolean, "
    "confidence_score double, keyword_hits_general array<string>, "
    "keyword_hits_thematic map<string,array<string>>, "
    "keyword_negative_hits struct<general:array<string>,thematic:map<string,array<string>>>"
)
BASELINE_MEASURE = (
    "candidate_id string, municipality_id string, municipality string, document_id string, "
    "source_document_id string, source_url string, measure_title string, policy_area string, "
    "instrument_type string, target_sectors array<string>, climate_dimension string, governance_type string, "
    "funding_available boolean, baseline_keywords array<string>, keyword_hit boolean, label_source string, "
    "confidence_score double"
)
DISCOVERED_SEED = (
    "municipality_id string, base_url string, discovered_seeds array<string>, "
    "debug struct<anchor_texts:array<string>,scores:array<int>>"
)
GATE_OUTPUT = (
    "is_policy_measure boolean, relevance_confidence double, policy_field string, measure_type string, "
    "target_group string, jurisdiction_level string, classification_confidence double, short_title string, "
    "actor string, instrument string, rationale string, evidence_quotes array<string>"
)
PREDICTION = (
    "candidate_id string, gold_label int, pred_label int, abstained boolean, confidence double, "
    "rationale string, raw string"
)
