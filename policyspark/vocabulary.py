"""Term lists, taxonomies, patterns and column orders.

Everything here is data that has to match existing data sets for results to
be comparable. No operator hard-codes one of these lists; each takes its terms
as a parameter and only defaults to the values below.
"""

from __future__ import annotations

# --- fixed values: document filter terms ------------------------------------
STRONG_TERMS = [
    "klima", "klimaschutz", "klimaneutral", "klimaneutralität", "klimaplan",
    "klimaanpassung", "treibhausgas", "co2", "wärmeplan", "wärmeplanung",
]
SUPPORTING_TERMS = [
    "energie", "heizung", "wärme", "solar", "photovoltaik", "pv-", "fernwärme",
    "dämmung", "sanierung", "emission", "förderprogramm", "förderung",
    "fördermittel", "zuschuss", "zuwendung", "bezuschusst", "nachhaltig",
]
NEGATIVE_TITLE_TERMS = [
    "datenschutzerklärung", "datenschutz", "impressum", "barrierefreiheit",
    "erklärung zur barrierefreiheit", "leichte sprache", "gebärdensprache",
    "hilfe", "onlineantrag", "meine onlineanträge", "kontakt", "karriere",
    "stellenportal", "jobs", "newsletter", "wetter", "stadtplan", "notruf",
]
NEGATIVE_URL_FRAGMENTS = ["facebook.com/", "youtube.com/", "instagram.com/"]
FUNDING_TERMS = [
    "förderprogramm", "förderprogramme", "förderung", "förderungen",
    "fördermittel", "zuschuss", "zuschüsse", "zuwendung", "zuwendungen",
    "bezuschusst", "bezuschussung", "förderantrag", "antragstellung",
    "richtlinie", "förderrichtlinie",
]
NAVIGATION_TITLE_TERMS = [
    "startseite", "stadt & rathaus", "stadt und rathaus", "stadtverwaltung",
    "ämter und dienststellen", "terminvereinbarung", "virtuelles amt",
    "verwaltung und stadtpolitik", "stadtfinanzen", "gemeinderat",
    "bürgermeisterinnen und bürgermeister", "verkehr und mobilität",
    "bekanntmachungen", "serviceleistungen", "bürgerdienste",
    "veranstaltungskalender", "veranstaltungen", "eventkalender", "kalender",
    "team sauberes karlsruhe", "sperrmüll", "weiße ware", "strom für münchen",
    "strom, erdgas/gas, fernwärme, wasser", "günstiger ökstrom",
    "strom für ihre wohnung",
]
NAVIGATION_URL_FRAGMENTS = [
    "/rathaus", "/stadt-rathaus", "/stadtverwaltung", "/verwaltung", "/aemter",
    "/aemter-und-dienststellen", "/stadtfinanzen", "/gemeinderat", "/verkehr",
    "/mobilitaet", "/m-strom", "/strom", "/erdgas", "/fernwaerme",
    "/fernwärme", "/energie",
]
NEWS_TITLE_TERMS = [
    "pressemitteilung", "presseinformation", "presse-info", "aktuell",
    "neuigkeiten", "nachrichten", "news",
]
NEWS_URL_FRAGMENTS = ["/presse", "/news", "/aktuell", "/aktuelles", "/nachrichten"]

# --- fixed values: snippet acceptance ---------------------------------------
MIN_SNIPPET_CHARS = 150
MAX_SNIPPET_CHARS = 900
SNIPPET_POSITIVE = [
    "förderprogramm", "förderung", "zuschuss", "zuschüsse", "zuwendung",
    "fördermittel", "förderantrag", "förderfäh", "förderfähig", "bezuschusst",
    "fördertopf", "zuwendungsrichtlinie", "förderbedingungen",
    "programm", "aktionsprogramm", "maßnahme", "maßnahmenpaket",
    "maßnahmenprogramm", "klimaschutzkonzept",
    "energie- und klimaschutzkonzept", "informationskampagne", "kampagne",
    "aktionsplan", "aktionsplan klima", "strategie", "strategiekonzept",
    "kommunale wärmeplanung", "wärmeplanung", "solaroffensive",
    "solarinitiative", "sanierungsprogramm", "sanierungsförderung",
    "energieberatung", "klimaberatung", "beratung und förderung",
    "die stadt fördert", "die stadt unterstützt", "es wird gefördert",
    "förderfähig sind", "sie können einen antrag stellen",
    "anträge können gestellt werden", "es besteht die möglichkeit",
]
SNIPPET_NEGATIVE = [
    "sitemap", "startseite", "impressum", "datenschutz", "cookie",
    "barrierefreiheit", "navigation", "breadcrumb", "hauptmenü",
    "seiteninhalte", "zur übersicht", "zurück zur startseite",
    "kontaktformular", "copyright", "bildnachweis", "direkt zu",
    "alle filter zurücksetzen", "menü stadt & rathaus", "menü eservice",
    "hauptregion der seite anspringen",
    "eservice – ihr anliegen bequem online erledigen", "virtuelles amt",
    "online-zulassung über i-kfz", "meldebescheinigung",
    "wohnsitz elektronisch anmelden",
    "januar 20", "februar 20", "märz 20", "april 20", "mai 20", "juni 20",
    "juli 20", "august 20", "september 20", "oktober 20", "november 20",
    "dezember 20",
]

# --- fixed values: baseline label rules (ordered, first match wins) ----------
BASELINE_AREA_RULES = [
    ("cross_sectoral", ["klimaschutzkonzept", "klimaplan", "klimaaktionsplan"]),
    ("buildings", ["gebaeude", "gebäude", "heizung", "sanierung"]),
    ("energy_supply", ["strom", "waerme", "wärme", "energieversorgung", "fernwärme", "fernwaerme"]),
    ("mobility", ["verkehr", "mobilitaet", "mobilität", "radverkehr", "fahrrad"]),
    ("adaptation", ["anpassung", "hitzeaktionsplan", "hochwasser", "klimaanpassung"]),
    ("waste", ["abfall", "muell", "müll", "recycling"]),
]
BASELINE_INSTRUMENT_RULES = [
    ("strategy_plan", ["klimaschutzkonzept", "klimaplan", "leitbild", "strategie"]),
    ("regulation_standard", ["satzung", "pflicht", "verordnung", "bauordnung"]),
    ("investment_infrastructure", ["bau", "umbau", "infrastruktur", "radweg", "ladestation"]),
    ("subsidy_funding_program", ["foerderprogramm", "förderprogramm", "zuschuss", "förderung"]),
    ("information_advice", ["beratung", "kampagne", "informationsangebot", "infoveranstaltung"]),
    ("public_procurement", ["vergab", "beschaffung", "ausschreibung"]),
]
BASELINE_SECTOR_RULES = [
    ("municipal_buildings", ["rathaus", "staedtische gebaeude", "städtische gebäude", "kommunale gebäude"]),
    ("households", ["wohngebaeude", "wohngebäude", "eigenheim", "mietshaus"]),
    ("transport", ["verkehr", "auto", "radverkehr", "oepnv", "öpnv", "bus", "bahn"]),
    ("industry", ["industrie", "gewerbegebiet", "gewerbe"]),
    ("households", ["haushalt", "privathaushalt", "bürger", "bürgerinnen"]),
]
BASELINE_MITIGATION_TERMS = ["co2", "treibhausgas", "emission", "einsparung", "klimaschutz"]
BASELINE_ADAPTATION_TERMS = ["anpassung", "hitze", "hochwasser", "regenwassermanagement", "resilienz"]
BASELINE_FUNDING_TERMS = ["foerderung", "förderung", "zuschuss", "förderprogramm", "foerderprogramm"]
BASELINE_LABEL_SOURCE = "baseline_rules_v1"

# --- fixed values: evidence patterns ----------------------------------------
EVIDENCE_WORDS = {
    "money": r"\b(euro|€|million|mio\.?|tausend)\b",
    "funding": r"\b(förder|förderung|förderprogramm|zuschuss|budget|haushalt|mittel)\b",
    "legal": r"\b(satzung|verordnung|richtlinie|pflicht|verpflichtend)\b",
    "decision": r"\b(beschluss|stadtratsbeschluss|gemeinderatsbeschluss|beschlossen|verabschiedet)\b",
    "implementation": r"\b(ausschreibung|vergabe|beauftragt|auftrag|bau|gebaut|sanierung|modernisierung"
                      r"|errichtet|inbetriebnahme|eingeführt|umgesetzt)\b",
}
DECLARED_EVIDENCE_PATTERNS = {
    "resolution": r"\b(beschluss|stadtratsbeschluss|gemeinderatsbeschluss|beschlossen)\b",
    "legal_basis": r"\b(satzung|verordnung|richtlinie|pflicht|verpflichtend)\b",
    "funded_amount": r"\b(gefördert|förderung|förderprogramm)\b.*\b(euro|€|million|tausend)\b",
    "budget_amount": r"\b(mittel|budget|haushalt)\b.*\b(euro|€|million|tausend)\b",
    "tender": r"\b(ausschreibung|vergabe|beauftragt|auftrag)\b",
    "construction": r"\b(bau|gebaut|umbau|sanierung|modernisierung|errichtet|inbetriebnahme)\b",
    "in_force": r"\b(umgesetzt|implementiert|in\s+kraft|inbetriebnahme)\b",
    "grant": r"\b(fördermittel|zuschuss|zuschüsse|bewilligt|bewilligung)\b",
    "provision": r"\b(stellt|stellt\s+.*\s+bereit|bereitgestellt)\b.*\b(mittel|budget|haushalt|förderung)\b",
    "membership": r"\b(beigetreten|mitglied|mitgliedschaft)\b.*\b(arbeitsgemeinschaft|netzwerk|verbund)\b",
}

# --- fixed values: links and assets -----------------------------------------
SEED_KEYWORDS = [
    "klima", "klimaschutz", "klimaneutral", "klimaneutralität", "energie",
    "strom", "wärme", "heizung", "heizungs", "sanierung", "umwelt", "nachhalt",
    "mobilität", "e-mobilität", "emobilität", "solar", "photovoltaik", "pv",
    "wind", "fernwärme", "foerder", "förder", "foerderprogramm",
    "förderprogramm", "zuschuss",
]
SEED_EXCLUDED_EXTENSIONS = [
    "pdf", "jpg", "jpeg", "png", "gif", "svg", "mp4", "mp3", "zip", "doc",
    "docx", "xls", "xlsx",
]
CRAWL_EXCLUDED_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "webp", "svg", "mp4", "zip", "doc", "docx",
    "xls", "xlsx",
]

# --- fixed values: taxonomies, scheme -> dimension -> allowed ids ------------
TAXONOMIES = {
    "baseline": {
        "policy_area": ["cross_sectoral", "buildings", "energy_supply", "mobility", "industry",
                        "waste", "land_use", "adaptation", "other"],
        "instrument_type": ["strategy_plan", "regulation_standard", "investment_infrastructure",
                            "subsidy_funding_program", "information_advice", "public_procurement", "other"],
        "target_sector": ["municipal_buildings", "private_buildings", "transport", "industry",
                          "households", "cross_sectoral", "other"],
        "climate_dimension": ["mitigation", "adaptation", "both", "unspecified"],
        "governance_type": ["local_municipality", "regional_state", "national", "eu", "multi_level"],
    },
    "enum": {
        "policy_area": ["energy_buildings", "mobility_transport", "land_use_urban_planning",
                        "waste_circular_economy", "industry_commerce_services", "agriculture_forestry",
                        "climate_adaptation_resilience", "cross_sector_governance", "other"],
        "instrument_type": ["regulation_standard", "economic_incentive", "information_education",
                            "planning_strategy", "infrastructure_investment",
                            "public_procurement_operations", "voluntary_agreement_partnership", "other"],
        "target_sector": ["households_residents", "businesses_industry", "transport_operators",
                          "public_sector_municipal", "public_sector_other", "agriculture_forestry",
                          "civil_society_ngos", "multiple_general_public"],
        "climate_dimension": ["mitigation", "adaptation", "both", "not_directly_climate"],
        "governance_type": ["own_operations", "regulator", "enabler_supporter", "coordinator_networker",
                            "participation_coproduction", "implementation_higher_level", "other"],
        "funding_available": ["true", "false", "unknown"],
    },
    "canonical": {
        "policy_area": ["buildings", "energy_supply", "transport_mobility", "industry_commerce",
                        "households", "agriculture_land_use", "cross_sectoral", "climate_adaptation"],
        "instrument_type": ["financial_incentive", "regulation", "strategy", "administrative",
                            "advisory_service", "information_outreach", "reporting_monitoring"],
        "jurisdiction_level": ["eu", "federal", "state", "local"],
        "target_sector": ["private_households", "enterprises", "public_admin", "ngos_civil_society",
                          "energy_suppliers", "agriculture", "transport_users", "other"],
        "climate_dimension": ["mitigation", "adaptation", "cross_cutting", "unspecified"],
        "governance_type": ["legally_binding", "political_commitment", "administrative_directive",
                            "voluntary", "incentive_based", "unspecified"],
    },
    "measure_v1": {
        "document_type": ["council_minutes", "statute", "funding_guideline", "climate_concept",
                          "press_release", "website_page", "report", "other"],
        "policy_area": ["energy_buildings", "renewable_energy", "mobility_transport", "urban_planning",
                        "adaptation_resilience", "waste_circular", "public_procurement",
                        "information_education", "governance", "other"],
        "instrument_type": ["subsidy", "tax_incentive", "regulation", "standard",
                            "infrastructure_investment", "service", "information_campaign",
                            "planning_instrument", "voluntary_agreement", "other"],
        "instrument_subtype": ["grant", "low_interest_loan", "rebate", "tax_reduction", "fee_exemption",
                               "pilot_project", "consultation", "awareness_campaign", "ordinance",
                               "guideline", "other"],
        "target_sector": ["households", "enterprises", "public_sector", "transport", "agriculture",
                          "cross_sectoral", "other"],
        "target_group": ["homeowners", "tenants", "sme", "large_enterprises", "associations", "schools",
                         "municipal_admin", "general_public"],
        "climate_dimension": ["mitigation", "adaptation", "both", "unclear"],
        "funding_level": ["eu", "national", "regional", "local", "private", "mixed"],
        "label_source": ["gold", "heuristic", "llm", "mixed", "unknown"],
        "quality_flag": ["ok", "needs_review", "rejected"],
    },
    "gate": {
        "policy_field": ["energy", "buildings", "mobility", "industry", "agriculture", "waste",
                         "land_use", "adaptation", "governance", "cross_sector"],
        "measure_type": ["regulation", "subsidy", "taxation_fee", "information", "infrastructure",
                         "planning_strategy", "public_procurement", "research_innovation",
                         "voluntary_agreement", "monitoring_reporting", "other"],
        "target_group": ["citizens", "companies", "public_administration", "agriculture_actors",
                         "utilities_grid", "transport_operators", "construction_real_estate",
                         "education_research", "cross_group"],
        "jurisdiction_level": ["eu", "federal", "state", "municipal", "district_county",
                               "public_entity_other"],
    },
    "annotation": {
        "is_policy_relevant": ["yes", "no", "uncertain"],
        "policy_scope": ["city_strategy", "city_sectoral_plan", "project_or_measure",
                         "advisory_or_information", "other", "unknown"],
        "instrument_type": ["regulation", "strategic_plan", "subsidy_or_funding",
                            "information_or_campaign", "infrastructure_investment",
                            "agreement_or_partnership", "administrative_procedure", "other", "unknown"],
        "sector": ["cross_sector", "buildings", "energy", "transport", "land_use", "waste", "industry",
                   "adaptation", "other", "unknown"],
        "target_group": ["municipal_admin", "citizens", "businesses", "civil_society",
                         "other_public_authorities", "multiple", "unknown"],
        "implementation_status": ["idea_or_vision", "in_planning", "adopted", "under_implementation",
                                  "completed", "unknown"],
        "policy_strength": ["weak", "medium", "strong", "unknown"],
        "digitalization_level": ["offline_or_analog", "info_only", "downloadable_pdf_form",
                                 "online_form_or_portal", "mixed", "unknown"],
        "governance_level_reference": ["municipal_only", "state_level", "federal_level", "eu_level",
                                       "multiple", "unknown"],
        "is_electromobility_related": ["yes", "no", "uncertain"],
        "doc_type": ["website_page", "pdf_report_or_study", "council_minutes_or_resolution",
                     "statute_or_regulation_document", "application_form", "flyer_or_info_brochure",
                     "other", "unknown"],
    },
}
INSTRUMENT_ALIASES = {
    "subsidy": "financial_incentive",
    "förderung": "financial_incentive",
    "foerderung": "financial_incentive",
    "standard": "regulation",
    "regulation": "regulation",
    "other": "information_outreach",
}
BASELINE_FALLBACKS = {
    "policy_area": "other",
    "instrument_type": "other",
    "target_sector": "cross_sectoral",
    "climate_dimension": "unspecified",
    "governance_type": "local_municipality",
}
ANNOTATION_COLUMNS = [
    "is_policy_relevant", "policy_scope", "instrument_type", "sector", "target_group",
    "implementation_status", "policy_strength", "digitalization_level",
    "governance_level_reference", "is_electromobility_related", "doc_type", "notes",
]

# --- fixed values: free-text label heuristics of model output ----------------
# (needles, label or None when the label is outside the closed vocabulary)
INSTRUMENT_HEURISTICS = [
    (["förder", "zuschuss", "funding", "subsid"], None),
    (["strategie", "konzept", "plan"], None),
    (["gesetz", "satzung", "verordnung", "regulation"], "regulation_standard"),
    (["beschaffung", "procurement"], None),
    (["infrastruktur", "infrastructure"], None),
]
# the same needles with the intended vocabulary members filled in
INSTRUMENT_HEURISTICS_CORRECTED = [
    (["förder", "zuschuss", "funding", "subsid"], "economic_incentive"),
    (["strategie", "konzept", "plan"], "planning_strategy"),
    (["gesetz", "satzung", "verordnung", "regulation"], "regulation_standard"),
    (["beschaffung", "procurement"], "public_procurement_operations"),
    (["infrastruktur", "infrastructure"], "infrastructure_investment"),
]
SECTOR_HEURISTICS_CORRECTED = [
    (["house", "privat", "haushalt"], "households_residents"),
    (["kommunal", "municipal", "verwaltung"], "public_sector_municipal"),
    (["verkehr", "transport", "mobil"], "transport_operators"),
    (["industrie", "gewerbe", "wirtschaft"], "businesses_industry"),
    (["cross", "sektorübergreifend", "sektoruebergreifend"], "multiple_general_public"),
]
TRUE_WORDS = ["yes", "ja", "true", "1", "y"]
FALSE_WORDS = ["no", "nein", "false", "0", "n"]

# --- fixed values: column aliases and export orders --------------------------
TEXT_ALIASES = ["text_for_annotation", "text", "content", "paragraph", "snippet"]
ID_ALIASES = ["id", "doc_id", "document_id", "source_id"]
MUNICIPALITY_ALIASES = ["municipality_id", "municipality", "muni", "city_id", "city"]
PROFILE_FIELDS = [
    "policy_area", "instrument_type", "instrument_subtype", "target_sector", "climate_dimension",
    "funding_program_level", "digitalization_level", "confidence_score",
]
ANALYSIS_COLUMNS = [
    "scope", "country_code", "state_code", "municipality_id", "municipality_name",
    "measure_local_id", "measure_uid", "document_id", "source_url", "crawl_timestamp", "depth",
    "referrer_url", "http_status", "mime_type", "document_title", "measure_title", "text_excerpt",
    "policy_area", "instrument_type", "target_sectors", "climate_dimension", "governance_type",
    "funding_available", "label_source", "confidence_score", "extraction_version",
    "classification_version", "keyword_hit",
]
MEASURE_CSV_COLUMNS = [
    "municipality_id", "document_id", "source_url", "measure_title", "measure_type", "sector",
    "target_group", "amount_min", "amount_max", "application_mode", "digitalization_level",
    "extraction_mode", "baseline_keywords",
]
LABELING_COLUMNS = ["municipality", "document_id", "url", "title", "text", "mime_type"]
LABELING_EMPTY_COLUMNS = [
    "label_is_policy_relevant", "label_policy_scope", "label_instrument_type",
    "label_target_sector", "label_notes",
]
GOLD_COLUMNS = ["is_measure_gold", "measure_type_gold", "sector_gold", "comment_gold"]

# --- fixed values: prompt wording used by the gate ---------------------------
GATE_JSON_INSTRUCTIONS = (
    'Output JSON: {"label": 1|0|-1, "confidence": 0..1, "rationale": "..."} '
    "Use -1 if unsure. Keep rationale <= 20 words."
)
DEFAULT_PROMPT = "Return only a single JSON object for the given snippet."

# --- fixed values: digitalization indicators per level -----------------------
DIGITALIZATION_LEVELS = [
    {"id": 0, "name": "offline_only",
     "html_contains": ["<address", "mailto:"],
     "text_contains": ["bitte wenden Sie sich an das Rathaus", "nur persönlich im Amt",
                       "nur schriftlich beantragen", "persönlich im Bürgerbüro",
                       "telefonisch zu beantragen"]},
    {"id": 1, "name": "download_form",
     "url_suffix": [".pdf", ".doc", ".docx"],
     "text_contains": ["Antragsformular zum Download", "Formular als PDF", "Formular herunterladen",
                       "Antrag als Vordruck"],
     "html_contains": ["download", 'href="/media', 'href="/fileadmin']},
    {"id": 2, "name": "email_submission",
     "html_contains": ["mailto:"],
     "text_contains": ["ausgefülltes Formular per E-Mail senden", "Antrag per E-Mail einreichen",
                       "senden Sie den Antrag an", "Scan des unterschriebenen Antrags"],
     "url_suffix": [".pdf", ".doc", ".docx"]},
    {"id": 3, "name": "online_form_partial",
     "html_contains": ["<form", 'type="submit"', "online-dienst", "buergerportal",
                       "buerger-service-portal", "service-bw.de/leistung"],
     "text_contains": ["Online-Dienst", "Online-Service", "online beantragen",
                       "elektronisch beantragen", "Online-Formular"],
     "negative_text": ["anschließend ausdrucken und unterschreiben"]},
    {"id": 4, "name": "online_full_digital",
     "html_contains": ["eID", "bundid", "npa", "servicekonto", "openid-connect"],
     "text_contains": ["vollständig online beantragen", "ohne persönliches Erscheinen",
                       "elektronische Signatur", "Servicekonto erforderlich",
                       "Anmeldung mit BundID"],
     "url_contains": ["ozg", "serviceportal", "buergerportal", "onlinezugangsgesetz"]},
]

# --- fixed values: declared measure table ------------------------------------
# name -> (type, required); enum types name a dimension of the measure_v1 scheme
MEASURE_FIELDS = {
    "measure_id": ("string", True), "municipality_id": ("string", True),
    "municipality_name": ("string", False), "country_code": ("string", True),
    "state_code": ("string", False), "source_scope": ("string", True),
    "source_document_id": ("string", True), "source_document_type": ("enum:document_type", False),
    "source_url": ("string", False), "source_referrer_url": ("string", False),
    "crawl_timestamp": ("datetime", False), "extraction_method": ("string", False),
    "extraction_run_id": ("string", False), "title": ("string", False),
    "short_description": ("string", False), "snippet": ("string", True),
    "full_text_span_start": ("integer", False), "full_text_span_end": ("integer", False),
    "policy_area": ("enum:policy_area", True), "instrument_type": ("enum:instrument_type", True),
    "instrument_subtype": ("enum:instrument_subtype", False),
    "target_sector": ("enum:target_sector", False),
    "target_group": ("list:enum:target_group", False),
    "climate_dimension": ("enum:climate_dimension", False),
    "co2_reduction_estimate_t_per_year": ("number", False), "budget_total_eur": ("number", False),
    "subsidy_amount_min_eur": ("number", False), "subsidy_amount_max_eur": ("number", False),
    "subsidy_rate_percent": ("number", False), "implementation_start_date": ("date", False),
    "implementation_end_date": ("date", False), "application_deadline": ("date", False),
    "is_permanent_program": ("boolean", False), "responsible_unit": ("string", False),
    "cooperation_partners": ("list:string", False), "has_external_funding": ("boolean", False),
    "funding_program_level": ("enum:funding_level", False),
    "funding_program_code": ("string", False), "funding_program_name": ("string", False),
    "digitalization_level": ("integer", False), "digitalization_level_name": ("string", False),
    "label_source": ("enum:label_source", False), "labeler_id": ("string", False),
    "confidence_score": ("number", False), "quality_flag": ("enum:quality_flag", False),
    "created_at": ("datetime", False), "updated_at": ("datetime", False),
    "pipeline_version": ("string", False),
}

# --- fixed values: static sample municipalities ------------------------------
SAMPLE_MUNICIPALITIES = {
    "de_sample": [
        ("karlsruhe", "Stadt Karlsruhe", "Baden-Württemberg", "https://www.karlsruhe.de"),
        ("muenchen", "Landeshauptstadt München", "Bayern", "https://www.muenchen.de"),
    ],
}
SAMPLE_CONFIDENCE = 0.99
SAMPLE_RATIONALE = "Platzhalter: manuell gesetzt für de_sample."
SAMPLE_SOURCE = "manual_seed_de_sample"
