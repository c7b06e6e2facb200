"""Reading labeler answers: JSON recovery, alias mapping, defaults, prompts."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions.taxonomy import choices
from policyspark.functions.terms import any_term
from policyspark.functions.text import clamp_unit, col, first_filled, let, prefix, strip, to_number
from policyspark.vocabulary import (
    ANNOTATION_COLUMNS, DEFAULT_PROMPT, FALSE_WORDS, GATE_JSON_INSTRUCTIONS, INSTRUMENT_HEURISTICS,
    TRUE_WORDS,
)

MEASURE_TEXT_FIELDS = [
    "measure_id", "measure_title", "title", "description", "snippet", "source_url", "source_scope",
    "policy_area", "policy_field", "instrument_type", "measure_type", "instrument_subtype",
    "climate_dimension", "target_sector", "target_group", "digitalization_level",
    "funding_program_level", "jurisdiction_level", "funding_program_code", "label_source",
    "is_policy_measure", "confidence_score", "relevance_confidence", "classification_confidence",
    "short_title", "actor", "instrument", "rationale",
]
ANSWER_SCHEMA = (
    "struct<" + ",".join(f"{f}:string" for f in MEASURE_TEXT_FIELDS) + ",evidence_quotes:array<string>>"
)
ERROR_COLUMNS = [
    "policy_area", "instrument_type", "instrument_subtype", "climate_dimension", "target_sector",
    "digitalization_level", "funding_program_level", "funding_program_code", "is_policy_measure",
    "relevance_confidence", "policy_field", "measure_type", "target_group", "jurisdiction_level",
    "classification_confidence", "short_title", "actor", "instrument", "rationale",
]


def _recover_object(text: str | None) -> str:
    """The answer itself when it is JSON, else the object that starts at its first brace, else '{}'."""
    text = (text or "").strip()
    try:
        return text if isinstance(json.loads(text), dict) else "{}"
    except ValueError:
        pass
    start = text.find("{")
    if start < 0:
        return "{}"
    try:
        _, end = json.JSONDecoder().raw_decode(text, start)
        return text[start:end]
    except ValueError:
        return "{}"


def first_json_object(answer: Column | str) -> Column:
    """JSON text of the first object in an answer, '{}' when there is none.

    Clean flat objects are recognised in the JVM; Python only sees the rest.
    """
    @F.pandas_udf("string")
    def recover(batch: pd.Series) -> pd.Series:
        return batch.map(_recover_object)

    answer = col(answer)
    stripped = strip(answer)
    clean = stripped.rlike(r"^\{[^{}]*\}$") & F.try_parse_json(stripped).isNotNull()
    clean = F.coalesce(clean, F.lit(False))
    return F.when(clean, stripped).otherwise(recover(F.when(~clean, answer)))


def widest_json_object(answer: Column | str) -> Column:
    """From the first '{' to the last '}', null when there is no such range."""
    return F.nullif(F.regexp_extract(strip(answer), r"(?s)\{.*\}", 0), F.lit(""))


def gate_answer(answer: Column | str) -> Column:
    """struct<label, confidence, rationale> of a gate answer; label -1 when it cannot be parsed."""
    def parse(found: Column) -> Column:
        return F.struct(
            F.from_json(found, "struct<label:string,confidence:string,rationale:string>").alias("v"),
            F.coalesce(F.try_parse_json(found).isNotNull(), F.lit(False)).alias("ok"),
            F.coalesce(F.json_object_keys(found), F.array().cast("array<string>")).alias("keys"))

    def read(x: Column) -> Column:
        def has(key: str) -> Column:
            return F.array_contains(x["keys"], key)

        rationale = F.when(has("rationale"), F.coalesce(x["v"]["rationale"], F.lit("None"))).otherwise("")
        return F.struct(
            x["ok"].alias("ok"),
            F.when(has("label"), to_number(x["v"]["label"]).cast("int")).otherwise(-1).alias("label"),
            F.when(has("confidence"), to_number(x["v"]["confidence"])).otherwise(0.0).alias("confidence"),
            strip(rationale).alias("rationale"))

    def settle(r: Column) -> Column:
        fine = r["ok"] & r["label"].isNotNull() & r["confidence"].isNotNull()
        return F.struct(
            F.when(fine, r["label"]).otherwise(-1).alias("label"),
            F.when(fine, r["confidence"]).otherwise(0.0).alias("confidence"),
            F.when(fine, r["rationale"]).otherwise("parse_error").alias("rationale"))

    return let(widest_json_object(answer), lambda found: let(parse(found), lambda x: let(read(x), settle)))


def _aliased(answer: str, keys: Column, name: str, alias: str) -> Column:
    """The alias only counts when the key is absent; an explicit null stays null."""
    return F.when(F.array_contains(keys, name), F.col(f"{answer}.{name}")).otherwise(F.col(f"{answer}.{alias}"))


def with_mapped_answer(
    df: DataFrame, answer_json: str, text: Column | str, title: Column | str, url: Column | str,
    scope: Column | str, default_label_source: str = "llm",
) -> DataFrame:
    """Resolve schema drift of an answer object into the measure columns."""
    text, title, url, scope = col(text), col(title), col(url), col(scope)
    base = df.withColumns({
        "__text": text, "__title": title, "__url": url, "__scope": scope,
        "__answer": F.from_json(answer_json, ANSWER_SCHEMA),
        "__keys": F.coalesce(F.json_object_keys(answer_json), F.array().cast("array<string>")),
    })
    keys = F.col("__keys")

    def a(name: str) -> Column:
        return F.col(f"__answer.{name}")

    confidence = F.coalesce(
        to_number(a("confidence_score")), to_number(a("classification_confidence")),
        to_number(a("relevance_confidence")), F.lit(0.0),
    )
    mapped = {
        "measure_id": a("measure_id"),
        "title": first_filled(a("measure_title"), a("title"), F.col("__title")),
        "snippet": first_filled(a("description"), a("snippet"), prefix("__text", 300)),
        "source_url": first_filled(a("source_url"), F.col("__url")),
        "source_scope": F.coalesce(first_filled(a("source_scope")), F.col("__scope")),
        "policy_area": _aliased("__answer", keys, "policy_area", "policy_field"),
        "instrument_type": _aliased("__answer", keys, "instrument_type", "measure_type"),
        "instrument_subtype": a("instrument_subtype"),
        "climate_dimension": a("climate_dimension"),
        "target_sector": _aliased("__answer", keys, "target_sector", "target_group"),
        "digitalization_level": a("digitalization_level"),
        "funding_program_level": _aliased("__answer", keys, "funding_program_level", "jurisdiction_level"),
        "funding_program_code": a("funding_program_code"),
        "label_source": first_filled(a("label_source"), default=default_label_source),
        "confidence_score": confidence,
        "is_policy_measure": a("is_policy_measure").try_cast("boolean"),
        "relevance_confidence": to_number(a("relevance_confidence")),
        "classification_confidence": to_number(a("classification_confidence")),
        "actor": a("actor"), "instrument": a("instrument"), "rationale": a("rationale"),
        "evidence_quotes": a("evidence_quotes"),
    }
    return base.withColumns(mapped).drop("__text", "__title", "__url", "__scope", "__answer", "__keys")


def error_row_columns(text: Column | str, title: Column | str, url: Column | str, scope: Column | str,
                      label_source: str) -> dict[str, Column]:
    """Columns of a row without an answer; ``label_source`` says why."""
    out = {name: F.lit(None).cast("string") for name in ERROR_COLUMNS}
    for name in ("relevance_confidence", "classification_confidence"):
        out[name] = F.lit(None).cast("double")
    out.update({
        "measure_id": F.lit(None).cast("string"),
        "is_policy_measure": F.lit(None).cast("boolean"),
        "title": first_filled(title),
        "snippet": prefix(F.coalesce(col(text), F.lit("")), 300),
        "source_url": first_filled(url),
        "source_scope": col(scope),
        "confidence_score": F.lit(0.0),
        "evidence_quotes": F.lit(None).cast("array<string>"),
        "label_source": F.lit(label_source),
    })
    return out


# --- free-text label heuristics ----------------------------------------------

def _exact(c: Column, dimension: str) -> Column:
    key = F.lower(strip(c))
    return F.when(key.isin(choices("enum", dimension)), key)


def free_area(c: Column | str) -> Column:
    return F.coalesce(_exact(col(c), "policy_area"), F.lit("other"))


def free_instrument(c: Column | str, heuristics=None) -> Column:
    """Value match, else the first heuristic whose needle occurs, else 'other'."""
    c = col(c)
    lowered = F.lower(c)
    guess = F.when(F.coalesce(c, F.lit("")) == "", F.lit("other"))
    for needles, label in heuristics if heuristics is not None else INSTRUMENT_HEURISTICS:
        guess = guess.when(any_term(lowered, needles), F.lit(label).cast("string"))
    exact = _exact(c, "instrument_type")
    return F.when(exact.isNotNull(), exact).otherwise(guess.otherwise(F.lit("other")))


def free_member(c: Column | str, dimension: str) -> Column:
    """Value match or null (the fall-back members are outside the vocabulary)."""
    return _exact(col(c), dimension)


def free_sectors(labels: Column | str, heuristics=None) -> Column:
    """Distinct sectors of a list of free labels; unknown labels only map with ``heuristics``."""
    def one(value: Column) -> Column:
        guess = F.when(strip(value) == "", F.lit(None).cast("string"))
        guess = guess.when(_exact(value, "target_sector").isNotNull(), _exact(value, "target_sector"))
        for needles, label in heuristics or ():
            guess = guess.when(any_term(F.lower(value), needles), F.lit(label))
        return guess

    found = F.array_distinct(F.array_compact(F.transform(col(labels), one)))
    return F.coalesce(found, F.array().cast("array<string>"))


def funding_flag(c: Column | str) -> Column:
    word = F.lower(strip(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(False)


def normalised_measure(df: DataFrame, fallback_title: Column | str, corrected: bool = False) -> DataFrame:
    """Project an answer table onto the measure label columns."""
    from policyspark.vocabulary import INSTRUMENT_HEURISTICS_CORRECTED, SECTOR_HEURISTICS_CORRECTED

    present = set(df.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("string")

    sectors = F.when(first_filled(c("target_sector")).isNotNull(), F.array(c("target_sector")))
    if "target_sectors" in present:
        sectors = F.coalesce(sectors, F.col("target_sectors"))
    out = {
        "measure_title": first_filled(c("measure_title"), c("title"), fallback_title, default=""),
        "policy_area": free_area(c("policy_area")),
        "instrument_type": free_instrument(
            c("instrument_type"), INSTRUMENT_HEURISTICS_CORRECTED if corrected else INSTRUMENT_HEURISTICS),
        "target_sectors": free_sectors(sectors, SECTOR_HEURISTICS_CORRECTED if corrected else None),
        "climate_dimension": free_member(c("climate_dimension"), "climate_dimension"),
        "governance_type": free_member(c("governance_type"), "governance_type"),
        "funding_available": funding_flag(c("funding_available")),
        "confidence_score": clamp_unit(c("confidence_score")),
        "keyword_hit": F.coalesce(c("keyword_hit").try_cast("boolean"), F.lit(False)),
    }
    return df.withColumns(out)


# --- annotation labels and prompts -------------------------------------------

def annotation_defaults(labels: str, columns: Sequence[str] = tuple(ANNOTATION_COLUMNS)) -> dict[str, Column]:
    """Fill the gaps of a label struct/map column: '' notes, uncertain relevance, unknown otherwise."""
    fallback = {"notes": "", "is_policy_relevant": "uncertain"}
    return {
        c: F.coalesce(F.col(labels)[c].cast("string"), F.lit(fallback.get(c, "unknown"))) for c in columns
    }


def render_prompt(template: str, text: Column | str, title: Column | str, url: Column | str,
                  scope: Column | str) -> Column:
    """Fill {text} {title} {url} {scope}; a template with other braces gets the fields appended."""
    import string

    base = template.strip() or DEFAULT_PROMPT
    fields = {"text": col(text), "title": col(title), "url": col(url), "scope": col(scope)}
    fields = {k: F.coalesce(v, F.lit("")) for k, v in fields.items()}
    try:
        parts = list(string.Formatter().parse(base))
        plain = all(
            name is None or (name in fields and not spec and not conv) for _, name, spec, conv in parts
        )
    except ValueError:
        plain = False
    if plain:
        pieces = []
        for literal, name, _, _ in parts:
            if literal:
                pieces.append(F.lit(literal))
            if name is not None:
                pieces.append(fields[name])
        return F.concat(*pieces) if pieces else F.lit("")
    return F.concat(
        F.lit(base), F.lit("\n\nDOCUMENT_TITLE: "), fields["title"], F.lit("\nDOCUMENT_URL: "), fields["url"],
        F.lit("\nSCOPE: "), fields["scope"], F.lit("\nDOCUMENT_TEXT:\n"), fields["text"],
    )


def gate_prompt(text: Column | str, examples: str | None = None) -> Column:
    """Prompt of the gate: optional examples, the JSON instruction, the text."""
    head = f"Labeled examples:\n{examples}\n\n" if examples else ""
    return F.concat(F.lit(head + GATE_JSON_INSTRUCTIONS + "\n\nTEXT:\n"), col(text))


def annotation_prompt(instructions: str, row_columns: Sequence[str] = ("municipality", "document_id", "url", "title"),
                      text: Column | str = "text") -> Column:
    """Instructions, then one '- name: value' line per metadata column, then the text."""
    lines = [
        F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in row_columns
    ]
    return strip(F.concat_ws("\n", F.lit(instructions), *lines, F.lit(""), F.coalesce(col(text), F.lit(""))))


def example_block(text: Column, label: Column, max_chars: int | None = None) -> Column:
    """One rendered few-shot example."""
    shown = prefix(text, max_chars) if max_chars else text
    return F.concat(
        F.lit("EXAMPLE\nTEXT:\n"), shown, F.lit('\nOUTPUT:\n{"label": '), label.cast("int").cast("string"),
        F.lit(', "confidence": 0.9, "rationale": "example"}\n'),
    )
