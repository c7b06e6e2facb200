"""Substring matching of term lists, and the scored keyword rules.

Matching is containment in lower-cased text, never token equality. Terms are
used as written: an upper-case term cannot match lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.functions.automaton import Automaton
from policyspark.functions.text import col, let
from policyspark.session import parallelism


def literal_array(terms: Iterable[str]) -> Column:
    terms = list(terms)
    if not terms:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(t) for t in terms])


def root_of(term: str, known: set[str]) -> str:
    """Shortest known term that occurs inside ``term`` (often the term itself).

    A text without the root cannot contain the term, so scanning for the few
    roots decides most texts. Only the pieces of the term are looked up, so a
    list takes time in proportion to its length.
    """
    for size in range(len(term) + 1):
        inside = {term[i:i + size] for i in range(len(term) - size + 1)} & known
        if inside:
            return min(inside)
    return term


def roots(terms: Sequence[str]) -> list[str]:
    known = set(terms)
    return list(dict.fromkeys(root_of(t, known) for t in terms))


def any_term(text: Column | str, terms: Sequence[str]) -> Column:
    """True when at least one term occurs; stops at the first hit. Null text counts as empty."""
    text = F.coalesce(col(text), F.lit(""))
    if not terms:
        return F.lit(False)
    return let(text, lambda t: F.exists(literal_array(roots(terms)), lambda term: F.contains(t, term)))


def term_hits(text: Column | str, terms: Sequence[str]) -> Column:
    """Terms contained in the text, in the order of the list; a term listed twice is returned twice."""
    text = F.coalesce(col(text), F.lit(""))
    if not terms:
        return literal_array([])
    known = set(terms)
    short = roots(terms)
    if len(short) == len(known):
        return let(text, lambda t: F.filter(literal_array(terms), lambda term: F.contains(t, term)))
    rooted = F.arrays_zip(literal_array(terms).alias("term"), literal_array([root_of(t, known) for t in terms]).alias("root"))

    def below(t: Column, found: Column) -> Column:
        kept = F.filter(rooted, lambda x: F.array_contains(found, x["root"]) & F.contains(t, x["term"]))
        return F.when(F.size(found) > 0, F.transform(kept, lambda x: x["term"])).otherwise(literal_array([]))

    return let(text, lambda t: let(
        F.filter(literal_array(short), lambda term: F.contains(t, term)), lambda found: below(t, found)))


#: A list of more terms than this is looked for by automata that read a text once, not term by term.
LONG_LIST = 100


def listed_hits(text: Column | str, terms: Sequence[str]) -> Column:
    """As :func:`term_hits`, for lists of any length; not for use inside array functions, which take no Python."""
    return scanned_hits(text, terms) if len(set(terms)) > LONG_LIST else term_hits(text, terms)


def scanned_hits(text: Column | str, terms: Sequence[str]) -> Column:
    """The hits of :func:`term_hits`, found by Aho-Corasick automata over packs of the list; time does not grow with a pack."""
    places: dict[str, list[int]] = {}
    for place, term in enumerate(terms):
        places.setdefault(term, []).append(place)
    everywhere = places.pop("", [])  # the empty term is in every text
    packs: list[list[str]] = [[]]
    size = 0
    for term in places:
        if size > PACK_BYTES:
            packs.append([])
            size = 0
        packs[-1].append(term)
        size += len(term.encode())

    def block_hits(texts: list[bytes], automata: list[tuple[Automaton, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the list) of all hits, sorted."""
        owner = [np.repeat(np.arange(len(texts)), len(everywhere))]
        place = [np.tile(np.array(everywhere, np.int64), len(texts))]
        for automaton, names in automata if any(texts) else ():
            found, term = automaton.contained(texts)
            of = [np.array(places[n], np.int64) for n in names]
            owner.append(np.repeat(found, [len(of[t]) for t in term]))
            place.extend(of[t] for t in term)
        owner, place = np.concatenate(owner), np.concatenate(place)
        order = np.lexsort((place, owner))
        return owner[order], place[order]

    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = [(Automaton([t.encode() for t in pack]), pack) for pack in packs if pack]
        listed = pa.array(terms, pa.string())
        for batch in batches:
            sizes = pc.cumulative_sum(pc.binary_length(batch).cast(pa.int64())).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK_BYTES)) + 1).tolist(), len(batch)]
            counts, places_found = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                owner, place = block_hits(batch.slice(a, b - a).cast(pa.binary()).to_pylist(), automata)
                counts.append(np.bincount(owner, minlength=b - a))
                places_found.append(place)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])
            found = np.concatenate([np.zeros(0, np.int64), *places_found])
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), listed.take(pa.array(found)))

    # Types by name: annotations of this module are texts, which the function could not be told from.
    hits.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(hits, "array<string>")(F.coalesce(col(text), F.lit("")))


def count_occurrences(text: Column | str, terms: Sequence[str]) -> Column:
    """Sum over the terms of their non-overlapping occurrences (nested terms count twice; empty terms not at all)."""
    text = F.coalesce(col(text), F.lit(""))
    terms = [t for t in terms if t]
    if not terms:
        return F.lit(0)

    def times(t: Column, term: Column) -> Column:
        removed = F.length(t) - F.length(F.replace(t, term, F.lit("")))
        return F.when(F.contains(t, term), (removed / F.length(term)).cast("int")).otherwise(0)

    return let(text, lambda t: F.aggregate(literal_array(terms), F.lit(0), lambda total, term: total + times(t, term)))


@dataclass(frozen=True)
class ThemeTerms:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class KeywordRules:
    """General and thematic term lists with the thresholds of the keyword score."""

    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    themes: dict[str, ThemeTerms] = field(default_factory=dict)
    min_general: int = 1
    min_themes: int = 1
    fold_case: bool = True

    @staticmethod
    def from_mapping(config: dict | None) -> "KeywordRules":
        """Rules of the nested mapping that a keyword YAML file holds."""
        config = config or {}
        general = config.get("general") or {}
        matching = config.get("matching") or {}

        def terms(block: dict, key: str) -> tuple[str, ...]:
            return tuple(sorted(set(block.get(key) or ())))

        return KeywordRules(
            positive=terms(general, "positive"),
            negative=terms(general, "negative"),
            themes={
                name: ThemeTerms(terms(block, "include"), terms(block, "exclude"))
                for name, block in (config.get("thematic") or {}).items()
            },
            min_general=int(matching.get("minimum_general_positive", 1)),
            min_themes=int(matching.get("minimum_thematic_positive", 1)),
            fold_case=bool(matching.get("case_insensitive", True)),
        )

    @staticmethod
    def from_yaml(path: str) -> "KeywordRules":
        import yaml

        with open(path, encoding="utf-8") as handle:
            return KeywordRules.from_mapping(yaml.safe_load(handle))

    @staticmethod
    def from_table(rules: DataFrame, **thresholds) -> "KeywordRules":
        """Rules of a configuration table ``(group, polarity, term)``; group 'general' is the general block.

        The terms become part of the plan, as if they were written in the
        program. Tables that grow with the data go through :func:`table_matches`.
        """
        buckets: dict[tuple[str, str], list[str]] = {}
        for group, polarity, term in sorted(set(map(tuple, rules.select("group", "polarity", "term").toLocalIterator()))):
            buckets.setdefault((group, polarity), []).append(term)
        themes = sorted({group for group, _ in buckets if group != "general"})
        return KeywordRules(
            positive=tuple(buckets.get(("general", "positive"), ())),
            negative=tuple(buckets.get(("general", "negative"), ())),
            themes={
                t: ThemeTerms(tuple(buckets.get((t, "include"), ())), tuple(buckets.get((t, "exclude"), ())))
                for t in themes
            },
            **thresholds,
        )

    def fold(self, text: Column | str) -> Column:
        return F.lower(col(text)) if self.fold_case else col(text)

    def passes(self, text: Column) -> Column:
        """Only the pass flag of an already folded text; fits array lambdas.

        Most texts lack a general term, so that test comes first.
        """
        excluded = list(self.negative) + [t for theme in self.themes.values() for t in theme.exclude]
        theme_flags = [any_term(text, theme.include).cast("int") for theme in self.themes.values()]
        enough_themes = (
            reduce(lambda a, b: a + b, theme_flags, F.lit(0)) >= self.min_themes
        )
        general = F.size(term_hits(text, self.positive)) >= self.min_general
        return general & enough_themes & ~any_term(text, excluded)


def with_keyword_score(df: DataFrame, text: Column | str, rules: KeywordRules) -> DataFrame:
    """Add hit lists, pass flag and confidence of ``rules`` for one text column.

    Columns: ``keyword_hits_general``, ``keyword_hits_thematic`` (groups with
    hits only), ``keyword_negative_hits``, ``passes_filter``,
    ``confidence_score``.
    """
    def theme_map(pick) -> Column:
        pairs = [x for name, t in rules.themes.items() for x in (F.lit(name), listed_hits("__kw_text", pick(t)))]
        if not pairs:
            return F.create_map().cast("map<string,array<string>>")
        return F.map_filter(F.create_map(*pairs), lambda _, hits: F.size(hits) > 0)

    scored = df.withColumn("__kw_text", rules.fold(text)).withColumns({
        "keyword_hits_general": listed_hits("__kw_text", rules.positive),
        "keyword_hits_thematic": theme_map(lambda t: t.include),
        "keyword_negative_hits": F.struct(
            listed_hits("__kw_text", rules.negative).alias("general"),
            theme_map(lambda t: t.exclude).alias("thematic"),
        ),
    })
    hits = F.size("keyword_hits_general") + F.aggregate(
        F.map_values("keyword_hits_thematic"), F.lit(0), lambda acc, h: acc + F.size(h)
    )
    return scored.withColumns({
        "passes_filter": (F.size("keyword_hits_general") >= rules.min_general)
        & (F.size("keyword_hits_thematic") >= rules.min_themes)
        & (F.size("keyword_negative_hits.general") == 0)
        & (F.size("keyword_negative_hits.thematic") == 0),
        "confidence_score": F.least(F.lit(1.0), F.lit(0.1) + F.lit(0.05) * hits),
    }).drop("__kw_text")


#: Bytes of the terms of a pack (its automaton takes at most 1 KB for each) and of texts that are scanned together.
PACK_BYTES = 1 << 15
BLOCK_BYTES = 1 << 20
#: Automata that a task keeps.
KEPT_PACKS = 8


def term_packs(terms: DataFrame, term: str) -> DataFrame:
    """(pack, terms): the distinct terms, dealt by hash into packs of about PACK_BYTES. Null and empty ones are left out."""
    words = terms.select(F.col(term).cast("string").alias("term")).where("term <> ''").distinct()
    size = words.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    pack = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-size // PACK_BYTES)))).cast("int")
    return words.groupBy(pack.alias("pack")).agg(F.sort_array(F.collect_list("term")).alias("terms"))


def text_blocks(texts: DataFrame, key: str, text: str, routes: int) -> DataFrame:
    """(route, keys, texts): rows put together to blocks of about BLOCK_BYTES; null texts are left out."""
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            size = pc.cumulative_sum(pc.binary_length(batch.column("text")).cast(pa.int64())).to_numpy()
            cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1
            bounds = pa.array([0, *cuts.tolist(), batch.num_rows], pa.int32())
            yield pa.record_batch({
                "route": pa.array([(number + i) % routes for i in range(len(bounds) - 1)], pa.int32()),
                "keys": pa.ListArray.from_arrays(bounds, batch.column("key")),
                "texts": pa.ListArray.from_arrays(bounds, batch.column("text"))})
            number += len(bounds) - 1

    return rows.mapInArrow(blocks, f"route int, keys array<{kind}>, texts array<string>")


def _scanned(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str, count: str | None) -> DataFrame:
    """Every block of texts meets every pack of terms, once, in a task that runs the pack's automaton over the block.

    Packs are copied to a fixed number of routes, blocks take one each, and
    the two meet by a plain equi join: the planner moves the smaller side.
    """
    routes = parallelism(texts.sparkSession)
    blocks = text_blocks(texts, key, text, routes)
    packs = term_packs(terms, term).withColumn("route", F.explode(F.sequence(F.lit(0), F.lit(routes - 1))))
    names = [key, term] + ([count] if count else [])
    kind = texts.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: dict[int, tuple[Automaton, pa.Array]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                pack = batch.column("pack")[i].as_py()
                if pack not in automata:
                    if len(automata) == KEPT_PACKS:
                        automata.pop(next(iter(automata)))
                    words = batch.column("terms")[i].values
                    automata[pack] = (Automaton(words.cast(pa.binary()).to_pylist()), words)
                automaton, words = automata[pack]
                block = batch.column("texts")[i].values.cast(pa.binary()).to_pylist()
                found = automaton.counted(block) if count else (*automaton.contained(block), None)
                columns = [batch.column("keys")[i].values.take(pa.array(found[0])), words.take(pa.array(found[1]))]
                yield pa.record_batch(columns + ([pa.array(found[2], pa.int64())] if count else []), names=names)

    schema = f"`{key}` {kind}, `{term}` string" + (f", `{count}` long" if count else "")
    return blocks.join(packs, "route").select("pack", "terms", "keys", "texts").mapInArrow(scan, schema)


def table_matches(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term") -> DataFrame:
    """(key, term) for every term of a table that a text contains; both tables may be of any size.

    Terms are dealt into packs of bounded size, each an Aho-Corasick automaton
    that reads a text once for all its terms. Null and empty terms and null
    texts match nothing; repeated terms count once, repeated texts each.
    """
    return _scanned(texts, terms, key, text, term, None)


def table_counts(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term", count: str = "n") -> DataFrame:
    """As :func:`table_matches`, with the number of non-overlapping occurrences of the term, counted from the left."""
    return _scanned(texts, terms, key, text, term, count)
