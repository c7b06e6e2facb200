"""Breadth-first traversal of a table of fetched pages, and seed discovery.

Fetching is somebody else's job: the input is a table of pages that are
already there. The traversal keeps first-in-first-out semantics per
municipality although each level is one distributed step: the visit order
inside a level is (position of the linking page, position of the link), the
first occurrence of a URL wins, and the document, PDF and request caps are
running sums in visit order. Every level is checkpointed to the shared folder,
so neither the plan nor the recomputation after a lost executor grows with the
depth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.functions.html import page_parts
from policyspark.functions.terms import any_term
from policyspark.functions.text import compose_id, filled_after_strip, first_filled, let
from policyspark.functions.urls import (
    authority, domain_allowed, has_extension, is_internal, is_pdf, link_score, mime_head,
)
from policyspark.operators.joins import lookup
from policyspark.operators.ordinals import last_per_key, top_per_key, with_running_totals
from policyspark.session import cut_lineage, kept_table, parallelism, scratch_folder
from policyspark.vocabulary import CRAWL_EXCLUDED_EXTENSIONS, SEED_EXCLUDED_EXTENSIONS, SEED_KEYWORDS


@dataclass(frozen=True)
class CrawlLimits:
    max_depth: int = 2
    max_docs: int = 40
    max_pdfs: int = 8
    max_requests: int = 400

    @staticmethod
    def from_mapping(limits: dict) -> "CrawlLimits":
        """Limits of a config mapping; per-municipality keys have several spellings."""
        def pick(default: int, *names: str) -> int:
            return int(next((limits[n] for n in names if n in limits), default))

        return CrawlLimits(
            max_depth=pick(2, "max_depth"),
            max_docs=pick(40, "max_docs_per_municipality", "max_pages_per_municipality", "max_docs_per_commune"),
            max_pdfs=pick(8, "max_pdfs_per_municipality", "max_pdfs_per_commune"),
            max_requests=pick(400, "max_total_requests"),
        )


def page_table(pages: DataFrame, html: str = "html", url: str = "url", status: str | None = None,
               content_type: str | None = None) -> DataFrame:
    """(url, status, ct, content_key) of fetched HTML pages."""
    return pages.select(
        F.col(url).alias("url"), (F.col(status) if status else F.lit(200)).cast("int").alias("status"),
        (F.col(content_type) if content_type else F.lit("text/html")).alias("ct"),
        F.sha2(F.col(html), 256).alias("content_key"))


def page_edges(pages: DataFrame, html: str = "html", url: str = "url", base_url: str | None = None) -> DataFrame:
    """(url, pos, link, anchor): one row per link of a page, resolved against ``base_url`` or the page."""
    found = pages.select(
        F.col(url).alias("url"), F.explode_outer(page_parts(html, base_url or url, ["links"])["links"]).alias("l"))
    return found.where(F.col("l").isNotNull()).select(
        "url", "l.pos", F.col("l.url").alias("link"), F.col("l.anchor").alias("anchor"))


class Visited:
    """The urls that a traversal has seen, as a table bucketed by (municipality, url).

    Every level adds its frontier. New links come out of their aggregation
    partitioned by the same columns into as many parts, so they meet the
    buckets in place: what was seen on earlier levels is never shuffled again.
    The table lives below the checkpoint folder until :meth:`drop`.
    """

    KEYS = ("muni", "url")

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = scratch_folder(spark, "visited")
        self.name = f"visited_{self.path.rsplit('-', 1)[1]}"
        self.buckets = parallelism(spark)

    def add(self, rows: DataFrame) -> None:
        spread = rows.select(*self.KEYS).repartition(self.buckets, *self.KEYS)
        spread.write.bucketBy(self.buckets, *self.KEYS).mode("append").format("parquet").option("path", self.path).saveAsTable(self.name)

    def unseen(self, links: DataFrame) -> DataFrame:
        return links.join(self.spark.table(self.name), list(self.KEYS), "left_anti")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


Edges = DataFrame | Callable[[DataFrame], DataFrame]


def linked_pages(pages: DataFrame, html: str = "html", url: str = "url", base_url: str | None = None) -> Edges:
    """The links of stored pages as traversals want them: a level's urls pick their pages, and only those are parsed."""
    def edges(wanted: DataFrame) -> DataFrame:
        chosen = pages.join(wanted.select(F.col("url").alias("__wanted")), F.col(url) == F.col("__wanted"), "left_semi")
        return page_edges(chosen, html, url, base_url)

    return edges


def gated_crawl(
    seeds: DataFrame, pages: DataFrame, edges: Edges, keywords: Sequence[str], limits: CrawlLimits = CrawlLimits(),
    allowed_types: Sequence[str] = ("text/html", "application/pdf"),
) -> DataFrame:
    """Index rows (muni, url, depth, ord, status, ct, kept, reason, raw_path) of the gated traversal.

    ``seeds``: (muni, url, allowed_domains); ``pages``: the page table, unique
    per url; ``edges``: (url, pos, link, anchor), or a function that gives the
    edges of a table of urls (:func:`linked_pages`). A url without a page row is a
    failed fetch. Links are followed from kept HTML pages when domain and
    keyword gate pass.
    """
    lowered = [k.lower() for k in keywords]

    def gate(url: Column, anchor: Column) -> Column:
        both = F.concat_ws("\n", F.lower(url), F.lower(F.coalesce(anchor, F.lit(""))))
        return let(both, lambda t: any_term(t, lowered))

    allowed = [a.lower() for a in allowed_types]
    fetched = pages.select(
        "url", F.col("status").alias("p_status"), mime_head("ct").alias("p_ct"),
        F.col("content_key").alias("p_key"), F.lit(True).alias("p_found"))
    frontier = seeds.select("muni", "url", "allowed_domains", F.lit(0).cast("long").alias("ord"))
    frontier = cut_lineage(frontier.where(domain_allowed("url", "allowed_domains")))
    tally = _tally(frontier, ["docs", "pdfs", "reqs"])
    visited = Visited(seeds.sparkSession)
    visited.add(frontier)
    levels = []
    for depth in range(limits.max_depth + 1):
        seen = _with_tally(lookup(frontier, fetched, ["url"]), tally)
        ok = F.coalesce(F.col("p_found"), F.lit(False))
        eligible = ok & (F.col("p_status") < 400) & F.col("p_ct").isin(allowed)
        step = cut_lineage(seen.withColumns({
            "ok": ok, "eligible": F.coalesce(eligible, F.lit(False)),
            "is_pdf": F.coalesce(eligible & is_pdf("p_ct", "url", "gated"), F.lit(False)),
        }).drop("p_found"))
        # The first PDFs up to the cap are stored, so the documents stored before
        # a row follow from plain counts and one pass gives all three caps.
        step = with_running_totals(step, ["muni"], ["ord"], {
            "pages_before": (F.col("eligible") & ~F.col("is_pdf")).cast("long"),
            "pdfs_before": F.col("is_pdf").cast("long"), "reqs_before": F.col("ok").cast("long"),
        })
        room = F.lit(limits.max_pdfs) - F.col("t_pdfs")
        step = step.withColumns({
            "stored": F.col("eligible") & ~(F.col("is_pdf") & (F.col("pdfs_before") >= room)),
            "place": F.col("pages_before") + F.least(F.col("pdfs_before"), room),
        })
        step = step.where((F.col("place") + F.col("t_docs") < limits.max_docs)
                          & (F.col("reqs_before") + F.col("t_reqs") < limits.max_requests))
        reason = F.when(F.col("ok") & (F.col("p_status") < 400),
                        F.when(~F.col("eligible"), "ct_filtered").when(~F.col("stored"), "pdf_cap"))
        done = cut_lineage(step.select(
            "muni", "url", F.lit(depth).alias("depth"), "ord", "place", "allowed_domains", "is_pdf",
            F.when(F.col("ok"), F.col("p_status").cast("string")).otherwise("error").alias("status"),
            F.when(F.col("ok"), F.col("p_ct")).alias("ct"), F.when(F.col("ok"), F.col("stored")).alias("kept"),
            reason.alias("reason"),
            F.when(F.col("stored"), F.concat("p_key", F.when(F.col("is_pdf"), ".pdf").otherwise(".html"))).alias("raw_path"),
        ))
        levels.append(done.drop("place", "allowed_domains", "is_pdf"))
        if depth == limits.max_depth:
            break
        tally = _spend(tally, done, {
            "docs": F.count_if("kept"), "pdfs": F.count_if(F.col("kept") & F.col("is_pdf")),
            "reqs": F.count_if(F.col("status") != "error")})
        frontier = cut_lineage(_next_level(
            done.where(F.col("kept") & ~F.col("is_pdf")), edges, visited,
            lambda u, a: domain_allowed(u, "allowed_domains") & gate(u, a)))
        if frontier.isEmpty():
            break
        visited.add(frontier)
    visited.drop()
    return reduce(DataFrame.unionByName, levels)


def _tally(frontier: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of zero counters per municipality."""
    return frontier.select(F.col("muni").alias("t_muni")).distinct().withColumns(
        {f"t_{n}": F.lit(0).cast("long") for n in names})


def _with_tally(rows: DataFrame, tally: DataFrame) -> DataFrame:
    return rows.join(tally, F.col("muni") == F.col("t_muni"), "left").drop("t_muni")


def _spend(tally: DataFrame, done: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Add a level's counts to the counters."""
    spent = done.groupBy(F.col("muni").alias("s_muni")).agg(*[c.alias(f"s_{n}") for n, c in counts.items()])
    return tally.join(spent, F.col("t_muni") == F.col("s_muni"), "left").select(
        "t_muni", *[(F.col(f"t_{n}") + F.coalesce(F.col(f"s_{n}"), F.lit(0))).alias(f"t_{n}") for n in counts])


def _next_level(parents: DataFrame, edges: Edges, visited: Visited, follow) -> DataFrame:
    """Unvisited links of a level; the first occurrence of a url per municipality keeps its place.

    Visit order = place of the parent among the expanded pages of its level
    (upper 31 bits), then the position of the link (lower 32). The place is
    bounded by the document cap at any depth.
    """
    sources = parents.select(F.col("url").alias("p_url"), "muni", "place", "allowed_domains")
    if callable(edges):
        edges = edges(sources.select(F.col("p_url").alias("url")).distinct())
    links = sources.join(edges, F.col("p_url") == F.col("url")).select(
        "muni", "allowed_domains", F.col("p_url").alias("referrer"), "place", F.col("pos").cast("long").alias("pos"),
        F.col("link").alias("url"), "anchor").where(follow(F.col("url"), F.col("anchor")))
    placed = links.withColumn("ord", F.col("place") * F.lit(1 << 32) + F.col("pos"))
    firsts = placed.groupBy("muni", "url").agg(
        F.min_by(F.struct("allowed_domains", "referrer"), "ord").alias("__f"), F.min("ord").alias("ord"))
    return visited.unseen(firsts).select("muni", "url", "__f.allowed_domains", "__f.referrer", "ord")


def plain_crawl(
    seeds: DataFrame, pages: DataFrame, edges: Edges, max_pages: int = 40, max_depth: int = 2, max_pdfs: int = 8,
    extensions: Sequence[str] = tuple(CRAWL_EXCLUDED_EXTENSIONS), timestamp: Column | None = None,
) -> DataFrame:
    """Ungated traversal: only assets are skipped, failed fetches count against the page cap, and content exists for status 200 to 399.

    ``seeds``: (muni, url, position). The links of ``edges`` are resolved the
    way the caller wants (against the municipality's base URL in the classic
    run). Every visited url gets a raw document row with the
    per-municipality number as document id. Levels are kept as tables, so that
    pages and links meet small ones without being shuffled.
    """
    empty = F.array().cast("array<string>")
    fetched = pages.select(
        "url", F.col("status").alias("p_status"), F.nullif(mime_head("ct"), F.lit("")).alias("p_ct"),
        F.when(F.col("status").between(200, 399), F.col("content_key")).alias("p_key"))
    frontier = seeds.groupBy("muni", "url").agg(F.min(F.col("position").cast("long")).alias("ord")).select(
        "muni", "url", "ord", empty.alias("allowed_domains"), F.lit(None).cast("string").alias("referrer"))
    frontier = cut_lineage(frontier.where(~has_extension("url", extensions)))
    tally = _tally(frontier, ["rows", "pdfs"])
    visited = Visited(seeds.sparkSession)
    visited.add(frontier)
    levels = []
    for depth in range(max_depth + 1):
        # Every row takes a number, so those beyond the cap can be told before pages are looked up.
        waiting = with_running_totals(_with_tally(frontier, tally), ["muni"], ["ord"], {"__before": F.lit(1).cast("long")})
        chosen = kept_table(waiting.where(F.col("__before") + F.col("t_rows") < max_pages).drop("__before"), "chosen")
        seen = lookup(chosen, fetched.join(chosen.select("url").distinct(), "url", "left_semi"), ["url"])
        stored = F.col("p_key").isNotNull()
        pdf = F.coalesce(stored & is_pdf("p_ct", "url", "crawl"), F.lit(False))
        step = cut_lineage(seen.withColumns({
            "is_pdf": pdf,
            "is_html": F.coalesce(stored & ~pdf & F.col("p_ct").contains("text/html"), F.lit(False)),
        }))
        step = with_running_totals(step, ["muni"], ["ord"], {
            "place": F.lit(1).cast("long"), "pdfs_before": F.col("is_pdf").cast("long")})
        step = step.withColumn("number", F.col("place") + F.col("t_rows")).where(F.col("number") < max_pages)
        keep_pdf = F.col("is_pdf") & (F.col("pdfs_before") + F.col("t_pdfs") < max_pdfs)
        done = kept_table(step.select(
            "muni", compose_id(F.col("muni").cast("string"), F.col("number").cast("string")).alias("document_id"),
            "url", "referrer", F.col("p_ct").alias("mime_type"), F.col("p_status").alias("http_status"),
            F.when(F.col("is_html"), F.col("p_key")).alias("content_key"),
            F.when(keep_pdf, F.concat("p_key", F.lit(".pdf"))).alias("raw_path"),
            (timestamp if timestamp is not None else F.lit(None).cast("string")).alias("crawl_timestamp"),
            F.lit(False).alias("keyword_hit"), F.lit(depth).alias("depth"), "place", "allowed_domains", "is_pdf", "is_html",
        ), "level")
        levels.append(done.drop("place", "allowed_domains", "is_pdf", "is_html"))
        if depth == max_depth:
            break
        tally = _spend(tally, done, {"rows": F.count(F.lit(1)), "pdfs": F.count_if("is_pdf")})
        frontier = cut_lineage(_next_level(
            done.where(F.col("is_html") & F.col("http_status").between(200, 299)), edges, visited,
            lambda u, a: ~has_extension(u, extensions)))
        if frontier.isEmpty():
            break
        visited.add(frontier)
    visited.drop()
    return reduce(DataFrame.unionByName, levels).withColumnsRenamed({
        "muni": "municipality_id", "url": "source_url", "referrer": "referrer_url"})


def crawl_seeds(municipalities: DataFrame, discovered: DataFrame, order: str) -> DataFrame:
    """(muni, url, position): a configured seed, else the discovered seeds, else the base url."""
    have = set(municipalities.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    own_id = first_filled(c("id").cast("string"), c("municipality_id").cast("string"), c("ags").cast("string"))
    base = municipalities.select(
        F.coalesce(own_id, F.concat(F.lit("m"), (F.col(order) + 1).cast("string"))).alias("muni"),
        first_filled(c("seed_url"), c("start_url")).alias("__seed"),
        first_filled(c("base_url"), c("seed_url"), c("start_url")).alias("base_url"),
    )
    found = discovered.select(F.col("municipality_id").alias("muni"), F.col("discovered_seeds").alias("__found"))
    joined = lookup(base, found, ["muni"])
    urls = (
        F.when(F.col("__seed").isNotNull(), F.array("__seed"))
        .when(F.size("__found") > 0, F.col("__found"))
        .when(F.col("base_url").isNotNull(), F.array("base_url"))
    )
    return joined.select("muni", "base_url", F.posexplode(urls).alias("position", "url"))


def link_candidates(pages: DataFrame, keywords: Sequence[str] = tuple(SEED_KEYWORDS),
                    key: str = "municipality_id", base_url: str = "base_url", html: str = "html") -> DataFrame:
    """Scored internal links of home pages: (key, pos, url, anchor, score) with score > 0."""
    links = pages.select(
        key, F.col(base_url).alias("__base"),
        F.explode_outer(page_parts(html, base_url, ["anchors"])["anchors"]).alias("__l"),
    ).where(F.col("__l").isNotNull()).select(key, "__base", "__l.pos", "__l.url", "__l.anchor")
    kept = links.where(is_internal("url", authority("__base")) & ~has_extension("url", SEED_EXCLUDED_EXTENSIONS))
    return kept.withColumn("score", link_score("url", "anchor", keywords)).where("score > 0").drop("__base")


def discover_seeds(links: DataFrame, max_seeds: int = 5, key: str = "municipality_id") -> DataFrame:
    """Best links per municipality: highest score first, page order within a score, one row per url."""
    order = F.struct(F.col("score"), (-F.col("pos").cast("long")).alias("p"))
    best = last_per_key(links, [key, "url"], order)
    return top_per_key(best, [key], [F.col("score").desc(), F.col("pos")], max_seeds, "rank")


def seed_records(seeds: DataFrame, municipalities: DataFrame, key: str = "municipality_id") -> DataFrame:
    """One nested row per municipality; those without seeds get empty lists."""
    lists = seeds.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "url", "anchor", "score"))).alias("__s"))
    base = municipalities.where(filled_after_strip(F.col(key).cast("string")).isNotNull()
                                & filled_after_strip("base_url").isNotNull()).select(key, "base_url")
    joined = lookup(base, lists, [key])
    items = F.coalesce(F.col("__s"), F.array().cast("array<struct<rank:int,url:string,anchor:string,score:int>>"))
    return joined.select(
        key, "base_url", F.transform(items, lambda x: x["url"]).alias("discovered_seeds"),
        F.struct(F.transform(items, lambda x: x["anchor"]).alias("anchor_texts"),
                 F.transform(items, lambda x: x["score"]).alias("scores")).alias("debug"),
    )


def content_store(pages: DataFrame, key: str = "municipality_id", content: str = "content",
                  extension: Column | None = None) -> DataFrame:
    """(key, digest, file_name, content): identical content is stored once per key."""
    named = pages.select(key, F.sha2(F.col(content), 256).alias("digest"), F.col(content).alias("content"),
                         (extension if extension is not None else F.lit(".html")).alias("__ext"))
    stored = named.groupBy(key, "digest").agg(
        F.first("content").alias("content"), F.min("__ext").alias("__ext"), F.count(F.lit(1)).alias("copies"))
    return stored.withColumn("file_name", F.concat("digest", "__ext")).drop("__ext")
