"""Queries over pages: text, features, links, seeds, traversal, filters, content store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark.catalog import query
from policyspark.catalog.inputs import joined, table
from policyspark.functions import html as H
from policyspark.functions import urls as U
from policyspark.operators import crawl, harmonise
from policyspark.session import cut_lineage, kept_table
from policyspark.vocabulary import DIGITALIZATION_LEVELS

LINK_WORDS = ["the", "ation", "de", "er", "on"]


def pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages")


# Markup without comments, scripts and styles; entities are resolved last.
CLEAN_SQL = r"""clean AS (SELECT page_id, url, html,
    regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '<x>', 'g'), '(?s)<script[^>]*>.*?</script>', '<x>', 'g'),
      '(?s)<style[^>]*>.*?</style>', '<x>', 'g') AS c FROM pages)"""


def unescape(column: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({column}, '&quot;?', '\"', 'g'), '&copy;?', '©', 'g'), "
            f"'&middot;?', '·', 'g'), '&amp;?', '&', 'g')")


@query("page_text", sql=rf"""WITH {CLEAN_SQL}
  SELECT page_id, nullif(trim({unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ' ' || chr(10)), '') AS title,
    trim(regexp_replace({unescape("regexp_replace(c, '<[^>]*>', chr(10), 'g')")}, '\s+', ' ', 'g')) AS text FROM clean""")
def page_text(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", H.page_parts("html", "url", ["title", "text"]).alias("p"))
    return p.select("page_id", "p.title", "p.text")


PIECES_SQL = (
    "list_filter(list_transform(regexp_split_to_array(c, '<[^>]*>'), lambda s: trim(" + unescape("s") + ", ' ' || chr(10) || chr(9))), "
    "lambda s: s <> '')"
)


@query("page_text_pieces", sql=f"""WITH {CLEAN_SQL}
  SELECT page_id, array_to_string({PIECES_SQL}, ' ') AS text_spaced, array_to_string({PIECES_SQL}, chr(10)) AS text_lines FROM clean""")
def page_text_pieces(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", H.page_parts("html", "url", ["text_spaced", "text_lines"]).alias("p"))
    return p.select("page_id", "p.text_spaced", "p.text_lines")


@query("page_features", sql=f"""SELECT page_id,
    trim({unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ' ' || chr(10)) AS title_or_h1,
    contains(html, '<form') AS has_form, regexp_matches(lower(html), 'href="[^"]*\\.pdf"') AS has_pdf_download,
    contains(html, 'mailto:') AS has_contact_email,
    CASE WHEN contains(html, '<form') THEN 'ONLINE_FORM' WHEN regexp_matches(lower(html), 'href="[^"]*\\.pdf"') THEN 'PDF_DOWNLOAD'
      WHEN contains(html, 'mailto:') THEN 'CONTACT_ONLY' ELSE 'UNKNOWN' END AS level FROM pages""")
def page_features(spark, sf_dir):
    fields = ["title_or_h1", "has_form", "has_pdf_download", "has_contact_email"]
    p = pages(spark, sf_dir).select("page_id", H.page_parts("html", "url", fields).alias("p")).select("page_id", "p.*")
    return p.withColumn("level", H.digitalization_level("has_form", "has_pdf_download", "has_contact_email"))


HOST_SQL = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
LINKS_SQL = rf"""hrefs AS (SELECT page_id, url AS page_url, {HOST_SQL} AS base,
    regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hs, regexp_extract_all(html, '(?s)<a href="[^"]*">(.*?)</a>', 1) AS ts FROM pages),
  links AS (SELECT page_id, page_url, base, unnest(hs) AS href, {unescape('unnest(ts)')} AS anchor, generate_subscripts(hs, 1) - 1 AS pos FROM hrefs)"""


@query("page_links", sql=f"""WITH {LINKS_SQL}
  SELECT page_id, CAST(pos AS INT) AS pos, href, base || href AS url, trim(anchor, ' ' || chr(10)) AS anchor FROM links""")
def page_links(spark, sf_dir):
    links = H.page_parts("html", "url", ["links"])["links"]
    rows = pages(spark, sf_dir).select("page_id", F.explode_outer(links).alias("l")).where(F.col("l").isNotNull())
    return rows.select("page_id", "l.pos", "l.href", "l.url", "l.anchor")


@query("page_links_sql", sql=f"""WITH {LINKS_SQL}
  SELECT page_id, count(*) AS n_links, max(length(base || href)) AS longest FROM links GROUP BY page_id""")
def page_links_sql(spark, sf_dir):
    """The same links through the table function for SQL users."""
    from policyspark.functions.sql import register_sql_functions

    register_sql_functions(spark)
    pages(spark, sf_dir).createOrReplaceTempView("policyspark_pages")
    return spark.sql("""SELECT page_id, count(*) AS n_links, CAST(max(length(l.url)) AS BIGINT) AS longest
        FROM policyspark_pages, LATERAL page_links(html, policyspark_pages.url) l GROUP BY page_id""")


def _hits(column: str) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::INT" for w in LINK_WORDS) + ")"


PATH_SQL = "lower(regexp_extract(href, '^[^?#]*'))"
SCORED_SQL = f"""{LINKS_SQL}, scored AS (SELECT base AS site, page_id, pos, base || href AS url, trim(anchor, ' ' || chr(10)) AS anchor,
    2 * {_hits(PATH_SQL)} + 2 * {_hits('lower(anchor)')} AS score FROM links
    WHERE NOT regexp_matches({PATH_SQL}, '\\.(pdf|jpg|jpeg|png|gif|svg|mp4|mp3|zip|doc|docx|xls|xlsx)$')),
  positive AS (SELECT *, page_id * 1000 + pos AS place FROM scored WHERE score > 0)"""


@query("link_scores", sql=f"WITH {SCORED_SQL} SELECT page_id, CAST(pos AS INT) AS pos, url, anchor, CAST(score AS INT) AS score FROM positive")
def link_scores(spark, sf_dir):
    return crawl.link_candidates(pages(spark, sf_dir), LINK_WORDS, key="page_id", base_url="url").select(
        "page_id", "pos", "url", "anchor", "score")


def site_links(spark, sf_dir) -> DataFrame:
    """Scored links with the site (scheme and host) as municipality; place = page, then link position."""
    p = pages(spark, sf_dir).withColumn("key", F.struct(
        F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), U.authority("url")).alias("site"), "page_id"))
    scored = crawl.link_candidates(p, LINK_WORDS, key="key", base_url="url")
    return scored.select(F.col("key.site").alias("municipality_id"), (F.col("key.page_id") * 1000 + F.col("pos")).alias("pos"),
                         "url", "anchor", "score")


SEEDS_SQL = f"""{SCORED_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY score DESC, place) AS k FROM positive),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, place) AS rank FROM firsts WHERE k = 1),
  seeds AS (SELECT * FROM ranked WHERE rank <= 5)"""


@query("seed_topn", sql=f"""WITH {SEEDS_SQL}
  SELECT site AS municipality_id, CAST(rank AS INT) AS rank, url, anchor, CAST(score AS INT) AS score FROM seeds""")
def seed_topn(spark, sf_dir):
    return crawl.discover_seeds(site_links(spark, sf_dir)).select("municipality_id", "rank", "url", "anchor", "score")


@query("seed_records", sql=f"""WITH {SEEDS_SQL}, sites AS (SELECT DISTINCT {HOST_SQL} AS site FROM pages)
  SELECT s.site AS municipality_id, coalesce(string_agg(x.url, ' ' ORDER BY x.rank), '') AS seeds,
    coalesce(string_agg(CAST(x.score AS VARCHAR), ' ' ORDER BY x.rank), '') AS scores FROM sites s LEFT JOIN seeds x USING (site) GROUP BY s.site""")
def seed_records(spark, sf_dir):
    sites = table(spark, sf_dir, "pages").select(F.concat(
        F.regexp_extract("url", "^([a-z]+://)", 1), U.authority("url")).alias("municipality_id")).distinct()
    munis = sites.withColumn("base_url", F.col("municipality_id"))
    records = crawl.seed_records(crawl.discover_seeds(site_links(spark, sf_dir)), munis)
    return records.select("municipality_id", joined("discovered_seeds", " ").alias("seeds"), joined("debug.scores", " ").alias("scores"))


@query("crawl_seeds", sql="""SELECT 'c' || c_custkey AS muni, 0 AS position, CASE WHEN c_custkey % 3 = 0 THEN 'https://seed/' || c_custkey
    WHEN c_custkey % 5 = 1 THEN 'https://found/' || c_custkey ELSE 'https://base/' || c_custkey END AS url
  FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 1 OR c_custkey % 2 = 0
  UNION ALL SELECT 'c' || c_custkey, 1, 'https://more/' || c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 = 1""")
def crawl_seeds(spark, sf_dir):
    """Configured seed, else discovered seeds, else base url; customers without any are left out."""
    c = table(spark, sf_dir, "customer")
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    munis = c.select(
        F.concat(F.lit("c"), s).alias("municipality_id"), F.when(k % 3 == 0, F.concat(F.lit("https://seed/"), s)).alias("seed_url"),
        F.when(k % 2 == 0, F.concat(F.lit("https://base/"), s)).alias("base_url"), k.alias("ord"))
    found = c.where(k % 5 == 1).select(F.concat(F.lit("c"), s).alias("municipality_id"), F.array(
        F.concat(F.lit("https://found/"), s), F.concat(F.lit("https://more/"), s)).alias("discovered_seeds"))
    return crawl.crawl_seeds(munis, found, "ord").select("muni", "position", "url")


# A site per nation: its home page links its customers in key order, a customer
# page links its orders. Statuses, types and anchors follow from the rows.
def site_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, pages, edges)"""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))

    def url(*parts) -> F.Column:
        return F.concat(F.lit("https://n"), *[p if not isinstance(p, str) else F.lit(p) for p in parts])

    def text(name: str):
        return F.col(name).cast("string")

    home_url = url(text("n_nationkey"), ".example/")
    customer_url = url(text("c_nationkey"), ".example/c/", text("c_custkey"))
    order_url = url(text("c_nationkey"), ".example/o/", text("o_orderkey"), F.when(F.col("o_orderkey") % 4 == 0, ".pdf").otherwise(""))
    owned = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    home = n.select(home_url.alias("url"), F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("ct"))
    middle = c.select(customer_url.alias("url"), F.when(F.col("c_custkey") % 7 == 0, 404).otherwise(200).alias("status"),
                      F.when(F.col("c_custkey") % 11 == 0, "image/png").otherwise("text/html").alias("ct"))
    leaves = owned.where("o_orderkey % 9 <> 0").select(
        order_url.alias("url"), F.lit(200).alias("status"),
        F.when(F.col("o_orderkey") % 4 == 0, "application/pdf").otherwise("text/html").alias("ct"))
    page_rows = home.unionByName(middle).unionByName(leaves).withColumn("content_key", F.sha2("url", 256))
    edges = c.select(
        url(text("c_nationkey"), ".example/").alias("url"), F.col("c_custkey").alias("pos"), customer_url.alias("link"),
        F.lower("c_mktsegment").alias("anchor"),
    ).unionByName(owned.select(
        customer_url.alias("url"), F.col("o_orderkey").alias("pos"), order_url.alias("link"),
        F.lower("o_orderpriority").alias("anchor")))
    seeds = n.select(
        F.concat(F.lit("n"), text("n_nationkey")).alias("muni"), home_url.alias("url"),
        F.array(url(text("n_nationkey"), ".Example").substr(F.lit(9), F.lit(30))).alias("allowed_domains"),
        F.lit(0).alias("position"))
    return seeds, page_rows, edges


CRAWL_SQL = """f0 AS (SELECT n_nationkey AS n FROM nation),
  f1 AS (SELECT c_nationkey AS n, c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord
    FROM customer WHERE {gate1}),
  r1 AS (SELECT *, c % 7 = 0 AS bad, c % 11 = 0 AS odd, c % 7 <> 0 AND c % 11 <> 0 AS kept FROM f1),
  k1 AS (SELECT *, 1 + coalesce(sum(kept::INT) OVER (PARTITION BY n ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS docs_before,
    ord AS reqs_before FROM r1),
  l1 AS (SELECT * FROM k1 WHERE docs_before < {docs} AND reqs_before < {reqs}),
  t1 AS (SELECT n, 1 + sum(kept::INT) AS docs, 1 + count(*) AS reqs FROM l1 GROUP BY n),
  f2 AS (SELECT l1.n, o_orderkey AS o, row_number() OVER (PARTITION BY l1.n ORDER BY l1.ord, o_orderkey) AS ord
    FROM l1 JOIN orders ON o_custkey = c WHERE kept AND {gate2}),
  r2 AS (SELECT *, o % 9 = 0 AS missing, o % 9 <> 0 AND o % 4 = 0 AS pdf FROM f2),
  p2 AS (SELECT *, coalesce(sum(pdf::INT) OVER (PARTITION BY n ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pdf_before FROM r2),
  q2 AS (SELECT *, NOT missing AND NOT (pdf AND pdf_before >= {pdfs}) AS kept FROM p2),
  k2 AS (SELECT *, coalesce(sum(kept::INT) OVER w, 0) AS db, coalesce(sum((NOT missing)::INT) OVER w, 0) AS rb FROM q2
    WINDOW w AS (PARTITION BY n ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  l2 AS (SELECT k2.*, 'https://n' || k2.n || '.example/o/' || o || CASE WHEN o % 4 = 0 THEN '.pdf' ELSE '' END AS url
    FROM k2 JOIN t1 ON t1.n = k2.n WHERE db + t1.docs < {docs} AND rb + t1.reqs < {reqs})"""

CRAWL_LIMITS = crawl.CrawlLimits(max_depth=2, max_docs=60, max_pdfs=5, max_requests=75)
CRAWL_WORDS = ["Mach", "1-urg", "5-low", "build"]


@query("crawl_gated", sql=f"""WITH {CRAWL_SQL.format(
    gate1="regexp_matches(lower(c_mktsegment), 'mach|build')", gate2="o_orderpriority IN ('1-URGENT', '5-LOW')", docs=60, reqs=75, pdfs=5)}
  SELECT 'n' || n AS muni, 'https://n' || n || '.example/' AS url, 0 AS depth, '200' AS status, 'text/html' AS ct, true AS kept, NULL::VARCHAR AS reason FROM f0
  UNION ALL SELECT 'n' || n, 'https://n' || n || '.example/c/' || c, 1, CASE WHEN bad THEN '404' ELSE '200' END,
    CASE WHEN odd THEN 'image/png' ELSE 'text/html' END, kept, CASE WHEN NOT bad AND odd THEN 'ct_filtered' END FROM l1
  UNION ALL SELECT 'n' || n, url, 2, CASE WHEN missing THEN 'error' ELSE '200' END,
    CASE WHEN missing THEN NULL WHEN pdf THEN 'application/pdf' ELSE 'text/html' END, CASE WHEN NOT missing THEN kept END,
    CASE WHEN NOT missing AND NOT kept THEN 'pdf_cap' END FROM l2""")
def crawl_gated(spark, sf_dir):
    """The gated traversal of one site per nation with domain, keyword, document, PDF and request caps."""
    seeds, page_rows, edges = site_graph(spark, sf_dir)
    # built from joins here; real page and edge tables are stored
    index = crawl.gated_crawl(seeds, cut_lineage(page_rows), cut_lineage(edges), CRAWL_WORDS, CRAWL_LIMITS)
    return index.select("muni", "url", "depth", "status", "ct", "kept", "reason")


@query("crawl_gated_pages", sql=f"""WITH {LINKS_SQL}, p AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url),
  f1 AS (SELECT DISTINCT p.page_id, p.url AS home, base || href AS link FROM links JOIN p USING (page_id)
    WHERE regexp_matches(lower(base || href) || chr(10) || lower(anchor), 'th|nicht|ung'))
  SELECT 'p' || page_id AS muni, url, 0 AS depth, '200' AS status, 'text/html' AS ct, true AS kept FROM p
  UNION ALL SELECT 'p' || f1.page_id, link, 1, CASE WHEN p.url IS NULL THEN 'error' ELSE '200' END,
    CASE WHEN p.url IS NOT NULL THEN 'text/html' END, CASE WHEN p.url IS NOT NULL THEN true END
    FROM f1 LEFT JOIN p ON p.url = link WHERE link <> home""")
def crawl_gated_pages(spark, sf_dir):
    """The gated traversal over the stored pages: each page is a seed, and only the pages of a level are parsed."""
    stored = pages(spark, sf_dir).groupBy("url").agg(F.min("page_id").alias("page_id"))
    unique = pages(spark, sf_dir).join(stored, ["url", "page_id"], "left_semi")
    seeds = unique.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("muni"), "url",
                          F.array().cast("array<string>").alias("allowed_domains"))
    limits = crawl.CrawlLimits(max_depth=1, max_docs=1000, max_pdfs=10, max_requests=1000)
    index = crawl.gated_crawl(seeds, crawl.page_table(unique), crawl.linked_pages(unique), ["th", "nicht", "UNG"], limits)
    return index.select("muni", "url", "depth", "status", "ct", "kept")


@query("crawl_plain_pages", sql=f"""WITH {LINKS_SQL}, p AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url),
  f1 AS (SELECT DISTINCT p.page_id, p.url AS home, base || href AS link FROM links JOIN p USING (page_id)),
  f2 AS (SELECT DISTINCT f1.page_id, f1.home, l.base || l.href AS link FROM f1 JOIN p ON p.url = f1.link
    JOIN links l ON l.page_id = p.page_id WHERE f1.link <> f1.home),
  seen AS (SELECT page_id, link, 1 AS depth FROM f1 WHERE link <> home UNION ALL SELECT page_id, link, 2 FROM f2 WHERE link <> home),
  firsts AS (SELECT page_id, link, min(depth) AS depth FROM seen GROUP BY page_id, link)
  SELECT 'p' || page_id AS municipality_id, url AS source_url, 0 AS depth, 200 AS http_status, 'text/html' AS mime_type FROM p
  UNION ALL SELECT 'p' || f.page_id, f.link, f.depth, CASE WHEN p.url IS NOT NULL THEN 200 END, CASE WHEN p.url IS NOT NULL THEN 'text/html' END
    FROM firsts f LEFT JOIN p ON p.url = f.link""")
def crawl_plain_pages(spark, sf_dir):
    """The ungated traversal over the stored pages, two levels deep from every page."""
    stored = pages(spark, sf_dir).groupBy("url").agg(F.min("page_id").alias("page_id"))
    unique = pages(spark, sf_dir).join(stored, ["url", "page_id"], "left_semi")
    seeds = unique.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("muni"), "url", F.lit(0).alias("position"))
    index = crawl.plain_crawl(seeds, crawl.page_table(unique), crawl.linked_pages(unique), max_pages=100_000, max_depth=2, max_pdfs=10)
    return index.select("municipality_id", "source_url", "depth", "http_status", "mime_type")


@query("crawl_plain", sql="""WITH f1 AS (SELECT c_nationkey AS n, c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord FROM customer),
  f2 AS (SELECT n, c, o_orderkey AS o, row_number() OVER (PARTITION BY n ORDER BY ord, o_orderkey) + (SELECT count(*) FROM f1 x WHERE x.n = f1.n) AS ord
    FROM f1 JOIN orders ON o_custkey = c WHERE c % 7 <> 0 AND c % 11 <> 0),
  everything AS (SELECT n_nationkey AS n, 0 AS ord, 0 AS depth, 'https://n' || n_nationkey || '.example/' AS url, NULL::VARCHAR AS referrer_url,
      'text/html' AS mime_type, 200 AS http_status FROM nation
    UNION ALL SELECT n, ord, 1, 'https://n' || n || '.example/c/' || c, 'https://n' || n || '.example/',
      CASE WHEN c % 11 = 0 THEN 'image/png' ELSE 'text/html' END, CASE WHEN c % 7 = 0 THEN 404 ELSE 200 END FROM f1
    UNION ALL SELECT n, ord, 2, 'https://n' || n || '.example/o/' || o || CASE WHEN o % 4 = 0 THEN '.pdf' ELSE '' END,
      'https://n' || n || '.example/c/' || c, CASE WHEN o % 9 = 0 THEN NULL WHEN o % 4 = 0 THEN 'application/pdf' ELSE 'text/html' END,
      CASE WHEN o % 9 <> 0 THEN 200 END FROM f2)
  SELECT 'n' || n AS municipality_id, 'n' || n || '::' || ord AS document_id, url AS source_url, referrer_url, mime_type, http_status, depth
  FROM everything WHERE ord < 90""")
def crawl_plain(spark, sf_dir):
    seeds, page_rows, edges = site_graph(spark, sf_dir)
    docs = crawl.plain_crawl(seeds, kept_table(page_rows, "pages"), kept_table(edges, "edges"), max_pages=90)
    return docs.select("municipality_id", "document_id", "source_url", "referrer_url", "mime_type", "http_status", "depth")


@query("url_parts", sql=r"""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS authority, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, split_part(url, '?', 1) AS no_query,
    regexp_extract(url, '([^/]*)$', 1) AS last_segment FROM pages""")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", U.authority("url").alias("authority"), U.host("url").alias("host"), U.path("url").alias("path"),
        U.without_query("url").alias("no_query"), U.last_segment("url").alias("last_segment"))


@query("link_filters", sql=r"""SELECT page_id, regexp_matches(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '\.(html|com)$') AS asset,
    regexp_extract(url, '://([^/?#]*)', 1) = 'thther.example.org' AS internal,
    lower(regexp_extract(url, '://([^/?#]*)', 1)) IN ('thther.example.org', 'spam-farm.example.org') AS allowed,
    contains(lower(url), '/en/') OR contains(lower(url), 'spam') AS gated FROM pages""")
def link_filters(spark, sf_dir):
    domains = F.array(F.lit("Thther.example.org"), F.lit("spam-farm.example.ORG"))
    return table(spark, sf_dir, "pages").select(
        "page_id", U.has_extension("url", ["html", "com"]).alias("asset"),
        U.is_internal("url", F.lit("thther.example.org")).alias("internal"),
        U.domain_allowed("url", domains).alias("allowed"), U.keyword_gate("url", ["/EN/", "spam"]).alias("gated"))


PDF_ROWS = """r AS (SELECT page_id, [NULL, 'application/pdf', 'application/x-pdf', 'text/html'][page_id % 4 + 1] AS mime,
    url || CASE WHEN page_id % 3 = 0 THEN '/a.PDF' WHEN page_id % 3 = 1 THEN '/b.pdf?x=1' ELSE '' END AS u FROM pages)"""


@query("pdf_variants", sql=f"""WITH {PDF_ROWS}
  SELECT page_id, contains(coalesce(mime, ''), 'pdf') OR regexp_matches(split_part(lower(u), '?', 1), '\\.pdf$') AS inspect,
    coalesce(mime, '') = 'application/pdf' OR regexp_matches(lower(u), '\\.pdf$') AS crawl,
    contains(coalesce(mime, ''), 'pdf') OR regexp_matches(lower(u), '\\.pdf$') AS gated FROM r""")
def pdf_variants(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    mime = F.when(k % 4 == 1, "application/pdf").when(k % 4 == 2, "application/x-pdf").when(k % 4 == 3, "text/html")
    url = F.concat("url", F.when(k % 3 == 0, "/a.PDF").when(k % 3 == 1, "/b.pdf?x=1").otherwise(""))
    return p.select("page_id", *[U.is_pdf(mime, url, v).alias(v) for v in ("inspect", "crawl", "gated")])


@query("fetch_decisions", sql="""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN false WHEN l_returnflag = 'R' THEN false ELSE true END AS kept,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'ct_filtered' END AS reason,
    lower(trim(split_part(CASE l_returnflag WHEN 'R' THEN 'image/GIF ; q' ELSE ' Text/HTML; charset=x' END, ';', 1))) AS ct FROM lineitem""")
def fetch_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    ct = U.mime_head(F.when(F.col("l_returnflag") == "R", "image/GIF ; q").otherwise(" Text/HTML; charset=x"))
    tagged = rows.withColumn("ct", ct)
    kept, reason = U.fetch_decision(F.when(F.col("l_linenumber") % 3 == 0, 404).otherwise(200), F.col("ct"), ["text/html"])
    return tagged.select("l_orderkey", "l_linenumber", "l_partkey", kept.alias("kept"), reason.alias("reason"), "ct")


@query("content_dedupe", sql="""SELECT lang AS municipality_id, sha256(text) AS digest, sha256(text) || '.html' AS file_name, count(*) AS copies,
  max(length(text)) AS chars FROM documents GROUP BY lang, text""")
def content_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("municipality_id"), F.col("text").alias("content"))
    return crawl.content_store(docs).select(
        "municipality_id", "digest", "file_name", "copies", F.length("content").cast("long").alias("chars"))


def raw_records(spark, sf_dir) -> DataFrame:
    """pages as raw crawl records in both shapes, with stored files, PDFs and empty rows."""
    k = F.col("page_id")
    no = F.lit(None).cast("string")
    p = pages(spark, sf_dir)
    return p.select(
        "page_id", F.when(k % 2 == 0, F.col("url")).alias("source_url"), F.when((k % 2 == 1) & (k % 13 != 0), F.col("url")).alias("url"),
        F.when(k % 2 == 0, F.lit("a")).otherwise(no).alias("municipality_id"), F.when(k % 2 == 1, F.lit("b")).alias("muni"),
        F.when(k % 5 == 0, F.lit("/raw/x.PDF")).when(k % 5 == 1, F.lit("/raw/y.html")).when(k % 5 == 2, F.lit("/raw/z.bin")).otherwise("").alias("raw_path"),
        F.when(k % 7 != 0, F.col("html")).alias("raw_content"), F.when(k % 5 == 1, F.col("html")).alias("stored"),
        F.lit(" some  pdf\ntext ").alias("pdf_body"), F.when(k % 3 == 0, "error").otherwise("200").alias("status"), F.lit(1).alias("depth"))


@query("extracted_documents", sql=rf"""WITH {CLEAN_SQL}, t AS (SELECT page_id, url, page_id AS k,
    trim(regexp_replace({unescape("regexp_replace(c, '<[^>]*>', chr(10), 'g')")}, '\s+', ' ', 'g')) AS text FROM clean)
  SELECT page_id, url, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS municipality_id,
    CASE WHEN k % 5 = 0 THEN 'some pdf text' WHEN k % 5 = 1 OR k % 7 <> 0 THEN text END AS text,
    CASE WHEN k % 5 = 0 THEN 'pdf' WHEN k % 5 = 1 THEN 'html' ELSE 'html' END AS doc_kind,
    CAST(CASE WHEN k % 3 <> 0 THEN 200 END AS INT) AS http_status
  FROM t WHERE (k % 2 = 0 OR k % 13 <> 0) AND (k % 5 IN (0, 1) OR k % 7 <> 0)""")
def extracted_documents(spark, sf_dir):
    raw = raw_records(spark, sf_dir).withColumn("document_id", F.col("page_id"))
    out = harmonise.keep_extracted(harmonise.extracted_documents(raw, stored_html="stored", pdf_text="pdf_body"))
    return out.select(F.col("document_id").alias("page_id"), "url", "municipality_id", "text", "doc_kind", "http_status")


@query("scope_documents", sql=f"""WITH {CLEAN_SQL}, t AS (SELECT page_id, url, page_id AS k, array_to_string({PIECES_SQL}, ' ') AS text,
    trim({unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ' ' || chr(10)) AS title FROM clean)
  SELECT CAST(page_id AS VARCHAR) AS document_id, CASE WHEN k % 4 = 0 THEN url || '/f.pdf' ELSE url END AS url,
    CASE WHEN k % 4 = 0 THEN 'f.pdf' ELSE title END AS title, CASE WHEN k % 4 = 0 THEN '' ELSE text END AS text,
    CASE WHEN k % 4 = 0 THEN 'application/pdf' WHEN k % 4 = 1 THEN 'text/html; charset=utf-8' ELSE '' END AS mime_type
  FROM t WHERE k % 4 <> 3 AND (k % 4 <> 0 OR NOT contains(url, '?'))""")
def scope_documents(spark, sf_dir):
    """HTML by type or by content, PDFs kept without text, everything else skipped."""
    k = F.col("page_id")
    raw = pages(spark, sf_dir).select(
        k.cast("string").alias("document_id"), F.lit("m").alias("municipality_id"),
        F.when(k % 4 == 0, F.concat("url", F.lit("/f.pdf"))).otherwise(F.col("url")).alias("source_url"),
        F.when(k % 4 == 1, "Text/HTML; charset=utf-8").when(k % 4 == 3, "image/png").alias("content_type"),
        F.when(k % 4 != 3, F.col("html")).alias("raw_content"))
    raw = raw.withColumn("raw_content", F.when(k_of(raw) % 4 != 0, F.col("raw_content")))
    return harmonise.scope_documents(raw).select("document_id", "url", "title", "text", "mime_type")


def k_of(df: DataFrame):
    return F.col("document_id").cast("long")


FILTER_RULES = harmonise.PageFilter(
    allowed_mime=("text/html", "application/*"), disallowed_mime=("application/zip",), min_chars=2000, max_chars=9000,
    include_fragments=("/en/", "/de/"), exclude_fragments=("spam", "#top"), remove_control_characters=True)


@query("page_filter", sql="""SELECT page_id, length(html) AS chars FROM pages
  WHERE page_id % 4 NOT IN (0, 3) AND (contains(lower(url), '/en/') OR contains(lower(url), '/de/'))
    AND NOT contains(lower(url), 'spam') AND NOT contains(lower(url), '#top') AND length(html) BETWEEN 2000 AND 9000""")
def page_filter(spark, sf_dir):
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.concat("html", F.lit("\x07\x01")).alias("text"),
        F.when(k % 4 == 0, "image/png").when(k % 4 == 1, "text/html").when(k % 4 == 2, "application/pdf").otherwise("application/zip").alias("mime_type"))
    return harmonise.filter_pages(p, FILTER_RULES).select("page_id", F.length("text").alias("chars"))


LEVELS = [
    {"id": 0, "html_contains": ["<footer"]}, {"id": 1, "url_suffix": [".html", "/"], "text_contains": ["zzzz"]},
    {"id": 2, "url_contains": ["/en/"], "negative_text": ["cookie"]}, {"id": 3, "html_contains": ["onon"], "negative_text": ["then"]},
]


@query("declared_digitalization", sql=r"""SELECT page_id, CAST(greatest(CASE WHEN contains(html, '<footer') THEN 0 END,
    CASE WHEN regexp_matches(lower(url), '(\.html|/)$') OR contains(html, 'zzzz') THEN 1 END,
    CASE WHEN contains(url, '/en/') AND NOT contains(html, 'cookie') THEN 2 END,
    CASE WHEN contains(html, 'onon') AND NOT contains(html, 'then') THEN 3 END) AS INT) AS level FROM pages""")
def declared_digitalization(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", H.declared_digitalization("url", "html", "html", LEVELS).alias("level"))


@query("declared_digitalization_default", sql=r"""SELECT CAST(greatest(
    CASE WHEN contains(html, '<address') OR contains(html, 'mailto:') THEN 0 END,
    CASE WHEN contains(html, 'download') OR contains(html, 'href="/media') OR contains(html, 'href="/fileadmin') THEN 1 END,
    CASE WHEN contains(html, 'mailto:') THEN 2 END,
    CASE WHEN contains(html, '<form') OR contains(html, 'type="submit"') THEN 3 END,
    CASE WHEN contains(html, 'eID') OR contains(html, 'bundid') OR contains(html, 'npa') OR contains(html, 'servicekonto')
      OR contains(url, 'ozg') THEN 4 END) AS INT) AS level, count(*) AS n FROM pages GROUP BY ALL""")
def declared_digitalization_default(spark, sf_dir):
    level = H.declared_digitalization("url", "html", "html", DIGITALIZATION_LEVELS)
    return table(spark, sf_dir, "pages").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
