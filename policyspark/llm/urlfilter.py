"""URL filters: dated list entries become validity intervals, joined as of the fetch time.

``intervals`` turns the add and remove events of block and allow lists into
half-open validity intervals; ``evaluate`` finds, for every capture, the most
specific entry that was active when it was fetched. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)"


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals of list entries.

    :param events: columns list_name, action (``block`` or ``allow``), entry,
        day (date), added (boolean). An event holds from its day until the
        next event of the same list, action and entry; several events on one
        day count as one, and an addition among them wins. Rows with a null
        entry, day or ``added`` take no part; repeated rows change nothing.
    :return: list_name, action, entry, active_from, active_to (exclusive; null
        while the entry stays active). An empty table gives no interval.

    The events of a day are combined before the window, so a window holds one
    row a day and entry however often an entry repeats.
    """
    daily = (
        events.where("entry IS NOT NULL AND day IS NOT NULL AND added IS NOT NULL")
        .groupBy("list_name", "action", "entry", "day").agg(F.max("added").alias("added"))
    )
    order = Window.partitionBy("list_name", "action", "entry").orderBy("day")
    changes = daily.withColumn("_before", F.lag("added").over(order)).where(
        "added IS DISTINCT FROM _before")  # an addition of an active entry changes nothing
    return (
        changes.withColumn("active_to", F.lead("day").over(order)).where("added")
        .select("list_name", "action", "entry", F.col("day").alias("active_from"), "active_to")
    )


def evaluate(captures: DataFrame, valid: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """Judge every capture by the list entries active on its day.

    An entry is a host (which covers its subdomains) or a host with a first
    path segment (``a.example/b``). Of the active entries the most specific
    decides: one with a path before one without, then the longer host; of
    equals ``allow`` before ``block``, then the smaller list name, then the
    later start.

    Every capture row is returned once, also repeated rows and rows whose url
    or day is null or holds no host; those, and captures no entry covers, get
    the verdict ``unlisted``. Added columns: host, verdict (``block``,
    ``allow``, ``unlisted``), list_name, entry, active_from, active_to; input
    columns of these names are replaced.

    Captures are reduced to their distinct (host, segment, day) before the
    as-of join, so a host with a third of all captures meets the lists once a
    day and segment; the way back is a plain left join that adaptive execution
    may split.
    """
    added = {"host", "verdict", "list_name", "entry", "active_from", "active_to"}
    kept = [c for c in captures.columns if c.lower() not in added]
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1)), F.lit(""))
    rows = captures.select(*[F.col(f"`{c}`") for c in kept], host.alias("_host"),
                           F.regexp_extract(F.coalesce(F.col(url), F.lit("")), PATH, 1).alias("_path"),
                           F.col(day).alias("_day"))
    sites = rows.select("_host", "_path", "_day").where("_host IS NOT NULL AND _day IS NOT NULL").distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = sites.select("*", F.explode(F.concat(
        F.transform(suffixes, lambda s: F.struct(F.lit(0).alias("path"), F.length(s).alias("size"), s.alias("key"))),
        F.transform(suffixes, lambda s: F.struct(F.lit(1).alias("path"), F.length(s).alias("size"),
                                                 F.concat(s, F.col("_path")).alias("key"))),
    )).alias("_k")).select("_host", "_path", "_day", "_k.*").where("path = 0 OR length(_path) > 1")
    rank = F.struct("path", "size", (F.col("action") == "allow").alias("allows"),
                    F.concat(F.transform(F.split("list_name", ""), lambda c: -F.ascii(c)), F.array(F.lit(0))).alias("name"),
                    "active_from")
    best = (
        keys.join(valid, F.col("key") == F.col("entry"))
        .where("active_from <= _day AND (active_to IS NULL OR _day < active_to)")
        .groupBy("_host", "_path", "_day")
        .agg(F.max_by(F.struct("action", "list_name", "entry", "active_from", "active_to"), rank).alias("_best"))
    )
    return rows.join(best, ["_host", "_path", "_day"], "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col("_host").alias("host"),
        F.coalesce("_best.action", F.lit("unlisted")).alias("verdict"), "_best.list_name", "_best.entry",
        "_best.active_from", "_best.active_to",
    )


def _digit(text: str, at: int) -> str:
    return f"(instr('0123456789abcdef', substr(md5({text}), {at}, 1)) - 1)"


def _date(days: str, spark: bool) -> str:
    return (f"date_add(DATE'2024-01-01', CAST({days} AS INT))" if spark
            else f"(DATE '2024-01-01' + CAST({days} AS INTEGER))")


def _event_sql(spark: bool) -> str:
    """Dated list events derived from the hosts of the captures: three lists, up to three events an entry."""
    parts = []
    for name, action, entry, salt in (("ads", "block", "domain", "a"), ("harmful", "block", "host", "h"),
                                      ("sections", "block", "section", "s"), ("trusted", "allow", "host", "t")):
        digest = f"'{salt}' || {entry}"
        start = f"{_digit(digest, 2)} * 12 + {_digit(digest, 3)}"
        for k, flag in enumerate(("TRUE", "FALSE", "TRUE")):
            parts.append(
                f"SELECT '{name}' AS list_name, '{action}' AS action, {entry} AS entry, "
                f"{_date(f'{start} + {k} * (5 + 6 * {_digit(digest, 4)})', spark)} AS day, {flag} AS added "
                f"FROM sites WHERE {_digit(digest, 1)} < {4 + 3 * (action == 'allow')} AND {_digit(digest, 5)} >= {5 * k}")
    return " UNION ALL ".join(parts)


_EVENTS = """WITH hosts AS (SELECT DISTINCT {host} AS host, {path} AS path FROM pages),
  sites AS (SELECT DISTINCT host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain, host || path AS section
            FROM hosts WHERE host <> '' AND length(path) > 1)"""


def list_events(pages: DataFrame) -> DataFrame:
    """Dated events of four lists over the hosts, domains and sections that occur in ``pages``."""
    pages.select("url").createOrReplaceTempView("_url_filter_pages")
    head = _EVENTS.format(host=f"lower(regexp_extract(coalesce(url, ''), r'{HOST}', 1))",
                          path=f"regexp_extract(coalesce(url, ''), r'{PATH}', 1)")
    return pages.sparkSession.sql(f"{head} {_event_sql(True)}".replace("FROM pages", "FROM _url_filter_pages"))


_ORACLE = f"""{_EVENTS.format(host=f"lower(regexp_extract(coalesce(url, ''), '{HOST}', 1))",
                              path=f"regexp_extract(coalesce(url, ''), '{PATH}', 1)")},
  events AS (SELECT DISTINCT * FROM ({_event_sql(False)})),
  daily AS (SELECT list_name, action, entry, day, bool_or(added) AS added FROM events GROUP BY ALL),
  marked AS (SELECT *, lag(added) OVER (PARTITION BY list_name, action, entry ORDER BY day) AS before FROM daily),
  valid AS (SELECT * FROM (SELECT list_name, action, entry, day AS active_from, added,
              lead(day) OVER (PARTITION BY list_name, action, entry ORDER BY day) AS active_to
            FROM marked WHERE added IS DISTINCT FROM before) WHERE added),
  rows_ AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
              regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path,
              DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetch_day FROM pages),
  hits AS (SELECT r.page_id, v.*, CASE WHEN contains(v.entry, '/') THEN 1 ELSE 0 END AS has_path
           FROM rows_ r JOIN valid v ON (r.host = v.entry OR ends_with(r.host, '.' || v.entry)
             OR (length(r.path) > 1 AND (r.host || r.path = v.entry OR ends_with(r.host || r.path, '.' || v.entry))))
           AND v.active_from <= r.fetch_day AND (v.active_to IS NULL OR r.fetch_day < v.active_to)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY has_path DESC, length(entry) DESC,
             CASE action WHEN 'allow' THEN 0 ELSE 1 END, list_name, active_from DESC) AS rn FROM hits) WHERE rn = 1)
SELECT r.page_id, r.url, r.fetch_day, NULLIF(r.host, '') AS host, coalesce(b.action, 'unlisted') AS verdict, b.list_name,
  b.entry, b.active_from, b.active_to FROM rows_ r LEFT JOIN best b ON b.page_id = r.page_id"""


@query("op10_url_filter", _ORACLE)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of ``pages`` against four dated lists, as of its fetch day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.expr("date_add(DATE'2024-01-01', CAST(page_id % 366 AS INT))"))
    return evaluate(captures, intervals(list_events(pages)))
