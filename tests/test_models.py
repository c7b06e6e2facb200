"""Independent plain-Python models, compared row for row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from policyspark.functions import html as H
from policyspark.functions import text as T
from policyspark.functions import urls as U
from policyspark.operators import crawl


def pack(text, limit=900):
    out = []
    for block in re.split(r"\n\s*\n", text or ""):
        flat = " ".join(block.split())
        pieces, current = [], ""
        for sentence in re.split(r"(?<=[.!?])\s+", flat) if flat else []:
            joined = f"{current} {sentence}" if current else sentence
            if current and len(joined) > limit:
                pieces.append(current)
                joined = sentence
            current = joined
        out += pieces + ([current] if current else [])
    return out


def test_snippets_match_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("text", T.snippets("text").alias("s")).collect()
    assert rows and all(r.s == pack(r.text) for r in rows)
    # nothing is lost: the pieces give back the normalised text
    flat = docs.select(T.snippets("text").alias("s"), T.collapse_spaces("text").alias("f")).collect()
    assert all(" ".join(r.s) == r.f for r in flat)


def test_snippets_on_odd_texts(spark):
    rng = random.Random(5)
    alphabet = ["a", "bb", "ccc.", "d!", "e?", "\n", "\n\n", " ", "\t", "\xa0", "é" * 30, "x" * 70, "😀.", ". ."]
    texts = ["".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", T.snippets("t", 60).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pack(text, 60), repr(text)


PAGES = [
    ('<title> A &amp; B </title><h1>H</h1><p>x <b>y<br>z</p>', "A & B"),
    ("<h1>Only <i>head</i></h1><p>t</p>", None),
    ('<title></title><h1>Head</h1>', None),
    ('<script>var t="</p>";</script><style>p{}</style><p>a<!-- c -->b</p><noscript>n</noscript>', None),
]


def test_page_text_modes(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "i int, h string")
    fields = ["title", "title_or_h1", "text", "text_spaced", "text_lines"]
    rows = [r for r in df.select("i", H.page_parts("h", F.lit("https://a.de/"), fields).alias("p")).orderBy("i").select("p.*").collect()]
    assert [r.title for r in rows] == [t for _, t in PAGES]
    assert [r.title_or_h1 for r in rows] == ["A & B", "Onlyhead", "Head", None]
    assert rows[0].text == "A & B H x y z" and rows[0].text_spaced == "A & B H x y z"
    assert rows[3].text == "a b n" and rows[3].text_lines == "a\nb"


def test_missing_page_is_null(spark):
    df = spark.createDataFrame([(None,), ("",)], "h string")
    assert all(r.p.text is None and r.p.links is None for r in df.select(H.page_parts("h", F.lit("u"), ["text", "links"]).alias("p")).collect())


def test_links(spark):
    page = ('<a href="../umwelt-klima/">Klima</a><a href="https://b.de/klima">x</a><a href="/klima.pdf">y</a><a>none</a>'
            '<a href="mailto:klima@a.de">Mail klima</a><a href>empty</a>')
    df = spark.createDataFrame([("m", "https://a.de/x/", page)], "municipality_id string, base_url string, html string")
    links = df.select(F.explode(H.page_parts("html", "base_url", ["links"])["links"]).alias("l")).select("l.*").collect()
    assert [r.url for r in links] == ["https://a.de/umwelt-klima/", "https://b.de/klima", "https://a.de/klima.pdf",
                                      "mailto:klima@a.de", "https://a.de/x/"]
    found = crawl.link_candidates(df, ["klima", "umwelt"]).orderBy("pos").collect()
    # two keywords and the bonus in the path, one keyword in the anchor; mailto passes as internal
    assert [(r.url, r.score) for r in found] == [("https://a.de/umwelt-klima/", 8), ("mailto:klima@a.de", 4)]


def test_url_parts(spark):
    urls = ["https://U@A.de:8/x/y.html;p=1?q#f", "mailto:a@b.de", "/rel/x.PDF", "//h/p", "https://a.de", "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    rows = df.select("i", U.host("u").alias("h"), U.path("u").alias("p")).orderBy("i").collect()
    assert [(r.h, r.p) for r in rows] == [("u@a.de:8", "/x/y.html"), ("", "a@b.de"), ("", "/rel/x.PDF"), ("h", "/p"), ("a.de", ""),
                                          ("", ""), (None, None)]


def random_site(seed, pages=60):
    rng = random.Random(seed)
    urls = [f"https://{rng.choice(['a.de', 'b.de'])}/{'klima' if rng.random() < .7 else 'other'}/{i}{rng.choice(['', '.pdf', '', '.jpg'])}" for i in range(pages)]
    table = {}
    for u in urls:
        if rng.random() < .1:
            continue
        links = [(rng.choice(urls), rng.choice(["Klima", "mehr", ""])) for _ in range(rng.randint(0, 8))]
        table[u] = (rng.choice([200] * 8 + [404, 500]), rng.choice(["text/html; x", "text/html", "application/pdf", "image/png"]), links)
    return urls, table


def gated_model(seed_url, domains, words, lim, table):
    """Level by level: collect the level's urls in order, judge each, hand on the links of the kept ones."""
    def wanted(url, anchor):
        return (not domains or url.split("/")[2] in domains) and any(w in (url + "\n" + anchor).lower() for w in words)

    spent = {"docs": 0, "pdfs": 0, "reqs": 0}
    rows, known = [], {seed_url}
    level = [seed_url] if not domains or seed_url.split("/")[2] in domains else []
    for depth in range(lim.max_depth + 1):
        following = []
        for url in level:
            if spent["docs"] >= lim.max_docs or spent["reqs"] >= lim.max_requests:
                return sorted(rows, key=str)
            verdict, links = judge(url, table, spent["pdfs"] >= lim.max_pdfs)
            rows.append((url, depth, *verdict))
            kept, pdf = verdict[1] is True, url.endswith(".pdf") or "pdf" in table.get(url, (0, ""))[1]
            spent["reqs"] += verdict[0] != "error"
            spent["docs"] += kept
            spent["pdfs"] += kept and pdf
            following += [u for u, a in links if kept and not pdf and wanted(u, a)]
        level = [u for u in dict.fromkeys(following) if u not in known]
        known.update(level)
    return sorted(rows, key=str)


def judge(url, table, pdfs_full):
    """((status, kept, reason), links) of one url."""
    if url not in table:
        return ("error", None, None), []
    status, ct, links = table[url]
    kind = ct.partition(";")[0].strip()
    reason = None
    if status < 400 and kind not in ("text/html", "application/pdf"):
        reason = "ct_filtered"
    elif status < 400 and pdfs_full and ("pdf" in kind or url.endswith(".pdf")):
        reason = "pdf_cap"
    return (str(status), status < 400 and reason is None, reason), links


def page_frames(spark, table):
    rows = [(u, s, ct, f"k{u}") for u, (s, ct, _) in table.items()]
    edges = [(u, i, a, b) for u, (_, _, links) in table.items() for i, (a, b) in enumerate(links)]
    return (spark.createDataFrame(rows, "url string, status int, ct string, content_key string"),
            spark.createDataFrame(edges, "url string, pos int, link string, anchor string"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gated_crawl_matches_a_queue(spark, seed):
    urls, table = random_site(seed)
    munis = {"m1": (urls[0], ["a.de", "b.de"]), "m2": (urls[1], []), "m3": (urls[2], ["a.de"])}
    lim = crawl.CrawlLimits(max_depth=3, max_docs=12, max_pdfs=2, max_requests=20)
    seeds = spark.createDataFrame([(m, u, d) for m, (u, d) in munis.items()], "muni string, url string, allowed_domains array<string>")
    got = crawl.gated_crawl(seeds, *page_frames(spark, table), ["KLIMA"], lim).collect()
    for m, (u, domains) in munis.items():
        mine = sorted(((r.url, r.depth, r.status, r.kept, r.reason) for r in got if r.muni == m), key=str)
        assert mine == gated_model(u, domains, ["klima"], lim, table)


def test_crawl_over_html(spark):
    """Page and edge tables built from markup: relative links resolve against the page."""
    home = '<a href="klima/a">Klima</a><a href="/other">x</a><a href="https://b.de/klima">away</a>'
    pages = spark.createDataFrame([("https://a.de/", home), ("https://a.de/klima/a", '<a href="b">mehr Klima</a>')], "url string, html string")
    seeds = spark.createDataFrame([("m", "https://a.de/", ["A.de"])], "muni string, url string, allowed_domains array<string>")
    got = crawl.gated_crawl(seeds, crawl.page_table(pages), crawl.page_edges(pages), ["klima"]).collect()
    assert sorted((r.url, r.depth, r.status) for r in got) == [
        ("https://a.de/", 0, "200"), ("https://a.de/klima/a", 1, "200"), ("https://a.de/klima/b", 2, "error")]


def plain_model(muni, seeds, max_pages, max_depth, max_pdfs, table):
    rows, known, pdfs = [], set(), 0
    level = [(u, None) for u in seeds]
    for depth in range(max_depth + 1):
        fresh = {}
        for url, ref in level:
            if url not in known and not url.endswith(".jpg"):
                fresh.setdefault(url, ref)
        known.update(fresh)
        level = []
        for url, ref in fresh.items():
            status, ct, links = table.get(url, (None, "", []))
            kind = ct.partition(";")[0].strip()
            content = url in table and 200 <= status < 400
            pdf = content and (kind == "application/pdf" or url.endswith(".pdf"))
            stored = pdf and pdfs < max_pdfs
            pdfs += stored
            rows.append((f"{muni}::{len(rows)}", url, ref, status, depth, stored))
            if content and not pdf and kind == "text/html" and status < 300:
                level += [(u, url) for u, _ in links]
    return rows[:max_pages]


@pytest.mark.parametrize("seed", [4, 5])
def test_plain_crawl_matches_a_queue(spark, seed):
    urls, table = random_site(seed)
    starts = {"m1": urls[:3], "m2": [urls[7], urls[7], urls[4]]}
    seeds = spark.createDataFrame([(m, u, i) for m, us in starts.items() for i, u in enumerate(us)], "muni string, url string, position int")
    got = crawl.plain_crawl(seeds, *page_frames(spark, table), max_pages=25, max_depth=3, max_pdfs=3).collect()
    for m, us in starts.items():
        mine = {(r.document_id, r.source_url, r.referrer_url, r.http_status, r.depth, r.raw_path is not None) for r in got if r.municipality_id == m}
        assert mine == set(plain_model(m, us, 25, 3, 3, table))


def test_plain_crawl_looks_up_only_what_the_cap_lets_through(spark, monkeypatch):
    """Links beyond the page cap meet no page, and pages that no kept link names meet no link (F14); a page stored twice still counts twice."""
    from policyspark.operators import crawl

    looked_up, lookup = [], crawl.lookup
    monkeypatch.setattr(crawl, "lookup", lambda facts, table, keys: looked_up.append((facts.count(), table.count())) or lookup(facts, table, keys))
    home, urls = "https://a.example/", [f"https://a.example/p{i}" for i in range(300)]
    stored = [home, *urls, urls[2]]
    pages = spark.createDataFrame([(u, 200, "text/html", u) for u in stored], "url string, status int, ct string, content_key string")
    edges = spark.createDataFrame([(home, i, u, "") for i, u in enumerate(urls)], "url string, pos int, link string, anchor string")
    seeds = spark.createDataFrame([("m", home, 0)], "muni string, url string, position int")
    got = crawl.plain_crawl(seeds, pages, edges, max_pages=10, max_depth=1).orderBy("depth", "document_id").collect()
    assert looked_up == [(1, 1), (9, 10)]
    assert [r.source_url for r in got] == sorted([home, *urls[:8], urls[2]])
    assert [r.document_id for r in got] == [f"m::{i}" for i in range(10)]


def test_feature_table_equals_the_features_of_the_classifier(spark, sf_dir):
    """With more buckets than terms, a text's weights are those of the feature table."""
    from pyspark.ml.feature import HashingTF

    from policyspark.operators import bootstrap

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").limit(40)
    rows = docs.select("doc_id", "text", F.col("quality").alias("label")).checkpoint()
    model = bootstrap.train_classifier(rows, iterations=1, buckets=1 << 24)
    hashing = next(s for s in model.stages if isinstance(s, HashingTF))
    want = {(r.doc_id, i): w for r in model.transform(rows).select("doc_id", "__features").collect()
            for i, w in zip(r["__features"].indices.tolist(), r["__features"].values.tolist()) if w}
    table = [(r.doc_id, hashing.indexOf(r.term), r.weight) for r in bootstrap.tfidf_weights(rows, "doc_id", "text").collect()]
    got = {(d, i): w for d, i, w in table}
    assert len(got) == len(table) and got.keys() <= want.keys()
    lost = len(want) - len(got)  # buckets that rare terms share by chance count as frequent
    assert lost < 0.01 * len(want)
    assert sum(abs(got[k] - want[k]) > 0.02 for k in got) == 0


def test_feature_table_counts_terms_inside_the_row(spark):
    """Rows of terms travel to their term and to their text, never by both; keys repeat, are null, and terms are frequent."""
    import re
    from collections import Counter
    from math import log, sqrt

    from policyspark.operators import bootstrap

    data = [(i, f"the Word{i % 7} and Word{i % 5} x the end{i} das, ÄPFEL und-so") for i in range(40)]
    data += [(3, "the end3 again"), (None, "the word1 end1"), (None, "und so"), (90, None), (91, " . "), (92, "word1")]
    table = bootstrap.tfidf_weights(spark.createDataFrame(data, "k long, t string"), "k", "t")
    tf = {}
    for k, t in data:
        w = re.findall(r"\b\w\w+\b", (t or "").lower())
        tf.setdefault(k, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(term for c in tf.values() for term in c)
    n, want = len(data), {}
    for k, c in tf.items():
        raw = {x: f * (log((n + 1) / (df[x] + 1)) + 1) for x, f in c.items() if 2 <= df[x] <= 0.95 * n}
        if k is not None:
            want |= {(k, x): v / sqrt(sum(u * u for u in raw.values())) for x, v in raw.items()}
    got = table.collect()
    assert len(got) == len(want) and all(abs(want[r.k, r.term] - r.weight) < 1e-9 for r in got)
    assert not re.search(r"hashpartitioning\(k#\d+L?, term", table._jdf.queryExecution().executedPlan().toString())


def test_classifier_passes_send_as_many_vectors_as_there_are_cores(spark, monkeypatch):
    """Each pass of the regression sends a vector over the buckets from every partition (F9): more partitions of rows make no more."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF
    from policyspark.operators.bootstrap import train_classifier

    seen = []
    for kind in (IDF, LogisticRegression):
        monkeypatch.setattr(kind, "fit", lambda self, rows, fit=kind.fit: seen.append((rows.rdd.getNumPartitions(), rows.count())) or fit(self, rows))
    rows = spark.createDataFrame([(f"word{i % 9} other{i % 7}", i % 2) for i in range(200)], "text string, label int")
    train_classifier(rows, iterations=2, buckets=64, partitions=23)
    assert seen == [(spark.sparkContext.defaultParallelism, 200)] * 2


def test_classifier_holds_nothing_that_grows_with_the_vocabulary(spark):
    from policyspark.operators import bootstrap

    rows = spark.createDataFrame([(i, " ".join(f"w{i * 50 + j} {'yes' if i % 2 else 'no'}thing" for j in range(50)), i % 2)
                                  for i in range(60)], "doc_id long, text string, label int")
    model = bootstrap.train_classifier(rows, iterations=20, buckets=256)
    assert all(len(v.toArray()) == 256 for v in (model.stages[-1].coefficients, model.stages[-3].getScalingVec()))
    got = bootstrap.predict_table(model, rows, "label", "doc_id")
    assert got.where("gold_label = pred_label").count() >= 58


def test_visited_rows_are_not_shuffled_again(spark):
    """Three levels on, new links still meet the visited table in its buckets."""
    from policyspark.operators import crawl

    visited = crawl.Visited(spark)
    for depth in range(3):
        visited.add(spark.createDataFrame([(f"m{i % 4}", f"u{depth}-{i}") for i in range(40)], "muni string, url string"))
    links = spark.createDataFrame([(f"m{i % 4}", f"u{i % 5}-{i}", i) for i in range(100)], "muni string, url string, ord long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fresh = visited.unseen(links.groupBy("muni", "url").agg(F.min("ord").alias("ord")))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        seen = {(f"m{i % 4}", f"u{d}-{i}") for d in range(3) for i in range(40)}
        want = {(f"m{i % 4}", f"u{i % 5}-{i}") for i in range(100)} - seen
        assert {(r.muni, r.url) for r in fresh.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        visited.drop()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # that of the aggregation of new links
