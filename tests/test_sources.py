"""Readers and writers on real files."""

import json

import pytest
from pyspark.sql import functions as F

from policyspark import schemas
from policyspark.operators import harmonise
from policyspark.plans import stages
from policyspark.sources import ndjson, sinks, tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_ndjson_modes(spark, tmp_path):
    path = write(tmp_path / "a.ndjson", '{"a": 1, "b": "ü"}\n\nnot json\n[1]\n{"a": 2}\n')
    assert [r.a for r in ndjson.read_ndjson(spark, path, "a int, b string").orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception):
        ndjson.read_ndjson(spark, path, "a int", on_bad="fail").collect()
    assert ndjson.read_ndjson(spark, path, "a int", on_bad="flag").where("_broken").count() == 2
    placed = ndjson.read_ndjson(spark, path, "a int", with_position=True).orderBy("ord").collect()
    assert [r.a for r in placed] == [1, 2]
    with pytest.raises(FileNotFoundError):
        ndjson.read_ndjson(spark, str(tmp_path / "none"), "a int")
    assert ndjson.read_ndjson(spark, str(tmp_path / "none"), "a int", on_missing="empty").count() == 0
    counters = ndjson.line_counters(spark.read.text(path)).first()
    assert (counters.rows_total, counters.empty_lines, counters.parse_errors) == (4, 1, 2)


def test_ndjson_write_keeps_nulls_and_appends(spark, tmp_path):
    df = spark.createDataFrame([("ä", None)], "a string, b int")
    out = str(tmp_path / "out")
    sinks.write_ndjson(df, out)
    sinks.write_ndjson(df, out, append=True)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines == ['{"a":"ä","b":null}'] * 2


def test_crawl_index_of_varying_shape(spark, tmp_path):
    out = str(tmp_path / "index")
    sinks.write_crawl_index(spark.createDataFrame([("m", "u", 0, "error", "timeout")], "muni string, url string, depth int, status string, error string"), out)
    sinks.write_crawl_index(spark.createDataFrame([("n", "v", 1, "200", True)], "muni string, url string, depth int, status string, kept boolean"), out)
    back = ndjson.read_ndjson(spark, out + "/*/*.json", schemas.CRAWL_INDEX.replace("muni string, ", ""))
    assert sorted((r.url, r.status, r.kept) for r in back.collect()) == [("u", "error", None), ("v", "200", True)]


def test_municipality_sources(spark, tmp_path):
    meta = tmp_path / "meta"
    meta.mkdir()
    assert tables.read_municipalities(spark, str(meta)).count() == 0
    write(meta / "municipalities.ndjson", '{"municipality_id": "x", "name": "X"}\n')
    assert tables.read_municipalities(spark, str(meta)).first().name == "X"
    write(meta / "municipalities.csv", 'municipality_id,name,base_url,admin_level,population\na,"A, Stadt",https://a,city,12\nb,,https://b,,\n,no,https://c,,\nd,D,,,\n')
    rows = {r.municipality_id: r for r in tables.read_municipalities(spark, str(meta)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].population == 12 and rows["b"].population is None
    assert rows["a"].official_name == "A, Stadt" and rows["b"].name == "b" and rows["b"].source == "municipalities.csv"


def test_sample_municipalities(spark):
    assert tables.sample_municipalities(spark, "de_sample").count() == 2
    assert tables.sample_municipalities(spark, "other").count() == 0


def test_discovered_seeds_last_row_wins(spark, tmp_path):
    write(tmp_path / "discovered_seeds.ndjson",
          '{"municipality_id": "a", "discovered_seeds": ["1", null]}\n{"municipality_id": "a", "discovered_seeds": ["2", "3"]}\n{"municipality_id": "b"}\n')
    assert {r.municipality_id: r.discovered_seeds for r in tables.read_discovered_seeds(spark, str(tmp_path)).collect()} == {"a": ["2", "3"]}
    assert tables.read_discovered_seeds(spark, str(tmp_path / "none")).count() == 0


def test_crawl_targets(spark):
    config = {"communes": [{"id": "m", "seed_url": "https://a", "allowed_domains": "a"}, {"name": "n", "url": "https://b", "domains": ["b", "c"]}, "skip"]}
    got = {r.muni: (r.url, r.allowed_domains) for r in tables.crawl_targets(spark, config).collect()}
    assert got == {"m": ("https://a", ["a"]), "n": ("https://b", ["b", "c"])}
    with pytest.raises(ValueError):
        tables.crawl_targets(spark, {"communes": [{"id": "m"}]})
    with pytest.raises(ValueError):
        tables.crawl_targets(spark, {})
    rows = spark.createDataFrame([("m", "https://a", "a")], "name string, start_url string, domains string")
    assert tuple(tables.target_rows(rows).first()) == ("m", "https://a", ["a"])


def test_csv_sources(spark, tmp_path):
    gold = write(tmp_path / "gold.csv", 'candidate_id,text,gold_is_policy_measure\n1,"a ""q""\nb",1\n')
    row = tables.read_gold(spark, gold, "text").first()
    assert row.text == 'a "q"\nb' and row.gold_is_policy_measure == 1
    with pytest.raises(ValueError, match="rule_label"):
        tables.read_weak_pool(spark, gold)
    weak = write(tmp_path / "weak.csv", "candidate_id,text,rule_label,rule_score\n1,a,1.0,3\n2,b,,x\n")
    rows = tables.read_weak_pool(spark, weak).orderBy("candidate_id").collect()
    assert [(r.rule_label, r.rule_score) for r in rows] == [(1, 3.0), (None, None)]
    preds = write(tmp_path / "p.csv", "candidate_id,gold_label,pred_label,abstained,confidence\n1,1,1.0,False,0.9\n2,0,,True,bad\n")
    rows = tables.read_predictions(spark, preds).orderBy("candidate_id").collect()
    assert [(r.pred_label, r.abstained, r.confidence) for r in rows] == [(1, False, 0.9), (None, True, 0.0)]
    semi = write(tmp_path / "s.csv", "a;b\n1;2\n3;4\n")
    assert tables.read_csv_sniffed(spark, semi).columns == ["a", "b"]
    assert tables.read_csv_sniffed(spark, weak).columns[0] == "candidate_id"


def test_page_files_with_bad_bytes(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.html").write_bytes(b"<title>T\xff</title><p>x</p>")
    (folder / "b.pdf").write_bytes(b"%PDF")
    files = tables.page_files(spark, str(folder))
    assert files.count() == 1
    raw = spark.createDataFrame([("m", "u1", str(folder / "a.html")), ("m", "u2", str(folder / "gone.html")), ("m", "u3", str(folder / "b.pdf"))],
                                "muni string, url string, raw_path string")
    docs = stages.extract(tables.with_stored_pages(raw, files), stored_html="stored_html").collect()
    assert [(d.url, d.title, d.text, d.doc_kind) for d in docs] == [("u1", "T�", "T� x", "html")]
    every = harmonise.extracted_documents(tables.with_stored_pages(raw, files), stored_html="stored_html")
    assert {r.url: r.doc_kind for r in every.collect()} == {"u1": "html", "u2": "html", "u3": "pdf"}


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(1), spark.range(2)
    assert sinks.write_table(two, path, dry_run=True) == 2
    sinks.write_table(one, path)
    sinks.write_table(two, path)
    assert spark.read.parquet(path).count() == 1
    sinks.write_table(two, path, force=True)
    assert spark.read.parquet(path).count() == 2


def test_csv_exports(spark, tmp_path):
    from policyspark.vocabulary import ANALYSIS_COLUMNS, LABELING_EMPTY_COLUMNS, MEASURE_CSV_COLUMNS

    docs = spark.createDataFrame([("m", "d", "t\r\nx", 1)], "municipality_id string, document_id string, text string, ord int")
    measures = docs.select("municipality_id", "document_id", F.array(F.lit("a"), F.lit("b")).alias("target_sectors"), "ord")
    munis = spark.createDataFrame([("m", "M", 1)], "municipality_id string, name string, ord int")
    table = stages.analysis(measures, docs, munis, "s")
    sinks.write_analysis_csv(table, str(tmp_path / "a"))
    back = tables.read_csv(spark, str(tmp_path / "a"))
    assert back.columns == ANALYSIS_COLUMNS and back.first().target_sectors == "a|b"
    sinks.write_analysis_csv(table.limit(0), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).count() == 0
    sinks.write_measure_csv(measures.withColumn("baseline_keywords", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "m"))
    row = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert row.columns == MEASURE_CSV_COLUMNS and row.first().baseline_keywords == "x, y"
    sinks.write_labeling_csv(docs, str(tmp_path / "l"), 3)
    row = spark.read.option("header", True).csv(str(tmp_path / "l"))
    assert row.first().text == "t  " and row.columns[-5:] == LABELING_EMPTY_COLUMNS


def test_reports_and_predictions(spark, tmp_path):
    sinks.write_report_json(spark.createDataFrame([(1, None)], "n int, m double"), str(tmp_path / "r"))
    assert json.loads((tmp_path / "r").read_text()) == {"n": 1, "m": None}
    sinks.write_predictions_csv(spark.createDataFrame([("1", None)], "candidate_id string, pred_label int"), str(tmp_path / "p"))
    lines = {line for part in (tmp_path / "p").glob("part-*.csv") for line in part.read_text().splitlines()}
    assert lines == {"candidate_id,pred_label", "1,"}
    from policyspark.operators.gate import operating_points

    sinks.write_operating_points(operating_points(spark.createDataFrame([("a", 0.5)], "s string, coverage double"), "s"), str(tmp_path / "o"))
    back = spark.read.option("header", True).csv(str(tmp_path / "o/table_metrics_rounded.csv")).first()
    assert back.coverage == "0.50" and back.precision is None
    sinks.write_predictions_csv(spark.createDataFrame([("1", None)], "candidate_id string, pred_label int"), str(tmp_path / "named.csv"), named=True)
    assert (tmp_path / "named.csv").read_text().splitlines() == ["candidate_id,pred_label", "1,"]
    assert {f.name.lstrip(".").removesuffix(".crc") for f in (tmp_path / "o").iterdir()} == {"table_metrics.csv", "table_metrics_rounded.csv"}


def test_a_named_report_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = tmp_path / "metrics.json"
    sinks.write_report_json(spark.createDataFrame([(1,)], "n int"), str(path))
    broken = spark.range(1).select(F.raise_error(F.lit("lost")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_report_json(broken, str(path))
    assert json.loads(path.read_text()) == {"n": 1}
    sinks.write_report_json(spark.createDataFrame([(2,)], "n int"), str(path))
    assert json.loads(path.read_text()) == {"n": 2}
    assert not [f for f in tmp_path.iterdir() if "draft" in f.name]
    (tmp_path / "old.json").mkdir()
    (tmp_path / "old.json" / "part-0.json").write_text("{}")
    sinks.write_report_json(spark.createDataFrame([(3,)], "n int"), str(tmp_path / "old.json"))
    assert json.loads((tmp_path / "old.json").read_text()) == {"n": 3}
    empty = spark.createDataFrame([], "a int, b string")
    sinks.publish(empty, str(tmp_path / "none.csv"), lambda writer, to: sinks.csv_options(writer).csv(to))
    assert (tmp_path / "none.csv").read_text().strip() in ("", "a,b")


def test_content_store(spark, tmp_path):
    from policyspark.operators.crawl import content_store

    pages = spark.createDataFrame([("m", "x"), ("m", "x"), ("m", "y"), ("n", "x")], "municipality_id string, content string")
    sinks.write_content_store(content_store(pages), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 3 and back.where("content = 'x' and municipality_id = 'm'").first().copies == 2


def test_content_store_of_a_hot_municipality_and_of_two_runs(spark, tmp_path):
    """Pages of one municipality are spread over tasks; runs that overlap add rows that readers see once."""
    from policyspark.operators.crawl import content_store

    path = str(tmp_path / "c")
    pages = spark.range(400).selectExpr("'hot' AS municipality_id", "concat('page ', id) AS content")
    store = content_store(pages)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else so little data becomes one task
    sinks.write_content_store(store, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "c" / "municipality_id=hot").glob("part-*.parquet"))) > 1
    store.write.mode("append").partitionBy("municipality_id").parquet(path)  # a run that looked before the first had written
    got = sinks.read_content_store(spark, path)
    assert spark.read.parquet(path).count() == 800 and got.count() == 400 == got.select("digest").distinct().count()
    assert got.exceptAll(store.select(got.columns)).count() == 0


def test_sql_functions(spark):
    from policyspark.functions.sql import register_sql_functions

    register_sql_functions(spark)
    assert spark.sql("SELECT snippets('a. b.\n\nc') AS s").first().s == ["a. b.", "c"]
    assert spark.sql("SELECT url FROM page_links('<a href=\"x\">y</a>', 'https://a.de/')").first().url == "https://a.de/x"


def test_whole_chain_on_files(spark, tmp_path):
    """Raw records to analysis table, profile and report through files."""
    page = "<title>Förderprogramm</title><p>" + "Die Stadt fördert Solaranlagen mit einem Zuschuss. " * 6 + "</p>"
    raw = [{"municipality_id": "m", "document_id": f"m::{i}", "source_url": f"https://m/{i}", "mime_type": "text/html", "raw_content": page} for i in range(4)]
    path = write(tmp_path / "raw.ndjson", "\n".join(json.dumps(r) for r in raw) + "\nbroken\n")
    docs = stages.extract(ndjson.read_ndjson(spark, path, schemas.RAW_ANY))
    assert docs.count() == 4
    found = stages.candidates(docs)
    measures = stages.baseline(found).withColumn("ord", F.monotonically_increasing_id())
    assert measures.count() == 4 and measures.first().instrument_type == "subsidy_funding_program"
    munis = spark.createDataFrame([("m", "Musterstadt", 0)], "municipality_id string, name string, ord int")
    table = stages.analysis(measures, docs.withColumn("ord", F.lit(0)), munis, "s")
    assert {r.municipality_name for r in table.collect()} == {"Musterstadt"} and table.first().text_excerpt.startswith("Förder")
    parts = stages.inspect(measures, "ord")
    assert parts["stats"].first().n == 4 and parts["lowest"].count() == 4 and parts["random"].count() == 4
    assert {r.field: r.missing for r in parts["missing"].collect()}["instrument_subtype"] == 4


def test_report_tables(spark):
    pool = spark.createDataFrame([("a",), ("bb",)], "text string")
    weak = spark.createDataFrame([("1", "a", 1, 3.0, "x;y"), ("2", "b", None, 0.0, "x")], "candidate_id string, text string, rule_label int, rule_score double, matched_rules string")
    gold = spark.createDataFrame([("1", "a", "yes", "m")], "candidate_id string, text string, gold_is_policy_measure string, municipality string")
    note = spark.createDataFrame([("no",), (None,)], "is_policy_measure string")
    out = stages.report_tables(pool, weak, gold, note, note)
    assert set(out) == {"dataset_sizes", "label_balance", "text_lengths", "weak_coverage", "rule_scores", "top_rules", "top_rules_positive",
                        "annotation_progress", "annotation_progress_extra", "municipality_support"}
    assert [tuple(r) for r in out["top_rules"].collect()] == [("x", 2), ("y", 1)]
    assert out["annotation_progress"].first().n_pending == 1 and out["municipality_support"].first().n_pos == 1
    for df in out.values():
        df.collect()


def test_stored_pages_are_written_once(spark, tmp_path):
    from policyspark.operators.crawl import content_store

    pages = spark.createDataFrame([("m", "x"), ("m", "y"), ("n", "x")], "municipality_id string, content string")
    for _ in range(2):
        sinks.write_content_store(content_store(pages), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    """Tasks take large files first; positions follow file paths all the same."""
    from policyspark.sources.ndjson import read_ndjson

    (tmp_path / "part-0.json").write_text('{"a": 0}\n')
    (tmp_path / "part-1.json").write_text("".join(f'{{"a": {i}}}\n' for i in range(1, 400)) + "broken\n")
    for mode in ("drop", "flag"):
        rows = read_ndjson(spark, str(tmp_path), "a int", on_bad=mode, with_position=True).orderBy("ord").collect()
        assert [r.a for r in rows if r.a is not None] == list(range(400))
    assert sum(r._broken for r in rows) == 1
    with pytest.raises(Exception, match="not one JSON object"):
        read_ndjson(spark, str(tmp_path), "a int", on_bad="fail", with_position=True).collect()


def test_only_pages_of_a_level_are_parsed(spark):
    from policyspark.operators.crawl import linked_pages

    pages = spark.createDataFrame([("u", "<a href='/x'>x</a>"), ("v", "<a href='/y'>y</a>")], "url string, html string")
    links = linked_pages(pages)(pages.where("url = 'u'").select("url"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    parser = min(plan.find(w) for w in ("ArrowEvalPython", "MapInArrow", "MapInPandas", "BatchEvalPython") if w in plan)
    assert 0 <= parser < plan.find("Join")
    assert [r.anchor for r in links.collect()] == ["x"]


def page_rows(files):
    return sorted((r.raw_path, r.html) for r in files.collect())


def test_page_files_are_dealt_out_and_found_as_spark_finds_them(spark, tmp_path, monkeypatch):
    """Small files do not become a task per few of them; which files there are is what Spark's own scan says."""
    from policyspark.session import parallelism

    for i in range(400):
        (tmp_path / f"m{i % 20}" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"m{i % 20}" / "deep" / f"{i}.{('htm', 'html')[i % 2]}").write_text(f"page {i} ä")
    for name in ("top.html", "_x=1.html", "_hidden.html", ".hidden.html", "up.HTML", "a.pdf", "sp ace%20ü.htm", "dir.html/in.htm", "_dir/in.htm", ".dir/in.htm", "gone._COPYING_/in.htm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty.html").write_bytes(b"")
    (tmp_path / "bad.html").write_bytes(b"\xff\xc3(\x00")
    (tmp_path / "linked.html").symlink_to(tmp_path / "top.html")
    files = tables.page_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= parallelism(spark)
    monkeypatch.setattr(tables, "READ_BYTES", 40)  # several batches are passed on for one that came in
    monkeypatch.setattr(tables, "LISTED_PATHS", 30)
    got = page_rows(tables.page_files(spark, str(tmp_path)))
    assert got == page_rows(files) == page_rows(tables.page_files(spark, tmp_path.as_uri() + "/"))
    monkeypatch.setattr(tables, "local_folder", lambda spark, path: None)
    assert got == page_rows(tables.page_files(spark, str(tmp_path))) and len(got) == 406
    with pytest.raises(Exception, match="(?i)path"):
        tables.page_files(spark, str(tmp_path / "none")).collect()


def test_pages_are_written_as_files(spark, tmp_path, monkeypatch):
    """A file a page, no folder a page; other file systems get the same lines from Spark's writer."""
    rows = [(f"u{i}", f"<p>{i} ä") for i in range(300)] + [("twice", "a"), ("twice", "b"), (None, "x"), (None, "y"), ("none", None), ("empty", ""), ("spaces", "  s  ")]
    pages = spark.createDataFrame(rows, "url string, html string").coalesce(1)
    odd = spark.createDataFrame([("comment", "# x"), ("separator", "a\u0001b"), ("zero", "\u0000x")], "url string, html string")
    sinks.write_page_files(pages.unionByName(odd), str(tmp_path / "own"))
    lines = {r.html for r in tables.page_files(spark, str(tmp_path / "own")).collect()}
    assert lines == {f"{h}\n" for u, h in rows[:300]} | {"a\nb\n", "x\ny\n", "  s  \n", "# x\n", "a\u0001b\n", "\u0000x\n"}
    folders = [p for p in (tmp_path / "own").rglob("*") if p.is_dir()]
    assert len(folders) <= 257 and not [p for p in (tmp_path / "own").rglob(".*")]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_page_files(pages, str(tmp_path / "own"))
    sinks.write_page_files(pages, str(tmp_path / "mine"))
    monkeypatch.setattr(sinks, "local_folder", lambda spark, path: None)
    sinks.write_page_files(pages, str(tmp_path / "sparks"))
    name = F.regexp_extract("raw_path", "page=([0-9a-f]+)", 1).alias("raw_path")
    assert page_rows(tables.page_files(spark, str(tmp_path / "mine")).select(name, "html")) == page_rows(
        tables.page_files(spark, str(tmp_path / "sparks")).select(name, "html"))


def test_a_failed_page_write_leaves_no_part_of_a_page(spark, tmp_path):
    pages = spark.range(20).coalesce(1).selectExpr("concat('u', id) AS url", "if(id = 13, raise_error('lost'), concat('page ', id)) AS html")
    with pytest.raises(Exception, match="lost"):
        sinks.write_page_files(pages, str(tmp_path / "p"))
    assert all(html.startswith("page ") and html.endswith("\n") for _, html in page_rows(tables.page_files(spark, str(tmp_path / "p"))))
