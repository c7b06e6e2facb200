"""Neighbours, packing, URL filter, components, registration and the pipeline."""

import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from policyspark.llm import components, neighbours, packing, registry, urlfilter
from tests.conftest import rows_of


def exact(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
              and np.all(np.isfinite(np.array(v, float))) and np.any(np.array(v, float))]
    size = collections.Counter(len(v) for _, v in usable).most_common(1)[0][0]
    usable = [(i, v) for i, v in usable if len(v) == size]
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            others = {i: max(float(w @ v) for j, w in usable if j == i) for i, _ in usable if i != q}
            out[q] = sorted(others.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    same = rng.normal(size=8).round(3).tolist()
    rows += [(1000 + i, same) for i in range(200)]  # a third of all rows
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [float("inf")] + [1.0] * 7),
             (2005, [1.0, None] + [1.0] * 6), (2006, [1.0, 2.0]), (None, same), (2020, [0.0] * 8)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit("theirs"))


def test_neighbours(vectors):
    rows, df = vectors
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.9
    by_id = {i: v for i, v in rows if v}
    for q, hits in got.items():
        assert hits == sorted(hits, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float(np.dot(by_id[q], by_id[i])), abs=1e-12) for i, s in hits)
    copies = [i for i, _ in got[1000] if 1000 <= i < 1200]
    assert copies == list(range(1001, 1001 + len(copies)))  # ties go to smaller ids


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (7, [-1.0, -1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:3] for r in got] == [(0, 1, 20), (0, 2, 7), (20, 1, 0), (20, 2, 7)]
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0


def recall_of(got, vectors):
    hit = 0
    for q in range(0, len(vectors), 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hit += len(set(np.argsort(-scores)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    return hit / (20 * len(range(0, len(vectors), 20)))


def test_neighbours_of_varying_norms(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(3000, 32))
    vectors *= np.exp(0.35 * rng.normal(size=(3000, 1))) / np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert recall_of(neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect(), vectors) >= 0.96


def test_neighbours_out_of_reach_are_scanned(spark):
    vectors = np.random.default_rng(8).normal(size=(600, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    thin = neighbours.Settings(tables=1, width=0.002)  # no perturbation by one slot reaches far
    assert recall_of(neighbours.nearest(df, F.col("vec_id") % 20 == 0, settings=thin).collect(), vectors) == 1


def test_scanned_queries_pass_the_driver_block_by_block(spark, monkeypatch):
    vectors = np.random.default_rng(9).normal(size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "rep long, vector array<double>")
    taken, seen, scan = [0], [], neighbours.scan

    def counted():
        for row in df.orderBy("rep").collect():
            taken[0] += 1
            yield row

    def spied(distinct, names, queries, keep):
        seen.append((taken[0], len(names)))
        return scan(distinct, names, queries, keep)

    class Asked:
        toLocalIterator = staticmethod(counted)

    monkeypatch.setattr(neighbours, "ROWS", 40)
    monkeypatch.setattr(neighbours, "scan", spied)
    got = neighbours._scanned(df, Asked, 3)
    assert seen == [(40, 40), (80, 40), (90, 10)]  # no query is fetched before its block
    want = {(q, int(i)) for q in range(90) for i in np.argsort(-(vectors @ vectors[q]))[:3]}
    assert {(r.query, r.rep) for r in got.collect()} == want and got.count() == 270
    assert neighbours._scanned(df, df.limit(0), 3).count() == 0


def test_a_repeated_row_hides_no_other_id(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])] * 30 + [(i, [1.0, 2.0]) for i in range(2, 9)], "vec_id long, vector array<double>")
    assert [r.ids for r in neighbours.distinct_vectors(rows, 5, 1).collect()] == [[1, 2, 3, 4, 5]]


def check_bins(rows, capacity, sources, clusters):
    bins = collections.defaultdict(list)
    for r in rows:
        if r.bin is not None:
            bins[r.bin].append(r)
    for content in bins.values():
        content.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in content:
            assert r.bin_offset == at
            at += r.length
        assert at <= capacity
        for kind in (sources, clusters):
            seen = [kind[r.doc_id] for r in content if kind[r.doc_id] is not None]
            assert len(seen) == len(set(seen))
    return bins


def test_packing(rough, clashing):
    docs = clashing(rough.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL"))
    out = packing.pack_documents(docs, capacity=100).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    check_bins(out, 100, {r.doc_id: r.source for r in rows}, {r.doc_id: (r.text or "").lower() or None for r in rows})
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    for r in rows:
        own = sorted(pieces[r.doc_id], key=lambda p: p.piece)
        assert sum(p.length for p in own) == len((r.text or "").split())
        assert [p.start for p in own] == [100 * i for i in range(len(own))]
        assert own[0].bin is None or own[0].length > 0
    assert len(pieces) == len(rows)


def test_packing_of_repeats_and_nothing(rough, empty):
    assert packing.pack_documents(empty).count() == 0
    repeated = rough.where("doc_id = 9").unionByName(rough.where("doc_id = 9")).unionByName(rough.where("doc_id IS NULL"))
    out = packing.pack_documents(repeated).collect()
    assert len(out) == repeated.count()
    assert len({r.bin for r in out if r.doc_id == 9}) == sum(r.doc_id == 9 for r in out)


def test_best_fit_takes_the_tightest_compatible_bin():
    lengths, sources, clusters = [6, 5, 4, 4, 3], ["a", "b", "a", "c", None], [1, 2, 3, 1, 2]
    # 6|5 open two bins; 4 (source a) must pass the tighter bin of the first 6 and goes to the second.
    assert packing.best_fit(lengths, sources, clusters, 10) == [0, 1, 1, 2, 0]


def brute_intervals(events):
    state = collections.defaultdict(dict)
    for name, action, entry, day, added in events:
        if entry is not None and day is not None and added is not None:
            key = (name, action, entry)
            state[key][day] = state[key].get(day, False) or added
    out = []
    for key, days in state.items():
        since = None
        for day in sorted(days):
            if days[day] and since is None:
                since = day
            elif not days[day] and since is not None:
                out.append((*key, since, day))
                since = None
        if since is not None:
            out.append((*key, since, None))
    return out


def test_url_filter(spark):
    d = dt.date
    events = [("l", "block", "bad.example", d(2024, 1, 5), True), ("l", "block", "bad.example", d(2024, 1, 10), False),
              ("l", "block", "bad.example", d(2024, 1, 10), True), ("l", "block", "bad.example", d(2024, 1, 20), False),
              ("l", "block", "bad.example", d(2024, 2, 1), True), ("l", "block", "bad.example", d(2024, 1, 7), True),
              ("m", "allow", "good.bad.example", d(2024, 1, 1), True), ("m", "block", "bad.example/ads", d(2024, 1, 1), True),
              ("a", "block", "bad.example", d(2024, 1, 1), True), ("ab", "block", "bad.example", d(2024, 1, 1), True),
              ("l", "block", None, d(2024, 1, 1), True), ("l", "block", "x.example", None, True), ("l", "block", "x.example", d(2024, 1, 1), None),
              ("l", "block", "bad.example", d(2024, 1, 5), True)]
    table = spark.createDataFrame(events, "list_name string, action string, entry string, day date, added boolean")
    valid = urlfilter.intervals(table)
    assert sorted(map(tuple, valid.collect()), key=repr) == sorted(brute_intervals(events), key=repr)
    captures = [("http://bad.example/x", d(2024, 1, 12)), ("https://www.bad.example", d(2024, 1, 25)), ("http://GOOD.bad.example/", d(2024, 1, 12)),
                ("http://u:p@a.good.bad.example:80/ads?x", d(2024, 1, 12)), ("http://notbad.example/ads", d(2024, 1, 12)),
                ("http://bad.example/ads/1", d(2023, 12, 31)), (None, d(2024, 1, 1)), ("nonsense", d(2024, 1, 1)), ("http://bad.example/", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(captures + captures[:1])], "page_id long, url string, fetch_day date").withColumn(
        "verdict", F.lit("theirs"))
    got = {r.page_id: (r.verdict, r.list_name, r.entry) for r in urlfilter.evaluate(df, valid).collect()}
    assert got == {0: ("block", "a", "bad.example"), 1: ("block", "a", "bad.example"), 2: ("allow", "m", "good.bad.example"),
                   3: ("block", "m", "bad.example/ads"), 4: ("unlisted", None, None), 5: ("unlisted", None, None),
                   6: ("unlisted", None, None), 7: ("unlisted", None, None), 8: ("unlisted", None, None), 9: ("block", "a", "bad.example")}
    assert urlfilter.evaluate(df.limit(0), valid).count() == 0
    assert {r.verdict for r in urlfilter.evaluate(df, valid.limit(0)).collect()} == {"unlisted"}


def test_url_filter_query_stays_native(spark, sf_dir, duck):
    df = registry.load_all()[0]["op10_url_filter"](spark, sf_dir)
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
    want = duck.execute(registry.SQL["op10_url_filter"])
    names = [c[0] for c in want.description]
    order = sorted(names)
    rows = sorted(tuple("" if x is None else str(x)[:10 if isinstance(x, dt.datetime) else None] for x in
                        (r[names.index(c)] for c in order)) for r in want.fetchall())
    mine = sorted(tuple("" if r[c] is None else str(r[c]) for c in order) for r in df.collect())
    assert rows_of(df)[0] == order and mine == rows


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    edges += [tuple(sorted(map(int, rng.integers(300, 340, 2)))) for _ in range(30)] + [(5, 4), (5, 4)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_operator_has_its_query():
    names = registry.load_all()[0]
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert all(name in names for name in registry.load_all()[1])


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    rows, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir).checkpoint()
        assert rows.columns == docs.columns and rows.schema == docs.schema
        assert 0 < rows.count() <= before
        before = rows.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert packed.select("doc_id").distinct().count() == before
