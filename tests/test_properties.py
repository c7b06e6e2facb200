"""Repartition invariance, hot groups, brute force of the ordered operators."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from policyspark.catalog.inputs import NEGATIVE, POSITIVE
from policyspark.operators import bootstrap, classify, gate, joins, ordinals, sampling, snippets


@pytest.fixture(scope="module")
def hot(spark):
    """12,000 rows, one key with a third of them, a null key, scattered order values."""
    n = 12_000
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % n * F.when(F.col("id") % 5 == 0, 1_000_000).otherwise(1)).alias("o"), "id",
        (F.col("id") % 11).alias("v"))


def test_running_totals_match_a_window(hot):
    w = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = hot.withColumn("t", F.coalesce(F.sum("v").over(w), F.lit(0)))
    got = ordinals.with_running_totals(hot, ["k"], ["o", "id"], {"t": F.col("v")})
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_row_numbers_match_a_window_under_any_partitioning(hot):
    want = {r.id: r.n for r in hot.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o", "id"))).collect()}
    for parts in (1, 7):
        got = ordinals.with_row_number(hot.repartition(parts), ["k"], ["o", "id"], "n", start=1)
        assert {r.id: r.n for r in got.collect()} == want


@pytest.mark.parametrize("shape", ["hot key", "constant first order", "null first order", "one key for all"])
def test_no_slice_holds_much_more_than_its_share(hot, shape):
    """Slices are what tasks get: even with a hot key or an order column that says nothing."""
    df = hot if shape in ("hot key", "one key for all") else hot.withColumn(
        "o", F.lit(5) if shape.startswith("constant") else F.lit(None).cast("long"))
    columns = ["o", "id"] if shape == "one key for all" else ["k", "o", "id"]
    cuts = ordinals.slice_cuts(df, columns, 8)
    sizes = [r["count"] for r in df.groupBy(ordinals.slice_column(df, columns, cuts).alias("s")).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2.5 * 12_000 / 8
    got = ordinals.with_row_number(df, columns[:-2], columns[-2:], "n")
    w = Window.partitionBy(*(columns[:-2] or [F.lit(0)])).orderBy(*columns[-2:])
    want = df.withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    assert got.exceptAll(want).count() == 0


def test_global_numbers(hot):
    got = ordinals.with_row_number(hot, [], ["o", "id"], "n").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(got) == (0, 11_999, 12_000)


def test_median_is_the_upper_one(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 10, 101, 400):
        values = [rng.choice([0.5, rng.random(), -1.0]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        assert ordinals.upper_median(df, "v").first()[0] == sorted(values)[n // 2]
    nothing = spark.createDataFrame([(None,)], "v double")
    assert ordinals.upper_median(nothing, "v").first()[0] is None


def test_split_is_stratified_exact_and_stable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    a = sampling.stratified_split(df, "id", "y", 0.3, 42)
    counts = {(r.y, r.split): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert counts == {(0, "test"): 1350, (0, "train"): 3150, (1, "test"): 150, (1, "train"): 350}
    b = sampling.stratified_split(df.repartition(9), "id", "y", 0.3, 42)
    assert a.exceptAll(b).count() == 0
    other = sampling.stratified_split(df, "id", "y", 0.3, 43)
    assert a.exceptAll(other).count() > 0


@pytest.mark.parametrize("n, frac", [(10, 0.3), (7, 0.25), (3, 0.5), (1, 0.3)])
def test_split_total(spark, n, frac):
    df = spark.range(n).select("id", (F.col("id") % 2).alias("y"))
    got = sampling.stratified_split(df, "id", "y", frac).where("split = 'test'").count()
    assert got == math.ceil(round(n * frac, 9))


def test_candidates_do_not_depend_on_partitioning(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.lit("same").alias("document_id"), F.when(F.col("doc_id") % 3 > 0, "hot").alias("municipality_id"), "text", "doc_id")
    runs = [snippets.snippet_candidates(docs.repartition(p), positive=POSITIVE, negative=NEGATIVE, order="doc_id") for p in (1, 6)]
    a, b = (r.select("candidate_id", "snippet") for r in runs)
    assert a.count() > 50 and a.exceptAll(b).count() == 0
    assert a.select("candidate_id").distinct().count() == a.count()


def test_post_gate_is_idempotent(spark, sf_dir):
    from policyspark.catalog.evaluation import regated
    from policyspark.catalog.inputs import EVIDENCE, predictions

    texts = predictions(spark, sf_dir).select("candidate_id", "text")
    once = regated(spark, sf_dir)
    twice = gate.post_gate(once.drop("text").join(texts, "candidate_id"), "text", 0.3, 0.6, EVIDENCE)
    cols = ["candidate_id", "pred_label", "abstained"]
    assert once.select(cols).exceptAll(twice.select(cols)).count() == 0
    m = gate.gate_metrics(once).first()
    assert m.coverage * m.n_total == pytest.approx(m.n_classified) and m.tp + m.tn + m.fp + m.fn == m.n_classified


def test_no_test_row_reaches_the_training_set(spark, sf_dir):
    from policyspark.catalog.evaluation import gold
    from policyspark.catalog.inputs import weak_pool

    split = sampling.stratified_split(gold(spark, sf_dir), "candidate_id", "gold_is_policy_measure")
    test, train = split.where("split = 'test'"), split.where("split = 'train'")
    rows = bootstrap.training_set(train, bootstrap.without_test_rows(weak_pool(spark, sf_dir), test))
    assert rows.join(test, "candidate_id", "left_semi").count() == 0
    clean = bootstrap.training_set(train, bootstrap.without_test_rows(weak_pool(spark, sf_dir), test), drop_gold_repeats=True)
    assert clean.groupBy("candidate_id").count().where("count > 1").count() == 0


def test_lookup_keeps_every_fact_row(spark, hot):
    table = spark.createDataFrame([("hot", 1, "old"), ("hot", 2, "new"), ("k1", 1, "x"), (None, 1, "never")], "k string, ord int, name string")
    out = joins.lookup(hot, table, ["k"], "ord")
    assert out.count() == hot.count()
    assert {r.name for r in out.where("k = 'hot'").select("name").distinct().collect()} == {"new"}
    assert out.where("k is null").where("name is not null").count() == 0


def test_anti_join_keeps_null_and_empty_ids(spark):
    facts = spark.createDataFrame([("1",), ("",), (None,), ("2",), ("2",)], "id string")
    done = spark.createDataFrame([(1,), (None,)], "id int")
    assert sorted(str(r.id) for r in joins.without(facts, done, "id").collect()) == ["", "2", "2", "None"]


def test_labels_compare_as_text_and_drop_nan(spark):
    docs = spark.createDataFrame([("m", 1), ("m", 2), (None, 3)], "municipality string, document_id int")
    labels = spark.createDataFrame([("m", "1", 1.0, 1), ("m", "1", float("nan"), 2)], "municipality string, document_id string, score double, ord int")
    out = {r.document_id: r.labels for r in joins.merge_labels(docs, labels, ["municipality", "document_id"], "ord").collect()}
    assert out[1].score is None and out[2] is None and out[3] is None
    with pytest.raises(ValueError):
        joins.merge_labels(docs, labels.drop("municipality"), ["municipality"])


def test_sweep_equals_one_run_per_threshold(spark, sf_dir):
    from policyspark.catalog.inputs import EVIDENCE, predictions

    p = predictions(spark, sf_dir)
    cuts = [0.1, 0.5, 0.77, 0.9]
    swept = {r.pos_conf: r for r in gate.threshold_sweep(p, "text", cuts, 0.6, EVIDENCE).collect()}
    for cut in cuts:
        one = gate.gate_metrics(gate.post_gate(p, "text", cut, 0.6, EVIDENCE)).first()
        assert all(swept[cut][c] == one[c] for c in gate.METRIC_COLUMNS)


def test_relevant_documents_survive_filtering_on_them(spark, sf_dir):
    """Filtering on the class must not blow the plan up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.lit("").alias("title"), F.lit("").alias("url"))
    config = classify.FilterConfig(strong_terms=["e"], supporting_terms=["a"], min_length=10)
    kept = classify.relevant_documents(docs, config)
    assert kept.count() == classify.filter_stats(docs, config).first().kept
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_class_weights_are_balanced(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 9, "y int")
    assert {r.y: r.weight for r in bootstrap.with_class_weights(df, "y").distinct().collect()} == {1: 2.0, 0: pytest.approx(2 / 3)}


def test_classifier_separates_words(spark):
    rows = [(str(i), "solar förderung programm" if i % 2 else "kino konzert abend", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "candidate_id string, text string, label int")
    model = bootstrap.train_classifier(df, iterations=20)
    table = bootstrap.predict_table(model, df, "label")
    assert table.where("gold_label = pred_label").count() == 40 and table.where("score between 0 and 1").count() == 40


def test_hot_lookup_keys_are_split_at_run_time(spark):
    """A third of the facts share one key and no side may be broadcast: the skew join cuts that key up."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 300_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("payload"))
        table = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
        out = joins.lookup(facts, table, ["k"])
        assert out.agg(F.count("name"), F.count(F.lit(1))).first()[1] == 300_000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_term_lists_of_any_length(spark):
    """Hits come in list order, repeats as given, whatever else the list holds; 10,000 terms run."""
    from policyspark.functions import terms

    df = spark.createDataFrame([("b a t9999 a",), ("",), (None,), ("nothing",)], "t string")
    many = [f"t{i}" for i in range(10_000)]
    short = df.select(terms.term_hits("t", ["b", "a", "b"]).alias("h")).collect()
    assert [r.h for r in short] == [["b", "a", "b"], [], [], []]
    long = df.select(terms.term_hits("t", ["b", "a", "b", *many]).alias("h"), terms.any_term("t", many).alias("any"),
                     terms.count_occurrences(F.lower("t"), ["a", *many]).alias("n")).collect()
    hits = [w for w in many if w in "t9999"]
    assert long[0].h == ["b", "a", "b", *hits] and [r.any for r in long] == [True, False, False, False]
    assert long[0].n == 2 + len(hits) and [r.n for r in long[1:]] == [0, 0, 0]
    rules = terms.KeywordRules(positive=tuple(many), min_themes=0)
    assert [r[0] for r in df.select(rules.passes(F.coalesce("t", F.lit("")))).collect()] == [True, False, False, False]


def test_term_tables_match_like_containment(spark, sf_dir):
    from policyspark.functions import terms

    words = ["a", "th", "eau", "tion", "nicht d", "license", "ß", "zzzz", "", None, "tion", "é è"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("t")).limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-3, "th")], "doc_id long, t string"))
    table = spark.createDataFrame([(w,) for w in words], "term string")
    got = sorted(map(tuple, terms.table_matches(docs, table, "doc_id", "t").collect()))
    want = sorted((r.doc_id, w) for r in docs.collect() for w in {w for w in words if w} if r.t and w in r.t)
    assert got == want
    assert terms.table_matches(docs, table.where("term = 'x' AND term = 'y'"), "doc_id", "t").count() == 0


def test_term_tables_count_like_str_count(spark, monkeypatch):
    """Nested and overlapping terms, terms longer than a lane, many packs, blocks and lanes; bytes of other texts never join in."""
    import random

    from policyspark.functions import automaton, terms

    rng = random.Random(3)
    texts = ["".join(rng.choice("abß €") for _ in range(rng.choice([0, 1, 7, 90, 900]))) for _ in range(120)]
    texts += ["a" * 3000, "ab" * 2000, None, "", "aabaab" * 40, "😀a😀😀"]
    words = sorted({t[i:i + rng.choice([1, 2, 3, 5, 40])] for t in texts if t for i in range(0, min(len(t), 40), 3)} - {""})
    words += ["aa", "abab", "aabaa", "a" * 700, "zz", "😀", "b" * 2001]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, t string").repartition(3)
    table = spark.createDataFrame([(w,) for w in [*words, None, "", *words[:5]]], "term string")
    want = sorted((i, w, t.count(w)) for i, t in rows if t for w in set(words) if w in t)
    for pack, block, segment in ((1 << 15, 1 << 20, 512), (200, 500, 16)):
        monkeypatch.setattr(terms, "PACK_BYTES", pack)
        monkeypatch.setattr(terms, "BLOCK_BYTES", block)
        monkeypatch.setattr(automaton, "SEGMENT", segment)
        assert sorted(map(tuple, terms.table_counts(docs, table, "doc_id", "t").collect())) == want
        assert sorted(map(tuple, terms.table_matches(docs, table, "doc_id", "t").collect())) == [w[:2] for w in want]
    assert terms.table_counts(docs.limit(0), table, "doc_id", "t").count() == 0


def test_only_terms_that_overlap_themselves_are_counted_hit_by_hit(monkeypatch):
    """What a block holds besides its hits follows its texts and terms, not how often a term occurs (F13)."""
    from policyspark.functions.automaton import Automaton

    words = ["ab", "ba", "bab", "c", "cab", "aa", "ß", "ßaß"]
    texts = ["ab" * 500, "cab" * 300 + "a" * 9, "", "ßaßaßß" * 50, "c"]
    automaton = Automaton([w.encode() for w in words])
    assert [w for w, o in zip(words, automaton.overlapping()) if o] == ["bab", "aa", "ßaß"]
    placed, apart = [], Automaton._apart
    monkeypatch.setattr(Automaton, "_apart", staticmethod(lambda group, *rest: placed.append(len(group)) or apart(group, *rest)))
    got = sorted(zip(*(x.tolist() for x in automaton.counted([t.encode() for t in texts]))))
    assert got == sorted((i, j, t.count(w)) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t)
    found = sum(t.startswith(w, i) for t in texts for w in ("bab", "aa", "ßaß") for i in range(len(t)))
    assert placed == [found]


def test_roots_decide_like_the_full_list(spark):
    from policyspark.functions import terms

    words = ["klimaschutz", "klima", "schutz", "aktionsprogramm", "programm", "x", "klima", "ma"]
    assert terms.roots(words) == ["ma", "schutz", "programm", "x"]
    texts = ["", "klima", "schutz klimaschutz", "programm", "aktionsprogramm ma", "nichts", "k li ma x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", terms.term_hits("t", words).alias("h"), terms.any_term("t", words).alias("a")).collect():
        assert r.h == [w for w in words if w in r.t] and r.a == bool(r.h)


def test_profiles_of_parts_add_up(spark):
    """States of parts, merged in any order, give the profile of all rows; an empty table has one too."""
    from policyspark.operators import profile

    rows = [(i, None if i % 7 == 0 else "" if i % 11 == 0 else f"a{i % 5}", ["x"] if i % 3 else [],
             "n/a" if i % 13 == 0 else str((i * 37 % 101) / 100), i % 23 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, area string, tags array<string>, confidence_score string, broken boolean")
    fields = ["area", "tags", "absent"]
    whole = {"missing": profile.missing_rates(df, fields, "broken"), "buckets": profile.confidence_buckets(df.where("NOT broken")),
             "stats": profile.confidence_stats(df.where("NOT broken")),
             "top_values": profile.top_values(df.where("NOT broken"), ["area"], 3, F.lit(500))}
    parts = [profile.profile_state(df.where(F.col("id") % 3 == k), fields, ["area"], "broken") for k in (2, 0, 1)]
    merged = profile.profile_of_state(profile.merged_state(*parts), fields, ["area"], 3)
    for name, table in whole.items():
        got, want = ({tuple(r[c] for c in table.columns) for r in t.collect()} for t in (merged[name], table))
        assert got == want, name
    none = profile.profile_of_state(profile.profile_state(df.limit(0), fields, ["area"], "broken"), fields, ["area"])
    assert {r.missing for r in none["missing"].collect()} == {0} and none["stats"].first().n == 0


def test_long_lists_are_scanned_like_containment(spark, monkeypatch):
    from policyspark.functions import terms

    monkeypatch.setattr(terms, "PACK_BYTES", 50)  # several packs
    monkeypatch.setattr(terms, "BLOCK_BYTES", 20)  # several blocks
    words = ["b", "", "ünd", "b", *[f"t{i}x" for i in range(300)], "t1", "🙂a", "x"]
    texts = ["", None, "bb", "t1x t299x", "und ünd b", "x" * 50 + "t7x", "🙂ab", "nichts", "t1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert "ArrowEvalPython" in df.select(terms.listed_hits("t", words))._jdf.queryExecution().executedPlan().toString()
    for r in df.select("t", terms.listed_hits("t", words).alias("h"), terms.term_hits("t", words).alias("w")).collect():
        assert r.h == r.w == [w for w in words if w in (r.t or "")]
    assert df.limit(0).select(terms.listed_hits("t", words).alias("h")).collect() == []
    rules = terms.KeywordRules(positive=tuple(words), themes={"a": terms.ThemeTerms(("t1",), ("🙂",))})
    scored = terms.with_keyword_score(df.where("t = 't1x t299x'"), "t", rules).first()
    assert scored.keyword_hits_general == ["", "t1x", "t299x", "t1", "x"] and scored.passes_filter


def counting(spark, df, counter):
    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    return df.mapInArrow(counted, df.schema)


def test_profiles_compute_their_rows_once(spark):
    from policyspark.operators import profile
    from policyspark.plans import stages

    rows = [(str(i), f"a{i % 5}", "n/a" if i % 13 == 0 else str((i * 37 % 101) / 100), i % 23 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "candidate_id string, policy_area string, confidence_score string, _broken boolean")
    seen = spark.sparkContext.accumulator(0)
    stats = profile.confidence_stats(counting(spark, df, seen)).first()
    numbers = sorted(float(r[2]) for r in rows if r[2] != "n/a")
    assert tuple(stats) == (len(numbers), numbers[0], numbers[len(numbers) // 2], numbers[-1]) and seen.value == 300
    seen = spark.sparkContext.accumulator(0)
    parts = stages.inspect(counting(spark, df, seen), "candidate_id", broken="_broken")
    assert all(part.count() for part in parts.values()) and seen.value == 300
