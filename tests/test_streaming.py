"""A stream over growing folders gives the same rows as the batch run."""

import json
import shutil

from pyspark.sql import functions as F

from policyspark import schemas
from policyspark.catalog import streams
from policyspark.operators.labeling import label_candidates, rule_labeler
from policyspark.plans import stages
from policyspark.sources.ndjson import read_ndjson
from policyspark.streaming.incremental import append_stream, label_stream, stream_candidates, stream_extracted


def drop_file(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")


def raw(i):
    return {"muni": "m", "url": f"https://m/{i}", "status": "200", "ct": "text/html", "kept": True,
            "raw_content": f"<title>T{i}</title><p>" + f"Förderprogramm Nummer {i} der Stadt mit Zuschuss. " * 5 + "</p>"}


def test_stream_equals_batch(spark, tmp_path):
    folder, out, found = tmp_path / "index", str(tmp_path / "docs"), str(tmp_path / "found")
    drop_file(folder, "a.ndjson", [raw(0), "broken", raw(1)])
    append_stream(stream_extracted(spark, str(folder)), out, str(tmp_path / "c1")).awaitTermination()
    drop_file(folder, "b.ndjson", [raw(2), "", {"muni": "m"}])
    append_stream(stream_extracted(spark, str(folder)), out, str(tmp_path / "c1")).awaitTermination()
    batch = stages.extract(read_ndjson(spark, f"{folder}/*", schemas.RAW_ANY))
    streamed = spark.read.parquet(out)
    assert streamed.count() == 3
    assert streamed.exceptAll(batch.select(streamed.columns)).count() == 0
    docs = spark.readStream.schema(streamed.schema).parquet(out)
    append_stream(stream_candidates(docs), found, str(tmp_path / "c2")).awaitTermination()
    want = stages.candidates(batch).select("candidate_id", "snippet")
    got = spark.read.parquet(found).select("candidate_id", "snippet")
    assert got.count() == want.count() == 3 and got.exceptAll(want).count() == 0


def test_labelling_resumes(spark, tmp_path):
    source, sink = tmp_path / "cand", str(tmp_path / "labels")
    schema = "candidate_id string, municipality_id string, text string"

    def label(rows):
        return label_candidates(rows, rule_labeler).select("candidate_id", "is_policy_measure", "confidence_score")

    def rows(ids):
        return [{"candidate_id": i, "municipality_id": "m", "text": f"Zuschuss {i}"} for i in ids]

    drop_file(source, "a.json", rows(["1", "2"]))
    stream = spark.readStream.schema(schema).json(str(source))
    label_stream(stream, sink, str(tmp_path / "c"), label).awaitTermination()
    drop_file(source, "b.json", rows(["2", "3"]))
    label_stream(stream, sink, str(tmp_path / "c"), label).awaitTermination()
    # a lost checkpoint replays everything and still adds nothing
    label_stream(stream, sink, str(tmp_path / "fresh"), label).awaitTermination()
    assert sorted(r.candidate_id for r in spark.read.parquet(sink).collect()) == ["1", "2", "3"]


def test_labelling_survives_repeats_nulls_and_crashes(spark, tmp_path):
    """Repeats inside a batch, null and blank ids, a crash before the write and one between write and commit."""
    import pytest

    from policyspark.streaming import incremental

    source, sink, state = tmp_path / "cand", str(tmp_path / "labels"), str(tmp_path / "c")
    schema = "candidate_id string, text string"
    drop_file(source, "a.json", [{"candidate_id": i, "text": f"{i}-{n}"} for n in range(3) for i in ("1", "2", None, " ")])
    stream = spark.readStream.schema(schema).json(str(source))
    moment = {"fail": "before"}

    def label(rows):
        if moment["fail"] == "before":
            raise RuntimeError("lost before the write")
        return rows.selectExpr("candidate_id", "text", "1 AS label")

    def rows():
        return sorted((r.candidate_id or "", r.text) for r in incremental.labelled(spark, sink).collect())

    want = sorted([("1", "1-0"), ("2", "2-0")] + [("", f"None-{n}") for n in range(3)] + [(" ", f" -{n}") for n in range(3)])
    with pytest.raises(Exception, match="lost before"):
        label_stream(stream, sink, state, label).awaitTermination()
    inner = incremental.write_once

    def crashing(sink, transform):
        def run(batch, batch_id):
            inner(sink, transform)(batch, batch_id)
            if moment["fail"] == "after":
                raise RuntimeError("lost after the write")
        return run

    incremental.write_once = crashing
    try:
        moment["fail"] = "after"
        with pytest.raises(Exception, match="lost after"):
            label_stream(stream, sink, state, label).awaitTermination()
        assert rows() == want
        moment["fail"] = ""
        label_stream(stream, sink, state, label).awaitTermination()
        assert rows() == want
    finally:
        incremental.write_once = inner
    drop_file(source, "b.json", [{"candidate_id": i, "text": "new"} for i in ("2", "3", "3", "")])
    label_stream(stream, sink, state, label).awaitTermination()
    want = sorted([*want, ("3", "new"), ("", "new")])
    assert rows() == want
    # a lost checkpoint: ids of the sink are known; rows without an id arrive again
    label_stream(stream, sink, str(tmp_path / "fresh"), label).awaitTermination()
    assert [r for r in rows() if r[0].strip()] == [r for r in want if r[0].strip()]


def test_labeler_failures_stay_in_their_row(spark):
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(10)], "candidate_id string, text string")

    def short(prompts):
        if any("t7" in p for p in prompts):
            raise ValueError
        return ['{"policy_field": "energy"}'] * len(prompts)

    out = label_candidates(rows, short, "{text}", batch_rules=True)
    failed = [r.candidate_id for r in out.where(F.col("label_source") == "llm_error").collect()]
    assert failed == ["7"] and out.count() == 10


def test_a_labeler_is_asked_once(spark, tmp_path):
    """Predictions and metrics of an evaluation read the same answers; failures keep their reason."""
    from policyspark.operators.labeling import ask
    from policyspark.plans import stages

    log = str(tmp_path / "asked")

    def labeler(prompts):
        with open(log, "a") as f:
            f.write("".join(f"{hash(p)}\n" for p in prompts))
        return ['{"label": 1, "confidence": 0.9}'] * len(prompts)

    gold = spark.createDataFrame([(str(i), f"text {i}", i % 2) for i in range(60)],
                                 "candidate_id string, text_for_annotation string, gold_is_policy_measure int")
    predictions, metrics = stages.gate_evaluation(gold, labeler)
    n = predictions.count()
    assert metrics.first().n_total == n == 18
    predictions.collect()
    assert len(open(log).read().split()) == n

    def broken(prompts):
        raise ValueError("no model")

    row = ask(gold.limit(1).select(F.col("text_for_annotation").alias("prompt")), broken).first()
    assert row.answer is None and row.answer_error == "ValueError: no model"


def test_a_labeler_holds_the_texts_of_its_own_call_only(spark):
    from policyspark.operators.labeling import ask

    def labeler(prompts):
        import gc

        lists = [o for o in gc.get_objects() if type(o) is list and len(o) > 1 and all(
            x is None or type(x) is str and x.startswith("prompt ") for x in o)]
        return [str(max(map(len, lists)))] * len(prompts)

    rows = spark.range(0, 500, 1, 1).selectExpr(
        "IF(id % 2 = 0, id, NULL) AS n", "IF(id = 7, NULL, concat('prompt ', id)) AS prompt", "array(id, NULL) AS l")
    got = ask(rows.repartition(1), labeler, batch_size=8)
    assert got.columns == ["n", "prompt", "l", "answer", "answer_error"]
    assert max(int(r.answer) for r in got.collect()) <= 8
    kept = sorted(((r.n, r.prompt, r.l) for r in got.collect()), key=str)
    assert kept == sorted(((r.n, r.prompt, r.l) for r in rows.collect()), key=str)


def test_a_failed_run_asks_only_the_running_wave_again(spark, tmp_path):
    import pytest

    from policyspark.operators import labeling

    log, fuse = str(tmp_path / "asked"), tmp_path / "fuse"
    rows = [(str(i), f"text {i}") for i in range(80)] + [("7", "text 7"), ("7", "other"), (None, "text"), (None, None)]
    prompts = spark.createDataFrame(rows, "id string, prompt string")

    def labeler(texts):
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [f"answer to {t}" for t in texts]

    inner, runs = labeling.ask, []

    def dying(todo, *args):
        got = inner(todo, *args)
        runs.append(todo.count())
        if len(runs) == 5 and not fuse.exists():
            fuse.touch()
            raise RuntimeError("executor lost before the commit")
        return got

    labeling.ask = dying
    try:
        with pytest.raises(RuntimeError, match="lost"):
            labeling.ask_in_waves(prompts, labeler, str(tmp_path / "ledger"), "id", waves=8)
        got = labeling.ask_in_waves(prompts, labeler, str(tmp_path / "ledger"), "id", waves=8).collect()
    finally:
        labeling.ask = inner
    asked = open(log).read().splitlines()
    assert sorted((r.id, r.prompt) for r in got if r.id) == sorted((i, p) for i, p in rows if i)
    assert all(r.answer == f"answer to {r.prompt}" for r in got)
    assert len(asked) == 83 + runs[4]  # the wave that was lost, and nothing else, twice
    labeling.ask_in_waves(prompts, labeler, str(tmp_path / "ledger"), "id", waves=8)
    assert len(open(log).read().splitlines()) == len(asked)


def test_stream_reads_a_table_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    rows.repartition(4).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "single"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "single").glob("*.parquet")), tmp_path / "one" / "documents.parquet")
    rows.write.parquet(str(tmp_path / "many" / "documents.parquet2"))
    for folder in ("one", "many"):
        found = streams.drained(spark, streams.stream(spark, str(tmp_path / folder), "documents"), "documents")
        assert sorted(r.doc_id for r in found.collect()) == list(range(20)), folder


def test_stream_without_rows_is_an_empty_table(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    rows = spark.readStream.schema("doc_id long").parquet(str(tmp_path / "empty"))
    found = streams.drained(spark, rows, "empty")
    assert found.columns == ["doc_id"] and found.count() == 0
