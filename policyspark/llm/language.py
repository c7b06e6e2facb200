"""Language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

Two texts are as similar as the sets of their byte n-grams (n = 1 to 3) are,
each n with the same weight and normed by itself. Landmarks drawn from a
bounded sample span the feature space; a ridge regression per language is
fitted in it. Presence kernels are inner products, so landmarks and regression
fold into one matrix, and scoring is a batched matrix product over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import LOWER, chunks, fold_of, table

FOLDS, HELD = 4, 2
SLICES = 64
#: Training rows and landmarks a language gets at least (if it has as many), however many languages there are.
LEAST_ROWS, LEAST_MARKS = 16, 4
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """grams: longest n-gram; landmarks: of the Nyström map; sample: training rows in all; both grow with
    the number of languages beyond LEAST_MARKS and LEAST_ROWS for each; per_language: rows of a language; ridge: the penalty; rows: texts of one matrix product."""

    grams: int = 3
    landmarks: int = 192
    sample: int = 3000
    per_language: int = 400
    ridge: float = 1e-2
    rows: int = 128


def codes(texts: list[bytes], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, code of each byte n-gram, its text) for n = 1 to ``longest``; n-grams do not cross texts."""
    joined = b"".join(texts).translate(LOWER)
    buffer = np.frombuffer(joined, np.uint8)
    of_text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    code = np.zeros(len(buffer), np.uint32)
    for n in range(1, longest + 1):
        if len(buffer) < n:
            return
        count = len(buffer) - n + 1
        code = code[:count] * np.uint32(256) + buffer[n - 1:]
        inside = of_text[:count] == of_text[n - 1:]
        yield n, code[inside], of_text[:count][inside]


@dataclass(frozen=True)
class Model:
    """languages in order; grams: the n-grams of the landmarks by n; matrix: n-gram to score of each language."""

    languages: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    matrix: np.ndarray
    settings: Settings

    def columns(self) -> list[np.ndarray]:
        """Per n the column of every possible code, -1 for n-grams no landmark has."""
        out, base = [], 0
        for n, known in enumerate(self.grams, 1):
            at = np.full(256 ** n, -1, np.int32)
            at[known] = base + np.arange(len(known), dtype=np.int32)
            base += len(known)
            out.append(at)
        return out


def presence(texts: list[bytes], columns: list[np.ndarray], sizes: list[int], longest: int) -> np.ndarray:
    """Presence vectors, each n normed to length 1: their products are the blended kernel."""
    x = np.zeros((len(texts), sum(sizes)), np.float32)
    for n, code, of_text in codes(texts, longest):
        at = columns[n - 1][code]
        found = at >= 0
        x[of_text[found], at[found]] = 1
    base = 0
    for size in sizes:
        part = x[:, base:base + size]
        part /= np.maximum(np.sqrt(part.sum(axis=1, keepdims=True)), 1)
        base += size
    return x


def _train(texts: list[bytes], labels: list[str], settings: Settings) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    names = sorted(set(labels))
    if not names:
        return [], [np.zeros(0, np.int64)] * settings.grams, np.zeros((0, 0), np.float32)
    # Landmarks: in turn from each language, in the order of the rows (which is hashed).
    turn = np.zeros(len(names), int)
    place = []
    for label in labels:
        k = names.index(label)
        place.append((turn[k], k))
        turn[k] += 1
    chosen = sorted(range(len(labels)), key=lambda i: place[i])[:max(settings.landmarks, LEAST_MARKS * len(names))]
    grams = []
    seen: list[list[np.ndarray]] = [[] for _ in range(settings.grams)]
    for i in chosen:
        for n, code, _ in codes([texts[i]], settings.grams):
            seen[n - 1].append(np.unique(code))
    for parts in seen:
        known, times = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
        grams.append(known[times >= min(2, len(chosen))].astype(np.int64))
    model = Model(tuple(names), tuple(grams), np.zeros((0, 0)), settings)
    columns, sizes = model.columns(), [len(g) for g in grams]
    mark = presence([texts[i] for i in chosen], columns, sizes, settings.grams)
    to_marks = np.vstack([presence(texts[i:i + settings.rows], columns, sizes, settings.grams) @ mark.T
                          for i in range(0, len(texts), settings.rows)]).astype(np.float64)
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    good = values > max(1e-8, 1e-6 * values.max())
    nystrom = vectors[:, good] / np.sqrt(values[good])
    mapped = to_marks @ nystrom
    target = (np.array(labels)[:, None] == np.array(names)[None, :]).astype(np.float64)
    weight = np.linalg.solve(mapped.T @ mapped + settings.ridge * np.eye(mapped.shape[1]), mapped.T @ target)
    return names, grams, (mark.T.astype(np.float64) @ (nystrom @ weight)).astype(np.float32)


def training_rows(docs: DataFrame, doc_id: str, lang: str, settings: Settings) -> DataFrame:
    """A bounded, hashed sample of the rows that may be learned from: (_lang, text).

    A language is cut into slices by the hash, so that it may hold any share of
    all rows; each slice gives its rows of smallest hash, ``per_language`` in
    all slices together, and ``sample`` rows come out in all, or LEAST_ROWS of
    each language if that is more. Languages take turns, so none is left out.
    """
    ids = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col(doc_id).isNotNull()
                     & (fold_of(doc_id, FOLDS) != HELD)).select(
        F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_lang"),
        F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")).alias("_h"))
    slices = Window.partitionBy("_lang", F.pmod("_h", F.lit(SLICES))).orderBy("_h", "_id")
    first = ids.withColumn("_n", F.row_number().over(slices)).where(F.col("_n") <= -(-settings.per_language // SLICES))
    # At most SLICES * ceil(per_language / SLICES) rows of a language are left.
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id"))
    count = max(settings.sample, LEAST_ROWS * ids.select("_lang").distinct().count())
    few = first.withColumn("_turn", turn).orderBy("_turn", "_h", "_id").limit(count).select("_id", "_h")
    # At most ``count`` ids, which the planner sees from the limit and sends to the texts.
    return (docs.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_lang"), "text")
            .where("_lang IS NOT NULL AND text IS NOT NULL").join(few.distinct(), "_id"))


def fit(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """Learn from rows with a language and a text whose crc32(id) mod 4 is not 2; one task holds the bounded sample."""
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        labels: list[str] = []
        for batch, values in chunks(batches):
            texts += values
            labels += batch.column("_lang").to_pylist()
        names, grams, matrix = _train(texts, labels, settings)
        yield pa.record_batch({"languages": pa.array([names], pa.list_(pa.string())),
                               "grams": pa.array([[g.tobytes() for g in grams]], pa.list_(pa.binary())),
                               "matrix": pa.array([matrix.tobytes()], pa.binary())})

    row = (training_rows(docs, doc_id, lang, settings).repartition(1).sortWithinPartitions("_h", "_id", "_lang", "text")
           .select("_lang", "text").mapInArrow(trained, "languages array<string>, grams array<binary>, matrix binary").first())
    names = tuple(row["languages"]) if row else ()
    grams = tuple(np.frombuffer(g, np.int64) for g in row["grams"]) if row else ()
    matrix = np.frombuffer(row["matrix"], np.float32).reshape(-1, len(names)) if names else np.zeros((0, 0), np.float32)
    return Model(names, grams, matrix, settings)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    could be learned. Ties go to the language that sorts first. The score is
    the regression's value for the language, cut to 0 to 1.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id, FOLDS) == HELD).alias("held_out"), "text",
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    sizes = [len(g) for g in model.grams]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = model.columns() if model.languages else []
        for batch, texts in chunks(batches):
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            best = np.zeros(len(texts), int)
            value = np.zeros(len(texts))
            for i in range(0, len(texts), model.settings.rows) if model.languages else ():
                scores = presence(texts[i:i + model.settings.rows], columns, sizes, model.settings.grams) @ model.matrix
                best[i:i + len(scores)] = scores.argmax(axis=1)
                value[i:i + len(scores)] = scores.max(axis=1)
            known = letters & bool(model.languages)
            names = np.array(model.languages + (UNDETERMINED,), dtype=object)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names[np.where(known, best, len(model.languages))].tolist(), pa.string()),
                "score": pa.array(np.where(known, np.clip(value, 0, 1), 0.0)),
            })

    return rows.mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; one fold in four is never learned from."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
