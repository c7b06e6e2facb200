"""Quality classifier: supervised subword embeddings trained by numpy SGD.

A document is the average of learned vectors, found by hashing: those of its
words, of its word pairs and of its character n-grams of each length, every
kind averaged by itself. A softmax over the averaged
vector gives the class. Training takes a bounded, hashed sample of labelled
rows in one task; scoring is a map over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import LOWER, chunks, fold_of, only_own_names, segment_sums, table

#: The folds of op5's contract: rows of the last remainder are held out.
FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """buckets: hashed vectors; dimensions: of each; grams: lengths of character n-grams;
    sample: labelled rows the model is fitted on at most; steps and rate: of the descent, in rounds over the sample."""

    buckets: int = 1 << 16
    dimensions: int = 10
    grams: tuple[int, ...] = (3, 4, 5)
    sample: int = 5000
    steps: int = 30000
    rate: float = 0.1


#: Fixed multipliers of the feature hashes (64-bit odd numbers).
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_PAIR = np.uint64(0xA24BAED4963EE407)
_SPACE = 32
#: White space becomes a blank, capitals become small.
_CLEAN = bytes(32 if b in b" \t\n\r\x0b\x0c" else LOWER[b] for b in range(256))


def features(texts: list[bytes], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of a chunk of texts, one kind at a time: (bucket of each, bounds per text).

    Kinds: words, pairs of neighbouring words, character n-grams that stay
    inside a word or touch its edge. Everything runs over the bytes at once.
    """
    shift = np.uint64(64 - int(settings.buckets).bit_length() + 1)
    buffer = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(_CLEAN), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    bounds = np.concatenate([np.zeros(1, np.int64), ends])  # a text starts with the blank before it
    blank = buffer == _SPACE

    def bucket(codes: np.ndarray, salt: int) -> np.ndarray:
        codes = (codes + np.uint64(salt)) * _MIX
        return ((codes ^ (codes >> np.uint64(29))) * _PAIR >> shift).astype(np.int32)

    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if len(starts):
        stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        inside = np.arange(len(buffer)) - np.repeat(np.concatenate([np.zeros(1, np.int64), starts]),
                                                    np.diff(np.concatenate([[0], starts, [len(buffer)]])))
        weight = np.where(blank, np.uint64(0), (buffer.astype(np.uint64) + np.uint64(1))
                          * powers()[inside & 4095])
        words = np.add.reduceat(weight, starts)
        of_text = np.searchsorted(starts, bounds)
        yield bucket(words, 1), of_text
        same = np.searchsorted(bounds, starts[:-1], "right") == np.searchsorted(bounds, starts[1:], "right")
        kept = np.concatenate([[0], np.cumsum(same)])
        pairs = bucket(words[:-1] * _PAIR + words[1:], 2)
        pairs[words[:-1] == words[1:]] = 0  # a word said twice is one feature, whatever the word
        yield pairs[same], kept[np.minimum(of_text, len(same))]
        del weight, inside, stops
    for n in settings.grams:
        count = len(buffer) - n + 1
        if count <= 0:
            continue
        code = np.zeros(count, np.uint64)
        broken = np.zeros(count, bool)
        for j in range(n):
            code = code * np.uint64(257) + buffer[j:j + count]
            if 0 < j < n - 1:
                broken |= blank[j:j + count]
        broken |= blank[:count] & blank[n - 1:n - 1 + count]
        at = np.flatnonzero(~broken)
        yield bucket(code[at], 16 + n), np.searchsorted(at, bounds)


def document(kinds: list[tuple[np.ndarray, np.ndarray]], i: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of text i and their share in its average."""
    parts = [bucket[at[i]:at[i + 1]] for bucket, at in kinds]
    if not sum(map(len, parts)):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    index, place = np.unique(np.concatenate(parts), return_inverse=True)
    share = np.concatenate([np.full(len(p), 1 / (max(len(p), 1) * (2 + len(settings.grams)))) for p in parts])
    return index.astype(np.int32), np.bincount(place, share).astype(np.float32)


def powers() -> np.ndarray:
    """Powers of the step, modulo 2**64."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(4095, _STEP)]))


def _train(rows: Iterator[pa.RecordBatch], settings: Settings) -> tuple[np.ndarray, float]:
    """Weight per bucket and bias of the log odds; the averaged embedding is linear, so they say all about scores."""
    docs = []
    for batch in rows:
        for index, weight, label in zip(*(batch.column(c).to_pylist() for c in ("index", "weight", "label"))):
            docs.append((np.frombuffer(index, np.int32), np.frombuffer(weight, np.float32), int(label)))
    labels = np.array([d[2] for d in docs])
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(settings.buckets, np.float32), (0.0 if not len(labels) else 8.0 * (2 * int(labels[0]) - 1))
    random = np.random.default_rng(7)
    vectors = ((random.random((settings.buckets, settings.dimensions)) - 0.5) / settings.dimensions).astype(np.float32)
    output = np.zeros((settings.dimensions, 2), np.float32)
    bias = np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)
    squares = np.zeros(settings.buckets, np.float32)
    rounds, step = -(-settings.steps // len(docs)), 0
    for _ in range(rounds):
        for i in random.permutation(len(docs)):
            index, weight, label = docs[i]
            rate = settings.rate * (1 - step / (rounds * len(docs)))
            step += 1
            mean = weight @ vectors[index]
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1  # the gradient of the logits
            back = output @ p
            output -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # AdaGrad: a document spreads its gradient over thousands of vectors, so each gets its own step size.
            gradient = weight[:, None] * back[None, :]
            squares[index] += (gradient * gradient).sum(axis=1)
            vectors[index] -= rate * gradient / np.sqrt(squares[index] + 1e-12)[:, None]
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids outside the held-out fold, by a hash of the id, with their texts.

    Null labels and ids do not count; of several labels of an id the smallest does.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold_of(doc_id, FOLDS) != 0))
        .groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    # At most ``sample`` rows of two numbers, which the planner sees from the limit and sends to the texts.
    return docs.select(F.col(doc_id).alias("_id"), "text").join(chosen, "_id").select("_id", "label", "text")


@dataclass(frozen=True)
class Model:
    """weights: log odds per bucket; bias: log odds of a text without features."""

    weights: np.ndarray
    bias: float
    settings: Settings


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality",
        settings: Settings = Settings()) -> Model:
    """Train on a bounded sample of labelled rows whose crc32(id) mod 5 is not 0.

    The features of a text are at most ``settings.buckets`` numbers, so the one
    training task holds a bounded amount whatever the input. Without labels of
    both classes the score is constant (0.5 without any).
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            kinds = list(features(texts, settings))
            own = [document(kinds, i, settings) for i in range(len(texts))]
            yield pa.record_batch({"label": batch.column("label").cast(pa.int32()),
                                   "index": pa.array([index.tobytes() for index, _ in own], pa.binary()),
                                   "weight": pa.array([weight.tobytes() for _, weight in own], pa.binary()),
                                   "_id": batch.column("_id").cast(pa.string())})

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _train(batches, settings)
        yield pa.record_batch({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": [bias]})

    sample = labelled_sample(docs, labels, doc_id, label, settings.sample).mapInArrow(
        counted, "label int, index binary, weight binary, _id string")
    row = (sample.repartition(1).sortWithinPartitions("_id", "index").select("label", "index", "weight")
           .mapInArrow(trained, "weights binary, bias double").first())
    if row is None:
        return Model(np.zeros(settings.buckets, np.float32), 0.0, settings)
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"], settings)


def score_chunk(texts: list[bytes], model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    total = np.zeros(len(texts))
    for index, bounds in features(texts, model.settings):
        total += segment_sums(model.weights[index], bounds) / np.maximum(np.diff(bounds), 1)
    return 1 / (1 + np.exp(-np.clip(total / (2 + len(model.settings.grams)) + model.bias, -50, 50)))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc_id (and the columns of ``keep``), held_out, score, predicted: one row per input row, whole texts.

    Null and empty texts have no features and get the model's bias; repeated
    rows get the same score each. ``predicted`` is 1 from a score of 0.3 on.
    """
    columns = keep if keep is not None else [doc_id]
    held = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_text"),
                       (fold_of(doc_id, FOLDS) == 0).alias("_held"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "_text"):
            p = score_chunk(texts, model)
            arrays = [batch.column(c) for c in columns]
            yield pa.record_batch(arrays + [batch.column("_held"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                  names=columns + ["_h", "_s", "_p"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return held.mapInArrow(scored, f"{schema}, _h boolean, _s double, _p int")


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document; labels of one fold in five are never seen."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.col("_h").alias("held_out"), F.col("_s").alias("score"),
                                     F.col("_p").alias("predicted"))


@only_own_names
def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns (of any name), that the model predicts to be of quality 1.

    Null texts are scored as empty ones; repeated rows fare alike; an empty table stays empty.
    """
    return score(docs, model, keep=docs.columns).where("_p = 1").drop("_h", "_s", "_p")
