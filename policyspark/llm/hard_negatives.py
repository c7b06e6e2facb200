"""Hard negatives by a vertical scan with branch-and-bound on dimensions (BOND).

Vectors are stored by columns: blocks of up to 4,096 rows of one label hold one
array per dimension, and its least and largest value. An anchor reads the
dimensions of a block in the order of its own components' magnitude, a few at a
time. What the remaining dimensions can add lies between the sums of their
least and largest contributions; rows whose score cannot reach any open place
leave the bitmap of candidates, and blocks that lose all of them are left
early. Rows that stay to the end have exact integer scores.

The anchors are a stated part of the rows and are compared with all rows: a
turn takes a bounded number of anchors, sends them to all blocks, and merges
the best of each task. Positives of a turn set the windows of its negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import release, scratch, table, written

#: Rows of a block, dimensions read at a time, anchors of a turn, and anchors whose results are merged together.
BLOCK = 4096
STEP = 8
TURN = 4096
TOGETHER = 16
#: Components of this magnitude and more could take a score out of 64 bits.
LARGEST = 65536.0
_NONE = -(1 << 62)


@dataclass(frozen=True)
class Mining:
    """positives and negatives: rows wanted of each; low and high: shares of the positive score, in hundredths,
    that a negative score lies between."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, vector of whole 256ths): one row per id, the least if an id has several.

    Rows with a null id, label, vector or component, an empty vector, or a
    component that is not finite or as large as LARGEST take no part.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.col(embedding).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & whole)
    scaled = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256).cast("int")))
    return scaled.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def columns_of(rows: DataFrame) -> DataFrame:
    """(size, label, ids, dims): blocks of rows of one label and length, an array of 32-bit numbers per dimension.

    Rows are sorted by range of label and a hash, so a label may hold any share of them.
    """
    keys = [F.col("size"), F.col("label"), F.xxhash64("vec_id"), F.col("vec_id")]
    ordered = rows.withColumn("size", F.size("vector")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def block(size: int, label: int, ids: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        by_dimension = np.ascontiguousarray(np.concatenate(values).T)
        return pa.record_batch({
            "size": pa.array([size], pa.int32()), "label": pa.array([label], pa.int64()),
            "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
            "dims": pa.array([[d.tobytes() for d in by_dimension]], pa.list_(pa.binary()))})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, values, held = None, [], [], 0
        for batch in batches:
            size, label = batch.column("size").to_numpy(), batch.column("label").to_numpy()
            cuts = np.flatnonzero((size[1:] != size[:-1]) | (label[1:] != label[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
                if at != (size[a], label[a]) and held:
                    yield block(*at, ids, values)
                    ids, values, held = [], [], 0
                at = (int(size[a]), int(label[a]))
                while a < b:
                    c = min(b, a + BLOCK - held)
                    part = batch.slice(a, c - a)
                    ids.append(part.column("vec_id").to_numpy())
                    values.append(part.column("vector").flatten().to_numpy().astype("<i4").reshape(c - a, -1))
                    a, held = c, held + c - a
                    if held == BLOCK:
                        yield block(*at, ids, values)
                        ids, values, held = [], [], 0
        if held:
            yield block(*at, ids, values)

    return ordered.select("size", "label", "vec_id", "vector").mapInArrow(
        packed, "size int, label long, ids binary, dims array<binary>")


class Columns:
    """A block in memory: ids, one row of ``values`` per dimension, and its least and largest value."""

    def __init__(self, ids: bytes, dims: list[bytes], largest: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.values = np.frombuffer(b"".join(dims), "<i4").reshape(len(dims), -1)
        self.least, self.most = self.values.min(axis=1).astype(np.int64), self.values.max(axis=1).astype(np.int64)
        bound = max(abs(int(self.least.min())), abs(int(self.most.max()))) * largest * len(dims)
        # Doubles hold whole numbers up to 2^53; larger scores are added up as integers.
        self.values = self.values.astype(np.float64 if bound < 1 << 53 else np.int64)

    def scan(self, anchor: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of the rows that ``wanted`` keeps to the end, by bounds of their scores."""
        kind = self.values.dtype
        order = np.argsort(-np.abs(anchor), kind="stable")
        one, two = anchor * self.least, anchor * self.most
        rest_low = np.concatenate([np.cumsum(np.minimum(one, two)[order][::-1])[::-1], [0]])
        rest_high = np.concatenate([np.cumsum(np.maximum(one, two)[order][::-1])[::-1], [0]])
        if not wanted(rest_low[:1], rest_high[:1])[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        weights = anchor.astype(kind)
        alive, score = None, np.zeros(self.values.shape[1], kind)
        for start in range(0, len(order), STEP):
            dims = order[start:start + STEP]
            some = self.values[dims] if alive is None else self.values[dims][:, alive]
            score = score + weights[dims] @ some
            end = start + len(dims)
            keep = wanted(score + rest_low[end], score + rest_high[end])
            if not keep.all():
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                score = score[keep]
                if not len(score):
                    break
        return np.arange(len(self.ids)) if alive is None else alive, score.astype(np.int64)


@dataclass
class Best:
    """The best (score, id) so far: higher scores first, ties to smaller ids; scores lie in low..high."""

    keep: int
    low: int = _NONE
    high: int = -_NONE
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def needed(self) -> int:
        """The least score that can still enter."""
        return int(self.scores[-1]) if len(self.scores) == self.keep else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.needed) & (scores <= self.high)
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[:self.keep]
            self.scores, self.ids = scores[order], ids[order]


@dataclass(frozen=True)
class Anchors:
    """The anchors of a turn."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: list[np.ndarray]

    @property
    def largest(self) -> int:
        return max((int(np.abs(v).max()) for v in self.vectors), default=0)


#: The best of some anchors in one task: anchor, place among its windows, id and score, as arrays of 64-bit numbers.
PACKED = "part int, anchor binary, window binary, id binary, score binary"


def scanned(blocks: DataFrame, anchors: Anchors, windows: list[list[tuple[int, int]]], keep: int, same: bool) -> DataFrame:
    """(anchor, window, rank, id, score): for each anchor the ``keep`` best other rows of each of its windows of scores.

    ``same`` says whether rows have the anchor's label or another one.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [[Best(keep, low, high) for low, high in some] for some in windows]
        largest = anchors.largest
        for batch in batches:
            for row in batch.to_pylist():
                columns = Columns(row["ids"], row["dims"], largest)
                for i, places in enumerate(state):
                    if not places or len(anchors.vectors[i]) != row["size"] or (anchors.labels[i] == row["label"]) != same:
                        continue
                    high = np.array([[p.high] for p in places])
                    needed = np.array([[p.needed] for p in places])

                    def wanted(low_bound: np.ndarray, high_bound: np.ndarray) -> np.ndarray:
                        return ((high_bound >= needed) & (low_bound <= high)).any(axis=0)

                    at, scores = columns.scan(anchors.vectors[i], wanted)
                    other = columns.ids[at] != anchors.ids[i]
                    for p in places:
                        p.add(scores[other], columns.ids[at][other])
        for start in range(0, len(state), TOGETHER):
            some = [(i, j, p) for i in range(start, min(len(state), start + TOGETHER)) for j, p in enumerate(state[i]) if len(p.ids)]
            if some:
                yield pa.record_batch({
                    "part": pa.array([start // TOGETHER], pa.int32()),
                    "anchor": pa.array([np.concatenate([np.full(len(p.ids), i) for i, _, p in some]).astype("<i8").tobytes()], pa.binary()),
                    "window": pa.array([np.concatenate([np.full(len(p.ids), j) for _, j, p in some]).astype("<i8").tobytes()], pa.binary()),
                    "id": pa.array([np.concatenate([p.ids for *_, p in some]).astype("<i8").tobytes()], pa.binary()),
                    "score": pa.array([np.concatenate([p.scores for *_, p in some]).astype("<i8").tobytes()], pa.binary())})

    def merge(whole: pa.Table) -> pa.Table:
        anchor, window, id_, score = (np.frombuffer(b"".join(whole.column(c).to_pylist()), "<i8")
                                      for c in ("anchor", "window", "id", "score"))
        order = np.lexsort((id_, -score, window, anchor))
        anchor, window, id_, score = anchor[order], window[order], id_[order], score[order]
        first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])])
        rank = np.arange(len(anchor)) - np.maximum.accumulate(np.where(first, np.arange(len(anchor)), 0)) + 1
        good = rank <= keep
        return pa.table({"anchor": anchor[good], "window": window[good], "rank": pa.array(rank[good].astype(np.int32)),
                         "id": id_[good], "score": score[good]})

    return blocks.mapInArrow(scan, PACKED).groupBy("part").applyInArrow(
        merge, "anchor long, window long, rank int, id long, score long")


def window_of(positive: int, mining: Mining) -> tuple[int, int]:
    """The least and largest whole score n with low * positive <= 100 * n <= high * positive."""
    return -(-mining.low * positive // 100), mining.high * positive // 100


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label",
         mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count in whole 256ths, rounded down; a score is the integer
    inner product. An anchor's positives are its best other rows of the same
    label; each gets its best rows of other labels with a score in the window.
    Ties go to smaller ids. Rows left out by :func:`usable` take no part;
    vectors of different lengths do not meet. An id that comes several times
    counts once, with its least (label, vector). Positives with an empty window
    give no row, nor does an empty table.

    :param is_anchor: a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    given = vectors.withColumn("_label", F.col(label) if isinstance(label, str) else label)
    rows = written(usable(given, vec_id, embedding, "_label"), "rows")
    blocks = written(columns_of(rows), "columns")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = scratch(spark, "mined")
    spark.createDataFrame([], schema).write.parquet(path)
    chosen = rows.where(is_anchor)
    turns = -(-chosen.count() // TURN)
    if turns:
        turned = scratch(spark, "anchors")
        chosen.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(turns))).write.partitionBy("turn").parquet(turned)
    for turn in range(turns):
        some = spark.read.parquet(turned).where(F.col("turn") == turn).orderBy("vec_id").collect()  # about TURN rows
        if not some:
            continue
        anchors = Anchors(np.array([r["vec_id"] for r in some]), np.array([r["label"] for r in some]),
                          [np.array(r["vector"], np.int64) for r in some])
        release(spark)
        found = scanned(blocks, anchors, [[(_NONE, -_NONE)]] * len(some), mining.positives, True).collect()
        positives: list[list[tuple[int, int]]] = [[] for _ in some]  # (id, score)
        for r in sorted(found, key=lambda r: (r["anchor"], r["rank"])):
            positives[r["anchor"]].append((r["id"], r["score"]))
        windows = [[window_of(score, mining) for _, score in own] for own in positives]
        hard = scanned(blocks, anchors, windows, mining.negatives, False)
        named(hard, anchors, positives, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def named(hard: DataFrame, anchors: Anchors, positives: list[list[tuple[int, int]]], schema: str) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, window = batch.column("anchor").to_pylist(), batch.column("window").to_pylist()
            positive = [positives[i][j] for i, j in zip(anchor, window)]
            yield pa.record_batch({
                "anchor_id": pa.array([int(anchors.ids[i]) for i in anchor], pa.int64()),
                "positive_id": pa.array([p for p, _ in positive], pa.int64()), "rank": batch.column("rank"),
                "negative_id": batch.column("id"), "positive_score": pa.array([s for _, s in positive], pa.int64()),
                "negative_score": batch.column("score")})

    return hard.mapInArrow(name, schema)


SQL = """
WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 10
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
