"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are dealt into bands of similar norm. In a band they are scaled by its
largest norm and get one more component that fills their norm up to 1, so that
the largest inner product is the smallest distance; within a band this
component stays small, and slots fit the spread of the band. A table hashes
them by a few Gaussian projections cut into slots. A query visits, in every
band and table, its own bucket and perturbed ones in the order of their
estimated success (the squared distances to the slot borders that are
crossed); candidates of all tables are merged and ranked by their exact inner
product.

How many buckets a query visits in a band is measured: for a bounded sample of
queries the exact neighbours are found, and the number is chosen so that the
wanted share of them lies in a visited bucket. If no number of visits reaches
it, the tables of the band take fewer projections, and if even one projection
does not do, all vectors of the band are compared with all queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import release, scratch, slots, table, written

TOP = 20
#: Distinct vectors a task handles together, and queries (each has hundreds of buckets).
ROWS = 4096
ASKED = 64
#: Norms of a band differ by about this factor; there are at most BANDS of them, the last one open.
BAND_RATIO = 0.75
BANDS = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """tables: hash tables; width: slot width in standard deviations; per_bucket: vectors a bucket
    should hold; most: projections of a table at most; recall: wanted share of neighbours in visited
    buckets; sample: vectors the slots are fitted on; asked: queries the visits are fitted on; slices:
    parts a common vector or bucket is cut into."""

    tables: int = 6
    width: float = 1.6
    per_bucket: int = 256
    most: int = 7
    recall: float = 0.96
    sample: int = 10_000
    asked: int = 96
    slices: int = 32


@dataclass(frozen=True)
class Hashing:
    """Of a band: projections (table, projection, dimension + 1), offsets, slot width, scale of the vectors and perturbations."""

    projections: np.ndarray
    offsets: np.ndarray
    width: float
    scale: float
    moves: np.ndarray
    band: int = 0

    def narrowed(self, k: int) -> Hashing:
        """The same with the first k projections of each table."""
        return replace(self, projections=self.projections[:, :k], offsets=self.offsets[:, :k], moves=perturbations(k))

    def slots_of(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Positions in slots: (vector, table, projection)."""
        if queries:
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            full = np.hstack([vectors / norm, np.zeros((len(vectors), 1))])
        else:
            inner = vectors / self.scale
            full = np.hstack([inner, np.sqrt(np.maximum(0, 1 - (inner * inner).sum(axis=1, keepdims=True)))])
        return (np.einsum("nd,tkd->ntk", full, self.projections) + self.offsets) / self.width

    def buckets(self, slot: np.ndarray) -> np.ndarray:
        """64-bit bucket of integer slots (..., table, projection), different in every band and table."""
        code = np.arange(slot.shape[-2], dtype=np.uint64) + np.uint64(1 + self.band * slot.shape[-2])
        code = np.broadcast_to(code, slot.shape[:-1]).copy()
        for k in range(slot.shape[-1]):
            code = (code ^ slot[..., k].astype(np.int64).view(np.uint64)) * _MIX
            code ^= code >> np.uint64(29)
        return code

    def visits(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """Buckets (vector, table, visit) in the order of estimated success."""
        at = self.slots_of(vectors, True)
        own = np.floor(at)
        down = at - own  # distance to the lower border, in slots
        cost = np.stack([(1 - down) ** 2, np.zeros_like(down), down ** 2])  # up, stay, down
        total = sum(cost[1 - self.moves[:, k]][..., k].transpose(1, 2, 0) for k in range(at.shape[-1]))
        count = min(count, len(self.moves))
        order = np.argsort(total, axis=-1, kind="stable")[..., :count]
        return self.buckets((own[:, :, None, :] + self.moves[order]).transpose(0, 2, 1, 3)).transpose(0, 2, 1)

    def first_visits(self, vectors: np.ndarray, owner: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The visit that meets each vector from the query ``owner`` in any table; infinite if none does."""
        at = self.slots_of(queries, True)
        move = np.floor(self.slots_of(vectors, False)) - np.floor(at)[owner]
        down = at - np.floor(at)
        k = at.shape[-1]
        cost = np.stack([(1 - down) ** 2, np.zeros_like(down), down ** 2])
        total = sum(cost[1 - self.moves[:, j]][..., j].transpose(1, 2, 0) for j in range(k))
        ranks = np.argsort(np.argsort(total, axis=-1, kind="stable"), axis=-1)
        place = {tuple(m): i for i, m in enumerate(self.moves.tolist())}
        first = np.full(len(owner), np.inf)
        for i in range(len(owner)):
            for t in range(move.shape[1]):
                known = place.get(tuple(move[i, t].astype(int).tolist()))
                if known is not None:
                    first[i] = min(first[i], ranks[owner[i], t, known] + 1)
        return first


def perturbations(k: int) -> np.ndarray:
    return np.array(sorted(product((-1, 0, 1), repeat=k), key=lambda m: sum(map(abs, m))), np.int64)


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part.

    Left out are null ids, null or empty vectors, such with null or non-finite
    components, zero vectors, and vectors of another length than most have (of
    equally frequent lengths the smaller counts).
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite
                      & F.exists("vector", lambda x: x != 0))
    most = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (most["n"] if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_vectors(rows: DataFrame, keep: int, slices: int) -> DataFrame:
    """(rep, vector, ids): each different vector once, with its ``keep`` smallest ids; rep is the smallest.

    Copies are thinned inside slices of the ids first, so that one vector may
    be any share of all rows. More than ``keep`` copies of a vector cannot all
    be among the nearest, ties going to smaller ids.
    """
    part = Window.partitionBy("vector", "_slice").orderBy("vec_id")
    few = (rows.select("vec_id", "vector").distinct().withColumn("_slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))
           .withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= keep))
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep)
    return few.groupBy("vector").agg(ids.alias("ids")).select(F.col("ids")[0].alias("rep"), "vector", "ids")


def norm_of(vector: str = "vector") -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def sampled(distinct: DataFrame, count: int) -> np.ndarray:
    some = distinct.orderBy(F.xxhash64("rep"), "rep").limit(count).select("vector").toPandas()["vector"]
    return np.array(some.tolist(), np.float64)


def banded(distinct: DataFrame, settings: Settings) -> DataFrame:
    """distinct with its band: 0 for the largest norms. Edges follow the largest norm and a bounded sample."""
    scale = distinct.agg(F.max(norm_of())).first()[0]
    if not scale:
        return distinct.withColumn("band", F.lit(0))
    low = max(float(np.quantile(np.linalg.norm(sampled(distinct, settings.sample), axis=1), 0.05)), scale * 1e-9)
    span = np.log(scale / low) if np.isfinite(scale) else 0.0
    bands = int(np.clip(np.ceil(span / -np.log(BAND_RATIO)), 1, BANDS))
    edges = [float(scale * np.exp(-span * i / bands)) for i in range(1, bands)]
    return distinct.withColumn("band", sum(((norm_of() < e).cast("int") for e in edges), F.lit(0)))


def fit(distinct: DataFrame, settings: Settings) -> list[Hashing]:
    """Slots of each band from the number and norms of all its vectors and a bounded sample of them."""
    sizes = distinct.groupBy("band").agg(F.count("*"), F.max(norm_of())).orderBy("band").collect()
    out = []
    for band, count, scale in sizes:
        vectors = sampled(distinct.where(F.col("band") == band), max(1, settings.sample // len(sizes)))
        dimension = vectors.shape[1]
        random = np.random.default_rng(11 + band)
        raw = Hashing(random.standard_normal((settings.tables, settings.most, dimension + 1)), np.zeros((1, 1)), 1.0,
                      float(scale), np.zeros((0, 0)))
        width = settings.width * max(1e-9, float(raw.slots_of(vectors, False).std(axis=0).mean()))
        # A projection tells about log2(4.13 / width) bits; buckets should hold per_bucket vectors.
        bits = max(0.5, np.log2(4.13 / settings.width))
        k = int(np.clip(np.ceil(np.log2(max(2.0, count / settings.per_bucket)) / bits), 1, settings.most))
        out.append(Hashing(raw.projections[:, :k], random.random((settings.tables, k)) * width, width, float(scale),
                           perturbations(k), band))
    return out


def best(scores: np.ndarray, reps: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best of each row, ties to smaller reps; reps ascend."""
    if scores.shape[1] <= keep:
        return np.argsort(-scores, axis=1, kind="stable")
    cut = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
    out = np.empty((len(scores), keep), np.int64)
    for i, row in enumerate(scores):
        some = np.flatnonzero(row >= cut[i])
        out[i] = some[np.argsort(-row[some], kind="stable")[:keep]]
    return out


def scan(distinct: DataFrame, names: np.ndarray, queries: np.ndarray, keep: int) -> DataFrame:
    """(query, rep, score): the exact best of a bounded block of queries, per batch of all vectors."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("rep").to_numpy())
            reps, vectors = batch.column("rep").to_numpy()[order], matrix(batch.column("vector"))[order]
            for i in range(0, len(queries), 256):
                scores = queries[i:i + 256] @ vectors.T
                at = best(scores, reps, keep)
                yield pa.record_batch({
                    "query": pa.array(names[i:i + 256]), "reps": pa.array([reps[a].tobytes() for a in at], pa.binary()),
                    "scores": pa.array([s.tobytes() for s in np.take_along_axis(scores, at, axis=1)], pa.binary())})

    return merged(distinct.select("rep", "vector").mapInArrow(scanned, FOUND), keep)


#: The best candidates of a query from one place, packed: 64-bit ids and doubles.
FOUND = "query long, reps binary, scores binary"


def merged(found: DataFrame, keep: int) -> DataFrame:
    """(query, rep, score): the best of what was found for each query in all places."""
    def merge(whole: pa.Table) -> pa.Table:
        reps = np.frombuffer(b"".join(whole.column("reps").to_pylist()), np.int64)
        scores = np.frombuffer(b"".join(whole.column("scores").to_pylist()))
        reps, first = np.unique(reps, return_index=True)  # a vector may come from several tables
        at = np.argsort(-scores[first], kind="stable")[:keep]
        query_id = whole.column("query")[0].as_py()
        return pa.table({"query": pa.array([query_id] * len(at), pa.int64()), "rep": pa.array(reps[at]),
                         "score": pa.array(scores[first][at])})

    return found.groupBy("query").applyInArrow(merge, "query long, rep long, score double")


def visits_needed(distinct: DataFrame, queries: DataFrame, hashings: list[Hashing], settings: Settings, keep: int
                  ) -> list[tuple[Hashing, int]]:
    """Each band's hashing and its visits per table that reach the wanted share of the exact neighbours in the band.

    Neighbours are those of a bounded sample of queries. 0 visits: the tables
    cannot reach the share. A band without any of the neighbours gets one visit.
    """
    some = queries.orderBy(F.xxhash64("rep", F.lit("asked")), "rep").limit(settings.asked).select("rep", "vector").toPandas()
    if not len(some):
        return [(h, 1) for h in hashings]
    names, vectors = some["rep"].to_numpy(np.int64), np.array(some["vector"].tolist(), np.float64)
    exact = scan(distinct, names, vectors, keep).join(distinct.select("rep", "vector", "band"), "rep").select(
        "query", "vector", "band").toPandas()  # asked * keep rows at most
    where = {name: i for i, name in enumerate(names.tolist())}
    owner = np.array([where[q] for q in exact["query"]])
    found, band = np.array(exact["vector"].tolist(), np.float64), exact["band"].to_numpy()
    return [reaching(h, found[band == h.band], owner[band == h.band], vectors, settings) for h in hashings]


def reaching(hashing: Hashing, found: np.ndarray, owner: np.ndarray, queries: np.ndarray, settings: Settings
             ) -> tuple[Hashing, int]:
    """The hashing with as many projections as reach the wanted share of ``found``, and the visits; 0 if none does."""
    if not len(found):
        return hashing, 1
    for k in range(hashing.offsets.shape[1], 0, -1):
        some = hashing.narrowed(k)
        first = np.sort(some.first_visits(found, owner, queries))
        needed = first[min(len(first), int(np.ceil(settings.recall * len(first)))) - 1]
        if np.isfinite(needed):
            return some, int(needed)
    return hashing, 0


def hot_buckets(distinct: DataFrame, plan: list[tuple[Hashing, int]], settings: Settings, bins: int) -> np.ndarray:
    """Buckets that hold more than a fair share of a bounded sample; 4 * bins * tables at most."""
    some = distinct.orderBy(F.xxhash64("rep"), "rep").limit(settings.sample).select("vector", "band").toPandas()
    vectors, band = np.array(some["vector"].tolist(), np.float64), some["band"].to_numpy()
    codes = [h.buckets(np.floor(h.slots_of(vectors[band == h.band], False))).ravel() for h, _ in plan if (band == h.band).any()]
    code, count = np.unique(np.concatenate(codes), return_counts=True)
    return code[count > max(4, len(some) / (4 * bins))]


def search(distinct: DataFrame, queries: DataFrame, plan: list[tuple[Hashing, int]], settings: Settings, keep: int) -> DataFrame:
    """(query, rep, score): the best candidates of each distinct query vector in the bands that are visited.

    Vectors and visits meet by bucket. Buckets are dealt into bins; the vectors
    of a common bucket are dealt into slices, all of which its visitors see.
    """
    bins = slots(distinct.sparkSession) * 2
    hot = hot_buckets(distinct, plan, settings, bins)
    plan = [(h, visits) for h, visits in plan if visits]

    def bin_of(code: np.ndarray, part: np.ndarray) -> np.ndarray:
        code = (code + part.astype(np.uint64)) * _MIX
        return ((code >> np.uint64(33)) % np.uint64(bins)).astype(np.int64)

    def packs(code: np.ndarray, part: np.ndarray, owner: np.ndarray, reps: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        bin_ = bin_of(code, part)
        order = np.argsort(bin_, kind="stable")
        code, part, owner, bin_ = code[order], part[order], owner[order], bin_[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bin_)) + 1, [len(bin_)]])
        rows = [(a, b, *np.unique(owner[a:b], return_inverse=True)) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.record_batch({
            "bin": pa.array([int(bin_[a]) for a, *_ in rows], pa.int64()),
            "code": pa.array([(code[a:b] + part[a:b].astype(np.uint64)).tobytes() for a, b, *_ in rows], pa.binary()),
            "owner": pa.array([inverse.astype(np.int32).tobytes() for *_, inverse in rows], pa.binary()),
            "reps": pa.array([reps[u].tobytes() for _, _, u, _ in rows], pa.binary()),
            "vectors": pa.array([vectors[u].tobytes() for _, _, u, _ in rows], pa.binary())})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                reps, vectors = batch.column("rep").slice(i, ROWS).to_numpy(), matrix(batch.column("vector").slice(i, ROWS))
                band = batch.column("band").slice(i, ROWS).to_numpy()
                codes, owners = [], []
                for hashing, _ in plan:
                    own = np.flatnonzero(band == hashing.band)
                    code = hashing.buckets(np.floor(hashing.slots_of(vectors[own], False)))
                    owners.append(np.repeat(own, code.shape[1]))
                    codes.append(code.ravel())
                code, owner = np.concatenate(codes), np.concatenate(owners)
                if not len(code):
                    continue
                part = np.where(np.isin(code, hot), (reps[owner] * 7919) % settings.slices, 0)
                yield packs(code, part, owner, reps, vectors)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ASKED):
                reps, vectors = batch.column("rep").slice(i, ASKED).to_numpy(), matrix(batch.column("vector").slice(i, ASKED))
                codes = [hashing.visits(vectors, visits) for hashing, visits in plan]
                owner = np.concatenate([np.repeat(np.arange(len(reps)), c[0].size) for c in codes])
                code = np.concatenate([c.ravel() for c in codes])
                common = np.isin(code, hot)
                part = np.concatenate([np.zeros((~common).sum(), np.int64),
                                       np.tile(np.arange(settings.slices), common.sum())])
                code = np.concatenate([code[~common], np.repeat(code[common], settings.slices)])
                owner = np.concatenate([owner[~common], np.repeat(owner[common], settings.slices)])
                yield packs(code, part, owner, reps, vectors)

    def opened(whole: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        base, owners = 0, []
        for o, r in zip(whole.column("owner").to_pylist(), whole.column("reps").to_pylist()):
            owners.append(np.frombuffer(o, np.int32) + base)
            base += len(r) // 8
        join = {c: b"".join(whole.column(c).to_pylist()) for c in ("code", "reps", "vectors")}
        code, owner = np.frombuffer(join["code"], np.uint64), np.concatenate(owners)
        order = np.argsort(code, kind="stable")
        return code[order], owner[order], np.frombuffer(join["reps"], np.int64), np.frombuffer(join["vectors"]).reshape(base, -1)

    def met(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and asked.num_rows:
            code, owner, reps, values = opened(vectors)
            q_code, q_owner, q_reps, q_values = opened(asked)
            shared = np.intersect1d(code, q_code)
            low, high = np.searchsorted(code, shared), np.searchsorted(code, shared, "right")
            q_low, q_high = np.searchsorted(q_code, shared), np.searchsorted(q_code, shared, "right")
            for a, b, c, d in zip(low, high, q_low, q_high):
                own = owner[a:b][np.argsort(reps[owner[a:b]])]
                for i in range(c, d, 256):
                    at_query = q_owner[i:min(d, i + 256)]
                    scores = q_values[at_query] @ values[own].T
                    at = best(scores, reps[own], keep)
                    found.append((np.repeat(q_reps[at_query], at.shape[1]), reps[own][at].ravel(),
                                  np.take_along_axis(scores, at, axis=1).ravel()))
        if not found:
            return pa.table({"query": pa.array([], pa.int64()), "reps": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
        asked_, rep, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((rep, -score, asked_))
        asked_, rep, score = asked_[order], rep[order], score[order]
        # The same vector may come from several tables; of each query the best of this bin go on.
        new = np.concatenate([[True], (asked_[1:] != asked_[:-1]) | (rep[1:] != rep[:-1])])
        asked_, rep, score = asked_[new], rep[new], score[new]
        start = np.flatnonzero(np.concatenate([[True], asked_[1:] != asked_[:-1]]))
        rows = [(a, min(a + keep, b)) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(asked_)])]
        return pa.table({"query": pa.array(asked_[start]), "reps": pa.array([rep[a:b].tobytes() for a, b in rows], pa.binary()),
                         "scores": pa.array([score[a:b].tobytes() for a, b in rows], pa.binary())})

    shape = "bin long, code binary, owner binary, reps binary, vectors binary"
    if not plan:
        return distinct.sparkSession.createDataFrame([], "query long, rep long, score double")
    found = (distinct.select("rep", "vector", "band").mapInArrow(index, shape).groupBy("bin")
             .cogroup(queries.select("rep", "vector").mapInArrow(ask, shape).groupBy("bin"))
             .applyInArrow(met, FOUND))
    return merged(found, keep)


def nearest(vectors: DataFrame, is_query: Column, k: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding",
            settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query, itself left out.

    Ties go to the smaller vec_id. Rows that :func:`valid` leaves out are
    neither queries nor candidates. Copies of a vector are searched once; a
    repeated id counts once per vector, and an id never finds itself. A query
    that found fewer than k although there are more is scanned exactly, and so
    are bands of norms whose tables cannot reach the wanted recall. An empty
    table gives no row.
    """
    keep = k + 1  # one of them may be the query
    rows = written(valid(vectors, vec_id, embedding), "vectors")
    distinct = written(distinct_vectors(rows, keep, settings.slices), "distinct-vectors")
    asked = rows.where(is_query).select("vec_id", "vector").distinct()
    queries = written(distinct.join(asked.select("vector").distinct(), "vector", "left_semi").select("rep", "vector"), "queries")
    distinct = banded(distinct, settings)
    hashings = fit(distinct, settings)
    if not hashings:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    plan = visits_needed(distinct, queries, hashings, settings, keep)
    found = search(distinct, queries, plan, settings, keep)
    if unreached := [h.band for h, visits in plan if not visits]:
        found = found.unionByName(_scanned(distinct.where(F.col("band").isin(unreached)), queries, keep))
    found = written(found, "found")
    wanted = min(keep, distinct.limit(keep).count())
    short = queries.join(found.groupBy("query").count().where(F.col("count") >= wanted), F.col("rep") == F.col("query"),
                         "left_anti").select("rep", "vector")
    # A scanned query leaves what the tables had found for it.
    scanned = _scanned(distinct, written(short, "short"), keep)
    found = found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(scanned)
    # Copies come back: ids of each found vector, then the queries of each query vector.
    expanded = found.join(distinct.select("rep", "ids"), "rep").select(
        "query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    few = expanded.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")
    ids = asked.join(distinct.select("rep", "vector"), "vector").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (few.join(ids, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _scanned(distinct: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """Exact results for queries the tables served badly, a block of bounded size at a time.

    The driver holds one block and one partition of ``asked``; results of all
    blocks are appended to one table.
    """
    spark = distinct.sparkSession
    out = spark.createDataFrame([], "query long, rep long, score double")
    path = scratch(spark, "scanned")
    out.write.parquet(path)
    rows = asked.toLocalIterator()
    while block := list(islice(rows, ROWS)):
        release(spark)
        scan(distinct, np.array([r["rep"] for r in block], np.int64),
             np.array([r["vector"] for r in block], np.float64), keep).write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


@query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
