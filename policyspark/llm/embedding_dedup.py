"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

In a table, a vector's code is the signs of its products with a few random
hyperplanes. Vectors of one code meet, and their cosines are computed exactly.
The number of hyperplanes is fitted so that a bucket holds few unlike vectors;
the number of tables follows from it by the formula of the method, so that a
pair exactly at the threshold shares a bucket with the wanted probability.

A pair is counted in the first table that brings it together (the codes of
earlier tables are known from the vectors), so link counts need no table of
pairs; components need no more than a spanning forest of each bucket. Vectors
meet sorted by code, and a task holds a bounded number of them: a bucket of
more vectors is cut into blocks, and every two of its blocks meet in a task of
their own. Buckets that a bounded sample shows to be common are spread first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from policyspark.llm.components import components
from policyspark.llm.registry import query
from policyspark.llm.spread import joined_spread
from policyspark.llm.words import mixed, release, scratch, slots, table, written


@dataclass(frozen=True)
class Settings:
    """threshold: least cosine of a link; recall: wanted probability that a pair at the threshold shares a
    bucket; mates: unlike vectors that a bucket should hold; most: hyperplanes of a table at most; sample:
    vectors that hyperplanes are fitted on; at_once: tables whose buckets are made in one job; block: vectors
    of a bucket that meet in one task; rows: vectors of a partition."""

    threshold: float = 0.95
    recall: float = 0.995
    mates: int = 64
    most: int = 48
    sample: int = 8192
    at_once: int = 3
    block: int = 4096
    rows: int = 1 << 16
    seed: int = 29


@dataclass(frozen=True)
class Tables:
    """Signs of ``bits`` hyperplanes in each of ``count`` tables; ``common``: 64-bit buckets to spread, with their parts."""

    bits: int
    count: int
    settings: Settings
    common: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def planes(self, dimension: int) -> np.ndarray:
        """(table, hyperplane, dimension)"""
        random = np.random.default_rng([self.settings.seed, dimension])
        return random.standard_normal((self.count, self.bits, dimension))

    def codes(self, unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """(vector, table): the signs as a number."""
        t, k, d = planes.shape
        signs = (unit @ planes.reshape(t * k, d).T).reshape(len(unit), t, k) > 0
        return signs @ (np.uint64(1) << np.arange(k, dtype=np.uint64))

    def buckets(self, codes: np.ndarray, first: int, dimension: int) -> np.ndarray:
        """One 64-bit number per bucket of a table and a length of vectors."""
        home = mixed(np.arange(first, first + codes.shape[1], dtype=np.uint64) + np.uint64(dimension << 20))
        return mixed(codes + home)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of norm 1, also where squares would overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fitted(unit: np.ndarray, total: int, settings: Settings) -> Tables:
    """Hyperplanes and tables for ``total`` vectors like the sampled ones.

    Rows that even the most hyperplanes do not part are near-duplicates and
    stay together in any case, so they do not count as mates.
    """
    n = len(unit)
    probe = Tables(settings.most, 4, settings)
    codes = probe.codes(unit, probe.planes(unit.shape[1]))

    def mates(k: int) -> float:
        out = 0.0
        for code in (codes & np.uint64((1 << k) - 1)).T:
            size = np.unique(code, return_counts=True)[1].astype(float)
            out += (size * (size - 1)).sum()
        return out / codes.shape[1] / max(1, n)

    floor = mates(settings.most)
    bits = next((k for k in range(1, settings.most) if (mates(k) - floor) * total / max(1, n) <= settings.mates), settings.most)
    alike = 1 - np.arccos(settings.threshold) / np.pi
    count = int(np.ceil(np.log(1 - settings.recall) / np.log1p(-min(alike ** bits, 1 - 1e-12))))
    tables = Tables(bits, max(1, count), settings)
    # A bucket with several sampled vectors, and more than a block in all, is spread over parts.
    codes = tables.codes(unit, tables.planes(unit.shape[1]))
    bucket, size = np.unique(tables.buckets(codes, 0, unit.shape[1]), return_counts=True)
    often = (size >= 8) & (size * (total / max(1, n)) > settings.block)
    parts = np.ceil(size[often] * (total / max(1, n)) / settings.block).astype(np.int64)
    return Tables(bits, max(1, count), settings, (bucket[often], parts))


#: Vectors on their way to their buckets, and what is found there.
PLACED = "bucket long, part int, table int, node binary, weight long, vector binary"
FOUND = "node binary, links long, root binary, bucket long, block long, table int, pack binary"


def matrix_of(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)


def keyed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, node, vector): node is 128 bits of SHA-256 of the vector, null where it takes no part."""
    kind = _kind(vectors, embedding)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            nodes, packed = [], []
            values = column.flatten()
            raw = np.asarray(values.to_numpy(zero_copy_only=False), kind) if len(values) else np.zeros(0, kind)
            finite = np.isfinite(raw)  # a null component has become nan
            size = np.array([0 if v is None else v for v in pa.compute.list_value_length(column).to_pylist()], np.int64)
            ends = np.cumsum(size)
            for a, b in zip((ends - size).tolist(), ends.tolist()):
                good = b > a and finite[a:b].all() and raw[a:b].any()
                packed.append(raw[a:b].tobytes() if good else None)
                nodes.append(hashlib.sha256(packed[-1]).digest()[:16] if good else None)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "node": pa.array(nodes, pa.binary()),
                                   "vector": pa.array(packed, pa.binary())})

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(embedding).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("embedding"))
    return rows.mapInArrow(taken, "vec_id long, node binary, vector binary")


def _kind(vectors: DataFrame, embedding: str) -> str:
    """Vectors travel as they are stored; cosines are computed in double precision."""
    type_ = vectors.select(embedding).schema[0].dataType
    return "<f4" if isinstance(type_, ArrayType) and isinstance(type_.elementType, FloatType) else "<f8"


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of unit vectors a[i] and b[j] reaches the threshold; rounding is settled by itself."""
    cosine = a @ b.T
    out = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12)):
        x, y = a[i], b[j]
        out[i, j] = (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= threshold
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """The smallest place that each place of a symmetric matrix of links can reach."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            root[i] = i
            edge = np.array([i])
            while len(edge):
                near = links[edge].any(axis=0) & (root < 0)
                edge = np.flatnonzero(near)
                root[edge] = i
    return root


class Meeting:
    """Links among vectors of a bucket, counted in the first table in which a pair meets."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.planes: dict[int, np.ndarray] = {}

    def codes(self, unit: np.ndarray, upto: int) -> np.ndarray:
        d = unit.shape[1]
        if d not in self.planes:
            self.planes[d] = self.tables.planes(d)
        return self.tables.codes(unit, self.planes[d][:upto + 1])

    def first(self, near: np.ndarray, a: np.ndarray, b: np.ndarray, table_: int) -> np.ndarray:
        """Of the links ``near``, those that meet in this table and in none before."""
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        one, two = self.codes(a[rows], table_), self.codes(b[columns], table_)
        part = near[np.ix_(rows, columns)] & (one[:, None, table_] == two[None, :, table_])
        for t in range(table_):
            part &= one[:, None, t] != two[None, :, t]
        out = np.zeros(near.shape, bool)
        out[np.ix_(rows, columns)] = part
        return out

    def within(self, unit: np.ndarray, weight: np.ndarray, table_: int) -> tuple[np.ndarray, np.ndarray]:
        """(links, root) of each vector of one block."""
        m = len(unit)
        links, near_all = np.zeros(m, np.int64), np.zeros((m, m), bool)
        for i in range(0, m, 512):
            near = linked(unit[i:i + 512], unit, self.tables.settings.threshold)
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            near_all[i:i + 512] = near
            if near.any():
                links[i:i + 512] = self.first(near, unit[i:i + 512], unit, table_) @ weight
        return links, forest(near_all | near_all.T) if near_all.any() else np.arange(m)

    def across(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, table_: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(links of a, links of b, a place of b for each of a or -1, a place of a for each of b or -1).

        Links inside a block are known from elsewhere, but two vectors of a may
        hang together by b only, and the other way round: every vector with a
        link is tied to the first it links to, and every two such stars that a
        third vector joins are tied through it.
        """
        la, lb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        near_all = np.zeros((len(a), len(b)), bool)
        for i in range(0, len(a), 512):
            near = linked(a[i:i + 512], b, self.tables.settings.threshold)
            near_all[i:i + 512] = near
            if near.any():
                first = self.first(near, a[i:i + 512], b, table_)
                la[i:i + 512] += first @ wb
                lb += first.T @ wa[i:i + 512]
        # Components of the bipartite graph, named by a place of a.
        ra, rb = np.full(len(a), -1), np.full(len(b), -1)
        for i in np.flatnonzero(near_all.any(axis=1)):
            if ra[i] < 0:
                ra[i], edge = i, np.array([i])
                while len(edge):
                    reach = np.flatnonzero(near_all[edge].any(axis=0) & (rb < 0))
                    rb[reach] = i
                    edge = np.flatnonzero(near_all[:, reach].any(axis=1) & (ra < 0))
                    ra[edge] = i
        return la, lb, ra, rb


def found_rows(node=(), links=(), root=(), bucket=(), block=(), table_=(), pack=()) -> pa.RecordBatch:
    n = max(len(node), len(bucket))

    def column(values, kind):
        return pa.array(values if len(values) else [None] * n, kind)

    return pa.record_batch({
        "node": column(node, pa.binary()), "links": column(links, pa.int64()), "root": column(root, pa.binary()),
        "bucket": column(bucket, pa.int64()), "block": column(block, pa.int64()), "table": column(table_, pa.int32()),
        "pack": column(pack, pa.binary())})


def packed_block(nodes: list[bytes], weights: np.ndarray, vectors: list[bytes]) -> bytes:
    return len(nodes).to_bytes(8, "little") + b"".join(nodes) + weights.astype("<i8").tobytes() + b"".join(vectors)


def unpacked_block(pack: bytes, kind: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    n = int.from_bytes(pack[:8], "little")
    nodes = [pack[8 + 16 * i:24 + 16 * i] for i in range(n)]
    weights = np.frombuffer(pack, "<i8", n, 8 + 16 * n)
    return nodes, weights, unit_vectors(np.frombuffer(pack, kind, offset=8 + 24 * n).reshape(n, -1).astype(np.float64))


def place(distinct: DataFrame, tables: Tables, first: int, last: int, kind: str) -> DataFrame:
    """Every vector once for each of the tables first..last-1, with its bucket."""
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        common, parts = tables.common
        for batch in batches:
            packed = batch.column("vector").to_pylist()
            size = np.array([len(v) for v in packed])
            for length in np.unique(size).tolist():
                for start in range(0, len(own := np.flatnonzero(size == length)), 4096):
                    some = own[start:start + 4096]
                    unit = unit_vectors(matrix_of([packed[i] for i in some], kind))
                    d = unit.shape[1]
                    planes.setdefault(d, tables.planes(d)[first:last])
                    bucket = tables.buckets(tables.codes(unit, planes[d]), first, d)
                    part = np.full(bucket.shape, -1, np.int32)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, bucket), len(common) - 1)
                        node = np.frombuffer(b"".join(batch.column("node").take(pa.array(some)).to_pylist()), "<u8")[::2]
                        spread = node[:, None] % parts[at].astype(np.uint64)
                        part = np.where(common[at] == bucket, spread.astype(np.int64), -1).astype(np.int32)
                    take = pa.array(np.repeat(some, bucket.shape[1]))
                    yield pa.record_batch({
                        "bucket": pa.array(bucket.ravel().view(np.int64)), "part": pa.array(part.ravel()),
                        "table": pa.array(np.tile(np.arange(first, last, dtype=np.int32), len(some))),
                        "node": batch.column("node").take(take), "weight": batch.column("weight").take(take),
                        "vector": batch.column("vector").take(take)})

    return distinct.select("node", "weight", "vector").mapInArrow(indexed, PLACED)


def meet(placed: DataFrame, tables: Tables, kind: str, partitions: int) -> DataFrame:
    """Links inside the buckets; blocks of buckets that are too large for one task come back as packs."""
    limit = tables.settings.block

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch, bool]]:
        """(bucket, part, number of the block, rows, whether the bucket ends here with its first block)"""
        held: list[pa.RecordBatch] = []
        at, block = None, 0
        for batch in batches:
            bucket, part = batch.column("bucket").to_numpy(), batch.column("part").to_numpy()
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
                if at is not None and at != (bucket[a], part[a]):
                    yield (*at, block, held, True)
                    held, block = [], 0
                at = (bucket[a], part[a])
                held.append(batch.slice(a, b - a))
                while sum(h.num_rows for h in held) > limit:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    yield (*at, block, whole.slice(0, limit).to_batches(), False)
                    held, block = whole.slice(limit).to_batches(), block + 1
        if at is not None:
            yield (*at, block, held, True)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(tables)
        node, links, root = [], [], []
        for bucket, part, block, rows, last in runs(batches):
            count = sum(r.num_rows for r in rows)
            alone = last and not block and part < 0
            if alone and count < 2:
                continue
            rows = pa.Table.from_batches(rows)
            names, packed = rows.column("node").to_pylist(), rows.column("vector").to_pylist()
            weight, table_ = rows.column("weight").to_numpy(), rows.column("table")[0].as_py()
            if not alone:
                yield found_rows(bucket=[int(bucket)], block=[(max(0, int(part)) << 32) + block], table_=[table_],
                                 pack=[packed_block(names, weight, packed)])
                continue
            unit = unit_vectors(matrix_of(packed, kind))
            if not linked(unit[:1], unit[1:], tables.settings.threshold).any() and count == 2:
                continue
            own, to = meeting.within(unit, weight, table_)
            for i in np.flatnonzero((own > 0) | (to != np.arange(count))):
                node.append(names[i])
                links.append(int(own[i]))
                root.append(names[to[i]])
            if len(node) > 4096:
                yield found_rows(node, links, root)
                node, links, root = [], [], []
        if node:
            yield found_rows(node, links, root)

    return (placed.repartition(partitions, "bucket", "part").sortWithinPartitions("bucket", "part")
            .mapInArrow(met, FOUND))


def blocks_meet(packs: DataFrame, tables: Tables, kind: str) -> DataFrame:
    """Links between and inside the blocks of large buckets: every two blocks of a bucket meet once."""
    others = packs.groupBy("bucket").agg(F.collect_list("block").alias("others"))
    pairs = packs.join(others, "bucket").withColumn("other", F.explode("others")).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "table", "block", "pack")

    def met(whole: pa.Table) -> pa.Table:
        meeting, table_ = Meeting(tables), whole.column("table")[0].as_py()
        order = np.argsort(whole.column("block").to_numpy(), kind="stable").tolist()
        (names, weight, unit), *more = [unpacked_block(whole.column("pack")[i].as_py(), kind) for i in order[:2]]
        if not more:
            own, to = meeting.within(unit, weight, table_)
            at = np.flatnonzero((own > 0) | (to != np.arange(len(unit))))
            out = found_rows([names[i] for i in at], own[at], [names[to[i]] for i in at])
        else:
            (names2, weight2, unit2), = more
            la, lb, ra, rb = meeting.across(unit, unit2, weight, weight2, table_)
            one, two = np.flatnonzero(ra >= 0), np.flatnonzero(rb >= 0)
            out = found_rows([names[i] for i in one] + [names2[i] for i in two], np.concatenate([la[one], lb[two]]),
                             [names[ra[i]] for i in one] + [names[rb[i]] for i in two])
        return pa.Table.from_batches([out])

    return pairs.groupBy("bucket", "low", "high").applyInArrow(met, FOUND)


def links_of(distinct: DataFrame, kind: str, settings: Settings) -> DataFrame:
    """(node, links, root) parts: links add up; a node and its root are connected.

    :param distinct: node, weight (vectors that are equal), vector (bytes).
    """
    spark = distinct.sparkSession
    total = distinct.count()
    some = [r[0] for r in distinct.orderBy("node").limit(settings.sample).select("vector").collect()]  # nodes are hashes
    length = max({len(v) for v in some}, key=lambda n: (sum(len(v) == n for v in some), -n)) if some else 0
    path = scratch(spark, "links")
    spark.createDataFrame([], FOUND).write.parquet(path)
    if some:
        tables = fitted(unit_vectors(matrix_of([v for v in some if len(v) == length], kind)), total, settings)
        for first in range(0, tables.count, settings.at_once):
            last = min(tables.count, first + settings.at_once)
            partitions = max(slots(spark), -(-total * (last - first) // settings.rows))
            meet(place(distinct, tables, first, last, kind), tables, kind, partitions).write.mode("append").parquet(path)
            release(spark)
        packs = spark.read.schema(FOUND).parquet(path).where("pack IS NOT NULL")
        blocks_meet(packs, tables, kind).write.mode("append").parquet(f"{path}-blocks")
        found = spark.read.schema(FOUND).parquet(path, f"{path}-blocks")
    else:
        found = spark.read.schema(FOUND).parquet(path)
    return found.where("node IS NOT NULL").select("node", "links", "root")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()
                    ) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per different (id, vector).

    Vectors link if their cosine reaches the threshold; n_links counts the
    other ones linked directly, copies among them, and component_id is the
    smallest id reachable, the own one included. Null or empty vectors, zero
    vectors and such with null or non-finite components link with nothing and
    are kept; so do vectors of different lengths. A repeated row counts once.
    An id with several vectors is one row for each of them. Null ids link but
    never name a component that has another; such a row is kept if no id is in
    reach. Other columns are ignored; an empty table gives no row.
    """
    kind = _kind(vectors, embedding)
    rows = written(keyed(vectors, vec_id, embedding), "vectors")
    ids = written(rows.select("vec_id", "node").distinct(), "ids")
    nodes = ids.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    once = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vector").alias("vector"))
    distinct = written(nodes.join(once, "node"), "distinct")
    found = written(links_of(distinct, kind, settings), "found")
    roots = written(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), spread=True), "roots")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    least = roots.select("node", "root").union(roots.select("root", "root").distinct()).toDF("node", "root")
    least = least.join(distinct.select("node", "least"), "node")
    named = joined_spread(least.select("node", "root"), "root", least.groupBy("root").agg(F.min("least").alias("component_id")), "node")
    info = (distinct.select("node", "least", "weight").join(sums, "node", "left")
            .join(named.select("node", "component_id", F.lit(True).alias("tied")), "node", "left")
            .select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                    F.when(F.col("tied"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
    known = joined_spread(ids.where("node IS NOT NULL"), "node", info, "vec_id").select("vec_id", "n_links", "component_id")
    alone = ids.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""


@query("op11_embedding_dedup", SQL)
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
