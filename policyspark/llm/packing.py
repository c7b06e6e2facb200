"""Best-fit packing under conflicts: bins of fixed capacity, no two pieces of one source or duplicate cluster in a bin.

Documents longer than the capacity are cut; full pieces are bins of their own.
The other pieces are dealt into packing shards of bounded size, and each shard
is packed longest first: bins stand in the order of their residual, carry a
bitmap of sources and one of clusters, and the search goes on from the first
bin that is large enough to its successors until one is compatible. Being the
first in that order, it is the tightest compatible one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import table

CAPACITY = 2048
#: Pieces a packing shard holds on average; it bounds a task's memory and the length of a search.
SHARD_PIECES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece, in the given order; null sources and clusters conflict with nothing."""
    source_bits: dict = {}
    cluster_bits: dict = {}

    def bit(known: dict, value) -> int:
        return 0 if value is None else 1 << known.setdefault(value, len(known))

    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    in_sources: list[int] = []
    in_clusters: list[int] = []
    chosen = []
    for length, source, cluster in zip(lengths, sources, clusters):
        s, c = bit(source_bits, source), bit(cluster_bits, cluster)
        at = bisect_left(order, (length, -1))
        while at < len(order) and (in_sources[order[at][1]] & s or in_clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, bin_ = order.pop(at)
        else:
            residual, bin_ = capacity, len(in_sources)
            in_sources.append(0)
            in_clusters.append(0)
        in_sources[bin_] |= s
        in_clusters[bin_] |= c
        if residual > length:
            insort(order, (residual - length, bin_))
        chosen.append(bin_)
    return chosen


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def text_cluster(text: str = "text") -> Column:
    """Copies share a cluster: a hash of the lower-cased text; null and empty texts have none."""
    return F.when(F.length(text) > 0, F.xxhash64(F.lower(text)))


def pack(docs: DataFrame, doc_id: str = "doc_id", length: str = "length", source: str = "source",
         cluster: str = "cluster", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack documents of known length into bins of ``capacity``.

    :return: doc_id, piece (from 0), start (offset in the document), length,
        bin (long), bin_offset. Every document gives at least one row. A length
        that is null, zero or negative gives one row with length 0 and null bin
        and offset. Repeated rows are packed as documents of their own (in a
        bin each if they share a cluster). Ties of length go by id, then piece.
        An empty table gives no row.

    Only ids, lengths, sources and clusters are shuffled. A piece goes to a
    shard by a hash of its id and contents, so a hot source or cluster is
    spread over all shards.
    """
    n = F.greatest(F.coalesce(F.col(length), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    cut = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(source).cast("string")).alias("_s"), F.col(source).isNull().alias("_sn"),
        F.xxhash64(F.col(cluster).cast("string")).alias("_c"), F.col(cluster).isNull().alias("_cn"), n.alias("_n"),
    ).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("_n") - 1) / capacity), F.lit(0))
                                       .cast("long"))).alias("piece"))
    pieces = cut.select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.col("_n") - F.col("piece") * capacity, F.lit(capacity)).alias("length"),
        F.when(~F.col("_sn"), F.col("_s")).alias("_s"), F.when(~F.col("_cn"), F.col("_c")).alias("_c"),
    )
    shards = max(1, -(-docs.count() // shard_pieces))
    # 40 bits for the shard, 23 for the bin in it.
    pieces = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "_c", "length"), F.lit(shards)))

    def of_shard(whole: pa.Table) -> pa.Table:
        whole = whole.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_c", "ascending"),
                               ("_s", "ascending")])
        lengths = whole.column("length").to_pylist()
        full = sum(n > 0 for n in lengths)  # pieces without length come last and go into no bin
        bins = best_fit(lengths[:full], whole.column("_s").to_pylist(), whole.column("_c").to_pylist(), capacity)
        filled: dict[int, int] = {}
        offsets: list[int | None] = []
        for bin_, size in zip(bins, lengths):
            offsets.append(filled.get(bin_, 0))
            filled[bin_] = offsets[-1] + size
        base = (whole.column("_shard")[0].as_py() if whole.num_rows else 0) << 23
        empty = [None] * (len(lengths) - full)
        return pa.table({
            "doc_id": whole.column("doc_id"), "piece": whole.column("piece"), "start": whole.column("start"),
            "length": whole.column("length"), "bin": pa.array([base + b for b in bins] + empty, pa.int64()),
            "bin_offset": pa.array(offsets + empty, pa.int64()),
        })

    kind = docs.schema[doc_id].dataType.simpleString()
    return pieces.groupBy("_shard").applyInArrow(
        of_shard, f"doc_id {kind}, piece long, start long, length long, bin long, bin_offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents by their word counts, copies of a text being one cluster."""
    return pack(docs.select("doc_id", "source", word_count().alias("length"), text_cluster().alias("cluster")),
                capacity=capacity)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of 2,048 words, no source and no text twice in a bin."""
    return pack_documents(table(spark, sf_dir, "documents"))
