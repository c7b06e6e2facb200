"""Repeated passages by windows of 20 words grouped by their hash in reference blocks.

The corpus is its own reference: a word sequence is a copy where it also
starts earlier. A duplicate span is a union of windows that all occur earlier,
so grouping equal windows replaces a greedy Relative Lempel-Ziv parse: there
is no longest match against a block, and windows next to each other are merged.

A document meets only the reference blocks that can hold such a factor. Every
window names one anchor, the smallest hash of its 8-word runs, which depends
on the window alone; equal windows have equal anchors. Anchors (one word in
seven) are counted first. Windows whose anchor occurs once are unique; the
others go to the reference block of their anchor, where the index of window
hashes says which of them start earlier elsewhere.

Both rounds combine inside a chunk of text before they shuffle: a chunk sends
an anchor or window once, however many copies of it the chunk holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import (as_bytes, chunks, gram_checks, gram_hashes, hashed_words, only_own_names, release,
                                   row_order, slots, table, without_words, written)

WINDOW = 20
ANCHOR = 8
CHUNK = 4 << 20
WORD = rb"[^\x20\x09-\x0D]+"
#: Stands for a null id, which orders before all others.
NO_ID = -(1 << 63)
#: What stands for the words of a window: 96 bits, so that windows of different words do not meet by chance.
KEY = np.dtype([("hash", "<u8"), ("check", "<u4")])
#: Rows for reference blocks have a block, rows for documents have an id.
PARTS = "block long, doc_id long, hash long, hashes binary, texts binary, places binary, ids binary"


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:len(values) - rest], values[rest:]) if rest else values


def windows_of(words: np.ndarray, bounds: np.ndarray, window: int, anchor: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, anchor hash) of every window of a chunk; windows do not cross texts."""
    count = max(0, len(words) - window + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(text[:count] == text[window - 1:]) if count else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    anchors = sliding(gram_hashes(words, anchor), window - anchor + 1, np.minimum)
    return starts, text[starts], anchors[starts]


def anchor_places(words: np.ndarray, starts: np.ndarray, anchors: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Places whose 8-word run is the anchor of a window; equal windows have theirs at different places."""
    grams = gram_hashes(words, anchor)
    reach = window - anchor
    largest = np.zeros(len(grams) + reach, np.uint64)  # of the windows that start at a place
    largest[starts + reach] = anchors
    return np.flatnonzero(sliding(largest, reach + 1, np.maximum) == grams)


def window_keys(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """KEY of the windows that begin at ``starts``."""
    keys = np.empty(len(starts), KEY)
    keys["hash"], keys["check"] = gram_hashes(words, window)[starts], gram_checks(words, window)[starts]
    return keys


def by_window(values: np.ndarray, text: np.ndarray, place: np.ndarray, keys: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, later): windows ordered by key, text and place; the first of each key; those that start after it."""
    order = np.lexsort((place, keys[text, 1], keys[text, 0], values["check"], values["hash"]))
    values, text, place = values[order], text[order], place[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return order, first, (place != place[lead]) | (keys[text] != keys[text[lead]]).any(axis=1)


def keyed(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Texts with the key of their document: the id, and a hash of the text that orders texts of one id."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("hash"),
                       F.coalesce("text", F.lit("")).alias("text"))


def _parts(values: np.ndarray, texts: np.ndarray, places: np.ndarray, blocks: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """One row per block: its hashes, text numbers and places, and the keys (id, hash) of the texts named."""
    order = np.lexsort((places, texts, blocks))
    values, texts, places, blocks = values[order], texts[order], places[order], blocks[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]) if len(blocks) else np.zeros(1, int)
    rows = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    named = [np.unique(texts[a:b], return_inverse=True) for a, b in rows]

    def column(parts: list[np.ndarray]) -> pa.Array:
        return pa.array([p.tobytes() for p in parts], pa.binary())

    none = pa.nulls(len(rows), pa.int64())
    return pa.record_batch({
        "block": pa.array([int(blocks[a]) for a, _ in rows], pa.int64()), "doc_id": none, "hash": none,
        "hashes": column([values[a:b] for a, b in rows]), "texts": column([i.astype(np.int32) for _, i in named]),
        "places": column([places[a:b].astype(np.int32) for a, b in rows]), "ids": column([keys[u] for u, _ in named]),
    })


def _answers(keys: np.ndarray, texts: np.ndarray, values: np.ndarray, name: str) -> dict[str, pa.Array]:
    """One row per text: its key and its values, packed."""
    order = np.argsort(texts, kind="stable")
    texts, values = texts[order], values[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(texts)) + 1, [len(texts)]]) if len(texts) else np.zeros(1, int)
    rows = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    own = keys[texts[cuts[:-1]]] if rows else np.zeros((0, 2), np.int64)
    return {"doc_id": pa.array(own[:, 0]), "hash": pa.array(own[:, 1]),
            name: pa.array([values[a:b].tobytes() for a, b in rows], pa.binary())}


def _local(keys: np.ndarray, texts: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
    """Answers a chunk can give itself, in the shape of PARTS."""
    own = _answers(keys, texts, values, name)
    n = len(own["doc_id"])
    empty = pa.nulls(n, pa.binary())
    columns = {"block": pa.nulls(n, pa.int64()), "hashes": empty, "texts": empty, "places": empty, "ids": empty} | own
    return pa.record_batch([columns[c.split()[0]] for c in PARTS.split(", ")], names=[c.split()[0] for c in PARTS.split(", ")])


def _chunk_keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column("doc_id").to_numpy(), batch.column("hash").to_numpy()], axis=1).astype(np.int64)


def _block(whole: pa.Table, kind: np.dtype = np.dtype("<u8")) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, text numbers, places and text keys of a reference block, its parts put together."""
    hashes = np.frombuffer(b"".join(whole.column("hashes").to_pylist()), kind)
    places = np.frombuffer(b"".join(whole.column("places").to_pylist()), np.int32)
    keys = [np.frombuffer(k, np.int64).reshape(-1, 2) for k in whole.column("ids").to_pylist()]
    base = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    texts = np.concatenate([np.frombuffer(t, np.int32) + base[i] for i, t in enumerate(whole.column("texts").to_pylist())])
    return hashes, texts, places, np.concatenate(keys)


def repeated_anchors(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, hash, places): the anchors (packed 64-bit hashes) of each text that occur more than once."""
    blocks = np.uint64(slots(texts.sparkSession) * 2)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in chunks(batches, "text", CHUNK):
            words, bounds = hashed_words(data)
            starts, _, anchors = windows_of(words, bounds, window, anchor)
            if not len(starts):
                continue
            keys = _chunk_keys(batch)
            at = anchor_places(words, starts, anchors, window, anchor)
            value = gram_hashes(words, anchor)[at]
            text = np.searchsorted(bounds, at, "right") - 1
            # The first of each hash goes out; texts whose hash the chunk holds again need no answer.
            distinct, first, count = np.unique(value, return_index=True, return_counts=True)
            again = (count > 1)[np.searchsorted(distinct, value)]
            pairs = np.unique(np.stack([text[again].astype(np.uint64), value[again]], axis=1), axis=0)
            yield _parts(value[first], text[first], np.zeros(len(first), np.int32),
                         ((value[first] >> np.uint64(20)) % blocks).astype(np.int64), keys)
            if len(pairs):
                yield _local(keys, pairs[:, 0].astype(np.int64), pairs[:, 1], "places")

    def counted(whole: pa.Table) -> pa.Table:
        hashes, text, _, keys = _block(whole)
        order = np.argsort(hashes)
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return pa.table(_answers(keys, text[again], hashes[again], "places"))

    parts = written(texts.mapInArrow(sent, PARTS), "anchors")
    answer = "doc_id long, hash long, places binary"
    found = (parts.where("block IS NOT NULL").select("block", "hashes", "texts", "places", "ids").groupBy("block")
             .applyInArrow(counted, answer))
    return found.unionByName(parts.where("block IS NULL").select("doc_id", "hash", "places"))


def gathered(answers: DataFrame) -> DataFrame:
    """All answers for a text in one row."""
    return answers.groupBy("doc_id", "hash").agg(F.collect_list("places").alias("places"))


def repeated_windows(texts: DataFrame, anchors: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, hash, places): starts (packed 32-bit) of the windows of each text whose words also start earlier."""
    blocks = np.uint64(slots(texts.sparkSession) * 2)
    candidates = texts.join(gathered(anchors), ["doc_id", "hash"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in chunks(batches, "text", CHUNK):
            words, bounds = hashed_words(data)
            starts, text, named = windows_of(words, bounds, window, anchor)
            keys = _chunk_keys(batch)
            known = [np.unique(np.frombuffer(b"".join(p), np.uint64)) for p in batch.column("places").to_pylist()]
            low = np.searchsorted(text, np.arange(len(data) + 1))
            chosen = np.concatenate([np.zeros(0, np.int64)] + [
                low[i] + np.flatnonzero(np.isin(named[low[i]:low[i + 1]], k)) for i, k in enumerate(known)])
            if not len(chosen):
                continue
            starts, text, named = starts[chosen], text[chosen], named[chosen]
            value = window_keys(words, starts, window)
            place = (starts - bounds[text]).astype(np.int64)
            # Of equal windows the earliest goes out (with it, the same place of a repeated row); the later ones are copies.
            order, first, later = by_window(value, text, place, keys)
            value, text, place, named = value[order], text[order], place[order], named[order]
            yield _parts(value[first], text[first], place[first],
                         ((named[first] >> np.uint64(20)) % blocks).astype(np.int64), keys)
            if later.any():
                yield _local(keys, text[later], place[later].astype(np.int32), "places")

    def looked_up(whole: pa.Table) -> pa.Table:
        values, text, place, keys = _block(whole, KEY)
        order, _, later = by_window(values, text, place, keys)
        text, place = text[order], place[order]
        return pa.table(_answers(keys, text[later], place[later].astype(np.int32), "places"))

    parts = written(candidates.mapInArrow(sent, PARTS), "windows")
    answer = "doc_id long, hash long, places binary"
    found = (parts.where("block IS NOT NULL").select("block", "hashes", "texts", "places", "ids").groupBy("block")
             .applyInArrow(looked_up, answer))
    return found.unionByName(parts.where("block IS NULL").select("doc_id", "hash", "places"))


def factors(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Duplicate spans (start, end) of a text from the starts of its repeated windows: those that overlap or touch merge.
    """
    if not len(starts):
        return []
    starts = np.unique(starts)
    gap = np.flatnonzero(np.diff(starts) > 1)
    first = starts[np.concatenate([[0], gap + 1])]
    end = starts[np.concatenate([gap, [len(starts) - 1]])] + window
    apart = np.flatnonzero(first[1:] > end[:-1])
    return list(zip(first[np.concatenate([[0], apart + 1])].tolist(), end[np.concatenate([apart, [len(end) - 1]])].tolist()))


def find(docs: DataFrame, doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, hash, places): for each text with repeated windows their starts, in packed parts; null ids are NO_ID.

    A window is repeated if its words also start earlier: in a text of smaller
    id (null first), in one of the same id and smaller hash, or earlier in the
    same text. Null texts and texts shorter than a window have none. Rows equal
    in id and text are one text here.
    """
    texts = keyed(docs, doc_id)
    anchors = written(repeated_anchors(texts, window, anchor), "repeated-anchors")
    return written(repeated_windows(texts, anchors, window, anchor), "repeated-windows")


def _with_places(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with _places (packed starts) and _copy (0 for the first row of an id and text)."""
    release(docs.sparkSession)
    own = gathered(found).toDF("_id", "_hash", "_places")
    keys = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_hash": F.xxhash64("text")})
    copy = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(row_order(docs))) - 1
    return keys.join(own, ["_id", "_hash"], "left").withColumn("_copy", copy)


def _spans(words: int, places: list[bytes] | None, copy: int, window: int) -> list[tuple[int, int]]:
    if copy and words >= window:
        return [(0, words)]  # a repeated row: all of it starts earlier
    return factors(np.frombuffer(b"".join(places), np.int32).astype(np.int64), window) if places else []


def removals(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of docs.

    A repeated row (id and text) is a copy of the first such row. Null and
    empty texts have no words.
    """
    from hashlib import sha256

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            total, gone, digest = [], [], []
            for text, places, copy in zip(texts, batch.column("_places").to_pylist(), batch.column("_copy").to_pylist()):
                words = text.split()
                spans = _spans(len(words), places, copy, window)
                total.append(len(words))
                gone.append(sum(b - a for a, b in spans))
                for a, b in reversed(spans):
                    del words[a:b]
                digest.append(sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()),
                                   "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    rows = _with_places(docs.select("doc_id", "text"), find(docs, "doc_id", window, anchor))
    return rows.select("doc_id", "text", "_places", "_copy").mapInArrow(
        parsed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


@only_own_names
def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with the repeated spans cut out of ``text``; all rows and other columns, of any name, stay.

    Null and empty texts stay as they are; an empty table gives an empty one.
    Of rows equal in id and text, one keeps its text, chosen by a hash of all its columns.
    """
    columns = docs.columns
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, places, copy in zip(as_bytes(batch.column("text")), batch.column("_places").to_pylist(),
                                          batch.column("_copy").to_pylist()):
                spans = _spans(len(text.split()), places, copy, window) if text and (places or copy) else []
                new.append(without_words(text, WORD, spans) if spans else text)
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.record_batch(arrays, names=columns)

    rows = _with_places(docs, find(docs, "doc_id", window, anchor))
    return rows.select(*[F.col(f"`{c}`") for c in columns], "_places", "_copy").mapInArrow(cut, docs.schema)


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole document without the windows of 20 words that start earlier."""
    return removals(table(spark, sf_dir, "documents"))
