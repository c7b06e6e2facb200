"""Helpers the operators share: tables, folds, words and bounded text chunks."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark import session

#: ASCII capitals become small letters; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text handled together by the vectorised operators.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")).cast("string")) % parts


def fold_of(key: str, parts: int) -> Column:
    """As :func:`fold`, for an id column of any type."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return session.scratch_folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table below the checkpoint folder and read it back.

    Lineage ends there, so a lost executor costs no earlier stage. Shuffle
    files of stages that ended before are given back first.
    """
    spark = df.sparkSession
    release(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files that no plan needs any more.

    It does so when the driver collects its garbage, which may otherwise take
    longer than the next stage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slots(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in order, cut so that a chunk holds about ``limit`` bytes of text or one longer text; null is empty."""
    for batch in batches:
        texts = [b or b"" for b in as_bytes(batch.column(text))]
        start = size = 0
        for i, value in enumerate(texts):
            if size and size + len(value) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(value) + 1
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def zipped(df: DataFrame, text: str) -> DataFrame:
    """df with its text column as compressed bytes (null as empty), for texts that have to be shuffled."""
    import zstandard

    columns = df.columns
    at = columns.index(text)

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array([compress(t or b"") for t in as_bytes(arrays[at])], pa.binary())
            yield pa.record_batch(arrays, names=columns)

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(compressed, schema)


def unzipped(column: pa.Array) -> list[bytes]:
    import zstandard

    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker.

    Functions of the package travel by value, so their globals last one task;
    workers serve many tasks and can keep what is slow to build.
    """
    home = sys.modules.setdefault("policyspark_worker_store", types.ModuleType("policyspark_worker_store"))
    return vars(home).setdefault(name, {})


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty segments give 0."""
    total = np.concatenate([np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: White space separates words; other bytes make them up.
BLANKS = b"\t\n\x0b\x0c\r "
#: Columns that stages know by name.
OWN_NAMES = ("doc_id", "text", "n_chars")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TURN = np.uint64(0xA24BAED4963EE407)


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every other; one to one."""
    values = (values ^ (values >> np.uint64(31))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _TURN
    return values ^ (values >> np.uint64(32))


def hashed_words(texts: list[bytes], clean: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a chunk of texts, and the bounds of each text in them.

    ``clean`` maps every byte before the words are cut at blanks.
    """
    buffer, starts, sizes, bounds = cut_words(texts, clean)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    return block_hashes(*blocks_of(buffer, starts, sizes), sizes), bounds


def cut_words(texts: list[bytes], clean: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, sizes, bounds): the bytes of all texts, their words in them, and the bounds of each text in the words."""
    joined = b" ".join(texts) + b" "
    buffer = np.frombuffer(joined.translate(clean) if clean else joined, np.uint8)
    blank = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts = edges[0::2]
    text_starts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return buffer, starts, edges[1::2] - starts, np.searchsorted(starts, text_starts)


def block_hashes(first: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given as blocks."""
    # Short words are one block each; the blocks of longer ones are scrambled with their number before they are added.
    place = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    sums = np.add.reduceat(mixed(mixed(values) + place.astype(np.uint64) * _STEP), first)
    return mixed(sums + sizes.astype(np.uint64) * _TURN)


def blocks_of(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's first block, blocks): the bytes of words as 64-bit numbers, eight at a time, padded by zeros."""
    counts = (sizes + 7) >> 3
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    inside = (np.arange(int(counts.sum())) - np.repeat(first, counts)) * 8
    at = np.repeat(starts, counts) + inside
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(buffer) + 1, "<u8", padded, strides=(1,))[at]
    missing = np.maximum(0, inside + 8 - np.repeat(sizes, counts)).astype(np.uint64) * np.uint64(8)
    return first, eights & (~np.uint64(0) >> missing)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words (texts not regarded)."""
    count = max(0, len(words) - n + 1)
    code = np.zeros(count, np.uint64)
    for j in range(n):
        code = code * _STEP + words[j:j + count]
    return mixed(code)


def gram_checks(words: np.ndarray, n: int) -> np.ndarray:
    """Further 32 bits on all runs of n neighbouring words, independent of :func:`gram_hashes`."""
    count = max(0, len(words) - n + 1)
    turned = mixed(words ^ _STEP)
    code = np.zeros(count, np.uint64)
    for j in range(n):
        code = code * _TURN + turned[j:j + count]
    return (mixed(code) >> np.uint64(32)).astype(np.uint32)


def sequence_hash(values: np.ndarray) -> np.uint64:
    """One 64-bit hash of a sequence of 64-bit values of any length."""
    place = np.arange(len(values), dtype=np.uint64) * _STEP
    total = np.add.reduce(mixed(mixed(values) + place), keepdims=True)
    return mixed(total + np.array([len(values)], np.uint64) * _TURN)[0]


def row_order(docs: DataFrame) -> Column:
    """A hash of all columns that have one: orders rows of one id and text that differ elsewhere."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind])


def only_own_names(stage):
    """A function of a table that gives its columns back, freed of clashes with names it uses inside.

    Columns other than ``doc_id``, ``text`` and ``n_chars`` pass it under neutral names.
    """
    from functools import wraps

    @wraps(stage)
    def renamed(docs: DataFrame, *args, **kwargs) -> DataFrame:
        columns = docs.columns
        neutral = [c if c in OWN_NAMES else f"column{i}" for i, c in enumerate(columns)]
        return stage(docs.toDF(*neutral), *args, **kwargs).toDF(*columns)

    return renamed


def spans_of(covered: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).view(np.int8)))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


def without_words(text: bytes, word: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` (word numbers) and what stands between the words of a span."""
    import re

    if not spans:
        return text
    out, at, todo = [], 0, iter(spans)
    start, end = next(todo)
    for i, match in enumerate(re.finditer(word, text)):
        if i == start:
            out.append(text[at:match.start()])
        if i == end - 1:
            at = match.end()
            start, end = next(todo, (-1, -1))
            if start < 0:
                break
    return b"".join(out) + text[at:]
