"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a bounded chunk of documents. Words that no benchmark item uses can
be in no occurrence, so they become separators, and only the stretches between
them that are long enough for a phrase are indexed: their suffixes are sorted,
the Burrows-Wheeler transform goes into a wavelet matrix, and every test
phrase is searched backwards by its ranks. Occurrences are located from
sampled suffix positions and merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import as_bytes, chunks, only_own_names, spans_of, table, without_words

WINDOW = 10
#: Bytes of benchmark text that travel to the executors together; more make a further pass each.
PACK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
SAMPLE_EVERY = 32
#: Letters and digits in lower case and all bytes beyond ASCII stay, the rest separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Wavelet:
    """Ranks of symbols in a sequence: a bit plane per bit of the symbols, zeros before ones in the next plane."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes = []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = len(bit) - int(bit.sum())
            self.planes.append((level, packed, before, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low, high = np.zeros_like(end), end
        for level, packed, before, zeros in self.planes:
            one = ((symbol >> level) & 1).astype(bool)
            low, high = (np.where(one, zeros + ones, at - ones) for at, ones in
                         ((at, before[at >> 6] + np.bitwise_count(
                             packed[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))))
                          for at in (low, high)))
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions in the order of the suffixes, by doubling; only suffixes still equal are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_ = symbols[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while not first.all():
        last = np.concatenate([first[1:], [True]])
        open_ = np.flatnonzero(~(first & last))  # places whose suffix shares its rank
        at = order[open_]
        beyond = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        again = np.lexsort((beyond, rank[at]))
        at, beyond = at[again], beyond[again]
        order[open_] = at
        group = rank[at]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])])
        first[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        step *= 2
    return order


class Index:
    """FM-index of a sequence of symbols 1.. with separators 0; phrases hold no separator."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.size = len(symbols)
        order = suffix_order(symbols)
        before = symbols[order - 1]  # the symbol before a suffix; position -1 is the last separator
        self.wavelet = Wavelet(before, int(alphabet).bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        self.before = before
        sampled = (order % SAMPLE_EVERY == 0) | (before == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (padded at the front), all searched backwards together."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for step in range(phrases.shape[1]):
            alive = np.flatnonzero((lengths > step) & (high > low))
            if not len(alive):
                break
            symbol = phrases[alive, phrases.shape[1] - 1 - step]
            low[alive] = self.less[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.less[symbol] + self.wavelet.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to the nearest sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol = self.before[rows[walking]]
            rows[walking] = self.less[symbol] + self.wavelet.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.positions[self.sample_rank[rows]] + steps


@dataclass(frozen=True)
class Pack:
    """Part of a benchmark: its words, its distinct phrases (padded at the front) and the items of each phrase."""

    words: dict[bytes, int]
    phrases: np.ndarray
    lengths: np.ndarray
    item_bounds: np.ndarray
    items: np.ndarray
    names: list

    @staticmethod
    def of(items: list[tuple[object, bytes]], window: int) -> Pack:
        words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        names: dict = {}
        for name, text in items:
            ids = [words.setdefault(w, len(words) + 1) for w in text.translate(WORD_BYTES).split()]
            number = names.setdefault(name, len(names))
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(tuple(ids[i:i + window]), set()).add(number)
        phrases = np.zeros((len(found), window), np.int64)
        for k, phrase in enumerate(found):
            phrases[k, window - len(phrase):] = phrase
        sizes = [len(v) for v in found.values()]
        return Pack(words, phrases, np.array([len(p) for p in found], np.int64),
                    np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                    np.array([i for v in found.values() for i in sorted(v)], np.int64), list(names))


def packs(benchmark: DataFrame, item_id: str, window: int) -> Iterator[Pack]:
    """The benchmark in packs of bounded size, fetched one after the other."""
    part: list[tuple[object, bytes]] = []
    size = 0
    rows = benchmark.where("text IS NOT NULL").select(F.col(item_id).cast("string"), "text").distinct()
    for name, text in rows.toLocalIterator():
        data = text.encode()
        if part and size + len(data) > PACK_BYTES:
            yield Pack.of(part, window)
            part, size = [], 0
        part.append((name, data))
        size += len(data)
    if part:
        yield Pack.of(part, window)


def shard_hits(texts: list[bytes], pack: Pack) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list]]:
    """Words, hit spans (word numbers, merged) and names of the items found, per text of a shard."""
    lookup = pack.words.get
    numbers = [[lookup(w, 0) for w in t.translate(WORD_BYTES).split()] for t in texts]
    counts = np.fromiter(map(len, numbers), np.int64, len(texts))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[list] = [[] for _ in texts]
    if not len(pack.lengths) or not counts.sum():
        return counts, spans, names
    # One separator after each text keeps phrases inside it.
    symbols = np.zeros(int(counts.sum()) + len(texts), np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    for i, own in enumerate(numbers):
        symbols[starts[i]:starts[i] + len(own)] = own
    edges = np.flatnonzero(np.diff(np.concatenate([[False], symbols > 0, [False]]).view(np.int8)))
    runs = np.stack([edges[0::2], edges[1::2]])
    runs = runs[:, runs[1] - runs[0] >= pack.lengths.min()]
    if not runs.shape[1]:
        return counts, spans, names
    # A stretch and the separator after it.
    size = runs[1] - runs[0] + 1
    place = np.repeat(runs[0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    kept = symbols[place]
    index = Index(kept, len(pack.words))
    low, high = index.search(pack.phrases, pack.lengths)
    hit = np.flatnonzero(high > low)
    times = (high - low)[hit]
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    phrase = np.repeat(hit, times)
    at = place[index.locate(rows)]
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + pack.lengths[phrase], -1)
    covered = np.cumsum(change[:-1]) > 0
    of_text = np.searchsorted(starts, at, "right") - 1
    pairs = np.unique(of_text * len(pack.lengths) + phrase)
    for i in np.unique(of_text).tolist():
        spans[i] = spans_of(covered[starts[i]:starts[i] + counts[i]])
    for pair in pairs.tolist():
        i, k = divmod(pair, len(pack.lengths))
        names[i] += [pack.names[j] for j in pack.items[pack.item_bounds[k]:pack.item_bounds[k + 1]]]
    return counts, spans, names


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW
         ) -> DataFrame:
    """docs with _words (number of words), _spans (merged spans of hit words) and _items (names of items found, sorted).

    A phrase is ``window`` words of an item, or a whole shorter one. Null and
    empty texts have no words; items without words find nothing; items with a
    null id count under one null name, which is hit but not listed. Repeated
    rows are judged each. Nothing is shuffled: a document is judged where it is
    read, once per pack of the benchmark (one, unless the benchmark exceeds
    ``PACK_BYTES``).
    """
    columns = docs.columns
    out = docs.withColumns({"_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<struct<start:long,end:long>>"),
                            "_items": F.array().cast("array<string>")})
    schema = out.schema
    found_any = False
    for pack in packs(benchmark, item_id, window):
        found_any = True
        # The pack travels with the function; ``PACK_BYTES`` bounds it.
        def judged(batches: Iterator[pa.RecordBatch], pack: Pack = pack) -> Iterator[pa.RecordBatch]:
            for batch, texts in chunks(batches, text, SHARD_BYTES):
                counts, spans, names = shard_hits(texts, pack)
                old_spans, old_items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
                spans = [merge([(s["start"], s["end"]) for s in a] + b) for a, b in zip(old_spans, spans)]
                items = [sorted({*a, *(x for x in b if x is not None)}) for a, b in zip(old_items, names)]
                yield pa.record_batch(
                    [batch.column(c) for c in columns]
                    + [pa.array(counts), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans],
                                                  pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                       pa.array(items, pa.list_(pa.string()))], names=[*columns, "_words", "_spans", "_items"])

        out = out.mapInArrow(judged, schema)
    if not found_any:
        words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD.decode())).cast("long")
        out = out.withColumn("_words", words)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def hit_words() -> Column:
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


@only_own_names
def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words of benchmark phrases: the spans are cut out of ``text``, other columns (of any name) stay.

    All rows stay, repeated ones too; null and empty texts are as before, and so is an empty table.
    """
    columns = docs.columns
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            spans = batch.column("_spans").to_pylist()
            new = [t if not s else without_words(t, WORD, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)]
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.record_batch(arrays, names=columns)

    return find(docs, benchmark, window=window).mapInArrow(cut, docs.schema)


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against all benchmark phrases of ten words."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit_words().alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))
