"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Texts are range-partitioned by id before they are encoded, so the ids
themselves are never shuffled and every file holds one range of ids in
ascending order. ORC stores the ids in stripes of run-length encoded integers;
readers take stripes in parallel and skip stripes and row groups by the
minimum, maximum and Bloom filter of the document id.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import LOWER, block_hashes, blocks_of, chunks, cut_words, scratch, slots, table, worker_store

END_ID = 1
#: Words whose ids a worker remembers; it starts anew beyond that.
REMEMBERED = 800_000
#: Words of one call of the tokenizer.
CALL_WORDS = 1000
#: Marks that the tokenizer keeps apart, as one run, from a letter before them.
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_{}~"
IS_MARK = np.isin(np.arange(256), np.frombuffer(MARKS, np.uint8))
ORC_OPTIONS = {
    "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd",
}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def marks_apart(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bounds: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as of :func:`cut_words`; a run of final marks after a small letter is a word of its own, but not in words with a bar."""
    ends, mark = starts + sizes, IS_MARK[buffer]
    marked = np.flatnonzero(mark[ends - 1])
    others = np.flatnonzero(~mark)  # the buffer ends with a blank
    cuts = others[np.searchsorted(others, ends[marked]) - 1] + 1
    last = buffer[cuts - 1]
    split = (cuts > starts[marked]) & (cuts < ends[marked]) & (last >= 97) & (last <= 122)
    bars = np.flatnonzero(buffer == 124)
    if len(bars):
        split &= np.searchsorted(bars, starts[marked]) == np.searchsorted(bars, ends[marked])
    marked, cuts = marked[split], cuts[split]
    starts, ends = np.insert(starts, marked + 1, cuts), np.insert(ends, marked, cuts)
    return starts, ends - starts, bounds + np.searchsorted(marked, bounds)


class WordEncoder:
    """Encodes texts word by word and remembers the words.

    The tokenizer splits at white space before anything else and never joins
    across it, so the ids of a text are those of its words in turn. It also
    ignores case and keeps a run of final marks apart from letters before it;
    both make words repeat more often. Texts that may hold the tokenizer's own
    special strings are taken word by word as written; of the others, final
    marks are cut off as words of their own, and each distinct word of a chunk
    is looked up once.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[bytes, bytes] = {}
        separators = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.separator_id, self.separator = next(iter(sorted(separators.items(), reverse=True)), (None, None))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def calls(self, words: list[str], glue: str, ends) -> list[bytes] | None:
        """Ids of words encoded many at a time; ``ends`` gives (first, end) places of each word's ids, if it can tell."""
        out: list[bytes] = []
        for i in range(0, len(words), CALL_WORDS):
            part = words[i:i + CALL_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([glue.join(part)], add_special_tokens=False)[0].ids, "<u4")
            first, end = ends(ids)
            if len(end) != len(part):
                return None
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip((first * 4).tolist(), (end * 4).tolist())]
        return out

    def encode_whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of words without a bar, which all special strings have.

        Words of small letters only are one piece to the tokenizer, so their
        last token carries the mark of a word's end; the others are kept apart
        by a special token.
        """
        def marked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            end = np.flatnonzero(self.ends_word[ids]) + 1
            return np.concatenate([[0], end[:-1]]), end

        def separated(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(ids == self.separator_id)
            return np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]])

        text = [w.decode() for w in words]
        plain = [t.isalpha() and t == t.lower() for t in text]
        out: dict[bytes, bytes] = {}
        for ways, want in (((" ", marked), True), ((self.separator, separated), False)):
            names = [w for w, p in zip(words, plain) if p == want]
            pieces = [t for t, p in zip(text, plain) if p == want]
            ids = self.calls(pieces, *ways) if ways[0] is not None else None
            if ids is None:
                ids = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            out.update(zip(names, ids))
        return out

    def learn(self, words: Iterable[bytes]) -> None:
        composed = {}
        plain = set()
        for word in words:
            if word[-1] in MARKS:
                core = word.rstrip(MARKS)
                if core and 97 <= core[-1] <= 122 and b"|" not in word:
                    composed[word] = (core, word[len(core):])
                    plain.update(composed[word])
                    continue
            plain.add(word)
        plain = {w for w in plain if w not in self.known}
        special = [w for w in plain if b"|" in w]
        rest = [w for w in plain if b"|" not in w]
        self.known.update(self.encode_whole(rest))
        for word in special:
            self.known[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        for word, (core, tail) in composed.items():
            self.known[word] = self.known[core] + self.known[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if not any(b"<|" in t for t in texts):
            return self.encode_distinct(texts)
        return list(chain.from_iterable(self.encode_distinct([t]) if b"<|" not in t else [self.encode_words(t.split())] for t in texts))

    def encode_words(self, words: list[bytes]) -> bytes:
        self.learn(set(words).difference(self.known))
        return b"".join(map(self.known.__getitem__, words))

    def encode_distinct(self, texts: list[bytes]) -> list[bytes]:
        """Each distinct word of the texts is looked up once; words are grouped by hash, and the groups compared byte by byte."""
        buffer, starts, sizes, bounds = cut_words(texts, LOWER)
        if not len(starts):
            return [b""] * len(texts)
        starts, sizes, bounds = marks_apart(buffer, starts, sizes, bounds)
        first, blocks = blocks_of(buffer, starts, sizes)
        _, index, group = np.unique(block_hashes(first, blocks, sizes), return_index=True, return_inverse=True)
        model = index[group]
        counts = (sizes + 7) >> 3
        same = np.array_equal(sizes, sizes[model]) and np.array_equal(
            blocks, blocks[np.repeat(first[model] - first, counts) + np.arange(len(blocks))])
        if not same:  # two words of one hash
            return [self.encode_words(t.translate(LOWER).split()) for t in texts]
        data = buffer.tobytes()
        words = [data[a:b] for a, b in zip(starts[index].tolist(), (starts + sizes)[index].tolist())]
        ids = list(map(self.known.get, words))
        if new := [i for i, of in enumerate(ids) if of is None]:
            self.learn([words[i] for i in new])
            for i in new:
                ids[i] = self.known[words[i]]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        offsets = np.cumsum(lengths) - lengths
        long = lengths[group]
        ends = np.concatenate([[0], np.cumsum(long)])
        at = np.repeat(offsets[group] - ends[:-1], long) + np.arange(ends[-1])
        out = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        cuts = (ends[bounds] * 4).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def encode(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID
           ) -> DataFrame:
    """doc_id, hash (of the text), n_tokens, ids: sorted by id within ranges of ids; one row per row of docs.

    Every text ends with ``end_id``; null and empty texts hold nothing else.
    Null ids come first; rows of one id are ordered by a hash of their text.
    """
    with open(tokenizer or tokenizer_file(), encoding="utf-8") as file:
        definition = file.read()  # a vocabulary file of fixed size; it travels with the function
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("tokens")
        if store.get("definition") != definition:
            store.update(definition=definition, encoder=WordEncoder(definition))
        for batch, texts in chunks(batches, "text"):
            ids = [e + end for e in store["encoder"].encode(texts)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            values = np.frombuffer(b"".join(ids), "<i4")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "n_tokens": pa.array(sizes),
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            })

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return (rows.repartitionByRange(slots(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
            .mapInArrow(encoded, f"doc_id {kind}, hash long, n_tokens long, ids array<int>"))


def write_tokens(encoded: DataFrame, path: str) -> None:
    """ORC files with row indexes and a Bloom filter on doc_id, one range of ids per file."""
    encoded.write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of a token table; with ``doc_ids`` only these, other stripes and row groups are skipped by their metadata."""
    rows = spark.read.orc(path)
    return rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else rows


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a token table, read from its files.

    The start is the sum of the files before (a file holds one range of ids)
    and of the documents before in the file.
    """
    import zlib

    file = F.col("_metadata.file_path").alias("file")
    rows = read_tokens(spark, path)
    order = Window.orderBy(F.col("first").asc_nulls_first(), "first_hash")  # one row per file
    offsets = (rows.select(file, "doc_id", "hash", "n_tokens").groupBy("file")
               .agg(F.sum("n_tokens").alias("total"), F.min(F.struct("doc_id", "hash")).alias("least"))
               .select("file", "total", F.col("least.doc_id").alias("first"), F.col("least.hash").alias("first_hash"))
               .select("file", (F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("total"))
                       .alias("before")))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            bounds = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.record_batch([batch.column(c) for c in ("file", "doc_id", "hash", "n_tokens")]
                                  + [pa.array(crc, pa.int64())], names=["file", "doc_id", "hash", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    small = rows.select(file, "doc_id", "hash", "n_tokens", "ids").mapInArrow(
        checked, f"file string, doc_id {kind}, hash long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "hash").rowsBetween(
        Window.unboundedPreceding, 0)
    return small.join(offsets, "file").select(
        "doc_id", (F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


@query("op3_token_ids")
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document, write ORC in id order, and digest what the files hold."""
    path = scratch(spark, "tokens")
    write_tokens(encode(table(spark, sf_dir, "documents")), path)
    return digests(spark, path)
