"""Language-model scores by deleted interpolation.

The probability of a word after its context mixes maximum-likelihood
estimates: lambda_n c(h, w) / c(h) + ... + lambda_1 c(w) / N + lambda_0 / (V + 1).
The weights depend on how often the context occurs (a bucket per power of
two) and are learned by expectation-maximisation: training texts of one fold
are deleted from the counts, and their n-grams are the held-out counts.

Texts are dealt into blocks of bounded size. A block sends each of its
distinct n-grams once, with its counts, to the range of n-gram hashes it
belongs to; the range adds up and answers each block in the block's own order.
So a very common word costs a block one number, and what travels are packed
arrays of hashes and counts, not a row per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import LOWER, fold_of, hashed_words, mixed, release, slots, table, unzipped, written, zipped

FOLDS = 10
HELD_OUT, DELETED = 0, 1
#: Length of the longest n-grams.
ORDER = 2
BLOCK_BYTES = 4 << 20
#: Steps per power of two in which estimates are told apart for the mixture weights, and the most steps.
STEPS, MOST = 4, 160
BUCKETS = 40
ROUNDS = 60
#: Held-out counts that a bucket takes from all buckets together, so that one with few of its own is not led astray.
PRIOR = 50.0
_START, _END = np.uint64(0x51A7), np.uint64(0xE0D)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers in one value, each compressed with its bytes of equal weight together."""
    import zstandard

    parts = [zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())
             for a in arrays]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unpacked(value: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    sizes = np.frombuffer(value, "<u4", len(kinds)).tolist()
    at = 4 * len(kinds)
    out = []
    for size, kind in zip(sizes, kinds):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(value[at:at + size]), np.uint8)
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data.reshape(width, -1).T).reshape(-1).view(kind))
        at += size
    return out


@dataclass(frozen=True)
class Grams:
    """n-grams of a block: distinct keys in order, and for each token the place of its keys.

    place[0] is of the token itself, place[n - 1] of the n-gram that ends with
    it, context[n - 2] of that n-gram without the token.
    """

    keys: np.ndarray
    place: list[np.ndarray]
    context: list[np.ndarray]
    bounds: np.ndarray


def grams(texts: list[bytes], order: int) -> Grams:
    """Words in lower case, then an end; what stands before a text is one start token."""
    words, bounds = hashed_words(texts, LOWER)
    count = np.diff(bounds) + 1
    at = np.concatenate([[0], np.cumsum(count)])
    tokens = np.full(at[-1], mixed(np.array([_END]))[0], np.uint64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    tokens[inside] = words
    number = np.arange(at[-1]) - np.repeat(at[:-1], count)  # of a token in its text
    start = mixed(np.array([_START]))[0]
    codes = [tokens]
    before = []
    context = np.zeros(len(tokens), np.uint64)
    for n in range(1, order):
        shifted = np.concatenate([np.full(n, start), tokens[:-n]]) if len(tokens) >= n else np.full(len(tokens), start)
        # The context grows to the left; beyond the text it is the start.
        context = mixed(context + np.where(number >= n, shifted, start) * _STEP + np.uint64(n)) if n > 1 else np.where(
            number >= 1, shifted, start)
        before.append(context)
        codes.append(mixed(context * _STEP + tokens * np.uint64(3) + np.uint64(n)))
    # The lowest bit tells tokens from longer n-grams; contexts of one word are tokens.
    kinds = [codes[0] | np.uint64(1), *[c & ~np.uint64(1) for c in codes[1:]]]
    contexts = [c | np.uint64(1) if n == 0 else c & ~np.uint64(1) for n, c in enumerate(before)]
    keys, inverse = np.unique(np.concatenate(kinds + contexts), return_inverse=True)
    parts = np.split(inverse, np.cumsum([len(tokens)] * (len(kinds) + len(contexts) - 1)))
    return Grams(keys, parts[:order], parts[order:], at)


def tallies(g: Grams, weight: np.ndarray) -> np.ndarray:
    """Count of each key: n-grams as they end, contexts where they are no n-gram counted already."""
    total = np.zeros(len(g.keys), np.int64)
    for place in g.place:
        total += np.bincount(place, weight, len(total)).astype(np.int64)
    first = g.bounds[:-1]
    # A context of one word is counted as a token, but for the start; longer contexts count where they are used.
    for n, place in enumerate(g.context):
        used = place if n else place[first]
        total += np.bincount(used, weight if n else weight[first], len(total)).astype(np.int64)
    return total


def blocks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """block, doc_id, fold, text (compressed): rows dealt into blocks of about BLOCK_BYTES; odd blocks hold the deleted fold."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    fold = fold_of(doc_id, FOLDS)
    many = max(1, size // BLOCK_BYTES)
    few = max(1, size // (BLOCK_BYTES * FOLDS))
    spread = F.xxhash64(F.col(doc_id), F.col(text))
    return zipped(docs.select(
        F.when(fold == DELETED, F.pmod(spread, F.lit(few)) * 2 + 1).otherwise(F.pmod(spread, F.lit(many)) * 2).alias("block"),
        F.col(doc_id).alias("doc_id"), fold.alias("fold"), F.col(text).alias("text")), "text")


def _texts(whole: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return unzipped(whole.column("text")), whole.column("fold").to_numpy()


def counts(blocks: DataFrame, order: int) -> DataFrame:
    """(block, bin, answer, tokens, known, kept_tokens, kept_known): for each block and hash range the counts of its keys.

    An answer holds two counts per key, with and without the deleted fold.
    Rows of a null block hold the sums of a range instead.
    """
    bins = slots(blocks.sparkSession) * 2

    def sent(key: tuple, whole: pa.Table) -> pa.Table:
        texts, fold = _texts(whole)
        g = grams(texts, order)
        of_token = np.repeat(fold, np.diff(g.bounds))
        kept = tallies(g, (of_token > DELETED).astype(float))
        gone = tallies(g, (of_token == DELETED).astype(float))
        bin_ = ((g.keys >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bin_, np.arange(bins + 1))
        rows = [(i, cuts[i], cuts[i + 1]) for i in range(bins) if cuts[i] < cuts[i + 1]]
        return pa.table({
            "bin": pa.array([i for i, _, _ in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "keys": pa.array([packed(np.diff(g.keys[a:b], prepend=np.uint64(0)), kept[a:b].astype(np.uint32),
                                     gone[a:b].astype(np.uint32)) for _, a, b in rows], pa.binary())})

    start = int(mixed(np.array([_START]))[0] | np.uint64(1))

    def added(key: tuple, whole: pa.Table) -> pa.Table:
        parts = [unpacked(v, np.uint64, np.uint32, np.uint32) for v in whole.column("keys").to_pylist()]
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        kept = np.bincount(place, np.concatenate([p[1] for p in parts]), len(distinct)).astype(np.int64)
        gone = np.bincount(place, np.concatenate([p[2] for p in parts]), len(distinct)).astype(np.int64)
        all_ = kept + gone
        single = (distinct & np.uint64(1) == 1) & (distinct != np.uint64(start))
        sums = [int(all_[single].sum()), int((all_[single] > 0).sum()), int(kept[single].sum()), int((kept[single] > 0).sum())]
        answers, at = [], 0
        for k in keys:
            own = place[at:at + len(k)]
            answers.append(packed(all_[own], kept[own]))
            at += len(k)
        n = len(keys)
        names = ("tokens", "known", "kept_tokens", "kept_known")
        return pa.table({
            "block": pa.array(whole.column("block").to_pylist() + [None], pa.int64()),
            "bin": pa.array([key[0].as_py()] * (n + 1), pa.int64()), "answer": pa.array(answers + [None], pa.binary()),
        } | {name: pa.array([None] * n + [s], pa.int64()) for name, s in zip(names, sums)})

    return (blocks.groupBy("block").applyInArrow(sent, "bin long, block long, keys binary").groupBy("bin")
            .applyInArrow(added, "block long, bin long, answer binary, tokens long, known long, kept_tokens long, kept_known long"))


def answered(g: Grams, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the keys of a block, all and without the deleted fold."""
    order = answers.sort_by("bin").column("answer").to_pylist()
    both = [unpacked(a, np.int64, np.int64) for a in order]
    return np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the power of two reached."""
    return np.minimum(np.where(count > 0, np.log2(np.maximum(count, 1)).astype(int) + 1, 0), BUCKETS - 1)


def estimates(g: Grams, count: np.ndarray, tokens: int, known: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Context bucket of each token, and its estimates: n-grams from the longest on, single words, uniform.

    The bucket is that of the longest context.
    """
    out = []
    for n in range(len(g.place) - 1, 0, -1):
        base = count[g.context[n - 1]]
        out.append(np.where(base > 0, count[g.place[n]] / np.maximum(base, 1), 0.0))
    out.append(count[g.place[0]] / max(tokens, 1))
    out.append(np.full(len(g.place[0]), 1 / (known + 1)))
    longest = count[g.context[-1]] if g.context else np.zeros(len(g.place[0]), int)
    return bucket(longest), out


def learn(blocks: DataFrame, answers: DataFrame, order: int, tokens: int, known: int) -> np.ndarray:
    """Mixture weights (bucket, order + 1), the longest n-gram first.

    All n-grams of the deleted fold count. They are added up by bucket and by
    their estimates in steps of a quarter of a power of two, so the table of
    held-out counts that the maximisation runs over has a bounded size.
    """
    def seen(key: tuple, whole: pa.Table, reply: pa.Table) -> pa.Table:
        names = [f"q{n}" for n in range(order)]
        if not whole.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), **{n: pa.array([], pa.int64()) for n in names},
                             "n": pa.array([], pa.int64())})
        g = grams(_texts(whole)[0], order)
        where, parts = estimates(g, answered(g, reply)[1], tokens, known)
        steps = [np.where(p > 0, np.minimum(np.rint(-STEPS * np.log2(np.maximum(p, 1e-300))), MOST - 1), MOST).astype(int)
                 for p in parts[:-1]]
        cells, n = np.unique(np.stack([where, *steps]), axis=1, return_counts=True)
        return pa.table({"bucket": pa.array(cells[0]), **{name: pa.array(c) for name, c in zip(names, cells[1:])},
                         "n": pa.array(n)})

    keys = ["bucket", *[f"q{n}" for n in range(order)]]
    table_ = (blocks.where(F.col("fold") == DELETED).groupBy("block")
              .cogroup(answers.where(F.col("block") % 2 == 1).select("block", "bin", "answer").groupBy("block"))
              .applyInArrow(seen, ", ".join(f"{k} long" for k in keys) + ", n long")
              .groupBy(*keys).agg(F.sum("n").alias("n")))
    rows = np.array([tuple(r) for r in table_.collect()], np.int64).reshape(-1, order + 2)
    start = np.full(order + 1, 1 / (order + 1))
    weights = np.tile(start, (BUCKETS, 1))
    p = np.concatenate([np.where(rows[:, 1:-1] < MOST, 2.0 ** (-rows[:, 1:-1] / STEPS), 0.0),
                        np.full((len(rows), 1), 1 / (known + 1))], axis=1)
    for _ in range(ROUNDS if len(rows) else 0):
        share = weights[rows[:, 0]] * p
        share *= (rows[:, -1] / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(rows[:, 0], share[:, k], BUCKETS) for k in range(order + 1)], axis=1)
        overall = total.sum(axis=0) + PRIOR * start
        weights = total + PRIOR * overall / overall.sum()
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Scores are log10 probabilities of whole texts. Rows whose crc32(id) mod 10
    is 0 are never learned from. Null and empty texts are one end token.
    Repeated rows are counted each time. Without training rows the weights are
    the starting ones and all words are unknown. An empty table gives no row.
    """
    blocks = blocks_of(docs, doc_id, text)
    answers = written(counts(blocks, order), "counts")
    release(docs.sparkSession)
    sums = answers.where("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (
        "tokens", "known", "kept_tokens", "kept_known")]).first()
    tokens, known = int(sums[0]), int(sums[1])
    answers = answers.where("block IS NOT NULL").select("block", "bin", "answer")
    weights = learn(blocks, answers, order, int(sums[2]), int(sums[3]))
    release(docs.sparkSession)
    kind = docs.schema[doc_id].dataType

    def scored(key: tuple, whole: pa.Table, reply: pa.Table) -> pa.Table:
        texts, fold = _texts(whole)
        g = grams(texts, order)
        count = answered(g, reply)[0]
        where, parts = estimates(g, count, tokens, known)
        mixture = sum(weights[where, k] * p for k, p in enumerate(parts))
        single = count[g.place[0]]
        base = np.log10((single + 0.1) / (tokens + 0.1 * (known + 1)))
        first = g.bounds[:-1]
        return pa.table({
            "doc_id": whole.column("doc_id"), "held_out": pa.array(fold == HELD_OUT),
            "n_tokens": pa.array(np.diff(g.bounds)), "n_known": pa.array(np.add.reduceat((single > 0).astype(np.int64), first)),
            "train_tokens": pa.array(np.full(len(fold), tokens)), "base_score": pa.array(np.add.reduceat(base, first)),
            "score": pa.array(np.add.reduceat(np.log10(mixture), first)),
        })

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")


@query("op2_deleted_interpolation")
def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document under the interpolated model and under single words."""
    return score(table(spark, sf_dir, "documents"))
