"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius 3 share a 64-bit value that is within half the
radius of each: 1 of the one and 2 of the other. All variants of every
fingerprint are generated, brought together by their value, and colliding
fingerprints are verified.

Flipping a bit changes the parity of a fingerprint. Two fingerprints at an odd
distance differ in parity, two at distance 2 do not. So fingerprints of even
parity emit the variants within radius 1, those of odd parity those within 2:
both kinds of pairs still meet, with half the variants.

Variants travel by route. A route fixes the low bits of a variant; a
fingerprint is sent once to each route that any of its variants takes (1 +
bits + bits*(bits-1)/2 at most), and its variants on this route are spelled
out there. Routes that many fingerprints share fix further bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark.llm.components import components
from policyspark.llm.registry import query
from policyspark.llm.spread import joined_spread
from policyspark.llm.words import (LOWER, chunks, gram_hashes, hashed_words, only_own_names, release, row_order,
                                   sequence_hash, slots, table, unzipped, written, zipped)

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints a route has on average; more fingerprints, more routing bits.
ROUTE_ROWS = 1000
#: A route with more fingerprints than this fixes ``FURTHER`` more bits.
HOT_ROUTE = 50_000
FURTHER = 12
#: Variants a task spells out at once; more are done in passes.
PASS_VARIANTS = 1 << 23
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles: a bit is set if it is set in over half of their XXH64 values."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    width = min(shingle, len(words)) - 1
    hashes = np.fromiter((xxh64_intdigest(joined[p:q], SEED) for p, q in
                          zip(starts[:n].tolist(), ends[width:].tolist())), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are each set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp as signed long, text hash): one row per row of docs. No words: fingerprint 0."""
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fp), "hash": batch.column("hash")})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    return rows.mapInArrow(taken, "doc_id long, fp long, hash long")


def flips(low: int, high: int, count: int) -> np.ndarray:
    """Masks of exactly ``count`` bits among low..high-1."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(low, high), count)], np.uint64)


def odd(values: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(values) & 1).astype(bool)


def routes(values: np.ndarray, bits: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(route, index of the fingerprint) for all routes that a variant of it takes.

    A route is its fixed bits; on a hot route the next FURTHER bits are fixed
    too and bit 63 is set.
    """
    reach = np.where(odd(values), 2, 1)
    low = np.uint64((1 << bits) - 1)
    further = np.uint64(((1 << FURTHER) - 1) << bits)
    out_route, out_index = [], []
    for used in range(3):
        index = np.flatnonzero(reach >= used)
        masks = flips(0, bits, used)
        keys = ((values[index] & low)[:, None] ^ masks[None, :]).ravel()
        index = np.repeat(index, len(masks))
        is_hot = np.isin(keys, hot)
        out_route.append(keys[~is_hot])
        out_index.append(index[~is_hot])
        keys, index = keys[is_hot], index[is_hot]
        for more in range(3 - used):
            own = np.flatnonzero(reach[index] >= used + more)
            masks = flips(bits, bits + FURTHER, more)
            rest = (keys[own] | (values[index[own]] & further))[:, None] ^ masks[None, :]
            out_route.append(rest.ravel() | np.uint64(1 << 63))
            out_index.append(np.repeat(index[own], len(masks)))
    return np.concatenate(out_route), np.concatenate(out_index)


def pairs_apart(place: np.ndarray, owner: np.ndarray, values: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within radius 3 of members of different classes that share a place; places ascend."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    size = np.diff(np.append(first, len(place)))
    of = classes[owner]
    mixed = np.repeat(np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first), size)
    place, owner = place[mixed], owner[mixed]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    here = np.arange(len(place))
    step = 0
    while len(here):
        step += 1
        here = here[here + step < len(place)]
        here = here[place[here] == place[here + step]]
        a, b = owner[here], owner[here + step]
        good = (classes[a] != classes[b]) & (np.bitwise_count(values[a] ^ values[b]) <= RADIUS)
        left.append(a[good])
        right.append(b[good])
    return np.concatenate(left), np.concatenate(right)


def meet(route: int, values: np.ndarray, names: np.ndarray, bits: int,
         classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (name, name) among the fingerprints of a route, as stars.

    Fingerprints that meet in a variant are tied to one of them: to an even one
    if there is any (it is 1 from the variant, the others 2 at most), else to
    the fingerprint that is the variant itself. Odd ones that meet at distance
    2 from an odd variant may be 4 apart; if they are 2 apart, they also meet
    in an even variant. So every linked pair is connected, with one link each.
    With ``classes``, every linked pair of different classes is given, itself.
    """
    fixed = bits + FURTHER if route >> 63 else bits
    low = np.uint64((1 << fixed) - 1)
    key = np.uint64(route & ((1 << 63) - 1)) & low
    is_odd = odd(values)
    left = np.where(is_odd, 2, 1) - np.bitwise_count((values & low) ^ key).astype(int)
    base = (values & ~low) | key
    free = [flips(fixed, 64, n) for n in range(3)]
    total = sum(int((left >= n).sum()) * len(free[n]) for n in range(3))
    passes = 1 << max(0, (total // PASS_VARIANTS).bit_length())
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for turn in range(passes):
        variants, owners = [], []
        for n in range(3):
            own = np.flatnonzero(left >= n)
            for i in range(0, len(own), 4096):
                some = (base[own[i:i + 4096], None] ^ free[n][None, :]).ravel()
                owner = np.repeat(own[i:i + 4096], len(free[n]))
                if passes > 1:
                    mine = (some * _MIX) >> np.uint64(40) & np.uint64(passes - 1) == turn
                    some, owner = some[mine], owner[mine]
                variants.append(some)
                owners.append(owner)
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        ordered = np.sort(variant)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(again):
            continue
        place = np.minimum(np.searchsorted(again, variant), len(again) - 1)
        hit = np.flatnonzero(again[place] == variant)
        place, owner = place[hit], owner[hit]
        if classes is not None:
            order = np.argsort(place, kind="stable")
            one, two = pairs_apart(place[order], owner[order], values, classes)
            links.append((np.minimum(names[one], names[two]), np.maximum(names[one], names[two])))
            continue
        # Of each variant: even members first, then the variant itself, then the others.
        kind = np.where(~is_odd[owner], 0, np.where(values[owner] == again[place], 1, 2))
        order = np.lexsort((names[owner], kind, place))
        place, owner, kind = place[order], owner[order], kind[order]
        first = np.concatenate([[True], place[1:] != place[:-1]])
        centre = owner[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        near = np.bitwise_count(values[centre] ^ values[owner]) <= RADIUS
        kept = near & (centre != owner)
        links.append((names[centre[kept]], names[owner[kept]]))
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])]), axis=1)
    return pairs[0], pairs[1]


def link(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within radius 3.

    :param distinct: distinct fingerprints: fp (long), name (long). With a
        column cls (long), of which a fingerprint may have several, the edges
        are all pairs within radius 3 of different cls.
    """
    apart = "cls" in distinct.columns
    spark = distinct.sparkSession
    count = distinct.count()
    bits = min(24, max(6, (count // ROUTE_ROWS).bit_length()))
    # A route is hot if over HOT_ROUTE fingerprints stand on it: count / HOT_ROUTE numbers at most.
    hot = np.array([r[0] for r in distinct.groupBy(F.col("fp").bitwiseAND((1 << bits) - 1).alias("k")).count()
                    .where(F.col("count") > HOT_ROUTE).collect()], np.uint64)
    bins = slots(spark) * 2

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                values = batch.column("fp").slice(i, 4096).to_numpy().view(np.uint64)
                names = batch.column("name").slice(i, 4096).to_numpy()
                classes = batch.column("cls").slice(i, 4096).to_numpy() if apart else None
                route, index = routes(values, bits, hot)
                bin_ = (route * _MIX >> np.uint64(33)) % np.uint64(bins)
                order = np.lexsort((route, bin_))
                route, index, bin_ = route[order], index[order], bin_[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bin_.view(np.int64))) + 1, [len(bin_)]])
                rows = list(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if len(bin_) else []
                yield pa.record_batch({
                    "bin": pa.array([int(bin_[a]) for a, _ in rows], pa.int64()),
                    "route": pa.array([route[a:b].tobytes() for a, b in rows], pa.binary()),
                    "fp": pa.array([values[index[a:b]].tobytes() for a, b in rows], pa.binary()),
                    "name": pa.array([names[index[a:b]].tobytes() for a, b in rows], pa.binary()),
                } | ({"cls": pa.array([classes[index[a:b]].tobytes() for a, b in rows], pa.binary())} if apart else {}))

    def met(whole: pa.Table) -> pa.Table:
        route, values = (np.frombuffer(b"".join(whole.column(c).to_pylist()), np.uint64) for c in ("route", "fp"))
        names = np.frombuffer(b"".join(whole.column("name").to_pylist()), np.int64)
        order = np.argsort(route, kind="stable")
        route, values, names = route[order], values[order], names[order]
        classes = np.frombuffer(b"".join(whole.column("cls").to_pylist()), np.int64)[order] if apart else None
        cuts = np.concatenate([[0], np.flatnonzero(route[1:] != route[:-1]) + 1, [len(route)]])
        found = [meet(int(route[a]), values[a:b], names[a:b], bits, classes[a:b] if apart else None)
                 for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    spread = distinct.select("fp", "name", *(["cls"] if apart else [])).repartition(slots(spark), "name")
    sent_columns = "bin long, route binary, fp binary, name binary" + (", cls binary" if apart else "")
    return spread.mapInArrow(sent, sent_columns).groupBy("bin").applyInArrow(met, "a long, b long")


#: Names of fingerprints that only rows without an id have: beyond all ids.
_NAMELESS = 1 << 62


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, hash: one row per row of docs.

    component_id is the smallest id reachable over links of 3 or fewer bits,
    the own one included; null ids link but do not count (null if a component
    has no other). Null, empty and wordless texts have fingerprint zero and are
    linked like any other. Repeated rows and copies share a fingerprint, which
    enters the search once; fingerprints with the same smallest id are one node. An empty table gives no row.
    """
    rows = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nameless = (F.shiftrightunsigned("fp", 2) + F.lit(_NAMELESS)).cast("long")  # equal only within radius 2
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("name")).select("fp", F.coalesce("name", nameless).alias("name"))
    distinct = written(distinct, "distinct")
    roots = components(link(distinct))
    release(docs.sparkSession)
    named = distinct.join(roots, distinct["name"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "name").alias("_root"))
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("_root") < _NAMELESS, F.col("_root")).alias("component_id"), "hash")


@query("op6_simhash_dedup")
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, all columns: the one of the smallest id, and of its repeats one row.

    Rows without an id stay unless their group has one with an id.
    """
    found = near_duplicates(docs)
    gone = found.where("doc_id IS DISTINCT FROM component_id").select(
        F.coalesce("doc_id", F.lit(_NAMELESS)).alias("_id"), F.col("hash").alias("_hash")).distinct()
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NAMELESS)), "_hash": F.xxhash64("text")})
    once = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
    return (keyed.join(gone, ["_id", "_hash"], "left_anti").withColumn("_n", once).where("_n = 1")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


#: Near-duplicates of a corpus: word shingles of this length, and the least Jaccard similarity of their sets.
LONG_SHINGLE = 5
SIMILAR = 0.8
#: Candidates: MinHash bands of so many rows; a pair of similarity 0.8 misses all with probability (1 - 0.8 ** 5) ** 16 = 0.2 %.
BANDS, BAND_ROWS = 16, 5
_STEPS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes], n: int = LONG_SHINGLE) -> Iterator[np.ndarray]:
    """64-bit hashes of the word shingles of each text, in order; a shorter text is one shingle, one without words none."""
    words, bounds = hashed_words(texts, LOWER)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield gram_hashes(words[a:b], max(1, min(n, b - a)))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One 64-bit key per MinHash band."""
    least = np.full(len(_STEPS), ~np.uint64(0))
    for i in range(0, len(grams), 1 << 12):
        least = np.minimum(least, (grams[i:i + (1 << 12), None] * _STEPS[None, :]).min(axis=0))
    code = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        code = (code ^ least[j::BAND_ROWS]) * _MIX
        code ^= code >> np.uint64(29)
    return code


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of shingle hashes as sets."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


#: Bits of a parity sketch: a power of two of at least twice the size of the set, within these limits.
LEAST_BITS, MOST_BITS = 256, 1 << 17


def parity(grams: np.ndarray) -> bytes:
    """For each class of hashes (by their low bits), whether it holds an odd number of this set of different hashes.

    Sketches of two sets differ in at most as many bits as there are hashes in only one of the sets.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(grams) - 1).bit_length()))
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def may_be_similar(size: np.ndarray, sketch: list[bytes], cls: np.ndarray, part: np.ndarray | None = None
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of different ``cls`` (and ``part``) that sizes and sketches allow to be similar.

    Similarity of 0.8 means that at most a ninth of the summed sizes is in only
    one of the two sets, so no similar pair is left out. Sketches of the next
    length are folded; empty sketches tell nothing.
    """
    order = np.argsort(size, kind="stable")
    size, cls = size[order], cls[order]
    part = part[order] if part is not None else None
    lengths = np.array([len(sketch[i]) for i in order.tolist()], np.int64)

    def rows_of(index: np.ndarray) -> np.ndarray:
        joined = b"".join([sketch[i] for i in order[index].tolist()])
        return np.frombuffer(joined, np.uint64).reshape(len(index), len(joined) // 8 // len(index))

    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(lengths).tolist():
        own, longer = np.flatnonzero(lengths == length), np.flatnonzero((lengths == 2 * length) & (length > 0))
        others, words = np.concatenate([own, longer]), rows_of(own)
        if len(longer):
            halves = rows_of(longer)
            words = np.concatenate([words, halves[:, :length // 8] ^ halves[:, length // 8:]])
        columns = np.ascontiguousarray(words.T)
        step = max(1, (1 << 20) // len(others))
        for i in range(0, len(own), step):
            one = own[i:i + step]
            end = int(np.searchsorted(4 * size[others], 5 * size[one[-1]], side="right"))
            two = others[i:end]
            differ = np.zeros((len(one), len(two)), np.int32)
            for column in columns:
                differ += np.bitwise_count(column[i:i + len(one), None] ^ column[None, i:end])
            good = (9 * differ <= size[one][:, None] + size[two][None, :]) & (cls[one][:, None] != cls[two][None, :])
            good &= one[:, None] < two[None, :]
            if part is not None:
                good &= part[one][:, None] != part[two][None, :]
            x, y = np.nonzero(good & (4 * size[two][None, :] <= 5 * size[one][:, None]))
            left.append(order[one[x]])
            right.append(order[two[y]])
    return np.concatenate(left), np.concatenate(right)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, key, size, sketch, fp, bands) of each row: key is equal for texts of the same shingles in the same order.

    size is the number of different shingles, sketch their parity.
    """
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            grams = list(shingles(texts))
            key = [int(sequence_hash(g).view(np.int64)) if len(g) else 0 for g in grams]
            sets = [np.unique(g) for g in grams]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "key": pa.array(key, pa.int64()),
                "size": pa.array(list(map(len, sets)), pa.int64()), "sketch": pa.array(list(map(parity, sets)), pa.binary()),
                "fp": pa.array(np.array([majority(g) for g in grams], np.uint64).view(np.int64)),
                "bands": pa.array([band_keys(g).view(np.int64).tolist() for g in grams], pa.list_(pa.int64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    return rows.mapInArrow(taken, "doc_id long, hash long, key long, size long, sketch binary, fp long, bands array<long>")


def banded(rows: DataFrame) -> DataFrame:
    """(band, key, n) for all bands that n > 1 keys share."""
    bands = rows.groupBy("key").agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("band"))
    bands = written(bands, "bands")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return written(joined_spread(bands, "band", shared, "key"), "shared")


def candidates(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys, a < b, that share a band or lie within 3 bits: a number linear in the keys.

    Who shares a band is tied to two of them: to the one whose bands hold the
    most members in all (a text that others were edited from shares more bands
    with them than they do with each other), and to one chosen in four
    different orders over the bands. What these miss is for :func:`remaining`.
    """
    fps = written(rows.groupBy("fp").agg(F.min("key").alias("name")), "distinct")
    near = link(fps).unionByName(rows.join(fps, "fp").select(F.col("key").alias("a"), F.col("name").alias("b")))
    popular = shared.groupBy("key").agg(F.sum("n").alias("met"))
    order = F.xxhash64("key", F.pmod("band", F.lit(4)))
    centres = shared.join(popular, "key").groupBy("band").agg(
        F.max(F.struct("met", "key"))["key"].alias("popular"), F.min(F.struct(order.alias("o"), "key"))["key"].alias("other"))
    tied = joined_spread(shared.select("band", "key"), "band", centres, "key").select(
        F.col("key").alias("a"), F.explode(F.array("popular", "other")).alias("b"))
    return near.unionByName(tied).where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Members of a band that a task holds against each other; larger bands are cut into blocks, every two of which meet once.
BAND_MEMBERS = 2048


def remaining(rows: DataFrame, shared: DataFrame, checked: DataFrame, roots: DataFrame) -> DataFrame:
    """All further pairs (a, b) of keys that share a band or lie within 3 bits and are not connected so far.

    Pairs of one component need no check: their documents are in one group
    already. ``checked`` pairs are left out, and those whose numbers of
    shingles alone rule the similarity out. Members of a band are compared by
    their sketches (if rows have them) in the task that holds them, and only pairs that may be similar leave it.
    """
    if "sketch" not in rows.columns:
        rows = rows.withColumn("sketch", F.lit(b""))
    keys = rows.groupBy("key").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    keys = written(keys.join(roots, keys["key"] == roots["node"], "left").select(
        "key", "fp", "size", "sketch", F.coalesce("root", "key").alias("cls")), "classes")
    # Fingerprints: one node for each and class, then the keys behind them.
    nodes = written(keys.groupBy("fp", "cls").agg(F.min("key").alias("name")), "nodes")
    behind = keys.join(nodes, ["fp", "cls"]).select("name", "key")
    near = (link(nodes).join(behind.select(F.col("name").alias("a"), F.col("key").alias("ka")), "a")
            .join(behind.select(F.col("name").alias("b"), F.col("key").alias("kb")), "b").select("ka", "kb"))
    # Bands whose members are of several classes; large ones are cut into blocks.
    placed = shared.select("band", "key").join(keys.select("key", "cls"), "key")
    several = placed.groupBy("band").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("n")).where(
        "low <> high").select("band", F.expr(f"cast((n - 1) div {BAND_MEMBERS} as int)").alias("last"))
    mixed = written(joined_spread(placed.select("band", "key"), "band", several, "key"), "mixed")
    part = F.expr("cast(pmod(xxhash64(key), last + 1) as int)")
    blocks = (mixed.select("band", "key", part.alias("part"), F.explode(F.expr("sequence(0, last)")).alias("other"))
              .join(keys.select("key", "size", "sketch", "cls"), "key")
              .select("band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                      "part", "key", "size", "sketch", "cls"))

    def met(whole: pa.Table) -> pa.Table:
        key, size, cls, part = (whole.column(c).to_numpy() for c in ("key", "size", "cls", "part"))
        apart = whole.column("low")[0] != whole.column("high")[0]
        one, two = may_be_similar(size, whole.column("sketch").to_pylist(), cls, part if apart else None)
        return pa.table({"ka": pa.array(key[one], pa.int64()), "kb": pa.array(key[two], pa.int64())})

    close = blocks.groupBy("band", "low", "high").applyInArrow(met, "ka long, kb long")
    pairs = near.unionByName(close).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
    size = keys.select("key", "size")
    fit = (pairs.join(checked, ["a", "b"], "left_anti")
           .join(size.toDF("a", "size_a"), "a").join(size.toDF("b", "size_b"), "b")
           .where("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)"))
    return fit.select("a", "b")


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets have at least the wanted similarity, by their texts."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    hashes = rows.join(named, "key", "left_semi").groupBy("key").agg(F.min("hash").alias("hash"))
    texts = docs.select(F.xxhash64("text").alias("hash"), "text").join(hashes, "hash")
    texts = zipped(texts.select("key", "text"), "text").groupBy("key").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")
    both = (pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                one, two = (shingles(unzipped(part.column(c))) for c in ("ta", "tb"))
                good = [k for k, (x, y) in enumerate(zip(one, two)) if similarity(x, y) >= SIMILAR]
                yield pa.record_batch({"a": part.column("a").take(pa.array(good, pa.int64())),
                                       "b": part.column("b").take(pa.array(good, pa.int64()))})

    return both.mapInArrow(similar, "a long, b long")


def similar_pairs(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that connect whatever candidates have the wanted similarity.

    The ties of :func:`candidates` are checked first; of the pairs that they leave in different components, each is.
    """
    shared = banded(rows)
    pairs = written(candidates(rows, shared), "candidates")
    found = written(verified(docs, rows, pairs), "found")
    rest = written(remaining(rows, shared, pairs, components(found)), "remaining")
    return found.unionByName(verified(docs, rows, rest))


@only_own_names
def keep_one_similar(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, all columns (of any name): the one of the smallest id.

    Of its repeated rows one stays, chosen by a hash of all columns.

    Groups are connected by pairs of at least 0.8 Jaccard similarity of their
    5-word shingles. SimHash fingerprints (within 3 bits) and MinHash bands (one
    shared) propose pairs; none that would join two groups goes unchecked against the texts. Ids that are null come last. Texts
    without words (null, empty) are copies of each other; an empty table stays empty.
    """
    rows = written(signed(docs), "signed")
    roots = components(similar_pairs(docs, rows))
    named = written(rows.join(roots, rows["key"] == roots["node"], "left").select(
        "doc_id", "hash", F.coalesce("root", "key").alias("_root")), "named")
    best = named.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "hash")).alias("_best"))
    gone = (joined_spread(named, "_root", best, "hash").where("NOT (doc_id <=> _best.doc_id AND hash = _best.hash)")
            .select(F.coalesce("doc_id", F.lit(_NAMELESS)).alias("_id"), F.col("hash").alias("_hash")).distinct())
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NAMELESS)), "_hash": F.xxhash64("text")})
    once = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(row_order(docs)))
    return (keyed.join(gone, ["_id", "_hash"], "left_anti").withColumn("_n", once).where("_n = 1")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
