"""Operators on texts against brute force, with nulls, copies, repeated rows and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from policyspark.llm import decontaminate, language, lm, quality, simhash, substrings, tokens
from policyspark.llm.words import gram_checks, hashed_words, sequence_hash
from tests.llm.conftest import lowered

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def remainder(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def brute_fingerprint(text, n=3):
    import xxhash

    words = WORDS.findall(lowered(text or ""))
    grams = [" ".join(words[k:k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def brute_components(values, ids):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    v = np.array(values, np.uint64)
    for a in range(len(v)):
        for b in np.flatnonzero(np.bitwise_count(v[a + 1:] ^ v[a]) <= 3) + a + 1:
            parent[find(a)] = find(int(b))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(v))]


def test_simhash(rough, clashing):
    rows = rough.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    expected = sorted(zip((r.doc_id for r in rows), ("%016x" % f for f in fps),
                          brute_components(fps, [r.doc_id for r in rows])), key=repr)
    assert collected(simhash.near_duplicates(clashing(rough)).drop("hash")) == expected


@pytest.mark.parametrize("bits,hot", [(6, []), (10, []), (5, range(0, 32, 2))])
def test_ball_hashing_connects_what_is_within_three_bits(bits, hot):
    rng = np.random.default_rng(3)
    values = []
    for base in rng.integers(0, 2 ** 64, 120, dtype=np.uint64):
        for _ in range(rng.integers(1, 10)):
            x = int(base)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            values.append(x)
    values = np.unique(np.array(values, np.uint64))
    names = np.arange(len(values))
    route, index = simhash.routes(values, bits, np.array(list(hot), np.uint64))
    links = set()
    for r in np.unique(route):
        own = index[route == r]
        links |= set(zip(*(x.tolist() for x in simhash.meet(int(r), values[own], names[own], bits))))
    assert all(np.bitwise_count(values[a] ^ values[b]) <= 3 for a, b in links)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(values))] == brute_components([int(v) for v in values], names.tolist())


def test_passes_of_a_large_route_find_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    base = np.uint64(rng.integers(0, 2 ** 64, dtype=np.uint64))
    values = np.unique(base ^ (np.uint64(1) << rng.integers(20, 64, 60).astype(np.uint64)))
    once = simhash.meet(int(base & np.uint64(1023)), values, np.arange(len(values)), 10)
    monkeypatch.setattr(simhash, "PASS_VARIANTS", 1000)
    again = simhash.meet(int(base & np.uint64(1023)), values, np.arange(len(values)), 10)
    assert [x.tolist() for x in once] == [x.tolist() for x in again]


def test_every_candidate_pair_of_two_groups_is_checked(spark):
    # Fingerprints: 0b1011 and 0b0111 are two bits apart and tied to 0b0011 only, which is no text like theirs.
    links = simhash.meet(3, np.array([0b0011, 0b1011, 0b0111], np.uint64), np.array([1, 2, 3]), 6)
    assert (2, 3) not in set(zip(*(x.tolist() for x in links)))
    apart = simhash.meet(3, np.array([0b0011, 0b1011, 0b0111], np.uint64), np.array([1, 2, 3]), 6, np.array([1, 2, 3]))
    assert set(zip(*(x.tolist() for x in apart))) == {(1, 2), (1, 3), (2, 3)}
    one_class = simhash.meet(3, np.array([0b0011, 0b1011, 0b0111], np.uint64), np.array([1, 2, 3]), 6, np.array([1, 2, 2]))
    assert set(zip(*(x.tolist() for x in one_class))) == {(1, 2), (1, 3)}
    # As rows: keys 1 to 6, one band of all; 5 and 6 are of one group, which leaves the pairs across groups.
    rows = spark.createDataFrame([(k, 100, fp, [7, 100 + k]) for k, fp in enumerate([3, 11, 7, 1 << 40, 1 << 50, 1 << 60], 1)],
                                 "key long, size long, fp long, bands array<long>")
    checked = spark.createDataFrame([(1, 2), (1, 4)], "a long, b long")
    roots = spark.createDataFrame([(5, 5), (6, 5)], "node long, root long")
    got = {tuple(r) for r in simhash.remaining(rows, simhash.banded(rows), checked, roots).collect()}
    assert got == set(combinations(range(1, 7), 2)) - {(1, 2), (1, 4), (5, 6)}


def test_sketches_leave_out_no_similar_pair():
    rng = np.random.default_rng(8)
    sets, cls = [], []
    for k, size in enumerate([1, 3, 9, 100, 127, 128, 129, 140, 255, 256, 300, 1000, 70_000]):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0.01, 0.05, 0.08, 0.1, 0.11, 0.12, 0.15, 0.2, 0.3, 0.9):
            gone = int(size * share)
            new = rng.integers(0, 1 << 63, gone if size % 2 else 0, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[gone:], new])))
            cls.append(len(cls) if k else 0)
    size, sketch, cls = np.array(list(map(len, sets))), [simhash.parity(x) for x in sets], np.array(cls)
    alike = {(i, j) for i, j in combinations(range(len(sets)), 2) if cls[i] != cls[j] and simhash.similarity(sets[i], sets[j]) >= 0.8}
    assert len(alike) > 100
    found = [(min(p), max(p)) for p in zip(*(x.tolist() for x in simhash.may_be_similar(size, sketch, cls)))]
    assert len(found) == len(set(found)) < 3 * len(alike) and alike <= set(found)
    part = np.arange(len(sets)) % 2
    across = {(min(p), max(p)) for p in zip(*(x.tolist() for x in simhash.may_be_similar(size, sketch, cls, part)))}
    assert across == {(i, j) for i, j in found if part[i] != part[j]}
    none = simhash.may_be_similar(np.array([4, 5, 5, 7]), [b""] * 4, np.arange(4))
    assert set(zip(*(x.tolist() for x in none))) == {(0, 1), (0, 2), (1, 2)}


def test_a_band_of_unlike_texts_leaves_few_pairs(spark, monkeypatch):
    """Edits of one text, each unlike the others (below 0.8), share a band; only the few alike ones are pairs."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(90):
        words = [f"w{i}" for i in range(200)]
        for at in rng.choice(200, 10, replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, f"{rows[k][1]} more") for k in range(5)]
    signed = simhash.signed(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    keys = {r.doc_id: r.key for r in signed.collect()}
    monkeypatch.setattr(simhash, "BAND_MEMBERS", 20)
    shared = signed.selectExpr("7L band", "key", f"{len(rows)}L n")
    empty = spark.createDataFrame([], "a long, b long")
    got = [tuple(r) for r in simhash.remaining(signed, shared, empty, empty.toDF("node", "root")).collect()]
    wanted = {tuple(sorted((keys[k], keys[100 + k]))) for k in range(5)}
    assert wanted <= set(got) and len(got) < 100


def test_keep_one_keeps_one_of_each_group(rough):
    rows = rough.collect()
    kept = simhash.keep_one(rough)
    assert kept.columns == rough.columns
    fps = [brute_fingerprint(r.text) for r in rows]
    groups = set(brute_components(fps, [r.doc_id for r in rows]))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(groups, key=repr)


def test_edited_copies_are_near_duplicates(spark, rough):
    rng = np.random.default_rng(12)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(3000)])

    def grams(text):
        words = lowered(text).split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}

    texts, pairs = [], []
    for k in range(60):
        words = rng.choice(vocabulary, 150).tolist()
        copy = list(words)
        for at in rng.choice(150, 1 + k % 3, replace=False):
            copy[at] = "changed"
        a, b = " ".join(words), "  ".join(copy).upper()
        pairs.append((len(texts), len(grams(a) & grams(b)) / len(grams(a) | grams(b))))
        texts += [a, b]
    texts += [None, "", " ", "one two", "One  two", "one three"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, rough.schema)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    # Brute force: of each pair the copy goes if it is similar enough, and nothing else does.
    similar = {i + 1 for i, j in pairs if j >= 0.8}
    assert len(similar) > 40
    assert kept == [i for i in range(120) if i not in similar] + [120, 123, 125]


def brute_substrings(rows, window=20):
    """Rows in the order of null ids first, then id, then text hash; the result does not depend on the last for one id."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k:k + window])
            if w in seen:
                gone[k:k + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(rough, clashing):
    rows = sorted(((r.doc_id, r.text) for r in rough.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert collected(substrings.removals(clashing(rough))) == brute_substrings(rows)


def test_substrings_cut_the_text(rough):
    cut = substrings.remove(rough)
    assert cut.columns == rough.columns
    left = {(r.doc_id, len(WORDS.findall(r.text or ""))) for r in cut.collect()}
    kept = {(r.doc_id, r.n_words - r.n_removed) for r in substrings.removals(rough).collect()}
    assert left == kept
    again = substrings.removals(cut.where("doc_id < 200"))
    assert again.agg(F.max("n_removed")).first()[0] <= 60


def test_factors_merge_at_boundaries():
    assert substrings.factors(np.array([5, 6, 7, 26, 40, 80]), 20) == [(5, 60), (80, 100)]
    assert substrings.factors(np.array([], int), 20) == []


def brute_hits(rows, items, window=10):
    phrases = collections.defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(lowered(text or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[k:k + window])].add(name)
    out = []
    for doc_id, text in rows:
        w = ALNUM.findall(lowered(text or ""))
        hit, names = [False] * len(w), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                found = phrases.get(tuple(w[k:k + n]))
                if found:
                    names |= {x for x in found if x is not None}
                    hit[k:k + n] = [True] * n
        out.append((doc_id, len(w), sum(hit), tuple(sorted(map(str, names)))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark_rows(rough):
    texts = [r.text for r in rough.collect() if r.text and len(r.text.split()) > 30]
    items = [(i, " ".join(t.split()[4:4 + n])) for i, (t, n) in enumerate(zip(texts, [10, 11, 25, 9, 3, 1, 14]))]
    return items + [(50, ""), (51, None), (52, "..."), (None, texts[8]), (53, items[0][1].upper()), items[0], (54, "absent words only")]


@pytest.mark.parametrize("pack", [8 << 20, 40])
def test_decontamination(spark, rough, clashing, benchmark_rows, pack, monkeypatch):
    monkeypatch.setattr(decontaminate, "PACK_BYTES", pack)
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    docs = clashing(rough).drop("_words")
    found = decontaminate.find(docs, bench).select("doc_id", "_words", decontaminate.hit_words(), "_items")
    got = sorted(((r[0], r[1], r[2], tuple(sorted(r[3]))) for r in found.collect()), key=repr)
    assert got == brute_hits([(r.doc_id, r.text) for r in rough.collect()], benchmark_rows)
    cut = decontaminate.remove(rough, bench)
    assert cut.columns == rough.columns
    left = {(r.doc_id, len(ALNUM.findall(lowered(r.text or "")))) for r in cut.collect()}
    assert left == {(r[0], r[1] - r[2]) for r in got}


def test_suffix_order_and_index():
    rng = np.random.default_rng(1)
    for size in (1, 5, 400):
        symbols = np.concatenate([rng.integers(0, 4, size), [0]])
        order = decontaminate.suffix_order(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        index = decontaminate.Index(symbols, 3)
        phrases = np.array([[0, 1, 2], [1, 1, 1], [0, 0, 3], [2, 3, 1]])
        lengths = np.array([2, 3, 1, 3])
        low, high = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high):
            want = [i for i in range(len(symbols) - n + 1) if symbols[i:i + n].tolist() == p[3 - n:].tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_language_model_base_scores(rough, clashing):
    rows = [(r.doc_id, WORDS.findall(lowered(r.text or "")) + [None]) for r in rough.collect()]
    counts = collections.Counter(w for d, ws in rows if remainder(d, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((d, remainder(d, 10) == 0, len(ws), sum(counts[w] > 0 for w in ws), n,
                        round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in rows), key=repr)
    out = lm.score(clashing(rough)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out),
                  key=repr) == expected
    assert all(r.score < 0 for r in out)
    # Copies of training texts are likelier under longer contexts.
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_is_the_stated_mixture(spark, order, monkeypatch):
    """With known weights the scores follow from counts of the training texts."""
    weights = np.tile(np.array([0.5] + [0.3 / (order - 1)] * (order - 1) + [0.2]), (lm.BUCKETS, 1))
    monkeypatch.setattr(lm, "learn", lambda *a: weights)
    docs = [(i, t) for i, t in enumerate(["a b a b c", "a b c", "", "b b b b", "c a b a", "a", "b a c b a b", "z a b"])]
    train = [t.split() for i, t in docs if remainder(i, 10)]
    start, end = "<", ">"
    grams = [collections.Counter() for _ in range(order + 1)]
    contexts = [collections.Counter() for _ in range(order + 1)]
    for t in train:
        seq = [start] * (order - 1) + t + [end]
        for k in range(order - 1, len(seq)):
            for n in range(1, order + 1):
                grams[n][tuple(seq[k - n + 1:k + 1])] += 1
                contexts[n][tuple(seq[k - n + 1:k])] += 1
    tokens_, known = sum(grams[1].values()), len(grams[1])
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), order=order).collect()}
    for i, t in docs:
        seq = [start] * (order - 1) + t.split() + [end]
        total = 0.0
        for k in range(order - 1, len(seq)):
            p = weights[0, -1] / (known + 1)
            for n in range(order, 0, -1):
                base = contexts[n][tuple(seq[k - n + 1:k])] if n > 1 else tokens_
                p += weights[0, order - n] * (grams[n][tuple(seq[k - n + 1:k + 1])] / base if base else 0)
            total += math.log10(p)
        assert got[i] == pytest.approx(total, abs=1e-9), (i, t)


def test_words_that_differ_in_final_marks_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_file())
    with open(tokens.tokenizer_file(), encoding="utf-8") as file:
        definition = file.read()
    texts = ["Alpha### alpha%%% alpha,", "", "it's 3%, é&&& alpha's*** a'll) x\u0338!", " \n", "<|endoftext|>alpha### b|** ((", "alpha###"]
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def encoded(encoder):
        return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode([t.encode() for t in texts])]

    seen = []
    encoder = tokens.WordEncoder(definition)
    whole = encoder.encode_whole
    monkeypatch.setattr(encoder, "encode_whole", lambda words: seen.extend(words) or whole(words))
    assert encoded(encoder) == wanted
    assert seen.count(b"alpha") == 1 and b"alpha###" not in seen
    # Words of one hash are told apart by their bytes.
    monkeypatch.setattr(tokens, "block_hashes", lambda first, values, sizes: np.zeros(len(sizes), np.uint64))
    assert encoded(tokens.WordEncoder(definition)) == wanted


def test_token_encoder_looks_words_up_without_their_final_marks():
    """Words that differ in final marks are one word and the marks (op3): the encoder remembers no word with them."""
    from tokenizers import Tokenizer

    from policyspark.llm.tokens import WordEncoder, tokenizer_file

    texts = ["stone, stone. (stone) stone!? Stone... a.b. don't.", "", "... stone.", "é. 5. x|y. |. stone|. z", "  .\n", "stone", "q.",
             "stone. <|x|> stone.", "a,b;c: \U0001f600. x\u00a0."]
    definition = open(tokenizer_file(), encoding="utf-8").read()
    whole = Tokenizer.from_file(tokenizer_file())
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = WordEncoder(definition)
    assert encoder.encode([t.encode() for t in texts[:7]]) == want[:7]
    assert not {b"stone,", b"stone.", b"stone!?", b"stone...", b"a.b.", b"q."} & set(encoder.known)
    assert encoder.encode([t.encode() for t in texts]) == want
    for t, ids in zip(texts, want):
        assert WordEncoder(definition).encode([t.encode()]) == [ids]


def test_tokens_round_trip(spark, rough, clashing, tmp_path):
    from tokenizers import Tokenizer

    extra = spark.createDataFrame([(400, "a<|endoftext|>b, <|STARTOFTEXT|> don't. x.., É́a !.", "en", "s", 1),
                                   (401, "A b c\x1cd word,. Word., e.g. 3.14, ...", "en", "s", 1)], rough.schema)
    docs = clashing(rough.unionByName(extra))
    path = str(tmp_path / "tokens")
    tokens.write_tokens(tokens.encode(docs), path)
    tokenizer = Tokenizer.from_file(tokens.tokenizer_file())
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    start, expected = 0, []
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert collected(tokens.digests(spark, path)) == sorted(expected, key=repr)
    assert tokens.read_tokens(spark, path, [5]).count() == 1


def test_tokens_prune_by_metadata(spark, rough, tmp_path):
    path = str(tmp_path / "tokens")
    tokens.write_tokens(tokens.encode(rough), path)
    plan = tokens.read_tokens(spark, path, [5])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(doc_id,5)" in plan


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(150):
        bad = i % 3 == 0
        rows.append((i, ("spam ### buy " if bad else "plain words here ") * (3 + i % 5), "en" if i % 2 else "de", "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), rows[4], (None, "spam ### buy", "de", "s", 1)]
    labels += [(4, 1, 0), (None, 1, 0), (5, None, 0)]
    from tests.llm.conftest import SCHEMA
    return (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality(labelled, clashing):
    docs, labels = labelled
    settings = quality.Settings(steps=3000)
    model = quality.fit(clashing(docs), labels, settings=settings)
    out = quality.score(clashing(docs), model).collect()
    assert len(out) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in out if r._h and r.doc_id is not None and truth.get(r.doc_id) is not None]
    assert len(held) > 10 and all(r._p == truth[r.doc_id] for r in held)
    assert all(0 <= r._s <= 1 and r._p == int(r._s >= 0.3) and r._h == (remainder(r.doc_id, 5) == 0) for r in out)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    # A text scores the same whatever stands in its chunk.
    texts = [r.text.encode() for r in docs.where("length(text) > 0").collect()]
    alone = [quality.score_chunk([t], model)[0] for t in texts]
    assert np.allclose(alone, quality.score_chunk(texts, model))


def test_quality_without_labels(labelled, empty):
    docs, labels = labelled
    model = quality.fit(docs, labels.limit(0))
    assert {r._s for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_language(spark, rough, clashing):
    french, german = "le chat est dans la maison avec vous ", "der hund ist nicht in dem haus und "
    rows = [(i, (french if i % 3 else german) * (1 + i % 4), "fr" if i % 3 else "de", "hot", 1) for i in range(90)]
    rows += [(100, None, "fr", "s", 1), (101, "123 ...", "de", "s", 1), (102, french, None, "s", 1), rows[5], (None, german, "de", "s", 1)]
    docs = clashing(spark.createDataFrame(rows, rough.schema))
    out = language.predict(docs, language.fit(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (remainder(r.doc_id, 4) == 2)
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        want = "und" if text is None or text.startswith("1") else "fr" if text.startswith("le") else "de"
        assert r.lang_pred == want
    nothing = language.predict(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_every_language_is_learned_however_many_there_are(spark, rough):
    rng = np.random.default_rng(6)
    own = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for _ in range(60)]
    rows = [(20 * k + i, " ".join(rng.choice(own[k], 30)), f"l{k:02d}", "s", 1) for k in range(60) for i in range(20)]
    docs = spark.createDataFrame(rows, rough.schema)
    model = language.fit(docs, settings=language.Settings(sample=100, landmarks=20))
    assert model.languages == tuple(f"l{k:02d}" for k in range(60))
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in language.predict(docs, model).collect())


def test_empty_tables(spark, empty, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    assert substrings.removals(empty).count() == 0
    assert decontaminate.find(empty, bench).count() == 0
    assert lm.score(empty).count() == 0
    assert language.predict(empty, language.fit(empty)).count() == 0
    tokens.write_tokens(tokens.encode(empty), str(tmp_path / "t"))


def test_no_benchmark_finds_nothing(spark, rough):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find(rough, bench).select("doc_id", "_words", F.size("_spans")).collect()
    assert {r[2] for r in got} == {0}
    assert {(r[0], r[1]) for r in got} == {(r.doc_id, len(ALNUM.findall(lowered(r.text or "")))) for r in rough.collect()}


def thue_morse(length, one, other):
    return "".join((one, other)[i.bit_count() & 1] for i in range(length))


def test_long_words_that_differ_little_are_different(spark, rough):
    rest = " ".join(f"w{i}" for i in range(19))
    first, second = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    swapped = ["z" * at + "a" + "z" * (9000 - at) for at in (10, 10 + 4096, 10 + 8192)]
    words = [first, second, *swapped, "a", "a\0", "\0a", "é", "e"]
    hashes, bounds = hashed_words([w.encode() for w in words])
    assert len(set(hashes.tolist())) == len(words) and bounds.tolist() == list(range(len(words) + 1))
    rows = [(i, f"{w} {rest}") for i, w in enumerate(words[:5])]
    assert collected(substrings.removals(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_substrings(rows)
    twice = [(1, f"{first} {rest}"), (2, f"{second} {rest} {rest}")]
    assert collected(substrings.removals(spark.createDataFrame(twice, "doc_id long, text string"))) == brute_substrings(twice)


def test_hashes_of_words_and_sequences_follow_their_content():
    texts = [b"", b"one two  three", b"\tthree four-and-twenty ", b"one", b" "]
    hashes, bounds = hashed_words(texts)
    assert bounds.tolist() == [0, 0, 3, 5, 6, 6]
    assert hashes[0] == hashes[5] and hashes[2] == hashes[3] and len(set(hashes.tolist())) == 4
    a, b = np.array([5, 9], np.uint64)
    assert len({int(sequence_hash(np.array(s, np.uint64))) for s in ([], [a], [b], [a, b], [b, a], [a, b, a], [0], [0, 0])}) == 8
    runs = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    assert (gram_checks(runs, 3) == gram_checks(runs, 3)[0]).tolist() == [True, False, False, True, False]


STAGES = {
    "quality": lambda spark, docs: quality.keep_good(docs, quality.fit(
        spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i}") for i in range(40)], "doc_id long, text string"),
        spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))),
    "similar": lambda spark, docs: simhash.keep_one_similar(docs),
    "substrings": lambda spark, docs: substrings.remove(docs),
    "decontaminate": lambda spark, docs: decontaminate.remove(
        docs, spark.createDataFrame([(1, "word " * 12), (2, "no id here")], "item_id long, text string")),
}
INNER = ["_id", "_hash", "_places", "_copy", "_p", "_s", "_h", "_held", "_text", "_words", "_spans", "_items", "_root", "_best", "_n",
         "_part", "key", "fp", "bands", "hash", "block", "places", "node", "root", "column0", "n", "Text"]


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, rough, empty, name):
    docs = rough.where("doc_id > 90 OR doc_id IS NULL OR doc_id < 12")
    plain = collected(STAGES[name](spark, docs))
    theirs = docs.toDF(*docs.columns)
    for column in INNER:
        theirs = theirs.select("*", F.concat(F.lit(f"{column} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(
            column)) if column != "Text" else theirs.toDF(*theirs.columns).withColumnRenamed("n", "Text")
    result = STAGES[name](spark, theirs)
    assert result.columns == theirs.columns
    rows = result.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == plain
    for column, value in zip(result.columns[5:], zip(*[tuple(r)[5:] for r in rows])):
        own = "n" if column == "Text" else column
        assert list(value) == [f"{own} of {'none' if r[0] is None else r[0]}" for r in rows]
    nothing = STAGES[name](spark, empty)
    assert nothing.columns == empty.columns and nothing.count() == 0


def test_which_repeated_row_stays_does_not_depend_on_the_partitions(spark):
    rows = [(1, "same text here", s) for s in "abcdefgh"] + [(2, " ".join(f"w{i}" for i in range(30)), s) for s in "abcdefgh"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for stage in (simhash.keep_one_similar, substrings.remove):
        results = [collected(stage(docs.repartition(n, F.xxhash64("source", F.lit(n))))) for n in (1, 3, 7)]
        assert results[0] == results[1] == results[2]


def test_texts_edited_from_one_are_found_however_many_and_unlike(spark, rough):
    """A third of all rows are edits of one text, each unlike the other edits (below 0.8) and like the text itself."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    rows = [(1000, " ".join(base))]
    for k in range(200):
        words = list(base)
        for at in rng.choice(400, 8, replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    rows += [(2000 + k, " ".join(f"v{x}" for x in rng.integers(0, 9999, 60))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    kept = sorted(r.doc_id for r in simhash.keep_one_similar(docs).collect())

    def grams(text):
        words = text.split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}

    original = grams(rows[0][1])
    near = [i for i, t in rows[1:201] if len(original & grams(t)) / len(original | grams(t)) >= 0.8]
    assert len(near) > 150
    assert [k for k in kept if k >= 2000] == [r[0] for r in rows[201:]]
    assert len([k for k in kept if k < 2000 and (k == 1000 or k in near)]) <= 1 + len(near) // 20
