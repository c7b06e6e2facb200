"""Embedding near-duplicates, the Merkle manifest and hard negatives against plain versions."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from policyspark.llm import embedding_dedup as dedup
from policyspark.llm import hard_negatives, manifest, registry, spread

VECTORS = "vec_id long, embedding array<double>"


def usable(v):
    return v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v)


def plain_dedup(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of all different rows."""
    rows = list(dict.fromkeys((i, tuple(v) if usable(v) else None) for i, v in rows))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            u, v = rows[a][1], rows[b][1]
            if u is None or v is None or len(u) != len(v):
                continue
            u, v = np.array(u) / max(map(abs, u)), np.array(v) / max(map(abs, v))
            if u @ v / math.sqrt((u @ u) * (v @ v)) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i, (name, _) in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((name, links[i], least, name == least))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def near():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(250)]
    for start, size, noise in ((1000, 120, 0.02), (2000, 40, 0.07), (3000, 25, 0.09)):  # tight and loose groups
        centre = rng.normal(size=16)
        rows += [(start + i, (centre + noise * rng.normal(size=16)).tolist()) for i in range(size)]
    same = rng.normal(size=16).tolist()
    rows += [(4000 + i, same) for i in range(60)]
    rows += [(4100, [2 * x for x in same]), (4101, [1e200 * x for x in same]), (4102, [1e-200 * x for x in same]), (4103, [-x for x in same])]
    chain = rng.normal(size=(2, 16))
    chain /= np.linalg.norm(chain, axis=1, keepdims=True)
    rows += [(5000 + i, (math.cos(i * 0.2) * chain[0] + math.sin(i * 0.2) * chain[1]).tolist()) for i in range(8)]
    rows += [rows[0], rows[0], rows[260], (0, rng.normal(size=16).tolist()), (6000, None), (6001, []), (6002, [0.0] * 16),
             (6003, [float("nan")] + [1.0] * 15), (6004, [float("inf")] + [1.0] * 15), (6005, [None] + [1.0] * 15), (6005, None),
             (6006, [1.0, 1.0]), (6007, [2.0, 2.1]), (None, same), (None, None), (None, [1.0, -5.0])]
    return rows


def test_embedding_dedup(spark, near):
    df = spark.createDataFrame(near, VECTORS).withColumns({c: F.lit("theirs") for c in ("node", "bucket", "part", "_part", "root", "links")})
    got = ordered(dedup.near_duplicates(df.repartition(5)).collect())
    want = ordered(plain_dedup(near))
    assert [r[:1] + r[2:] for r in got] == [r[:1] + r[2:] for r in want]
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_embedding_dedup_of_large_buckets(spark, near):
    """Blocks of ten: nearly every bucket is cut, and common ones are spread; counts stay whole."""
    settings = dedup.Settings(block=10, at_once=2, recall=0.9999)
    df = spark.createDataFrame(near, VECTORS)
    assert ordered(dedup.near_duplicates(df, settings=settings).collect()) == ordered(plain_dedup(near))


def test_embedding_dedup_of_floats_and_none(spark, near):
    df = spark.createDataFrame(near, VECTORS).where("vec_id < 4000").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert [r[0::2] for r in ordered(dedup.near_duplicates(df).collect())] == [r[0::2] for r in ordered(plain_dedup(rows))]
    assert dedup.near_duplicates(df.limit(0)).count() == 0
    few = df.limit(0).union(spark.createDataFrame([(None, None), (3, None)], "vec_id long, embedding array<float>"))
    assert ordered(dedup.near_duplicates(few).collect()) == [(None, 0, None, True), (3, 0, 3, True)]


def test_hyperplanes_follow_the_number_of_rows():
    unit = dedup.unit_vectors(np.random.default_rng(1).normal(size=(2000, 32)))
    small, large = (dedup.fitted(unit, n, dedup.Settings()) for n in (2_000, 2_000_000))
    assert large.bits > small.bits and large.count > small.count
    alike = 1 - math.acos(0.95) / math.pi
    assert all(1 - (1 - alike ** t.bits) ** t.count >= 0.995 for t in (small, large))


def test_joined_spread(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(300)], "k long, v long")
    once = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (7, "d"), (9, "e")], "k long, name string")
    assert ordered(spread.joined_spread(rows, "k", once, "v").select("k", "v", "name").collect()) == ordered(
        rows.join(once, "k").select("k", "v", "name").collect())


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def runs(nodes):
    """(root, siblings of each node level by level as (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % 3
            paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1:first + 3])))
        nodes = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for (doc_id, text, lang, source, n_chars)."""
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = [h(*map(framed, (doc_id, source, lang, n_chars, t))) for t in (text, text and text.replace("\n", ""))]
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        groups[source].append((doc_id is not None, doc_id or 0, leaf[0], leaf[tampered], doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for name in names:
        groups[name].sort(key=lambda r: r[:3])
        built.append(runs([r[2] for r in groups[name]]))
    root, tops = runs([r for r, _ in built])
    out = []
    for name, (subroot, paths), top in zip(names, built, tops):
        for (*_, leaf, given, doc_id), path in zip(groups[name], paths):
            acc = given
            for left, right in path + top:
                acc = h(left, acc, right)
            out.append((doc_id, leaf, subroot, root, h(*[a + b for a, b in path + top]), acc, acc == root))
    return out


def test_manifest(spark, rough, clashing):
    rows = [tuple(r) for r in rough.collect()]
    df = clashing(rough).withColumns({c: F.lit("theirs") for c in ("place", "g", "i", "n", "h", "leaf", "cell", "seg", "payload", "first", "of")})
    got = ordered(manifest.document_manifest(df).collect())
    assert got == ordered(plain_manifest(rows))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_deep_trees(spark):
    """Sources of every size around powers of three, one of 7,000 rows (several chunks and cells), many sources."""
    sizes = [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 81, 82, 728, 729, 730, 7000] + [1] * 40
    rows, doc_id = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            rows.append((doc_id, f"text\n{doc_id % 11}", None if doc_id % 5 else "en", f"s{s:02d}" if s else None, 6))
            doc_id += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert ordered(manifest.document_manifest(df).collect()) == ordered(plain_manifest(rows))


def test_manifest_of_few_and_none(spark, empty):
    assert manifest.document_manifest(empty).count() == 0
    rows = [(5, None, None, None, None)]
    (got,) = manifest.document_manifest(spark.createDataFrame(rows, empty.schema)).collect()
    assert tuple(got) == plain_manifest(rows)[0] and got.root == got.leaf == got.subroot and got.verified


def plain_mining(rows):
    """(anchor, positive, rank, negative, scores) for (vec_id, embedding, label)."""
    least = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not len(v) or None in v or not all(map(math.isfinite, v)) or max(map(abs, v)) >= 65536:
            continue
        key = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        least[i] = min(least.get(i, key), key)
    out = []
    for a, (label, v) in least.items():
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in least.items() if i != a and len(w) == len(v)]
        for score, positive, _ in sorted(s for s in scores if s[2])[:5]:
            window = sorted(s for s in scores if not s[2] and -30 * score <= -100 * s[0] <= -90 * score)
            out += [(a, positive, r + 1, i, -score, -s) for r, (s, i, _) in enumerate(window[:10])]
    return out


LABELLED = "vec_id long, embedding array<double>, label int"
QUERY_LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 12))
    rows = [(i, (centres[i % 4] * (i % 3 > 0) + rng.normal(size=12)).round(2).tolist(), 1 if i % 3 else i % 4) for i in range(1500)]
    rows += [(2000 + i, rows[7][1], i % 5) for i in range(60)]  # equal vectors: ties by id
    rows += [(3000, None, 1), (3100, [], 1), (3200, [float("nan")] * 12, 1), (3300, [1.0] * 12, None), (3400, [None] + [1.0] * 11, 2),
             (3500, [0.0] * 12, 1), (3600, [1.0, 2.0], 1), (3601, [1.0, 2.5], 1), (3602, [1.0, 1.5], 2), (3700, [1e300] * 12, 1),
             (3800, [60000.0] * 12, 1), (3801, [59000.0] * 12, 1), (3802, [31000.0] * 12, 2), (None, [1.0] * 12, 1)]
    return rows + [rows[100], rows[100], (200, [0.5] * 12, 3)]


def test_hard_negatives(spark, labelled):
    df = spark.createDataFrame(labelled, LABELLED).withColumns({c: F.lit("theirs") for c in ("size", "ids", "dims", "turn", "score", "vector")})
    got = hard_negatives.mine(df.repartition(4), F.col("vec_id") % 100 == 0, label=F.expr(QUERY_LABEL))
    assert ordered(got.collect()) == ordered(plain_mining(labelled))


def test_hard_negatives_in_turns_and_small_blocks(spark, labelled, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TURN", 6)
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "STEP", 5)
    df = spark.createDataFrame(labelled, LABELLED)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=F.expr(QUERY_LABEL)).collect()
    assert ordered(got) == ordered(plain_mining(labelled))


def test_hard_negatives_of_none(spark, labelled):
    df = spark.createDataFrame(labelled, LABELLED)
    assert hard_negatives.mine(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_bounds_leave_rows_early():
    """The scan reads on only with rows that can still be wanted, and never loses one."""
    rng = np.random.default_rng(4)
    values = rng.integers(-200, 200, size=(64, 3000)).astype("<i4")
    anchor = rng.integers(-5, 6, size=64)
    anchor[3] = 300
    columns = hard_negatives.Columns(np.arange(3000).astype("<i8").tobytes(), [d.tobytes() for d in values], 300)
    seen = []

    def wanted(low, high):
        seen.append(len(low))
        return high >= 55_000

    at, scores = columns.scan(anchor, wanted)
    exact = anchor @ values
    assert set(np.flatnonzero(exact >= 55_000)) <= set(at.tolist()) and (exact[at] == scores).all()
    assert seen[-1] < seen[1] / 3


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_merkle_manifest", "op13_hard_negatives"])
def test_registered_queries(name, spark, sf_dir, duck):
    queries, sql = registry.load_all()
    got = queries[name](spark, sf_dir)
    result = duck.execute(sql[name])
    names = [d[0] for d in result.description]
    assert set(names) == set(got.columns)
    assert ordered(got.select(names).collect()) == ordered(result.fetchall())
