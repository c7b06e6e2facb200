"""A Merkle manifest of a table, with membership proofs found by pointer jumping.

Every row is a leaf. The leaves of a group (a source) in the order of their ids
are hashed three at a time, and so are the results, until one node is left:
the group's subroot. Subroots in the order of the groups give the root in the
same way.

Trees are built in chunks of six levels: the 729 nodes below one node meet in
one row, so that a tree over n leaves takes log(n) / log(729) shuffles. Proofs
come from self-joins: at first every node holds the siblings of its own run
and points to its parent; then, in each turn, it appends the siblings that the
node it points to holds and points where that one points. The distance
doubles, and a leaf reaches the root of its tree in log2(height) joins. Only
nodes at multiples of the distance are ever pointed to, so the others are
dropped on the way.

Leaves are numbered by a range sort and the row counts of its partitions, so a
group may hold any share of all rows. In a join the leaves of a tree are dealt
into cells of 6,561 neighbours; a node above many leaves is copied to each cell
below it, so that no key of a join grows with a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyspark.llm.registry import query
from policyspark.llm.words import table, written

#: Nodes of a run, and levels that are hashed in one go.
ARITY = 3
LEVELS = 6
CHUNK = ARITY ** LEVELS
#: Neighbouring leaves that join under one key.
CELL = ARITY ** 8
_SIBLINGS = "array<struct<l:binary,r:binary>>"
#: What a leaf is the hash of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def powers() -> Column:
    return F.expr("array(" + ", ".join(f"{ARITY ** k}L" for k in range(39)) + ")")


def power(level: Column) -> Column:
    return F.element_at(powers(), (level + 1).cast("int"))


def over(value: Column, by: Column | int) -> Column:
    """Whole division of longs."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by).cast("long"))


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with g (a number per group, ascending with it; null first), i (place in the group, from 0) and n (its size).

    Rows are range-partitioned and sorted by group and ``order`` (nulls first);
    counts of (partition, group) tell where each partition goes on.
    """
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33)
    runs = placed.groupBy(part.alias("run_part"), F.col(group).alias("run_of")).agg(
        F.min("place").alias("first"), F.count("*").alias("size"))
    all_of = Window.partitionBy("run_of")  # a group has one row per partition at most
    before = F.sum("size").over(all_of.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("run_part", "run_of", "first", F.coalesce(before, F.lit(0)).alias("before"),
                       F.sum("size").over(all_of).alias("n"), F.min("first").over(all_of).alias("g"))
    joined = placed.join(runs, (part == F.col("run_part")) & F.col(group).eqNullSafe(F.col("run_of")))
    return joined.select(*df.columns, "g", (F.col("place") - F.col("first") + F.col("before")).alias("i"), "n")


def height(n: Column) -> Column:
    """Levels above n leaves: the powers of three below n."""
    return F.size(F.filter(powers(), lambda p: p < n)).cast("long")


def chunked(level: DataFrame, count: Column) -> DataFrame:
    """Chunks of up to 729 neighbouring nodes with their next six levels a0..a6 (fewer, where one node is left).

    :param level: g, leaves, i, h, payload; ``count`` is the nodes of the group on this level.
    """
    rows = level.withColumn("count", count)
    chunk = rows.groupBy("g", "leaves", "count", over(F.col("i"), CHUNK).alias("c")).agg(
        F.sort_array(F.collect_list(F.struct("i", "h", "payload"))).alias("kids"))
    chunk = chunk.withColumn("a0", F.col("kids.h"))
    for k in range(LEVELS):
        chunk = chunk.withColumn(f"a{k + 1}", F.when(F.col("count") > ARITY ** k, runs_of(f"a{k}")).otherwise(F.col(f"a{k}")))
    return chunk


def runs_of(nodes: str) -> Column:
    """The digests of the runs of a list of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(F.col(nodes), j * ARITY + 1, ARITY), ""), 256))


def run_of(nodes: str, j: Column) -> Column:
    """The siblings of node j in its run, as bytes: those to the left and those to the right."""
    at = F.pmod(j, F.lit(ARITY)).cast("int")
    left = F.slice(F.col(nodes), (j - at + 1).cast("int"), at)
    right = F.slice(F.col(nodes), (j + 2).cast("int"), (F.lit(ARITY - 1) - at))
    return F.struct(F.unhex(F.array_join(left, "")).alias("l"), F.unhex(F.array_join(right, "")).alias("r"))


def placed(nodes: str, first: Column) -> Column:
    """pos (counted from ``first``) and siblings of each node of a list."""
    return F.transform(nodes, lambda _, j: F.struct((first + j).alias("pos"), F.array(run_of(nodes, j)).alias("seg")))


def grown(leaves: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trees of all groups: (leaf nodes, nodes above the leaves without the roots, roots (g, leaves, root)).

    :param leaves: g, i, n, h, payload (a struct that leaves keep); ``most`` is the largest n.
    """
    level = leaves.select("g", F.col("n").alias("leaves"), "i", "h", "payload")
    base, low, upper, roots = 0, None, [], []
    while True:
        # Nodes of a level that is itself made of full chunks: leaves / 3^base, rounded up.
        count = over(F.col("leaves") + F.lit(ARITY ** base - 1), ARITY ** base)
        chunks = written(chunked(level, count), "tree")
        if not base:
            kid = F.transform("kids", lambda x, j: F.struct(
                x["i"].alias("pos"), x["h"].alias("h"), x["payload"].alias("payload"),
                F.when(F.col("count") > 1, F.array(run_of("a0", j))).otherwise(F.array().cast(_SIBLINGS)).alias("seg")))
            low = chunks.select("g", "leaves", F.explode(kid).alias("k")).select("g", "leaves", F.lit(0).cast("long").alias("level"), "k.*")
        for k in range(0 if base else 1, LEVELS):
            node = placed(f"a{k}", over(F.col("c") * F.lit(CHUNK), ARITY ** k))
            upper.append(chunks.where(F.col("count") > ARITY ** k).select("g", "leaves", F.explode(node).alias("k")).select(
                "g", "leaves", F.lit(base + k).cast("long").alias("level"), "k.pos", F.col("k.seg").cast(_SIBLINGS).alias("seg")))
        top = F.element_at(f"a{LEVELS}", 1)
        roots.append(chunks.where(F.col("count") <= CHUNK).select("g", "leaves", top.alias("root")))
        base += LEVELS
        if ARITY ** base >= most:
            break
        level = chunks.where(F.col("count") > CHUNK).select("g", "leaves", F.col("c").alias("i"), top.alias("h"),
                                                            F.lit(None).cast("int").alias("payload"))
    for parts in (upper, roots):
        while len(parts) > 1:
            parts[0] = parts[0].unionByName(parts.pop())
    return low, upper[0], roots[0]


def hop(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each node that is not there yet takes over the siblings and the pointer of the node that it points to."""
    there = F.col("at") >= height(F.col("leaves"))
    near = nodes.withColumns({
        # Nodes that have arrived meet nothing and stay spread by their place.
        "to": F.when(there, F.lit(-1).cast("long")).otherwise(F.col("at")),
        "to_pos": F.when(there, F.col("pos")).otherwise(over(F.col("pos"), power(F.col("at") - F.col("level")))),
        "cell": over(F.col("pos") * power(F.col("level")), CELL)})
    start = F.col("pos") * power(F.col("level"))
    end = F.least(F.col("leaves"), start + power(F.col("level"))) - 1
    far = targets.select(F.col("g").alias("tg"), F.col("level").alias("tl"), F.col("pos").alias("tp"), F.col("at").alias("ta"),
                         F.col("seg").alias("ts"), F.explode(F.sequence(over(start, CELL), over(end, CELL))).alias("tc"))
    joined = near.join(far, (F.col("g") == F.col("tg")) & (F.col("to") == F.col("tl")) & (F.col("to_pos") == F.col("tp"))
                       & (F.col("cell") == F.col("tc")), "left")
    kept = [c for c in nodes.columns if c not in ("seg", "at")]
    return joined.select(*kept, F.concat("seg", F.coalesce("ts", F.array().cast(_SIBLINGS))).alias("seg"),
                         F.coalesce("ta", "at").alias("at"))


def jumped(low: DataFrame, upper: DataFrame, most: int) -> DataFrame:
    """The leaf nodes with the siblings of all levels up to their root in ``seg``.

    Of the nodes above, only those at multiples of the distance go on.
    """
    def at(nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("at", F.least(F.col("level") + 1, height(F.col("leaves"))))

    low, upper = at(low), written(at(upper), "nodes")
    distance = 1
    while ARITY ** distance < most:
        low = hop(low, upper)
        upper = written(hop(upper.where(F.col("level") % (2 * distance) == 0), upper), "nodes")
        distance *= 2
    return low.drop("at", "level")


def proofs(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaf nodes with all siblings on their way: g, leaves, pos, h, payload, seg; roots: g, leaves, root)."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    low, upper, roots = grown(leaves, most)
    return jumped(low, upper, most), roots


def manifest(rows: DataFrame, group: str, order: str, leaf: str = "leaf", keep: tuple[str, ...] = ()) -> DataFrame:
    """group, order, leaf, ``keep``, subroot, root, siblings: one row per row, with its proof.

    ``siblings`` are the other nodes of the runs on the way to the root, level
    by level: bytes of the digests to the left and to the right. Leaves of a
    group ascend by ``order``, null first, equal ones by their digest; groups
    ascend bytewise, null first. Repeated rows are leaves of their own. An
    empty table gives no row.
    """
    kept = [group, order, *keep]
    leaves = rows.select(F.col(group).alias("_1"), F.col(order).alias("_2"), F.col(leaf).alias("h"),
                         F.struct(*[F.col(c).alias(f"k{j}") for j, c in enumerate(kept)]).alias("payload"))
    paths, subroots = proofs(numbered(leaves, "_1", ["_2", "h"]))
    subroots = written(subroots, "subroots")
    sources = numbered(subroots.select(F.lit(0).alias("all"), F.col("g").alias("of"), F.col("root").alias("h")), "all", ["of"])
    tops, root = proofs(sources.select("g", "i", "n", "h", F.struct("of").alias("payload")))
    tops = tops.join(root.select("g", "root"), "g").select(F.col("payload.of").alias("of"), F.col("h").alias("subroot"), "root",
                                                           F.col("seg").alias("more"))
    # A group's way from its subroot goes to each cell of its leaves.
    cells = F.sequence(F.lit(0).cast("long"), over(F.col("leaves") - 1, CELL))
    tops = subroots.select(F.col("g").alias("sg"), F.explode(cells).alias("cell")).join(tops, F.col("sg") == F.col("of")).drop("of")
    whole = paths.withColumn("at_cell", over(F.col("pos"), CELL)).join(
        tops, (F.col("g") == F.col("sg")) & (F.col("at_cell") == F.col("cell")))
    return whole.select(*[F.col(f"payload.k{j}").alias(c) for j, c in enumerate(kept)], F.col("h").alias(leaf), "subroot", "root",
                        F.concat("seg", "more").alias("siblings"))


def proof_digest(siblings: str = "siblings") -> Column:
    """SHA-256 of the hex digests of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.lower(F.hex(F.concat(s["l"], s["r"])))), ""), 256)


def folded(leaf: Column, siblings: str = "siblings") -> Column:
    """The root that a leaf leads to with these siblings."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(F.lower(F.hex(s["l"])), h, F.lower(F.hex(s["r"]))), 256))


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """(source, doc_id, leaf, tampered): tampered is the leaf without the line feeds of the text where
    2 divides the CRC-32 of the decimal id and there are any, else null. A row without an id is never tampered."""
    def leaf(altered: bool) -> Column:
        return digest(*[framed(F.replace(F.col(c), F.lit("\n"), F.lit("")) if altered and c == text else F.col(c)) for c in fields])

    chosen = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col(text), F.lit("\n"))
    return docs.select("source", "doc_id", leaf(False).alias("leaf"), F.when(chosen, leaf(True)).alias("tampered"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of docs; other columns are ignored.

    Null fields are hashed as ``-``; rows of a null source are a group of their own, the first.
    """
    rows = manifest(written(leaves_of(docs), "leaves"), "source", "doc_id", keep=("tampered",))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"),
                       folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _level_sql(levels: int = 20) -> str:
    """Nodes of all levels, unrolled: a group goes on while it has several nodes."""
    out = ["n0(tree, pos, h, level) AS (SELECT source_no, row_number() OVER (PARTITION BY source_no ORDER BY doc_id NULLS FIRST, leaf) - 1, "
           "leaf, 0 FROM leaves)"]
    for k in range(1, levels + 1):
        out.append(f"n{k} AS (SELECT tree, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, {k} AS level FROM n{k - 1} "
                   f"WHERE tree IN (SELECT tree FROM n{k - 1} GROUP BY tree HAVING count(*) > 1) GROUP BY tree, pos // 3)")
    union = " UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(levels + 1))
    out.append(f"low AS ({union})")
    return ",\n".join(out)


def _manifest_sql(levels: int = 20) -> str:
    """Leaves, trees and walks in SQL; the upper tree is the tree -1. CRC-32 runs bit by bit."""
    def framed_sql(value: str) -> str:
        return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"

    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(framed_sql(text if c == "text" else c) for c in FIELDS) + ")"

    top = ["t0(pos, h, level) AS (SELECT tree - 1, max_by(h, level), 0 FROM low GROUP BY tree)"]
    for k in range(1, levels + 1):
        top.append(f"t{k} AS (SELECT pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, {k} AS level FROM t{k - 1} "
                   f"WHERE (SELECT count(*) FROM t{k - 1}) > 1 GROUP BY pos // 3)")
    tops = " UNION ALL ".join(f"SELECT -1 AS tree, pos, h, level FROM t{k}" for k in range(levels + 1))
    return f"""
WITH RECURSIVE crc(id, step, c) AS (
  SELECT DISTINCT doc_id::VARCHAR, 0, 4294967295 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT id, step + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) FROM (
    SELECT id, step, CASE WHEN step % 8 = 0 THEN xor(c, ascii(substr(id, step // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc
    WHERE step < 8 * strlen(id))),
even AS (SELECT id FROM crc WHERE step = 8 * strlen(id) AND c & 1 = 1),
leaves AS (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) AS source_no, doc_id, {leaf_sql("text")} AS leaf,
  CASE WHEN doc_id::VARCHAR IN (SELECT id FROM even) THEN {leaf_sql("replace(text, chr(10), '')")}
       ELSE {leaf_sql("text")} END AS given FROM documents),
{_level_sql(levels)},
{", ".join(top)},
nodes AS (SELECT tree, pos, h, level FROM low UNION ALL {tops}),
steps AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3
  WHERE a.level < (SELECT max(level) FROM nodes m WHERE m.tree = a.tree) GROUP BY 1, 2, 3),
peaks AS (SELECT tree, max(level) AS level, max_by(h, level) AS h FROM nodes GROUP BY tree),
walk(doc_id, leaf, source_no, tree, level, pos, acc, proof) AS (
  SELECT doc_id, leaf, source_no, source_no, 0, row_number() OVER (PARTITION BY source_no ORDER BY doc_id NULLS FIRST, leaf) - 1,
    given, '' FROM leaves
  UNION ALL
  SELECT doc_id, leaf, source_no, t2, l2, p2, a2, s2 FROM (
    SELECT w.doc_id, w.leaf, w.source_no, w.tree AS t2, w.level + 1 AS l2, w.pos // 3 AS p2, sha256(s.l || w.acc || s.r) AS a2,
      w.proof || s.l || s.r AS s2
    FROM walk w JOIN steps s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos
    UNION ALL
    SELECT w.doc_id, w.leaf, w.source_no, -1, 0, w.source_no - 1, w.acc, w.proof
    FROM walk w JOIN peaks p ON p.tree = w.tree AND p.level = w.level WHERE w.tree > 0))
SELECT w.doc_id, w.leaf, s.h AS subroot, p.h AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = p.h AS verified
FROM walk w JOIN peaks p ON p.tree = -1 AND w.tree = -1 AND w.level = p.level JOIN peaks s ON s.tree = w.source_no
"""


@query("op12_merkle_manifest", _manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and checked proof of every document."""
    return document_manifest(table(spark, sf_dir, "documents"))
