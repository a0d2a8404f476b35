"""Merkle manifest of a dataset: subtrees per group, one tree over them, a proof for every row, by slot pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spectrafold.llm.common import Scratch
from spectrafold.operators.blocks import dense_index

FANOUT = 3
#: A proof: per level, the digests of the run's other nodes, those before the own one and those after it.
PROOF = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated; digests go in as hex text."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*columns: Column) -> Column:
    """Digest of the columns' values as text, each led by its length in bytes and a colon; a null is a dash."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(field, columns))


def proof_digest(proof: Column) -> Column:
    """Digest of all digests of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda below, s: digest(s["before"], below, s["after"]))


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes above a level's pivot: the slot columns, concatenated, are hashed."""
    cells = [F.coalesce(F.col(f"slot{s}.hash"), F.lit("")) for s in range(fanout)]
    return level.select("tree", F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("pos"), digest(*cells).alias("hash"))


def _climb(nodes: DataFrame, fanout: int, largest: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Pivots of all levels, the leaves' first, and (tree, hash) of every root.

    nodes has tree, n (nodes of the tree), pos, hash and what leaves carry, in `row`. A pivot has one row per parent,
    its children in slot columns; a tree of n nodes leaves after ceil(log n) levels, so the levels together have
    little more rows than half the leaves.
    """
    cut = F.expr(f"pos div {fanout}L")
    levels, roots = [], nodes.where("n = 1").select("tree", "hash")
    while largest > 1:
        kept = F.struct(*[c for c in ("hash", "row") if c in nodes.columns])
        slots = [F.max(F.when(F.col("pos") % fanout == s, kept)).alias(f"slot{s}") for s in range(fanout)]
        level = scratch.save(nodes.where("n > 1").groupBy("tree", "n", cut.alias("parent")).agg(*slots))
        levels.append(level)
        nodes = _parents(level, fanout)
        roots = roots.union(nodes.where("n = 1").select("tree", "hash"))
        largest = -(-largest // fanout)
    return levels, roots


def _descend(levels: list[DataFrame], leaves: DataFrame, tops: DataFrame, fanout: int) -> DataFrame:
    """Every leaf with its proof: what its tree's top has, led by the siblings of every node on the way.

    tops has tree, proof and what a tree hands to its leaves, in `above`. Going down, a parent's proof is joined to its
    pivot row once, and leaving out a child's own slot column gives that child's siblings.
    """
    texts = [F.coalesce(F.col(f"slot{s}.hash"), F.lit("")) for s in range(fanout)]
    known = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        own = level.where(F.col("n") <= fanout).join(tops, "tree")
        if known is not None:
            lower = level.where(F.col("n") > fanout).join(known, ["tree", "parent"])
            own = own.unionByName(lower)
        cells = []
        for s in range(fanout):
            sides = F.struct(F.concat(F.lit(""), *texts[:s]).alias("before"), F.concat(F.lit(""), *texts[s + 1:]).alias("after"))
            cells.append(F.when(F.col(f"slot{s}").isNotNull(), F.struct(
                (F.col("parent") * fanout + s).alias("pos"), F.col(f"slot{s}").alias("node"), F.concat(F.array(sides), "proof").alias("proof"))))
        child = own.select("tree", "above", F.explode(F.array_compact(F.array(*cells))).alias("child"))
        known = child.select("tree", "above", F.col("child.pos").alias("parent"), "child.node", "child.proof")
        if k:
            known = known.drop("node")
    lone = leaves.where("n = 1").join(tops, "tree").select("tree", "above", F.struct("hash", "row").alias("node"), "proof")
    return lone if known is None else lone.unionByName(known.drop("parent"))


def _ranked(rows: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """rows (tree, hash, row) with pos and n, and the size of the largest tree."""
    sizes = scratch.save(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    placed = dense_index(rows, ["tree"], order)
    largest = sizes.agg(F.max("n")).first()[0] or 0
    return placed.join(sizes, "tree").select("tree", "n", "pos", "hash", "row"), largest


def manifest(docs: DataFrame, group: str, order: str, leaf: Column, carry: dict[str, Column], fanout: int = FANOUT) -> DataFrame:
    """carry's columns, leaf, subroot, root and proof (PROOF) of every row.

    The rows of a group, ascending by `order` (nulls first, ties by leaf), are the leaves of its subtree: runs of
    `fanout` nodes become their digest until one is left, a lone leaf itself. Subroots, ordered by group (null first,
    bytewise), become the root in the same way. `leaf` is the digest that a row stands for; `carry` names what its
    result shows besides. Equal rows are leaves each; null groups are a group; an empty table gives no rows.
    Texts are read once, levels are tables in the shared folder, and a group's leaves are spread by range and by parent.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("."), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(
        tree.alias("tree"), F.col(order).alias("at"), leaf.alias("hash"), F.struct(*[c.alias(n) for n, c in carry.items()]).alias("row"))
    rows = scratch.save(rows.withColumn("tie", F.monotonically_increasing_id()))
    leaves, largest = _ranked(rows, ["at", "hash", "tie"], scratch)
    leaves = scratch.save(leaves)
    levels, subroots = _climb(leaves, fanout, largest, scratch)
    heads = scratch.save(subroots.select(F.lit("").alias("tree"), "hash", F.struct(F.col("tree").alias("group")).alias("row")))
    trunk, width = _ranked(heads, ["row.group"], scratch)
    upper, roots = _climb(trunk, fanout, width, scratch)
    none = F.array().cast(PROOF)
    tops = roots.select("tree", F.col("hash").alias("above"), none.alias("proof"))
    tops = scratch.save(_descend(upper, trunk, tops, fanout).select(
        F.col("node.row.group").alias("tree"), F.struct(F.col("node.hash").alias("subroot"), F.col("above").alias("root")).alias("above"), "proof"))
    found = _descend(levels, leaves, tops, fanout)
    return found.select("node.row.*", F.col("node.hash").alias("leaf"), "above.subroot", "above.root", "proof")


def verify(found: DataFrame, seen: str) -> DataFrame:
    """found, of `manifest`, with folded_root, the root that the leaf digest in column `seen` leads to, and verified."""
    folded = found.withColumn("folded_root", fold(F.col(seen), F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The manifest of documents in DuckDB. CRC-32 goes bit by bit: eight steps a byte, the byte coming in at the first.
MANIFEST_SQL = """
WITH RECURSIVE base AS (
  SELECT *, row_number() OVER () AS rid,
    CASE WHEN doc_id IS NULL THEN 1 ELSE list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))) END AS crc
  FROM documents),
fields AS (
  SELECT rid, doc_id, crc, CASE WHEN source IS NULL THEN '' ELSE '.' || source END AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
    coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS cut
  FROM base),
leaves AS (
  SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND (4294967295 - crc) % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen
  FROM fields),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
climb AS (
  SELECT tree, 0 AS level, pos, n, leaf AS hash FROM ranked
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM climb WHERE n > 1 GROUP BY tree, level, pos // 3, n),
heads AS (
  SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM climb WHERE n = 1),
trunk AS (
  SELECT 0 AS level, pos, n, hash FROM heads
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM trunk WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (
  SELECT tree, level, pos, n, hash FROM climb UNION ALL SELECT NULL, level, pos, n, hash FROM trunk),
sides AS (
  SELECT a.tree, a.level, a.pos,
    coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY ALL),
walk AS (
  SELECT rid, tree AS home, tree, 0 AS level, pos, seen AS folded, '' AS proof, 0 AS steps FROM ranked
  UNION ALL
  SELECT w.rid, w.home, CASE WHEN s.pos IS NULL THEN NULL ELSE w.tree END, CASE WHEN s.pos IS NULL THEN 0 ELSE w.level + 1 END,
    CASE WHEN s.pos IS NULL THEN h.pos ELSE w.pos // 3 END,
    CASE WHEN s.pos IS NULL THEN w.folded ELSE sha256(s.before || w.folded || s.after) END,
    w.proof || coalesce(s.before || s.after, ''), w.steps + 1
  FROM walk w LEFT JOIN sides s ON w.tree IS NOT DISTINCT FROM s.tree AND w.level = s.level AND w.pos = s.pos
  JOIN heads h ON h.tree = w.home
  WHERE s.pos IS NOT NULL OR w.tree IS NOT NULL),
ends AS (
  SELECT rid, arg_max(folded, steps) AS folded_root, arg_max(proof, steps) AS proof FROM walk GROUP BY rid)
SELECT r.doc_id, r.leaf, h.hash AS subroot, t.hash AS root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = t.hash AS verified
FROM ranked r JOIN ends e USING (rid) JOIN heads h ON h.tree = r.tree JOIN (SELECT hash FROM trunk WHERE n = 1) t ON true
"""
