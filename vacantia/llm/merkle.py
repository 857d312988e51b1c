"""Merkle manifest of a data set: one binary hash tree per group of rows, one over the groups.

Leaves of a group are numbered in their order. Every aligned run of ``2**height`` numbers is a block: its subtree is stored as one
array of digests in van Emde Boas layout (a subtree of L levels is split at half height into an upper subtree of L // 2 levels and
lower ones, each stored together, and so on). ``address`` computes the place of a node from its depth and number in a few steps of
arithmetic; building and the look-up of siblings both go through it, and no pointers are kept. The roots of the blocks are the
leaves of the next tier, until a group has one root; the group roots, in group order, form a tree of the same kind.

Whatever the number of rows, a task holds one block at a time; a group with a third of all rows is many blocks. Rows get their
numbers by a range-partitioned sort with partition offsets. Proofs go down the tiers: a block passes to each of its nodes the
siblings inside it and all above it, so the rows of a block meet one row of proof.

Nodes hash the concatenated hexadecimal digests of their two children, or of the last one alone; a tree of one leaf is that leaf.
A path is 33 bytes per level: 1 (sibling to the right), 2 (to the left) or 0 (none), and the sibling's digest.

Defined results: null values hash as ``-``; rows of null groups form a group of their own, which stands first, as do rows without an id
inside theirs. Rows of equal group and id stand in the order of their digests; equal rows are leaves of their own and may trade
places. Empty tables give empty tables. Texts are hashed whole. Other columns are ignored."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import append, pick, table
from vacantia.operators.positions import with_position
from vacantia.session import cut

#: Levels below a block's root; a block has up to 2**HEIGHT leaves.
HEIGHT = 8
STEP = 33  # bytes of one level of a path

c = F.col


# --- van Emde Boas layout ---------------------------------------------------------------------------

def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` (0 from the left) at ``depth`` (0 is the root) in a subtree of ``levels`` levels."""
    index = np.asarray(index, dtype=np.int64)
    at = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth -= upper
        levels -= upper
        at = at + ((1 << upper) - 1) + (index >> depth) * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return at


def height_of(n: int, most: int = HEIGHT) -> int:
    """Levels below the root of a block whose tree has ``n`` leaves at this tier."""
    return min(most, (n - 1).bit_length())


def build_block(digests: bytes, height: int) -> np.ndarray:
    """The subtree over ``digests`` (32 bytes each, at most 2**height of them) as rows of 32 bytes in layout order."""
    levels, n = height + 1, len(digests) // 32
    nodes = np.zeros(((1 << levels) - 1, 32), np.uint8)
    nodes[address(levels, height, np.arange(n))] = np.frombuffer(digests, np.uint8).reshape(n, 32)
    for depth in range(height - 1, -1, -1):
        below = nodes[address(levels, depth + 1, np.arange(n))].tobytes().hex().encode()
        n = (n + 1) // 2
        made = b"".join(hashlib.sha256(below[128 * j : 128 * j + 128]).digest() for j in range(n))
        nodes[address(levels, depth, np.arange(n))] = np.frombuffer(made, np.uint8).reshape(n, 32)
    return nodes


def block_paths(nodes: np.ndarray, height: int, n: int) -> np.ndarray:
    """Paths inside a block for its ``n`` leaves: one row of ``height * STEP`` bytes each."""
    out = np.zeros((n, height, STEP), np.uint8)
    at = np.arange(n)
    for k in range(height):
        beside = at ^ 1
        has = beside < -(-n >> k)
        out[has, k, 0] = 1 + (at[has] & 1)
        out[has, k, 1:] = nodes[address(height + 1, height - k, beside[has])]
        at = at >> 1
    return out.reshape(n, height * STEP)


def fold(digest: str, path: bytes) -> str:
    """The root that ``digest`` leads to along ``path``."""
    for k in range(0, len(path), STEP):
        side, beside = path[k], path[k + 1 : k + STEP].hex()
        digest = hashlib.sha256((digest + beside if side == 1 else beside + digest if side == 2 else digest).encode()).hexdigest()
    return digest


def proof_text(path: bytes) -> str:
    """The siblings of a path as concatenated hexadecimal digests, from the leaf to the root."""
    return "".join(path[k + 1 : k + STEP].hex() for k in range(0, len(path), STEP) if path[k])


# --- tiers of blocks ----------------------------------------------------------------------------------

@dataclass
class Manifest:
    """``tiers``: block tables from the leaves up (tree, block, n, m, nodes, root; tier 0 also ``members``); ``crown``: the same over
    the group roots; ``trees``: tree, place, subroot, path (above the subroot); ``root``: of all; ``height``: levels below a full block's root."""

    height: int
    tiers: list[DataFrame]
    crown: list[DataFrame]
    trees: DataFrame
    root: str | None

    def stored(self) -> DataFrame:
        """All blocks as one table to keep: part ('tree' or 'crown'), tier, tree, block, n, m, nodes."""
        frames = [df.select(F.lit(part).alias("part"), F.lit(i).alias("tier"), "tree", "block", "n", "m", "nodes")
                  for part, tiers in (("tree", self.tiers), ("crown", self.crown)) for i, df in enumerate(tiers)]
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out


def _blocks(nodes: DataFrame, height: int, *extra: str) -> DataFrame:
    """Blocks over ``nodes`` (tree, i, n, leaf, extra): at most 2**height members are gathered for each."""
    grouped = nodes.groupBy("tree", F.shiftright("i", height).alias("block"), "n").agg(
        F.array_sort(F.collect_list(F.struct("i", "leaf", *extra))).alias("members")).withColumn("m", F.size("members"))

    def build(batch: pa.RecordBatch) -> list:
        members = batch.column("members")
        ends, digests = members.offsets.to_pylist(), members.values.field("leaf").to_pylist()
        trees = [build_block(bytes.fromhex("".join(digests[a:b])), height_of(n, height)) for a, b, n in zip(ends, ends[1:], batch.column("n").to_pylist())]
        return [[t.tobytes() for t in trees], [t[0].tobytes().hex() for t in trees]]  # the root is first in the layout

    made = append(grouped, "nodes binary, root string", build)
    return cut(made if extra else made.drop("members"))


def _tiers(nodes: DataFrame, most: int, height: int, *extra: str) -> tuple[list[DataFrame], DataFrame]:
    """Block tables up to single roots, and (tree, root). ``most``: leaves of the largest tree."""
    tiers, roots, width = [], None, 1 << height
    while True:
        blocks = _blocks(nodes, height, *(extra if not tiers else ()))
        tiers.append(blocks)
        done = blocks.where(c("n") <= width).select("tree", "root")
        roots = done if roots is None else roots.unionByName(done)
        if most <= width:
            return tiers, roots
        nodes = blocks.where(c("n") > width).select(
            "tree", c("block").alias("i"), F.shiftright(c("n") + width - 1, height).alias("n"), c("root").alias("leaf"))
        most = -(-most // width)


def _node_paths(blocks: DataFrame, height: int) -> DataFrame:
    """(tree, i, path, subroot) for every leaf of the given blocks, which carry the path ``above`` them and the root of their tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("tree", "block", "n", "m", "nodes", "above", "subroot"))
            for tree, block, n, m, nodes, above, subroot in zip(*columns):
                inside = block_paths(np.frombuffer(nodes, np.uint8).reshape(-1, 32), height_of(n, height), m)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, tree)), pa.array(np.arange(m) + (block << height)), pa.array([row.tobytes() + above for row in inside], pa.binary()),
                    pa.array([subroot] * m, pa.string())], names=["tree", "i", "path", "subroot"])

    return blocks.select("tree", "block", "n", "m", "nodes", "above", "subroot").mapInArrow(run, "tree long, i long, path binary, subroot string")


def _with_above(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The blocks of the lowest tier with the path ``above`` each and the root of its tree; ``tops``: tree, subroot, path above it.

    Both come down block by block, so that no join has the tree alone as its key."""
    above = None  # of the blocks of the tier at hand, from the tier over it
    for blocks in reversed(tiers):
        top = tops.join(blocks.where(c("n") <= 1 << height).select("tree", "block"), "tree").select("tree", "block", c("path").alias("above"), "subroot")
        above = top if above is None else above.unionByName(top)
        joined = blocks.join(above, ["tree", "block"])
        above = _node_paths(joined, height).select("tree", c("i").alias("block"), c("path").alias("above"), "subroot")
    return joined


def manifest(rows: DataFrame, group: str, order: str, digest: str, *extra: str, height: int = HEIGHT) -> Manifest:
    """The manifest of ``rows`` by ``group``, whose leaves ascend by ``order``; ``extra`` columns stay with the members of tier 0."""
    rows = rows.select(c(f"`{group}`").alias("_group"), c(f"`{order}`").alias("_order"), c(f"`{digest}`").alias("leaf"),
                       *[c(f"`{x}`").alias(f"_x{k}") for k, x in enumerate(extra)], F.monotonically_increasing_id().alias("_salt"))
    placed = with_position(rows, [c("_group").asc_nulls_first(), c("_order").asc_nulls_first(), c("leaf"), c("_salt")], "place")
    # a group is named by the place of its first row, so that names ascend with the groups
    groups = cut(placed.groupBy("_group").agg((F.min("place") - 1).alias("tree"), F.count(F.lit(1)).alias("n")))
    most, many = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    named = groups.withColumnRenamed("_group", "_of")
    leaves = placed.join(named, c("_group").eqNullSafe(c("_of"))).withColumn("i", c("place") - 1 - c("tree"))
    names = [f"_x{k}" for k in range(len(extra))]
    tiers, roots = _tiers(leaves.select("tree", "i", "n", "leaf", *names), most or 0, height, *names)
    subroots = cut(with_position(roots, [c("tree")], "place"))
    crown, top = _tiers(subroots.select(F.lit(0).cast("bigint").alias("tree"), (c("place") - 1).alias("i"), F.lit(many).alias("n"), c("root").alias("leaf")), many, height)
    paths = _node_paths(_with_above(crown, top.select("tree", F.lit(b"").alias("path"), F.lit("").alias("subroot")), height), height)
    trees = subroots.withColumnRenamed("root", "subroot").join(paths.select((c("i") + 1).alias("place"), "path"), "place")
    whole = top.first()  # one digest
    return Manifest(height, tiers, crown, cut(trees), whole["root"] if whole else None)


def prove(made: Manifest) -> DataFrame:
    """Blocks of leaves with all that a proof needs besides the root: members, nodes, above, subroot."""
    return _with_above(made.tiers, made.trees.select("tree", "path", "subroot"), made.height)


# --- documents ---------------------------------------------------------------------------------------

def field(x: Column) -> Column:
    """A value with its length before it, so that neighbours can't run together."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def audit(made: Manifest) -> DataFrame:
    """Each member (doc_id, leaf, and ``now``: the digest its row has today) held against the manifest."""
    height, root = made.height, made.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("members", "n", "m", "nodes", "above", "subroot"))
            for members, n, m, nodes, above, subroot in zip(*columns):
                inside = block_paths(np.frombuffer(nodes, np.uint8).reshape(-1, 32), height_of(n, height), m)
                paths = [row.tobytes() + above for row in inside]
                folded = [fold(x["_x1"], p) for x, p in zip(members, paths)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["_x0"] for x in members], pa.int64()), pa.array([x["leaf"] for x in members]), pa.array([subroot] * m), pa.array([root] * m),
                    pa.array([hashlib.sha256(proof_text(p).encode()).hexdigest() for p in paths]), pa.array(folded), pa.array([f == root for f in folded])],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return prove(made).select("members", "n", "m", "nodes", "above", "subroot").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = pick(table(spark, sf, "documents"), doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    tampered = F.crc32(c("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = row_digest(*[c(x) for x in ("doc_id", "source", "lang", "n_chars", "text")])
    other = row_digest(c("doc_id"), c("source"), c("lang"), c("n_chars") + 1, c("text"))
    rows = docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(tampered & c("n_chars").isNotNull(), other).alias("other"))
    rows = rows.select("lang", "doc_id", "leaf", F.coalesce("other", "leaf").alias("now"))
    return audit(manifest(rows, "lang", "doc_id", "leaf", "doc_id", "now"))


def _field_sql(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _row_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_STEPS_SQL = ", ".join(["-1"] * 8)
SQL = f"""WITH RECURSIVE rows_in AS (SELECT doc_id, lang, {_row_sql('n_chars')} AS leaf, {_row_sql('n_chars + 1')} AS other, n_chars,
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [ascii(d)::BIGINT, {_STEPS_SQL}]))) AS bits FROM documents),
marked AS (SELECT *, xor(list_reduce(bits, lambda v, s: CASE WHEN s >= 0 THEN xor(v, s) ELSE xor(v >> 1, (v & 1) * 3988292384) END), 4294967295) % 7 = 0 AS bad FROM rows_in),
leaves AS (SELECT doc_id, lang, leaf, CASE WHEN bad AND n_chars IS NOT NULL THEN other ELSE leaf END AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM marked),
levels AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY i) AS hs FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda k: sha256(hs[2 * k + 1] || coalesce(hs[2 * k + 2], ''))) FROM levels WHERE len(hs) > 1),
subroots AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(hs) = 1),
crown AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS hs FROM subroots
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda k: sha256(hs[2 * k + 1] || coalesce(hs[2 * k + 2], ''))) FROM crown WHERE len(hs) > 1),
walk AS (
  SELECT doc_id, lang, i, leaf, 0 AS lvl, i AS at, '' AS proof, now AS folded FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.i, w.leaf, w.lvl + 1, w.at // 2, w.proof || coalesce(hs[xor(w.at, 1) + 1], ''),
    sha256(CASE WHEN w.at % 2 = 0 THEN w.folded || coalesce(hs[w.at + 2], '') ELSE hs[w.at] || w.folded END)
  FROM walk w JOIN levels l ON l.lang IS NOT DISTINCT FROM w.lang AND l.lvl = w.lvl AND len(l.hs) > 1),
inside AS (SELECT * FROM walk WHERE lvl = (SELECT max(lvl) FROM levels l WHERE l.lang IS NOT DISTINCT FROM walk.lang)),
climb AS (
  SELECT x.doc_id, x.i, x.leaf, s.subroot, 0 AS lvl, s.place AS at, x.proof, x.folded FROM inside x JOIN subroots s ON s.lang IS NOT DISTINCT FROM x.lang
  UNION ALL
  SELECT w.doc_id, w.i, w.leaf, w.subroot, w.lvl + 1, w.at // 2, w.proof || coalesce(hs[xor(w.at, 1) + 1], ''),
    sha256(CASE WHEN w.at % 2 = 0 THEN w.folded || coalesce(hs[w.at + 2], '') ELSE hs[w.at] || w.folded END)
  FROM climb w JOIN crown l ON l.lvl = w.lvl AND len(l.hs) > 1)
SELECT doc_id, leaf, subroot, (SELECT hs[1] FROM crown WHERE len(hs) = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = (SELECT hs[1] FROM crown WHERE len(hs) = 1) AS verified FROM climb WHERE lvl = (SELECT max(lvl) FROM crown)"""

QUERIES = {"op12_merkle": (query, SQL)}
