"""Merkle manifest of a table: digests of rows, of groups and of the whole, with the proof of each row.

Method: recursive traversal of blocks in postorder. The leaves of a group, in order, are cut into aligned blocks of ARITY ** LEVELS; a task walks a block's tree
recursively, and while it unwinds it returns the digest of each subtree and appends to the proof of every leaf below what stands beside it. Blocks are aligned with the
tree, so their roots are its nodes of a higher level: they are the leaves of the next traversal, until each group has one root; the groups' roots then go the same way.
A second walk hands the proofs down: a block gets the proof of its own root from the traversal above, and each of its leaves has that after its own.

Only digests travel, never texts. No task holds more than a block, however many rows a group has; places within groups come from ranges, so no task sorts a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import shared_checkpoint, table
from vigilake.operators.queue import placed

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PROOF = "array<struct<left string, right string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenation."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A field so that neighbours can't run into each other: `-` if null, else its length in bytes, `:` and the value."""
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*(framed(x) for x in values))


def height(n: int) -> int:
    """Levels above n leaves: none above one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def walk(digests: Sequence[str], levels: int, proofs: list[list[tuple[str, str]]] | None = None) -> str:
    """The root of a block that is so many levels high. If proofs are given, one list for each leaf, (left, right) of each level is appended to them."""
    n = len(digests)

    def visit(at: int, level: int) -> str:
        if level == 0:
            return digests[at]
        width = ARITY ** (level - 1)
        starts = range(at, min(at + ARITY * width, n), width)
        parts = [visit(start, level - 1) for start in starts]
        if proofs is not None:
            for k, start in enumerate(starts):
                beside = ("".join(parts[:k]), "".join(parts[k + 1 :]))
                for leaf in range(start, min(start + width, n)):
                    proofs[leaf].append(beside)
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    return visit(0, levels)


def _in_order(block: pa.Table) -> tuple[pa.Table, int]:
    """A block's leaves by place, and how high its tree is: whole blocks of a larger tree have all levels, also the last one with few leaves."""
    block = block.sort_by("pos")
    n = block.column("n")[0].as_py()
    return block, LEVELS if n > BLOCK else height(n)


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, pos, digest, n) of the blocks' roots, from nodes with the same columns; n is the number of nodes that the whole tree has at that level."""

    def go(key: tuple, block: pa.Table) -> pa.Table:
        block, levels = _in_order(block)
        root = walk(block.column("digest").to_pylist(), levels)
        n = -(-block.column("n")[0].as_py() // BLOCK)
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [root], "n": [n]}, schema=pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]))

    return _blocks(nodes.select("tree", "pos", "digest", "n")).groupBy("tree", "block").applyInArrow(go, "tree string, pos long, digest string, n long")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their blocks' roots, the roots of those and so on, until every tree has one."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(shared_checkpoint(roots(levels[-1])))
        most = -(-most // BLOCK)
    return levels


def hand_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's rows with (proof, subroot, root), given tops: (tree, proof, subroot, root) of each tree's root."""
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    kinds = pa.schema([("proof", _PATH), ("subroot", pa.string()), ("root", pa.string())])

    def go(block: pa.Table, upper: pa.Table) -> pa.Table:
        block, levels = _in_order(block)
        proofs: list[list[tuple[str, str]]] = [[] for _ in range(block.num_rows)]
        walk(block.column("digest").to_pylist(), levels, proofs)
        rest = [(x["left"], x["right"]) for x in upper.column("proof")[0].as_py()]
        more = [pa.array([x + rest for x in proofs], _PATH), *(pa.array([upper.column(name)[0].as_py()] * block.num_rows, pa.string()) for name in ("subroot", "root"))]
        out = block.drop_columns(["block"])
        for field, column in zip(kinds, more, strict=True):
            out = out.append_column(field, column)
        return out

    for nodes in reversed(levels[:-1] or levels):
        keep = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in nodes.schema.fields)
        upper = above.select("tree", "pos", "proof", "subroot", "root")
        above = _blocks(nodes).groupBy("tree", "block").cogroup(upper.groupBy("tree", "pos")).applyInArrow(go, f"{keep}, proof {_PROOF}, subroot string, root string")
    return above


def _placed_nodes(rows: DataFrame, order: list) -> DataFrame:
    """Rows (tree, digest, …) with pos, from 0, in their tree, and n, the size of the tree."""
    at = placed(rows, [F.col("tree")], order, "pos").withColumn("pos", F.col("pos") - 1)
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n"))
    return at.join(sizes, "tree")


def manifest(df: DataFrame, leaf: Column, order: Column, group: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """(leaf, subroot, root, proof) and carried columns, a row for each row of df.

    leaf: the digest of a row; order: its order in its group, ties by digest (null first); group: a text, null being a group of its own and the first one. proof: for each
    level from the leaf to the root what stands left and right of the row's node in its run, as concatenated digests; a node without siblings has two empty texts.
    Rows that are equal in order and digest are leaves each. An empty table gives no rows. Texts of any length: only their digests travel.
    """
    carry = carry or {}
    given = df.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("tree"), leaf.alias("digest"), order.alias("_order"), *(x.alias(f"carry_{k}") for k, x in enumerate(carry.values())))
    leaves = _placed_nodes(shared_checkpoint(given), [F.asc_nulls_first("_order"), F.col("digest")]).drop("_order")
    lower = climb(leaves)
    subroots = lower[-1].where("n = 1").select("tree", "digest")
    top = subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("source"))
    upper = climb(_placed_nodes(top, [F.col("source")]))
    root = upper[-1].select(F.lit("").alias("tree"), F.array().cast(_PROOF).alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    if len(upper) == 1:  # one group: its root is the root of all
        tops = upper[0].select(F.col("source").alias("tree"), F.array().cast(_PROOF).alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    else:
        tops = hand_down(upper, root).select(F.col("source").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    if len(lower) == 1:  # every group is one leaf
        told = leaves.join(tops, "tree")
    else:
        told = hand_down(lower, tops)
    return told.select(F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"carry_{k}").alias(name) for k, name in enumerate(carry)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, x: digest(x["left"], acc, x["right"]))


def proof_digest(proof: Column) -> Column:
    """Of all siblings, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda x: F.array(x["left"], x["right"]))), ""), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of all documents, a fifth of them tampered with: their texts lower-cased, if they have A-Z.

    A null id isn't tampered with and is the first of its source; a null in another column is hashed as `-`.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    column = {x: F.col(x) for x in FIELDS}
    changed = leaf_digest(*(F.translate("text", UPPER, LOWER) if x == "text" else column[x] for x in FIELDS))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    told = manifest(docs, leaf_digest(*column.values()), column["doc_id"], column["source"], {"doc_id": column["doc_id"], "tampered": tampered})
    found = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = told.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB: nodes of all levels by a recursive CTE, a leaf's siblings by a join, the way up by a fold.
OP12_SQL = r"""
WITH RECURSIVE framed AS (
    SELECT doc_id, source, text, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
        list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
leaves AS (
    SELECT *, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM framed),
placed AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (
    SELECT tree, 0 AS level, pos, leaf AS h FROM placed
    UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, level, pos // 16),
tops AS (SELECT tree, max_by(h, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low GROUP BY tree),
high AS (
    SELECT 0 AS level, pos, subroot AS h FROM tops
    UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, pos // 16),
below AS (
    SELECT p.tree, p.pos, s.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < p.pos // (16 ** s.level)::BIGINT), '') AS l,
        coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > p.pos // (16 ** s.level)::BIGINT), '') AS r
    FROM placed p JOIN low s ON s.tree = p.tree AND s.pos // 16 = p.pos // (16 ** (s.level + 1))::BIGINT JOIN (SELECT tree, max(level) AS height FROM low GROUP BY tree) t ON t.tree = p.tree AND s.level < t.height
    GROUP BY p.tree, p.pos, s.level),
above AS (
    SELECT p.tree, s.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < p.pos // (16 ** s.level)::BIGINT), '') AS l,
        coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > p.pos // (16 ** s.level)::BIGINT), '') AS r
    FROM tops p JOIN high s ON s.pos // 16 = p.pos // (16 ** (s.level + 1))::BIGINT AND s.level < (SELECT max(level) FROM high) GROUP BY p.tree, p.pos, s.level),
proofs AS (
    SELECT p.doc_id, p.leaf, p.tampered, t.subroot, (SELECT max_by(h, level) FROM high) AS root,
        list_concat(coalesce((SELECT list({'l': l, 'r': r, 'own': ''} ORDER BY level) FROM below b WHERE b.tree = p.tree AND b.pos = p.pos), []),
            coalesce((SELECT list({'l': l, 'r': r, 'own': ''} ORDER BY level) FROM above a WHERE a.tree = p.tree), [])) AS steps FROM placed p JOIN tops t ON t.tree = p.tree),
told AS (
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.l || x.r), '')) AS proof_sha256,
        list_reduce(list_prepend({'l': '', 'r': '', 'own': coalesce(tampered, leaf)}, steps), lambda a, x: {'l': '', 'r': '', 'own': sha256(x.l || a.own || x.r)}).own AS folded_root FROM proofs)
SELECT *, folded_root = root AS verified FROM told
"""
