"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib

from pyspark.sql import functions as F

from vigilake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row, lower=False):
    text = row[1]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return H("".join(map(framed, (row[0], row[3], row[2], row[4], text))))


def tree(leaves):
    """Root and the siblings of each leaf, level by level: (left, right)."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k in range(len(leaves)):
            run = at[k] // 16 * 16
            proofs[k].append(("".join(nodes[run : at[k]]), "".join(nodes[at[k] + 1 : run + 16])))
        at = [x // 16 for x in at]
        nodes = [H("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    lower = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        lower[name] = (own, *tree([leaf_of(r) for r in own]))
    root, upper = tree([lower[x][1] for x in names])
    out = []
    for name, above in zip(names, upper, strict=True):
        own, subroot, proofs = lower[name]
        for row, proof in zip(own, proofs, strict=True):
            steps = proof + above
            told = leaf_of(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0)
            for left, right in steps:
                told = H(left + told + right)
            out.append((row[0], leaf_of(row), subroot, root, H("".join(a + b for a, b in steps)), told, told == root))
    return sorted(out, key=str)


def ran(spark, tmp_path, rows, more=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in more:
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_against_brute_force(spark, tmp_path):
    """One source larger than a block and one just beyond a run, one of one row, nulls in every column, repeated rows and ids, an empty and a very long text."""
    rows = [(k, f"Text {k}", "en", "hot", k) for k in range(merkle.BLOCK + 40)]
    rows += [(k, f"Über Ä {k}", None, "small", None) for k in range(17)] + [(5, "lone", "de", "", 4)]
    rows += [(None, None, None, None, None)] * 2 + [(None, "A", "en", "small", 1), (7, "", "en", None, 0), (7, "", "en", None, 0), (7, "Other", "en", None, 5), (-3, "Long text " * 200_000, "fr", "é", 9)]
    got = ran(spark, tmp_path, rows, ("leaf", "tree", "pos", "n", "block", "digest", "carry_0", "_range", "root"))
    assert got == brute(rows)
    assert {x[-1] for x in got} == {True, False}


def test_few_rows(spark, tmp_path):
    for k, rows in enumerate(([(1, "One", "en", "a", 3)], [(1, "One", "en", "a", 3), (2, "two", "en", "b", 3)], [(k, "X", "en", "a", 1) for k in range(3)], [(k, "X", "en", f"s{k}", 1) for k in range(20)])):
        assert ran(spark, tmp_path / str(k), rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert ran(spark, tmp_path, []) == []


def test_heights():
    assert [merkle.height(n) for n in (1, 2, 16, 17, 256, 257)] == [0, 1, 1, 2, 2, 3]
    proofs = [[] for _ in range(17)]
    leaves = [H(str(k)) for k in range(17)]
    assert (merkle.walk(leaves, 2, proofs), proofs) == tree(leaves)
