"""Near-dedup by Order MinHash and banded alignment.

Texts are sequences of lower-cased words. Each run of K words is labelled with how often it has occurred before, so repeats
count. For each of SKETCHES random orders the L smallest labelled runs are taken and kept in text order; two texts share a
sketch only if they hold the same runs in the same order, which follows their edit similarity rather than sets of words.
Texts that share a sketch are candidates. They are verified by an alignment in a band as wide as the threshold allows:
similarity = 1 - edits / words of the longer text, 0.8 or more.

A node is a text, known by 128 bits of hash over its words and, before them, the smallest id that holds it; so equal texts are one
node, two texts that share an id are two, and the smallest node of a class gives its smallest id. First, a sketch that many nodes
share gives each of them one candidate, the smallest node among them; all candidates by sketches of two nodes are verified, and the CENTERS smallest of the others. Verified links are joined to components by alternating
stars. Where a sketch then still holds several components, its members are compared with each other, with their texts at hand: in blocks of
MEMBERS, so a sketch of any size is divided over tasks, and no pairs are listed. Pairs of one component need no comparison,
pairs whose lengths differ too much can't be alike, and texts within e edits share all but q * e of their runs of q words, which counts
of runs, hashed to BUCKETS, bound from above; pairs that pass are aligned, where their first common sketch is held. So the components
are those of all alike pairs that share a sketch. Unlike texts that share a long passage cost comparisons of counts with the square of
their number.

Rows: one for each input row. A text without words is linked to nothing: its class is its own id. A text of under K words is one run.
A null id comes after all others: rows with a null id take part like others, and a class that only such rows hold has a null id. Each row is
classified by its own text, also where rows share an id. Repeated rows stay repeated in near_classes() and are one in near_dedup(). Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from vigilake.llm.common import raw, shared_checkpoint, slim, table, to_arrow
from vigilake.llm.words import plain_words

K = 5
SKETCHES = 32
L = 2
SIMILARITY = 0.8
#: Entries of the table of word hashes on a worker; labelled runs that are hashed for all sketches at once.
WORD_MEMO = 200_000
AT_ONCE = 20_000
#: Rows of a batch that are unpacked at a time.
AT_A_TIME = 500
#: Candidates of a node in the first pass, of sketches of more than two nodes.
CENTERS = 4
#: Runs whose counts bound the edits, buckets of these counts, words beyond which texts are aligned without; members of a sketch in one block.
RUNS, BUCKETS, MOST_WORDS, MEMBERS = (3, 2, 1), 1024, 60_000, 1_000
#: Nodes that are sent to all workers to pick their texts; beyond it they are joined by a shuffle. 25 bytes each.
FEW_NODES = 200_000
NULL_NODE, SOME_NODE, SIGN = b"\x01", b"\x00", 1 << 63


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, 1)
        return value


def spread(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def labelled_runs(words: np.ndarray, k: int, labels: bool = True) -> np.ndarray:
    """A hash for each run of k words, by its words, their order, and its number among equal runs."""
    n = max(1, len(words) - k + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        runs = spread(runs + words[j : j + n] + np.uint64(j + 1))
    if not labels:
        return runs
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if same.any():
        start = np.concatenate(([True], ~same))
        number = np.empty(n, np.uint64)
        at = np.arange(n)
        number[order] = (at - np.maximum.accumulate(np.where(start, at, 0))).astype(np.uint64)
        again = number > 0  # first occurrences keep their hash, so texts with and without repeats agree on them
        runs[again] = spread(runs[again] + number[again] * np.uint64(0x9E3779B97F4A7C15))
    return runs


def sketches(runs: np.ndarray, multipliers: np.ndarray, chosen: int) -> list[int]:
    """A hash for each random order: the `chosen` smallest runs, in text order."""
    chosen = min(chosen, len(runs))
    keys = []
    step = max(1, AT_ONCE * len(multipliers) // len(runs))
    for some in (multipliers[i : i + step] for i in range(0, len(multipliers), step)):
        values = runs[None, :] * some[:, None]
        each = np.arange(len(some))
        picks = []
        for _ in range(chosen):
            picks.append(values.argmin(axis=1))
            values[each, picks[-1]] = np.iinfo(np.uint64).max
        places = np.sort(np.stack(picks, axis=1), axis=1)
        key = some.copy()
        for j in range(chosen):
            key = spread(key + runs[places[:, j]])
        keys += key.astype(np.int64).tolist()
    return keys


def node_of(doc: int | None, words: list[bytes]) -> tuple[bytes, bytes]:
    """(node, digest) of a row: nodes are ordered by id, those without an id last."""
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return (NULL_NODE + b"\xff" * 8 if doc is None else SOME_NODE + (doc + SIGN).to_bytes(8, "big")) + digest, digest


def id_of(node: str) -> Column:
    """The id that a node names, or null."""
    return F.expr(f"CASE WHEN substring({node}, 1, 1) = X'00' THEN CAST(CAST(conv(hex(substring({node}, 2, 8)), 16, 10) AS DECIMAL(20, 0)) - 9223372036854775808BD AS BIGINT) END")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of AT_A_TIME rows, so that few texts are held twice."""
    return (batch.slice(k, AT_A_TIME) for k in range(0, batch.num_rows, AT_A_TIME))


def each_text(docs: DataFrame, schema: str, make: Callable[[], Callable[[int | None, list[bytes], bytes], tuple]], empty: bool = False) -> DataFrame:
    """What a function makes of the id, words and bytes of each text; texts without words are passed to it only if asked for."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, kinds = make(), to_arrow(schema)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True)
            made = [one(doc, words, data or b"") for doc, data in rows if (words := plain_words(data or b"")) or empty]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k.type) for x, k in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], k.type) for k in kinds], schema=kinds)

    return docs.mapInArrow(go, schema)


def signatures(docs: DataFrame, k: int, n: int, chosen: int) -> DataFrame:
    """(node, digest, n_words, keys) of texts with words."""

    def make():
        known, multipliers = WordHashes(), spread(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        return lambda doc, words, _: (*node_of(doc, words), len(words), sketches(labelled_runs(np.array([known[x] for x in words], np.uint64), k), multipliers, chosen))

    return each_text(docs, "node binary,digest binary,n_words long,keys array<long>", make)


def digests(docs: DataFrame) -> DataFrame:
    """(id, node, digest), one row for each document; node and digest are null where a text has no words."""
    return each_text(docs, "id long,node binary,digest binary", lambda: lambda doc, words, _: (doc, *(node_of(doc, words) if words else (None, None))), empty=True)


def packed_nodes(docs: DataFrame) -> DataFrame:
    """(node, text): compressed texts by the node that each row would be; only the first of equal texts is ever asked for."""

    def make():
        packer = zstandard.ZstdCompressor(level=3)
        return lambda doc, words, data: (node_of(doc, words)[0], packer.compress(data))

    return each_text(docs, "node binary,text binary", make)


def only_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose node is among the nodes, which are sent to all workers only if a count finds them few."""
    return rows.join(F.broadcast(nodes) if nodes.limit(FEW_NODES + 1).count() <= FEW_NODES else nodes, "node", "left_semi")


def edits_within(a: list, b: list, most: int) -> int:
    """The edit distance of two sequences, or most + 1 if it is larger. Columns are bit vectors over a band of 2 * most + 1 rows."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) < len(b):
        a, b = b, a
    if not b or not most:
        return min(len(a), most + 1)
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    size = len(a)
    most = min(most, size)
    width = 2 * most + 1
    every = (1 << width) - 1
    up, down, top = every ^ ((1 << most) - 1), 0, 1 << (width - 1)
    edits, give_up, edge = most, 2 * most + len(b) - size, 1 << (width - 2)
    for k, x in enumerate(b):
        here = places.get(x, 0)
        here = (here << (most - k) if k < most else here >> (k - most)) & every
        zero = ((((here & up) + up) ^ up) | here | down) & every
        more = (down | ~(zero | up)) & every
        less = zero & up
        if k < size - most:
            if not zero & top:
                edits += 1
        else:
            if more & edge:
                edits += 1
            elif less & edge:
                edits -= 1
            edge >>= 1
        if edits > give_up:
            return most + 1
        zero >>= 1
        up = (less | ~(zero | more)) & every
        down = zero & more
    return min(edits, most + 1)


def words_of(packed: bytes) -> list[bytes]:
    return plain_words(zstandard.decompress(packed))


def alike(a: list, b: list, similarity: float) -> bool:
    longer = max(len(a), len(b))
    most = int(longer * (1 - similarity) + 1e-9)
    return edits_within(a, b, most) <= most


def verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of rows (a, b, text_a, text_b), compressed texts, those (a, b) whose texts are alike."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            # One pair at a time is unpacked: words take many times the room of the compressed texts.
            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            good = [alike(words_of(x), words_of(y), similarity) for x, y in texts]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(go, "a binary,b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): the smallest node of its component. Large and small stars in turn, until nothing changes."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        roots = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        told = both.join(roots, "a")
        if large:
            return told.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        return told.select("b", "root").toDF("a", "b").union(roots.select("a", F.col("root").alias("b"))).where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = shared_checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(edges)
    while before[0]:
        edges = shared_checkpoint(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.toDF("node", "root")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the root of their node; one without a link is its own."""
    told = roots.toDF("linked", "root")
    return rows.join(told, rows.node == told.linked, "left").select(*rows.columns, F.coalesce("root", "node").alias("root"))


def unresolved(held: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, node, n_words, n, root): members of sketches that several components share. Of two members, both have been compared."""
    told = rooted(held.where("n > 2").select("band", "node", "n_words", "n"), roots)
    several = told.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    return told.join(several, "band", "left_semi")


def counts_of(words: np.ndarray, q: int) -> np.ndarray:
    """How many runs of q words fall into each bucket."""
    return np.minimum(np.bincount((labelled_runs(words, q, False) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 65_535).astype(np.uint16)


def block_links(rows: list[tuple], similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """Links (a, b) between the members of two blocks of a sketch, or of one, that join what no earlier link has joined; rows as in block_pairs()."""
    rows.sort(key=lambda r: r[4])
    known, sizes, cross = WordHashes(), np.array([r[4] for r in rows]), rows[0][1] != rows[0][2]
    counts = {q: np.empty((len(rows), BUCKETS), np.uint16) for q in RUNS}
    for k, row in enumerate(rows):  # texts stay packed: a block of long ones wouldn't fit in memory
        hashed = np.array([known[x] for x in words_of(row[8])], np.uint64)
        for q in RUNS:
            counts[q][k] = counts_of(hashed, q)
    sides, (roots, of) = np.array([r[3] for r in rows]), np.unique(np.array([r[5] for r in rows], object), return_inverse=True)
    joined = np.arange(len(roots))
    ends = np.searchsorted(sizes, sizes / similarity + 1e-6, "right")
    for k, end in enumerate(ends.tolist()):
        some = np.arange(k + 1, end)
        some = some[(joined[of[some]] != joined[of[k]]) & (sides[some] != sides[k] if cross else True)]
        for q in RUNS:
            if len(some):
                least = sizes[some] + 1 - q - q * np.floor(sizes[some] * (1 - similarity) + 1e-9)
                shared = np.concatenate([np.minimum(counts[q][x], counts[q][k]).sum(axis=1, dtype=np.int64) for x in np.array_split(some, 1 + len(some) // 512)])
                some = some[(shared >= least) | (sizes[some] > MOST_WORDS)]
        own = words_of(rows[k][8]) if len(some) else []
        for m in some.tolist():
            if joined[of[m]] != joined[of[k]] and min(set(rows[m][7]) & set(rows[k][7])) == rows[k][0] and alike(words_of(rows[m][8]), own, similarity):
                joined[joined == joined[of[m]]] = joined[of[k]]
                yield rows[m][6], rows[k][6]


def block_pairs(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) between members of different components, over rows (band, node, n_words, n, root) and (node, text).

    A band's members are dealt to blocks of about MEMBERS; each pair of blocks meets in one group.
    """
    bands = members.groupBy("node").agg(F.collect_set("band").alias("bands"))
    blocks = F.ceil(F.col("n") / MEMBERS)
    own = members.join(bands, "node").join(texts, "node").withColumn("own", F.pmod(F.xxhash64("node", "band"), blocks))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "n_words", "root", "node", "bands", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds = to_arrow("a binary,b binary")

        def links(rows: list[tuple]) -> pa.RecordBatch:
            found = list(block_links(rows, similarity))
            return pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [x for _, x in found]}, schema=kinds)

        for batch in (part for whole in batches for part in slices(whole)):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    return met.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(go, "a binary,b binary")


def near_links(docs: DataFrame, k: int, n_sketches: int, chosen: int, similarity: float) -> DataFrame:
    """(node, root) of all nodes that have a link, over rows (id, text)."""
    classes = shared_checkpoint(signatures(docs, k, n_sketches, chosen).groupBy("digest").agg(F.min("node").alias("node"), F.any_value("n_words").alias("n_words"), F.any_value("keys").alias("keys")))
    bands = classes.select("node", "n_words", F.explode("keys").alias("band"))
    centers = bands.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("other"), F.count("*").alias("n")).where("center <> other").drop("other")
    held = shared_checkpoint(bands.join(centers, "band").select("band", "node", "n_words", "center", "n"))
    texts = packed_nodes(docs)

    def links(pairs: DataFrame) -> DataFrame:
        asked = shared_checkpoint(pairs)
        some = only_nodes(texts, asked.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return verified(asked.join(some.toDF("a", "text_a"), "a").join(some.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b"), similarity)

    # A node's few smallest candidates join most of a class; what they leave apart is compared below, but for sketches of two nodes, whose one pair is compared here.
    some, pair = F.collect_set(F.when(F.col("n") > 2, F.col("center"))), F.collect_set(F.when(F.col("n") == 2, F.col("center")))
    few = held.where("node <> center").groupBy(F.col("node").alias("a")).agg(F.array_union(F.slice(F.array_sort(some), 1, CENTERS), pair).alias("b"))
    roots = components(links(few.select("a", F.explode("b").alias("b"))))
    members = shared_checkpoint(unresolved(held, roots))
    if not members.isEmpty():
        some = only_nodes(texts, members.select("node").distinct()).dropDuplicates(["node"])
        roots = components(block_pairs(members, some, similarity).union(roots))
    return roots


def classified(docs: DataFrame, k: int, n_sketches: int, chosen: int, similarity: float) -> DataFrame:
    """(id, node, first, root) of rows (id, text): the row as a node, the node of its text, the smallest node of its class. Null without words."""
    roots = near_links(docs, k, n_sketches, chosen, similarity)
    said = digests(docs)
    named = rooted(said.where("digest IS NOT NULL").groupBy("digest").agg(F.min("node").alias("node")), roots).withColumnRenamed("node", "first")
    return said.join(named, "digest", "left").select("id", "node", "first", "root")


def near_classes(df: DataFrame, *, k: int = K, n_sketches: int = SKETCHES, chosen: int = L, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy_of, class_id, kept): for each row the smallest id with an equal text, the smallest id of its class, and whether it is the row that stands for the class."""
    told = classified(slim(df, id_col, text_col), k, n_sketches, chosen, similarity)
    own = F.col("node").isNull()
    return told.select(
        F.col("id").alias(id_col), F.when(own, F.col("id")).otherwise(id_of("first")).alias("copy_of"), F.when(own, F.col("id")).otherwise(id_of("root")).alias("class_id"),
        (own | (F.col("node") == F.col("root"))).alias("kept"),
    )


def near_dedup(df: DataFrame, *, k: int = K, n_sketches: int = SKETCHES, chosen: int = L, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id. Rows without words stay; of rows equal in id and text one stays."""
    docs = slim(df, id_col, text_col)
    roots = near_links(docs, k, n_sketches, chosen, similarity)
    said = digests(docs).where("node IS NOT NULL")
    first = rooted(said.groupBy("digest").agg(F.min("node").alias("node")), roots)
    stay = first.where("node = root").select("node")

    at_id, at_text = (df.columns.index(x) for x in (id_col, text_col))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = zip(batch.column(at_id).cast(pa.int64()).to_pylist(), raw(batch.column(at_text)), strict=True)
                nodes = pa.array([node_of(doc, words)[0] if (words := plain_words(data or b"")) else None for doc, data in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, "_node"])

    marked = df.mapInArrow(mark, StructType([*df.schema.fields, StructField("_node", BinaryType())]))
    kept = marked.join(stay.withColumnRenamed("node", "_node"), "_node", "left_semi").dropDuplicates(["_node"])
    return kept.unionByName(marked.where("_node IS NULL")).select(*(F.col(f"`{x}`") for x in df.columns))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
