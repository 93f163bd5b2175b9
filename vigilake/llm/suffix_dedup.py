"""Exact removal of repeated passages by prefix-partitioned suffix trees.

The suffixes are those of word sequences, cut at `size` words, so a node at that depth stands for one window of
`size` words, and its leaves are the places where the window stands. A word is removed if a window that covers it
also starts in a document with a smaller id.

A suffix belongs to the tree only if something like it stands elsewhere. Of each window the smallest hash of its ANCHOR-word runs is taken; equal windows have
equal smallest runs, and neighbouring windows mostly share theirs, so few runs travel. Suffixes whose run no other document holds are dropped: they can't lead
to a node of two documents.

The rest are split by prefixes of variable length: a suffix goes to the group of its first ANCHOR words; where a count finds a group larger than
PART_SUFFIXES, its suffixes go by twice as many words instead, and where that is still too many, by all `size` words. A group of the last kind holds
equal windows, of which every block of texts sends one. So a group fits in memory, however frequent a short passage is. Each group's suffixes are sorted
into a tree: neighbours share a prefix, and the runs of neighbours that share `size` words are its deep internal nodes. Each such node names its smallest document; the other leaves
are removed, and consecutive starts are joined to maximal repeats. Within a task's block of texts the same is done first, so only the smallest document of a block travels.

Prefixes are known by hashes: polynomials of 64 bits over random 64-bit word hashes. Nodes compare the prefix of ANCHOR words and that of `size` words; a false match needs
both to agree. The order of siblings in the tree is that of their hashes.

Rows: one for each input row. A null or empty text has no words, and texts under `size` words lose none. A null id counts as
larger than any other id, so such rows lose what any other document holds. Rows that share an id are one document: windows
in another row of the same id don't count as earlier, and each row loses its own words (rows are told apart by id and text).
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import raw, shared_checkpoint, slim, table, to_arrow
from vigilake.llm.pieces import by_part, groups, pack, parts_of, unpack

SIZE = 50
ANCHOR = 16
#: Words whose windows a task compares among themselves before anything travels.
BLOCK_WORDS = 1_000_000
#: Bytes of all texts for each part of the tree, and the least number of parts.
PART_BYTES = 4_000_000
LEAST_PARTS = 512
#: Suffixes of a group beyond which its prefix grows.
PART_SUFFIXES = 2_000_000
#: Entries of the table of word hashes on a worker.
WORD_MEMO = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NULL_ID = (1 << 63) - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, 20)
        return value


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Rolling:
    """Hashes of runs of words. Tables of powers grow with the longest text seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, words: np.ndarray) -> np.ndarray:
        if len(words) + 1 > len(self.up):
            n = 2 * len(words) + 1
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, size: int) -> np.ndarray:
        """A hash for each run of `size` words. The last steps spread the bits, as smallest values are asked for."""
        n = len(sums) - size
        out = (sums[size:] - sums[:n]) * self.down[:n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each `size` consecutive values, by minima from both ends of blocks of that size."""
    n = len(values)
    padded = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, size)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - size + 1], left[size - 1 : n])


def spans_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False]))))
    return edges[::2], edges[1::2]


def hashes_of(data: bytes, known: WordHashes) -> np.ndarray:
    return np.array([known[x] for x in data.split()], np.uint64)


PIECES = "part long,id long,key long,data binary"


def anchors_of(docs: DataFrame, size: int, anchor: int, block_words: int, parts: int) -> DataFrame:
    """(id, key, data): of each document the anchors that another document holds too, over rows (id, key, text). Several rows for a document."""

    def flush(block: list) -> Iterator[pa.RecordBatch]:
        """Of anchors that a block holds in one document all travel; of others the block's documents are told, and one mark travels."""
        counts = [len(x) for _, _, x in block]
        runs, of = np.concatenate([x for _, _, x in block]), np.repeat(np.arange(len(block), dtype=np.int32), counts)
        ids, keys = np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], np.int64)
        order = np.lexsort((ids[of], runs))
        at = groups(runs[order])
        several = np.repeat(ids[of[order[at]]] != ids[of[order[np.append(at[1:], len(order)) - 1]]], np.diff(np.append(at, len(order))))
        yield from told(ids, keys, of[order[several]], runs[order[several]])
        first = np.zeros(len(order), bool)
        first[at] = True
        travel = order[~several | first]
        mark = several[~several | first]
        part = (runs[travel] % np.uint64(parts)).astype(np.int64)
        where, data = [], []
        for p, some in by_part(part):
            where.append(p)
            data.append(pack([runs[travel[some]], ids[of[travel[some]]], keys[of[travel[some]]], mark[some]]))
        yield pa.RecordBatch.from_pydict({"part": where, "id": [None] * len(where), "key": [None] * len(where), "data": data}, schema=to_arrow(PIECES))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling, block, n = WordHashes(), Rolling(), [], 0
        for batch in batches:
            for doc, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                words = hashes_of(data or b"", known)
                if len(words) >= size:
                    block.append((doc, key, np.unique(window_minima(rolling.runs(rolling.sums(words), anchor), size - anchor + 1))))
                    n += len(words)
                    if n >= block_words:
                        yield from flush(block)
                        block, n = [], 0
        if block:
            yield from flush(block)

    def resolve(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        runs, ids, keys, mark = (np.concatenate(x) for x in zip(*(unpack(x, (np.uint64, np.int64, np.int64, np.bool_)) for x in held), strict=True))
        order = np.lexsort((ids, runs))
        at = groups(runs[order])
        ends = np.append(at[1:], len(order))
        several = (ids[order[at]] != ids[order[ends - 1]]) | np.logical_or.reduceat(mark[order], at)
        some = order[np.repeat(several, ends - at)]
        some = some[~mark[some]]
        docs, of = np.unique(np.column_stack((ids[some], keys[some])), axis=0, return_inverse=True)
        yield from told(docs[:, 0], docs[:, 1], of.ravel(), runs[some])

    return dealt(docs.mapInArrow(go, PIECES), resolve)


def told(ids: np.ndarray, keys: np.ndarray, of: np.ndarray, runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (null, id, key, data): the runs of each document."""
    if len(of):
        order = np.argsort(of, kind="stable")
        at = groups(of[order])
        data = [x.tobytes() for x in np.split(runs[order], at[1:])]
        docs = of[order[at]]
        yield pa.RecordBatch.from_pydict({"part": [None] * len(at), "id": ids[docs], "key": keys[docs], "data": data}, schema=to_arrow(PIECES))


def dealt(made: DataFrame, resolve: Callable[[list[bytes]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(id, key, data): what is made of all pieces of each part, which come one part after another, and rows without a part as they are."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            if (done := batch.filter(pa.compute.is_null(batch.column(0)))).num_rows:
                yield done
            for part, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if part is not None:
                    if part != of and held:
                        yield from resolve(held)
                        held = []
                    of = part
                    held.append(data)
        if held:
            yield from resolve(held)

    spread = made.repartition(F.coalesce("part", F.xxhash64("id", "key", "data"))).sortWithinPartitions("part")
    return spread.mapInArrow(go, PIECES).select("id", "key", "data")


class Suffixes:
    """The suffixes of some documents that may repeat: hashes of their prefixes of several lengths, their documents and starts."""

    def __init__(self, size: int, anchor: int):
        self.size, self.anchor, self.rolling = size, anchor, Rolling()
        self.clear()

    def clear(self) -> None:
        self.ids, self.keys, self.starts, self.depths, self.words = [], [], [], ([], [], []), 0

    def add(self, doc: int, key: int, words: np.ndarray, anchors: np.ndarray) -> None:
        sums = self.rolling.sums(words)
        runs = self.rolling.runs(sums, self.anchor)
        at = np.flatnonzero(np.isin(window_minima(runs, self.size - self.anchor + 1), anchors))
        self.ids.append(doc)
        self.keys.append(key)
        self.starts.append(at.astype(np.int32))
        for held, depth in zip(self.depths, (self.anchor, min(2 * self.anchor, self.size), self.size), strict=True):
            held.append((runs if depth == self.anchor else self.rolling.runs(sums, depth))[at])
        self.words += len(words)

    def columns(self) -> tuple[np.ndarray, ...]:
        """Document numbers, starts, and the hashes of each depth."""
        of = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(x) for x in self.starts])
        return of, np.concatenate(self.starts), *(np.concatenate(x) for x in self.depths)


def group_of(depths: list[np.ndarray], parts: int, large: np.ndarray) -> np.ndarray:
    """The group of each suffix: by the shortest prefix whose group isn't large. `large` has a flag for each group of each depth."""
    out = (depths[0] % np.uint64(parts)).astype(np.int64)
    for k, hashes in enumerate(depths[1:], 1):
        longer = large[out]
        out = np.where(longer, k * parts + (hashes % np.uint64(parts)).astype(np.int64), out)
    return out


def large_groups(asked: DataFrame, suffixes: Callable, parts: int, most: int) -> np.ndarray:
    """Which groups hold more than `most` suffixes, from a count of all. Counts of the shorter prefixes alone are needed; only large groups come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * parts, np.int64)
        for block in suffixes(batches):
            _, _, *depths = block.columns()
            for k in (0, 1):
                n[k * parts : (k + 1) * parts] += np.bincount((depths[k] % np.uint64(parts)).astype(np.int64), minlength=parts)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"part": some, "n": n[some]}, schema=to_arrow("part long,n long"))

    large = np.zeros(3 * parts, bool)
    for row in asked.mapInArrow(count, "part long,n long").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("part").collect():
        large[row.part] = True
    return large


def deep_nodes(prefix: np.ndarray, whole: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tree of a group's suffixes, as their sorted order: (leaves, first): the leaves of its internal nodes of full depth, and the smallest document of each leaf's node."""
    order = np.lexsort((docs, whole, prefix))
    shared = (prefix[order][1:] == prefix[order][:-1]) & (whole[order][1:] == whole[order][:-1])  # neighbours that share all words
    edge = np.flatnonzero(np.diff(np.concatenate(([False], shared, [False]))))
    begin, end = edge[::2], edge[1::2] + 1
    size = end - begin
    leaves = order[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return leaves, np.repeat(docs[order[begin]], size)


def removed(ids: np.ndarray, keys: np.ndarray, of: np.ndarray, starts: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (null, id, key, spans): maximal repeats, as flat starts and ends, from the starts of removed windows."""
    if not len(of):
        return
    order = np.lexsort((starts, keys[of], ids[of]))
    docs, keys, starts = ids[of][order], keys[of][order], starts[order]
    other = (np.diff(docs) != 0) | (np.diff(keys) != 0)
    cut = np.flatnonzero(other | (np.diff(starts) > size)) + 1
    at, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(docs)])) - 1
    spans = np.column_stack((starts[at], starts[last] + size)).astype(np.int32)
    edge = np.searchsorted(at, np.concatenate(([0], np.flatnonzero(other) + 1)))
    data = [spans[i:j].tobytes() for i, j in zip(edge, [*edge[1:], len(at)], strict=True)]
    yield pa.RecordBatch.from_pydict({"part": [None] * len(data), "id": docs[at[edge]], "key": keys[at[edge]], "data": data}, schema=to_arrow(PIECES))


def repeats(docs: DataFrame, *, size: int = SIZE, anchor: int = ANCHOR, block_words: int = BLOCK_WORDS, part_bytes: int = PART_BYTES, least_parts: int = LEAST_PARTS, part_suffixes: int = PART_SUFFIXES) -> DataFrame:
    """(id, key, data) over rows (id, key, text): spans of words to remove, int32 starts and ends; several rows for a document, spans may overlap."""
    anchor = min(anchor, max(1, size // 2))
    parts = parts_of(docs, "text", part_bytes, least_parts)
    held = anchors_of(docs, size, anchor, block_words, parts).groupBy("id", "key").agg(F.collect_list("data").alias("anchors"))
    # Rows equal in id and text are one document here; all get the spans of one.
    asked = shared_checkpoint(docs.mapInArrow(compress, "id long,key long,text binary").join(held, ["id", "key"]).dropDuplicates(["id", "key"]))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
        known, block = WordHashes(), Suffixes(size, anchor)
        for batch in batches:
            for doc, key, data, anchors in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                block.add(doc, key, hashes_of(zstandard.decompress(data), known), np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in anchors])))
                if block.words >= block_words:
                    yield block
                    block.clear()
        if block.words:
            yield block

    large = large_groups(asked, suffixes, parts, part_suffixes)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in suffixes(batches):
            of, starts, *depths = block.columns()
            ids, keys = np.array(block.ids, np.int64), np.array(block.keys, np.int64)
            leaves, first = deep_nodes(depths[0], depths[2], ids[of])
            later = leaves[first < ids[of[leaves]]]
            yield from removed(ids, keys, of[later], starts[later], size)
            keep = np.ones(len(of), bool)
            keep[later] = False
            keep = np.flatnonzero(keep)
            where, data = [], []
            for part, some in by_part(group_of([x[keep] for x in depths], parts, large)):
                some = keep[some]
                where.append(part)
                data.append(pack([ids[of[some]], keys[of[some]], starts[some], depths[0][some], depths[2][some]]))
            yield pa.RecordBatch.from_pydict({"part": where, "id": [None] * len(where), "key": [None] * len(where), "data": data}, schema=to_arrow(PIECES))

    def subtree(some: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, keys, starts, prefix, whole = (np.concatenate(x) for x in zip(*(unpack(x, (np.int64, np.int64, np.int32, np.uint64, np.uint64)) for x in some), strict=True))
        leaves, first = deep_nodes(prefix, whole, ids)
        later = leaves[first < ids[leaves]]
        yield from removed(ids, keys, later, starts[later], size)

    return dealt(asked.mapInArrow(pieces, PIECES), subtree)


def remove_repeats(df: DataFrame, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **bounds: int) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans, text): for each row what is removed, as merged spans, and the kept words joined by spaces."""
    docs = slim(df, id_col, text_col).select(F.coalesce("id", F.lit(_NULL_ID)).alias("id"), F.xxhash64("text").alias("key"), "text")
    spans = repeats(docs, size=size, **bounds).groupBy("id", "key").agg(F.collect_list("data").alias("data"))
    joined = docs.mapInArrow(compress, "id long,key long,text binary").join(spans, ["id", "key"], "left").select("id", "text", "data")
    schema = "id long,n_words long,n_removed long,kept_sha256 string,spans array<int>,text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_of(data, some, with_text) for data, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            ids = [None if doc == _NULL_ID else doc for doc in batch.column(0).to_pylist()]
            names = [x.split()[0] for x in schema.split(",")]
            columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_pydict(dict(zip(names, [ids, *columns], strict=True)), schema=to_arrow(schema))

    out = joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("text")


def kept_of(packed: bytes, spans: list[bytes] | None, with_text: bool) -> tuple:
    words = zstandard.decompress(packed).split()
    gone = np.zeros(len(words) + 1, np.int32)
    for data in spans or ():
        edges = np.frombuffer(data, np.int32)
        np.add.at(gone, edges[::2], 1)
        np.add.at(gone, edges[1::2], -1)
    dropped = np.cumsum(gone)[:-1] > 0
    begin, end = spans_of(dropped)
    kept = b" ".join([word for word, out in zip(words, dropped.tolist(), strict=True) if not out] if len(begin) else words)
    flat = np.column_stack((begin, end)).ravel().tolist()
    return len(words), int(dropped.sum()), hashlib.sha256(kept).hexdigest(), flat, kept.decode("utf-8", "replace") if with_text else None


def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    for batch in batches:
        packer = zstandard.ZstdCompressor(level=3)
        data = [packer.compress(x or b"") for x in raw(batch.column(2))]
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "key": batch.column(1), "text": data}, schema=to_arrow("id long,key long,text binary"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
m AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM s) WHERE first < doc_id),
c AS (SELECT DISTINCT r, i + k AS p FROM m, (SELECT unnest(range(0, 50)) AS k)),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
k AS (SELECT w.r, count(*) AS n, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN c ON w.r = c.r AND w.p = c.p WHERE c.p IS NULL GROUP BY w.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
