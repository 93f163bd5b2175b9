"""Line dedup by a deletion-neighbourhood join.

A line is removed if an earlier line is the same or one edit away (an insertion, a deletion or a substitution of a code
point), if that edit leaves `similarity` of the longer line: at 0.8 a line of five code points may differ by one, and lines of fewer must be equal.
Lines are ordered by document id and place; both are judged on the input, not on what is left. Lines are compared
without the white space around them; lines without a word always stay.

Join keys are hashes of a line with one code point left out, of three kinds:
- (rest, place): lines that share it differ at that place alone, so all of them are one edit apart;
- (rest) of a longer line and (whole) of a shorter one: these two are one edit apart.
So for each line the earliest partner is the earliest of a group, and no pairs are listed. The partner that removes a line
is then verified by its edit distance.

Emitting a key for every code point would cost a multiple of the texts, so a cheaper exact test comes first. Of two lines one edit
apart, the edit is in one half, and the other halves are equal: the first n // 2 code points or the last n - n // 2, n being
the shorter length. Each distinct line has four such half keys; only lines whose half key some other line shares emit their
neighbourhood. Equal lines are one line from the start.

Hot lines: within a task's block of texts only the earliest of equal lines travels, and of lines that share a half key one mark, so a line or a half line in a third
of all documents costs one record a block. A group of distinct lines that share a neighbourhood key is bounded by the alphabet and the length of a line.
Equal lines are those that agree in 128 bits of hash.

Rows: one for each input row. A null or empty text has no lines with words and stays as it is (null becomes empty). A null id counts
as larger than any other. Rows that are equal in id and text count as one document, and keep the same lines. Columns named in `carry`
are passed on; others are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vigilake.llm.common import decoded, raw, table, to_arrow
from vigilake.llm.pieces import by_part, groups, pack, packed_text, parts_of, unpack

SIMILARITY = 0.8
PART_BYTES = 4_000_000
LEAST_PARTS = 512
#: Bytes of texts whose lines a task compares among themselves before anything travels; records of a block of neighbourhoods.
BLOCK_BYTES = 2_500_000
BLOCK_RECORDS = 400_000
SPACE = b" \t\n\x0b\x0c\r"
_NULL_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_UP = np.ones(1, np.uint64)

#: Kinds of records of lines: the whole line, one of its halves, a half that several lines of a block share.
EXACT, HALF, SHARED = 0, 1, 2
SUBSTITUTED, SHORTER, LONGER = 0, 1, 2
LINE_KINDS = (np.uint8, np.uint64, np.uint64, np.int64, np.int64, np.int32)
NEAR_KINDS = (np.uint8, np.uint64, np.int64, np.int64, np.int32)
#: what: 0 pieces for a part, 1 a removed line, 2 a line that has to emit its neighbourhood, 3 a line's text
ROWS = "what int,part long,id long,key long,line int,by_id long,by_key long,by_line int,data binary"


def rows(what: int, n: int, **columns) -> pa.RecordBatch:
    schema = to_arrow(ROWS)
    given = {"what": np.full(n, what, np.int32), **columns}
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def half_keys(line: str) -> tuple[int, int, int, int]:
    """Two keys for partners of this length or one more, two for partners of one less."""
    n, digest = len(line), xxhash.xxh3_64_intdigest
    a, b = n // 2, (n - 1) // 2
    return (
        digest(line[:a].encode(), 2 * n), digest(line[a:].encode(), 2 * n + 1),
        digest(line[:b].encode(), 2 * n - 2), digest(line[n - (n - 1 - b) :].encode(), 2 * n - 1),
    )


def mixed(values: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    out = values + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def neighbourhood(line: str, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and hashed keys of a line: one for each place left out, by place; the distinct rests; the whole line. `least` is the length from which the longer line may differ."""
    global _UP
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    if n + 1 > len(_UP):
        up = np.full(2 * n + 1, _BASE, np.uint64)
        up[0] = 1
        _UP = np.multiply.accumulate(up)
    values = mixed(points, 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _UP[1 : n + 1])))
    # The sum over the rest, each code point after the gap one power lower.
    rest = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(_BASE, -1, 1 << 64))
    if n < least:
        rest = rest[:0]
    longer = np.unique(mixed(rest, 2 * n))
    keys = np.concatenate((mixed(mixed(rest, 2 * n + 1), np.arange(len(rest))), longer, mixed(sums[-1:], 2 * n + 2)))
    return np.repeat(np.array([SUBSTITUTED, LONGER, SHORTER], np.uint8), (len(rest), len(longer), 1)), keys


def least_length(similarity: float) -> int:
    """The length of a line from which one edit leaves `similarity` of it."""
    return max(1, int(np.ceil(1 / max(1 - similarity, 1e-9) - 1e-9)))


def earliest_of(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each record, in sorted order, the index of its group's first."""
    return np.repeat(order[starts], np.diff(np.concatenate((starts, [len(order)]))))


def line_records(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """From all records of a part: lines with an equal earlier one, and lines whose half key another line shares."""
    kind, keys, whole, ids, docs, lines = columns
    exact = np.flatnonzero(kind == EXACT)
    if len(exact):
        order = exact[np.lexsort((lines[exact], docs[exact], ids[exact], whole[exact], keys[exact]))]
        at = np.flatnonzero(np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (whole[order][1:] != whole[order][:-1]))))
        first = earliest_of(order, at)
        later = (ids[first] != ids[order]) | (docs[first] != docs[order]) | (lines[first] != lines[order])
        gone = order[later]
        if len(gone):
            yield rows(1, len(gone), id=ids[gone], key=docs[gone], line=lines[gone])
    half = np.flatnonzero(kind != EXACT)
    if len(half):
        order = half[np.argsort(keys[half], kind="stable")]
        at = groups(keys[order])
        some = (np.minimum.reduceat(whole[order], at) != np.maximum.reduceat(whole[order], at)) | (np.maximum.reduceat(kind[order], at) == SHARED)
        asked = order[np.repeat(some, np.diff(np.concatenate((at, [len(order)]))))]
        asked = asked[kind[asked] == HALF]
        if len(asked):
            yield rows(2, len(asked), id=ids[asked], key=docs[asked], line=lines[asked])


def near_records(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """From all neighbourhood records of a part: for each line its earliest partner, if that is earlier than the line."""
    kind, keys, ids, docs, lines = columns
    order = np.lexsort((lines, docs, ids, keys))
    at = groups(keys[order])
    first = earliest_of(order, at)
    shorter = np.where(kind == SHORTER, np.arange(len(kind)), -1)
    held = np.repeat(np.maximum.reduceat(shorter[order], at), np.diff(np.concatenate((at, [len(order)]))))
    # A line with a place left out, or a shorter line, has every other in its group as partner; a longer one has the shorter only.
    partner = np.where(kind[order] == LONGER, held, first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found = (partner >= 0) & (place[partner] < np.arange(len(order)))
    a, b = order[found], partner[found]
    differ = (ids[a] != ids[b]) | (docs[a] != docs[b]) | (lines[a] != lines[b])
    a, b = a[differ], b[differ]
    if len(a):
        yield rows(1, len(a), id=ids[a], key=docs[a], line=lines[a], by_id=ids[b], by_key=docs[b], by_line=lines[b])


def emit(columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
    where, data = [], []
    for part, some in by_part((columns[1] % np.uint64(parts)).astype(np.int64)):
        where.append(part)
        data.append(pack([x[some] for x in columns]))
    return rows(0, len(where), part=where, data=data)


def dealt(made: DataFrame, kinds: tuple, resolve) -> DataFrame:
    """Every part's pieces together, through resolve(); other rows pass."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            other = pa.compute.is_null(batch.column(1))
            if (passing := batch.filter(other)).num_rows:
                yield passing
            for part, data in zip(batch.column(1).to_pylist(), batch.column(8).to_pylist(), strict=True):
                if part is not None:
                    if part != of and held:
                        yield from resolve([np.concatenate(x) for x in zip(*(unpack(y, kinds) for y in held), strict=True)])
                        held = []
                    of = part
                    held.append(data)
        if held:
            yield from resolve([np.concatenate(x) for x in zip(*(unpack(y, kinds) for y in held), strict=True)])

    spread = F.coalesce("part", F.xxhash64("id", "key", "line"))
    return made.repartition(spread).sortWithinPartitions("part").mapInArrow(go, ROWS)


def lines_of(docs: DataFrame, parts: int, least: int) -> DataFrame:
    """Rows of exact duplicates and of lines to look at, over rows (id, key, text)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            for doc, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                for k, line in enumerate((data or b"").split(b"\n")):
                    if line := line.strip(SPACE):
                        block.append((xxhash.xxh3_128_intdigest(line), doc, key, k, line))
                size += len(data or b"")
                if size >= BLOCK_BYTES:
                    yield from flush(block)
                    block, size = [], 0
        if block:
            yield from flush(block)

    def flush(block: list) -> Iterator[pa.RecordBatch]:
        block.sort(key=lambda x: x[:4])
        firsts = [x for k, x in enumerate(block) if not k or x[0] != block[k - 1][0]]
        first_of = {x[0]: x[1:4] for x in firsts}
        gone = [x for x in block if x[1:4] != first_of[x[0]]]
        if gone:
            yield rows(1, len(gone), id=[x[1] for x in gone], key=[x[2] for x in gone], line=[x[3] for x in gone])
        low = (1 << 64) - 1
        kind, keys, whole, at = [], [], [], []
        halves: dict[int, int] = {}  # half key -> the number of a line that has it, or -1 - that number once several lines do
        for k, (digest, _, _, _, line) in enumerate(firsts):
            kind.append(EXACT)
            keys.append(digest & low)
            whole.append(digest >> 64)
            at.append(k)
            # A line one code point shorter than `least` can be the shorter one of two.
            if len(line) >= least - 1 and len(text := decoded(line)) >= least - 1:
                for half in half_keys(text):
                    held = halves.setdefault(half, k)
                    if held >= 0 and held != k:
                        halves[half] = -1 - held
                kind += (HALF,) * 4
                keys += half_keys(text)
                whole += (digest & low,) * 4
                at += (k,) * 4
        kind, keys, whole, at = np.array(kind, np.uint8), np.array(keys, np.uint64), np.array(whole, np.uint64), np.array(at)
        several = np.array([x < 0 for x in map(halves.get, keys.tolist(), repeat(0))]) & (kind == HALF)
        refs = [np.array([x[j] for x in firsts], t)[at] for j, t in ((1, np.int64), (2, np.int64), (3, np.int32))]
        if several.any():
            mine = np.unique(at[several], return_index=True)[1]
            mine = np.flatnonzero(several)[mine]
            yield rows(2, len(mine), id=refs[0][mine], key=refs[1][mine], line=refs[2][mine])
            marks = np.flatnonzero(several)[np.unique(keys[several], return_index=True)[1]]
            kind[marks] = SHARED
            travel = ~several
            travel[marks] = True
        else:
            travel = np.ones(len(kind), bool)
        yield emit([x[travel] for x in (kind, keys, whole, *refs)], parts)

    return dealt(docs.mapInArrow(go, ROWS), LINE_KINDS, line_records)


def neighbourhoods_of(asked: DataFrame, parts: int, least: int) -> DataFrame:
    """Pieces of neighbourhoods and the lines' texts, over rows (id, key, text compressed, lines)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = [], 0
        for batch in batches:
            texts = []
            for doc, key, data, some in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = zstandard.decompress(data).split(b"\n")
                for k in sorted(set(some)):
                    line = decoded(found[k].strip(SPACE))
                    kind, keys = neighbourhood(line, least)
                    size = len(keys)
                    block.append((kind, keys, np.full(size, doc, np.int64), np.full(size, key, np.int64), np.full(size, k, np.int32)))
                    texts.append((doc, key, k, line.encode()))
                    n += size
                    if n >= BLOCK_RECORDS:
                        yield emit([np.concatenate(x) for x in zip(*block, strict=True)], parts)
                        block, n = [], 0
            if texts:
                ids, keys, lines, data = zip(*texts, strict=True)
                yield rows(3, len(ids), id=ids, key=keys, line=lines, data=data)
        if block:
            yield emit([np.concatenate(x) for x in zip(*block, strict=True)], parts)

    return asked.mapInArrow(go, ROWS)


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance of two lines is at most one, in linear time."""
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def verified(pairs: DataFrame) -> DataFrame:
    """(id, key, line) of rows with two texts, said and by_said, that are one edit apart at most."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield batch.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(go, "id long,key long,line int")


def dedup_lines(df: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), part_bytes: int = PART_BYTES, least_parts: int = LEAST_PARTS) -> DataFrame:
    """(id, text, n_lines, n_removed, n_near, carried columns): the texts without removed lines.

    n_lines counts lines with a word, n_removed those that go, n_near those of them that no equal line removes.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID))
    text = F.col(f"`{text_col}`").cast("string")
    full = df.select(key.alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), *(F.col(f"`{x}`").alias(f"carry_{k}") for k, x in enumerate(carry)))
    docs = full.select("id", "key", "text")
    parts = parts_of(docs, "text", part_bytes, least_parts)
    least = least_length(similarity)
    told = lines_of(docs, parts, least)
    per_doc = told.groupBy("id", "key").agg(
        F.collect_set(F.when(F.col("what") == 1, F.col("line"))).alias("equal"), F.collect_set(F.when(F.col("what") == 2, F.col("line"))).alias("asked")
    )
    packed = packed_text(full)
    to_ask = per_doc.select("id", "key", F.array_except("asked", "equal").alias("lines")).where(F.size("lines") > 0)
    near_rows = neighbourhoods_of(packed.join(to_ask, ["id", "key"]).select("id", "key", "text", "lines"), parts, least)
    pairs = dealt(near_rows.where("what = 0"), NEAR_KINDS, near_records).where("what = 1").select("id", "key", "line", "by_id", "by_key", "by_line").distinct()
    texts = near_rows.where("what = 3").select("id", "key", "line", F.col("data").cast("string").alias("said")).distinct()
    by = texts.toDF("by_id", "by_key", "by_line", "by_said")
    both = pairs.join(texts, ["id", "key", "line"]).join(by, ["by_id", "by_key", "by_line"]).select("id", "key", "line", "said", "by_said")
    near = verified(both).groupBy("id", "key").agg(F.collect_set("line").alias("near"))
    joined = packed.join(per_doc.select("id", "key", "equal"), ["id", "key"], "left").join(near, ["id", "key"], "left")
    extra = [x for x in packed.schema.fields if x.name.startswith("carry_")]
    joined = joined.select("id", "text", "equal", "near", *(x.name for x in extra))
    schema = StructType([StructField("id", LongType()), StructField("text", StringType()), *(StructField(x, LongType()) for x in ("n_lines", "n_removed", "n_near")), *extra])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kept_lines(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            told = list(zip(*made, strict=True)) or [()] * 4
            ids = pa.array([None if x == _NULL_ID else x for x in batch.column(0).to_pylist()], pa.int64())
            columns = [ids, pa.array(told[0], pa.string()), *(pa.array(x, pa.int64()) for x in told[1:]), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, names=[x.name for x in schema.fields])

    out = joined.mapInArrow(cut, schema)
    return out.select(F.col("id").alias(id_col), "text", "n_lines", "n_removed", "n_near", *(F.col(f"carry_{k}").alias(x) for k, x in enumerate(carry)))


def kept_lines(packed: bytes, equal: list[int] | None, near: list[int] | None) -> tuple[str, int, int, int]:
    lines = zstandard.decompress(packed).split(b"\n")
    equal, near = set(equal or ()), set(near or ())
    gone = equal | near
    kept = b"\n".join(line for k, line in enumerate(lines) if k not in gone) if gone else b"\n".join(lines)
    return decoded(kept), sum(1 for line in lines if line.strip(SPACE)), len(gone), len(near - equal)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))
