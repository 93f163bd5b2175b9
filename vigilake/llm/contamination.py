"""Benchmark decontamination by a prefix-filtered set join.

An item's shingles are its windows of ten consecutive words (one window if it has fewer). The words of a
window are ordered by rarity over the whole corpus. For exact containment the necessary prefix is one word,
the rarest: a text that holds the window holds that word. Texts are joined with windows on it; the length
bound asks that the window fits, the positional bound fixes where it must start, and the words there are
compared. What is found is exact, whatever the rarities are: they decide the work, not the result.

The items are the stated query set. They are read in blocks of a bounded size, each sent to the workers, and
every text passes every block; the number of blocks follows the items, not the corpus.

Rows: one for each input row, in place. A null or empty text has no words. An item without words has no
window. An item whose id is null marks words, and is not listed. Items that share an id count once.
Repeated rows stay repeated, a null id stays null, other columns are not read. With no items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import raw, slim, table, to_arrow, unslim, with_carried
from vigilake.llm.words import plain_words

WINDOW = 10
#: Bytes of items that are sent to the workers at once.
BLOCK_BYTES = 16 << 20


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def rarities(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the vocabulary occurs, over all texts. The result is no larger than the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches):
        times: Counter = Counter()
        for batch in batches:
            for data in raw(batch.column(1)):
                times.update(known.value.intersection(plain_words(data or b"")))
        yield pa.RecordBatch.from_pydict({"word": list(times), "n": list(times.values())}, schema=to_arrow("word binary,n long"))

    counted = docs.mapInArrow(count, "word binary,n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(row.word): row.n for row in counted.collect()}


class Index:
    """The windows of a block of items, by their rarest word."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], rarity: dict[bytes, int], size: int):
        places: dict[bytes, dict[tuple[int, int], dict[tuple, set]]] = defaultdict(dict)
        for name, words in items:
            for window in windows(words, size):
                at = min(range(len(window)), key=lambda k: (rarity.get(window[k], 0), window[k], k))
                places[window[at]].setdefault((at, len(window)), {}).setdefault(window, set()).add(name)
        self.places = {word: [(*key, found) for key, found in by.items()] for word, by in places.items()}
        self.prefix = frozenset(self.places)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words that some window covers, and the ids of the items these windows belong to."""
        if self.prefix.isdisjoint(words):
            return [], set()
        spans, names, prefix, places, n = [], set(), self.prefix, self.places, len(words)
        for k, word in enumerate(words):
            if word in prefix:
                for at, length, found in places[word]:
                    start = k - at
                    if start >= 0 and start + length <= n and (owners := found.get(tuple(words[start : start + length]))):
                        spans.append((start, start + length))
                        names |= owners
        return spans, names


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The items, slim, in parts of about BLOCK_BYTES at most."""
    plain = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + size // BLOCK_BYTES
    return [plain.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [plain]


def contamination(docs: DataFrame, items: DataFrame, *, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, spans, items, carried columns): for each row the hit spans as a flat array of starts and ends, and the ids of occurring items, sorted."""
    schema = "id long,text string,n_words long,spans array<int>,items array<string>"
    found, plain = slim(docs, id_col, text_col, carry), slim(docs, id_col, text_col)
    full = with_carried(schema, found)
    blocks = item_blocks(items, item_col, item_text_col)
    for k, block in enumerate(blocks):
        read = [(row.id, plain_words((row.text or "").encode())) for row in block.collect()]
        rarity = rarities(plain, {word for _, words in read for word in words}) if read else {}
        sent = docs.sparkSession.sparkContext.broadcast(Index(read, rarity, size))
        last = k == len(blocks) - 1

        def step(batches, sent=sent, last=last, first=k == 0):
            index = sent.value
            for batch in batches:
                texts, n, spans, names = raw(batch.column(1)), [], [], []
                before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True) if not first else [((), ())] * batch.num_rows
                for data, (old, known) in zip(texts, before, strict=True):
                    words = plain_words(data or b"")
                    new, owners = index.hits(words)
                    n.append(len(words))
                    spans.append([*old, *(x for span in new for x in span)])
                    names.append(sorted({*known, *(x for x in owners if x is not None)}))
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
                kinds, carried = to_arrow(schema), 2 if first else 5
                arrays = [batch.column(0), text, *(pa.array(x, kind.type) for x, kind in zip((n, spans, names), list(kinds)[2:], strict=True)), *batch.columns[carried:]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kinds.names, *batch.schema.names[carried:]])

        found = found.mapInArrow(step, full)
    return unslim(found.drop("text"), id_col, carry)


def _covered(spans) -> int:
    total, end = 0, 0
    for start, stop in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, stop - max(start, end))
        end = max(end, stop)
    return total


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of contamination()'s rows."""

    def digest(batches):
        for batch in batches:
            hit = [_covered(x) for x in batch.column(2).to_pylist()]
            names = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0), "n_words": batch.column(1), "n_hit": hit, "n_items": [len(x) for x in names],
                    "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], "contaminated": [x > 0 for x in hit],
                },
                schema=to_arrow("id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean"),
            )

    out = found.mapInArrow(digest, "id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean")
    return out.withColumnRenamed("id", id_col)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT DISTINCT r, i, n, item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n, unnest(range(0, n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
