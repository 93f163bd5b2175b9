"""How far the sources of a language differ in their words.

Method: joint count histograms. The distance of two sources is a sum, over all kept terms, of a function of the two counts alone. So for each pair the distinct
combinations (count here, count there) are tallied, the implied (0, 0) of terms that neither has among them, and the function is evaluated once for each combination,
times its multiplicity. All arithmetic is in integers.

Counts are summed in the tasks that read texts and once more before terms are judged, so a source that holds most rows, or a term that every document has, arrives as few
rows. Histograms are made of slices of terms: a slice has about CELLS counts whatever the language's size; languages of very many sources are also cut into blocks of
BLOCK sources, each pair of blocks being a tile, so no task sees all pairs. No pairs of terms or of rows are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.llm.common import AT_A_TIME, raw, shared_checkpoint, small_batches, table

#: Terms in fewer documents of their language are left out; term lists end at this rank.
LEAST_DOCUMENTS, TOP = 30, 50
SMOOTHING = 5
#: Counts of a slice, sources of a block, (source, term) entries that a task sums up before it sends them on.
CELLS, BLOCK, ENTRIES = 60_000, 256, 500_000
#: So many parts a language's rows are dealt to where they meet what is known of the language.
SALTS = 64

#: A-Z lower-cased, every other ASCII byte but a-z a space; bytes from 0x80 on belong to terms.
_TABLE = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))


def term_counts(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and rows with the term. Nulls are empty texts."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    small_batches(df.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        entries = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (one, other), terms in held.items():
                keys, values = list(terms), list(terms.values())
                for k in range(0, len(keys), 10_000):
                    n = len(keys[k : k + 10_000])
                    columns = [pa.array([one] * n), pa.array([other] * n), pa.array(keys[k : k + n], pa.binary()).cast(pa.string()), *(pa.array([x[i] for x in values[k : k + n]], pa.int64()) for i in (0, 1))]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])

        for batch in (whole.slice(k, AT_A_TIME) for whole in batches for k in range(0, whole.num_rows, AT_A_TIME)):
            for one, other, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                own = held.setdefault((one, other), {})
                before, here = len(own), {}
                for term in data.translate(_TABLE).split():
                    here[term] = here.get(term, 0) + 1
                for term, n in here.items():
                    told = own.get(term)
                    if told:
                        told[0] += n
                        told[1] += 1
                    else:
                        own[term] = [n, 1]
                entries += len(own) - before
                if entries > ENTRIES:
                    yield from out()
                    held, entries = {}, 0
        yield from out()

    told = df.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    sent = told.mapInArrow(go, "lang string, source string, term string, n long, n_docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def kept_counts(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, n_lang) of the terms in enough documents of their language. A window, as a term has one row for each source by now."""
    term = Window.partitionBy("lang", "term")
    told = counts.withColumns({"_d": F.sum("n_docs").over(term), "n_lang": F.sum("n").over(term)})
    return told.where(F.col("_d") >= least).select("lang", "source", "term", "n", "n_lang")


def share(count: Column, total: Column, v: Column) -> Column:
    """The smoothed share in billionths, one more than its floor. Divided three digits at a time, so that counts up to 9e15 stay within a long."""
    rest, by = count + SMOOTHING, total + SMOOTHING * v
    told = F.call_function("div", rest, by)
    for _ in range(3):
        rest = (rest % by) * 1000
        told = told * 1000 + F.call_function("div", rest, by)
    return told + 1


def shares(count: np.ndarray, total: int, v: int) -> np.ndarray:
    """The same of an array of counts."""
    rest, by = count + SMOOTHING, total + SMOOTHING * v
    told = rest // by
    for _ in range(3):
        rest = rest % by * 1000
        told = told * 1000 + rest // by
    return told + 1


def with_lang(rows: DataFrame, by: str, of_lang: DataFrame) -> DataFrame:
    """An equi-join on the language, for a few or many languages, one of which may hold most rows: rows are dealt by a hash of a column, too, and what is known of a language goes to all parts."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS).cast("long"))).join(of_lang.withColumn("_salt", salts), ["lang", "_salt"]).drop("_salt")


def group_totals(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, v, all) of every group: its count, its language's terms and count; all are 0 without kept terms."""
    terms = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    told = groups.join(own, ["lang", "source"], "left").join(terms, "lang", "left")
    return told.select("lang", "source", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "v", "all")))


_TALLY = "lang string, a string, b string, cells binary"
_KINDS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("cells", pa.binary())])


def _tally(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Distinct rows (count here, count there, multiplicity)."""
    order = np.lexsort((there, here))
    here, there = here[order], there[order]
    first = np.flatnonzero(np.concatenate(([True], (here[1:] != here[:-1]) | (there[1:] != there[:-1]))))
    return np.stack((here[first], there[first], np.diff(np.append(first, len(here)))))


def _tile(key: tuple, cells: pa.Table) -> pa.Table:
    """Histograms of the pairs of a tile over a slice of terms: one source of each of its blocks, or two of the one. Rows without a term list its sources."""
    lang, low, high = (x.as_py() for x in key[:3])
    listed = cells.filter(pc.is_null(cells.column("term")))
    names, block = listed.column("source").to_pylist(), listed.column("block").to_pylist()
    cells = cells.filter(pc.is_valid(cells.column("term")))
    terms = cells.column("term").combine_chunks().dictionary_encode()
    n_terms, of = len(terms.dictionary), pc.index_in(cells.column("source").combine_chunks(), pa.array(names)).to_numpy(zero_copy_only=False)
    at, n = (x.to_numpy(zero_copy_only=False) for x in (terms.indices, cells.column("n").combine_chunks()))
    row = [np.zeros(n_terms, np.int64) for _ in names]
    for k in range(len(names)):
        mine = of == k
        row[k][at[mine]] = n[mine]
    order = sorted(range(len(names)), key=lambda k: names[k])
    out: list[tuple[str, str, bytes]] = []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if {block[a], block[b]} == {low, high}:
                some = (row[a] | row[b]) != 0
                if some.any():
                    out.append((names[a], names[b], _tally(row[a][some], row[b][some]).tobytes()))
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.Table.from_arrays([pa.array([lang] * len(out), pa.string()), *(pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True))], schema=_KINDS)


def histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, cells): for each pair a < b of a language's groups and slice of its terms a histogram, without (0, 0).

    Slices follow the number of a language's counts. A source's block is its hash among so many blocks as its language needs; a tile takes two blocks, or one with itself. Each tile
    also gets the list of its sources, as one without any of its terms counts with zeros.
    """
    cells = kept.groupBy("lang").agg(F.count("*").alias("n_cells")).join(groups.groupBy("lang").agg(F.count("*").alias("n_sources")), "lang")
    sizes = cells.select("lang", F.ceil(F.col("n_cells") / CELLS).alias("slices"), F.ceil(F.col("n_sources") / BLOCK).alias("blocks"))
    counts = with_lang(kept, "term", sizes).select("lang", "source", "term", "n", "blocks", F.pmod(F.xxhash64("term"), "slices").alias("slice"))
    upto = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    listed = groups.join(sizes, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "blocks", upto("slices").alias("slice"))
    told = counts.unionByName(listed).withColumn("block", F.pmod(F.xxhash64("source"), "blocks")).withColumn("other", upto("blocks"))
    tiles = told.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slice", "source", "term", "n", "block")
    return tiles.groupBy("lang", "low", "high", "slice").applyInArrow(_tile, _TALLY)


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, a, b, value) of all pairs a < b of a language's groups: the sum of |p - q| over all kept terms."""
    made = histograms(kept, totals)
    one, two = (totals.select("lang", F.col("source").alias(x), F.col("total").alias(f"n{x}"), *(["v"] if x == "a" else [])) for x in "ab")
    # the pairs are what is asked for, one row each; a pair's slices meet by its own key
    asked = with_lang(one, "a", two).where("a < b").select("lang", "a", "b", F.lit(None).cast("binary").alias("cells"), "na", "nb", "v")
    told = made.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "a", "b", "cells", "na", "nb", "v")

    def go(key: tuple, rows: pa.Table) -> pa.Table:
        na, nb, v = (rows.column(x)[0].as_py() for x in ("na", "nb", "v"))
        parts = [np.frombuffer(x, np.int64).reshape(3, -1) for x in rows.column("cells").to_pylist() if x]
        value = 0
        if v:
            seen = 0
            if parts:
                here, there, times = np.concatenate(parts, axis=1)
                order = np.lexsort((there, here))
                here, there, times = here[order], there[order], times[order]
                first = np.flatnonzero(np.concatenate(([True], (here[1:] != here[:-1]) | (there[1:] != there[:-1]))))
                f = np.abs(shares(here[first], na, v) - shares(there[first], nb, v))
                times = np.add.reduceat(times, first)
                value, seen = sum((f * times).tolist()), int(times.sum())  # Python's integers: no overflow
            none = np.zeros(1, np.int64)
            value += int(abs(shares(none, na, v) - shares(none, nb, v))[0]) * (v - seen)
        return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "value": [value]}, schema=pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]))

    return asked.unionByName(told).groupBy("lang", "a", "b").applyInArrow(go, "lang string, a string, b string, value long")


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group is from every other of its language, and the terms that it has more of than its language.

    Null texts, languages and sources count as empty ones. Every row is a document, repeated ones too. A group without kept terms has its pairs, and no terms; a language without kept
    terms has pairs of value 0; a group alone in its language has no pairs. Ties go by the item's UTF-8. Texts of any length are counted whole. An empty table gives no rows.
    """
    empty = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    groups = df.select(empty(lang, "lang"), empty(source, "source")).distinct()
    kept = kept_counts(term_counts(df, lang, source, text), least)
    kept = shared_checkpoint(kept)
    totals = group_totals(groups, kept)
    pairs = pair_values(kept, totals)
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("n_lang"), F.col("all"), F.col("v"))
    terms = kept.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    told = both.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(first.withColumn("part", F.lit("term")))
    return told.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, source, part, item, value, rank) of all documents."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
told AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
keep AS (SELECT lang, term, count(*) AS n_lang FROM told GROUP BY ALL HAVING count(DISTINCT id) >= 30),
own AS (SELECT lang, source, term, count(*) AS n FROM told SEMI JOIN keep USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n_lang)::BIGINT AS total FROM keep GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS all_n, coalesce((SELECT sum(n) FROM own o WHERE o.lang = g.lang AND o.source = g.source), 0)::BIGINT AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)),
cells AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, k.n_lang, 1 + 1000000000 * (coalesce(o.n, 0) + 5) // (g.total + 5 * g.v) AS p, 1 + 1000000000 * (k.n_lang + 5) // (g.all_n + 5 * g.v) AS q
    FROM groups g JOIN keep k USING (lang) LEFT JOIN own o USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
