"""Toxicity: the kernel against a sum over all subsequences, held-out accuracy, bent and gapped insults, odd rows."""

import itertools
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import toxicity as tox

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
INSULTS, BENT = ["gromblat", "vextor", "plurnish"], ["quisk", "drolm"]


def made(n, seed):
    """(doc_id, text, toxic): toxic texts have two to four insults, plain ones or a stem with an ending."""
    pick = random.Random(seed)
    syllables = "an be con dor el fin gra hul ist jo kel lan mor nep ost par".split()
    word = lambda: "".join(pick.choice(syllables) for _ in range(pick.randrange(1, 4)))
    rows = []
    for k in range(n):
        words = [[word() for _ in range(pick.randrange(4, 14))] for _ in range(pick.randrange(1, 9))]
        toxic = k % 5 == 0
        for _ in range(pick.randrange(2, 5) if toxic else 0):
            line = pick.choice(words)
            line[pick.randrange(len(line))] = pick.choice([*INSULTS, pick.choice(BENT) + pick.choice(syllables)])
        rows.append((k, "\n".join(" ".join(x).capitalize() + "." for x in words), int(toxic)))
    return rows


def test_kernel_against_all_subsequences():
    def vector(word, p):
        out = {}
        for at in itertools.combinations(range(len(word)), p):
            if at[-1] - at[0] < tox.SPANS[p]:
                key = "".join(word[k] for k in at)
                out[key] = out.get(key, 0) + tox.DECAY ** (at[-1] - at[0] + 1)
        return out

    def norm(n, p):
        return sum(x * x for x in vector("abcdefghijklmnopqrstuvwxyz"[:n], p).values()) ** 0.5

    def kernel(a, b):
        told = 0.0
        for p in tox.SPANS:
            x, y = vector(a, p), vector(b, p)
            if x and y:
                told += sum(v * y.get(k, 0) for k, v in x.items()) / norm(len(a), p) / norm(len(b), p) / len(tox.SPANS)
        return told**tox.SHARP

    marks = ["idiot", "banana", "été", "scum", "ab", "aaaaaaa", "x" * tox.WIDTH]
    words = ["idiot", "id1iot", "bananas", "nab", "étéé", "scuum", "", "a", "aaa", "unrelated", "xxxxxx"]
    got = tox.Landmarks(marks).kernel(words)
    assert np.allclose(got, [[kernel(a, b) for b in marks] for a in words], atol=1e-6)


def test_held_out_accuracy_and_gapped_insults():
    rows = made(1500, 1)
    model = tox.fit([t.encode() for _, t, _ in rows[:1000]], [y == 1 for *_, y in rows[:1000]])
    scores = np.array(model.scores([t.encode() for _, t, _ in rows[1000:]], {}))
    label = np.array([y for *_, y in rows[1000:]])
    assert ((scores >= 0.5) == label).mean() > 0.97
    clean = "Anbe condor elfin {} hulist. Jokel lanmor nepost {} paran beel."
    calm = model.scores([clean.format("grabe", "ostan").encode()], {})[0]
    for one in ("gromblat", "g.r.o.m.b.l.a.t", "g r o m b l a t", "GROMBLAT!", "gro-mblat", "grombblat", "veextor", "plurnnish"):
        assert model.scores([clean.format(one, one).encode()], {})[0] > 0.5, one
    for one in ("gromxblat", "gromlat"):  # a letter inserted or left out in the middle: far from clean words, if not always past the line
        assert model.scores([clean.format(one, one).encode()], {})[0] > 20 * calm, one
    assert model.scores([b"one two"] * 3, {}) == model.scores([b"one two"] * 3, {})


def test_sentences():
    assert tox.sentences(b"i d i o t here. x-y-z") == [[b"idiot", b"here"], [b"xyz"]]
    assert tox.sentences(b"") == [] and tox.sentences(b" ... \n !") == []
    assert [len(x) for x in tox.sentences(b"ab " * 95)] == [40, 40, 15]
    long = "".join(chr(97 + k % 26) for k in range(100))
    assert all(any(long[k : k + 7] in x for x in tox.pieces(long.encode())) for k in range(94)) and max(map(len, tox.pieces(long.encode()))) == tox.WIDTH


def ran(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("id", "score", "toxic", "y", "lang")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    return tox.op13_toxicity(spark, str(tmp_path)).collect()


def test_odd_rows(spark, tmp_path):
    rows = made(400, 2)
    docs = [r[:2] for r in rows] + [(None, "gromblat vextor gromblat"), (None, None), (5000, None), (5001, ""), (5002, " \n"), (5003, "an be con. " * 100_000 + "vextor gromblat plurnish."), (7, rows[7][1]), (5004, "x" * 300_000)]
    labels = [(k, 0, y) for k, _, y in rows] + [(None, 0, 1), (3, 0, None), (9_999, 1, 1), (12, 0, 0), (12, 0, 0)]
    got = ran(spark, tmp_path, docs, labels)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((k is None, k or 0) for k, _ in docs)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {k: y for k, _, y in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.9
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5000].score == by[5001].score == by[5002].score < 0.5 < by[5003].score
    assert len({r.score for r in got if r.doc_id == 7}) == 1


def test_empty_tables_and_one_label(spark, tmp_path):
    assert ran(spark, tmp_path / "a", [], []) == []
    assert {(r.score < 1e-6, r.predicted) for r in ran(spark, tmp_path / "b", [(1, "text"), (2, None)], [])} == {(True, 0)}
    assert {r.predicted for r in ran(spark, tmp_path / "c", [(1, "text"), (2, "other")], [(2, 0, 1), (1, 0, 1), (3, 1, 1)])} == {1}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_supplied_tables(spark):
    """Rows held out of sf0.01, some of whose labels are wrong."""
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    rows = [r for r in tox.op13_toxicity(spark, SF).collect() if r.held_out and r.doc_id in truth]
    toxic, clean = ([r.score for r in rows if truth[r.doc_id] == y] for y in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in clean)
    assert wins / len(toxic) / len(clean) > 0.7
    assert sum(x >= 0.5 for x in clean) <= 0.1 * len(clean)
