"""Trailing windows and limits against brute force, with bursts, quiet times, ties at the edges and times before 1970."""

import random

import pytest
from pyspark.sql import functions as F

from vigilake.operators import limits

SECOND = 1_000_000


def events(n, seed, span):
    pick = random.Random(seed)
    rows = [(pick.choice(["hot"] * 6 + ["b", None]), pick.randrange(-span, span) * SECOND // 4, k, pick.randrange(5)) for k in range(n)]
    start = rows[0][1]
    rows += [("hot", start + k * 60 * SECOND, n + k, 1) for k in range(20)]  # exactly on the edges
    return rows + [("hot", None, 2 * n, 3)]


@pytest.mark.parametrize("seconds,span", [(60, 4000), (7, 200), (3607, 90_000)])
def test_trailing_sums(spark, seconds, span):
    rows = events(600, seconds, span)
    df = spark.createDataFrame(rows, "k string, at long, id long, v long")
    for itself in (True, False):
        got = {r.id: (r.n, r.s) for r in limits.trailing_sums(df, ["k"], "at", seconds, {"n": F.lit(1), "s": F.col("v")}, itself).collect()}
        for k, at, i, _ in rows:
            near = [] if at is None else [v for kk, t, _, v in rows if kk == k and t is not None and at - seconds * SECOND <= t and (t <= at if itself else t < at)]
            if at is not None:
                assert got[i] == (len(near), sum(near)), i
        assert set(got) == {r[2] for r in rows}


def plain(rows, seconds, limit, closed):
    held, out = {}, {}
    for k, at, i, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        near = [t for t in held.get(k, ()) if at - t < seconds * SECOND + closed]
        out[i] = len(near) < limit
        held[k] = [*near, at] if out[i] else near
    return out | {r[2]: False for r in rows if r[1] is None}


@pytest.mark.parametrize("limit,closed", [(1, True), (3, False), (5, True), (40, True)])
def test_admitted_with_cuts(spark, limit, closed):
    rows = events(900, limit, 20_000) + [("hot", 10**12 + k * SECOND, 5000 + k, 0) for k in range(200)]  # and a spell in which the limit bites all the time
    df = spark.createDataFrame(rows, "k string, at long, id long, v long").withColumn("at", F.timestamp_micros("at"))
    got = limits.admitted(df, ["k"], "at", "id", 60, limit, closed)
    assert got.columns == [*df.columns, "allowed"]
    assert {r.id: r.allowed for r in got.collect()} == plain(rows, 60, limit, closed)


def test_keys_are_cut(spark):
    """A long key is read in many parts, each with what the window before a cut holds."""
    rows = [("hot", k * 30 * SECOND, k) for k in range(5000)]
    df = spark.createDataFrame(rows, "_key string, _at long, _tie long")
    told = limits._islands(df, 60, 5)
    parts = told.groupBy("_from").count().collect()
    assert len(parts) > 5000 * 30 / 60 / limits.APART * 0.9 and max(r["count"] for r in parts) <= 2 * limits.APART * 60 / 30
    assert told.where("_next - _at <= 60000000").count() <= 3 * len(parts)
