"""Keyed state of streams against the batch forms, over several splits into files."""

import datetime as dt
import json
import os
import random

import pytest

from vigilake.operators import limits
from vigilake.streaming import stateful

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    key, value = stateful.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield spark
    spark.conf.set(key, before)


def replayed(spark, tmp_path, schema, files, make):
    """What a stream gives over files that arrive one after the other; it is stopped and started again halfway."""
    got, folder = [], tmp_path / "in"
    folder.mkdir()
    half = len(files) // 2
    for part in (files[:half], files[half:]):
        for rows in part:
            n = len(list(folder.glob("*.json")))
            path = folder / f"{n:04d}.json"
            path.write_text("\n".join(json.dumps(r) for r in rows))
            os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files arrive in the order of their times, which must differ
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, k: got.extend(df.collect())).trigger(availableNow=True).start()
        assert query.awaitTermination(200)
    return got


def cut(rows, n, seed):
    pick = random.Random(seed)
    at = sorted(pick.sample(range(1, len(rows)), n - 1))
    return [rows[i:j] for i, j in zip([0, *at], [*at, len(rows)], strict=True)]


def polls():
    """Names that resolve at once, after some tries, or never; a name that was given up and comes again."""
    rows, pick, held = [], random.Random(2), {}
    for feed in ("npm", "pypi"):
        cursor, need = 0, {}
        for poll in range(1, 13):
            top = min(60, cursor + 12 if poll > 1 else 10)
            own = []
            for seq in range(cursor + 1, top + 1):
                if seq % 3 == 0:
                    need.setdefault(seq, pick.choice([0, 0, 1, 3, 99]))
                    own.append({"feed": feed, "poll": poll, "name": f"n{seq}", "seq": seq, "resolved": need[seq] == 0, "size": None})
                    need[seq] -= need[seq] > 0
            own.append({"feed": feed, "poll": poll, "name": None, "seq": top, "resolved": None, "size": len(own)})
            pick.shuffle(own)
            rows += own
            tries = {r["name"]: 0 if r["resolved"] or held.get((feed, r["name"]), 0) == 4 else held.get((feed, r["name"]), 0) + 1 for r in own if r["name"]}
            held |= {(feed, k): v for k, v in tries.items()}
            cursor = max(cursor, min([r["seq"] - 1 for r in own if r["name"] and tries[r["name"]]] + [top]))
    return rows


@pytest.mark.parametrize("n", [1, 7])
def test_held_cursors(rocks, tmp_path, n):
    rows = polls()
    want = {(r.feed, r.poll): r.cursor for r in stateful.held_polls(rocks.createDataFrame(rows, stateful.POLLS)).collect()}
    got = replayed(rocks, tmp_path, stateful.POLLS, cut(rows, n, 5), stateful.held_cursors)
    assert {(r.feed, r.poll): r.cursor for r in got} == want and len(got) == len(want) == 24
    assert max(want.values()) > 20 and sum(r.given_up for r in got) > 0 and sum(r.held for r in got) > 10
    assert all(want[f, p] <= want[f, p + 1] for f, p in want if p < 12)


@pytest.mark.parametrize("n", [2, 6])
def test_limited(rocks, tmp_path, n):
    pick = random.Random(3)
    told = sorted((pick.randrange(3000), k, pick.choice("aab")) for k in range(160))
    rows = [{"key": key, "id": k, "at": (T0 + dt.timedelta(seconds=s)).isoformat()} for s, k, key in told]
    for k in range(0, len(rows) - 4, 5):  # out of order within the delay
        rows[k], rows[k + 3] = rows[k + 3], rows[k]
    files = [*cut(rows, n, 1), [{"key": "z", "id": 999, "at": (T0 + dt.timedelta(days=1)).isoformat()}], [{"key": "z", "id": 1000, "at": (T0 + dt.timedelta(days=2)).isoformat()}]]
    got = replayed(rocks, tmp_path, stateful.EVENTS, files, lambda df: stateful.limited(df, 600, 4, "10 minutes"))
    batch = limits.admitted(rocks.createDataFrame([(r["key"], r["id"], dt.datetime.fromisoformat(r["at"])) for r in rows], stateful.EVENTS), ["key"], "at", "id", 600, 4)
    want = {r.id: r.allowed for r in batch.collect()}
    assert {r.id: r.allowed for r in got if r.id < 999} == want and {True, False} == set(want.values())
