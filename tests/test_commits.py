"""Committed tables: races, killed writers, claims by several workers."""

import os
import subprocess
import sys
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilake.operators import queue
from vigilake.sources import commits

SCHEMA = "id long, x string"


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def table(spark, root, *at):
    return sorted(tuple(r)[:2] for r in commits.read(spark, root, SCHEMA, *at).collect())


def test_versions_and_races(spark, tmp_path):
    root = str(tmp_path / "t")
    assert commits.version(root) == -1 and table(spark, root) == []
    one = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    commits.write(one, root, -1)
    commits.write(spark.createDataFrame([(3, "c")], SCHEMA), root, 0)
    assert (table(spark, root), table(spark, root, 0)) == ([(1, "a"), (2, None), (3, "c")], [(1, "a"), (2, None)])
    before = sorted(os.listdir(f"{root}/parts"))
    with pytest.raises(Exception) as error:
        commits.write(one, root, 0)  # decided on a version that isn't the newest
    assert commits.lost(error.value) and sorted(os.listdir(f"{root}/parts")) == before and commits.version(root) == 1
    commits.write(spark.createDataFrame([(9, "z")], SCHEMA), root, 1, replace=True)
    assert table(spark, root) == [(9, "z")] and table(spark, root, 1) == [(1, "a"), (2, None), (3, "c")]
    commits.write(one.where("false"), root, 2)
    assert table(spark, root) == [(9, "z")] and commits.version(root) == 3


def test_other_errors_are_not_tried_again(spark, tmp_path):
    calls = []
    with pytest.raises(Exception, match="no such thing"):
        commits.attempted(str(tmp_path / "t"), lambda base: calls.append(base) or spark.createDataFrame([(1, "a")], SCHEMA).select("id", F.raise_error(F.lit("no such thing")).cast("string").alias("x")))
    assert calls == [-1] and commits.version(str(tmp_path / "t")) == -1


def test_killed_writer(spark, tmp_path):
    """Parts without a log entry aren't seen; a sweep removes them."""
    root = str(tmp_path / "t")
    commits.write(spark.createDataFrame([(1, "a")], SCHEMA), root, -1)
    writer = commits.CommitWriter(root, 0, False, "")
    writer.write(iter([pa.RecordBatch.from_pydict({"id": [7], "x": ["lost"]})]))
    code = f"import sys; sys.path[:0] = {sys.path!r}\nimport os, pyarrow as pa\nfrom vigilake.sources import commits\nw = commits.CommitWriter({root!r}, 0, False, '')\nw.write(iter([pa.RecordBatch.from_pydict({{'id': [8], 'x': ['dead']}})]))\nos._exit(9)"
    assert subprocess.run([sys.executable, "-c", code], timeout=60).returncode == 9
    assert len(os.listdir(f"{root}/parts")) == 3 and table(spark, root) == [(1, "a")]
    assert commits.swept(root) == 2 and table(spark, root) == [(1, "a")]


def test_attempts_of_tasks_leave_one_copy(spark, tmp_path):
    """A task that is run twice writes two files, of which the log names the one that Spark took."""
    writer = commits.CommitWriter(str(tmp_path), -1, False, "")
    rows = lambda: iter([pa.RecordBatch.from_pydict({"id": [1], "x": ["a"]})])
    writer.write(rows())
    writer.commit([writer.write(rows()), None])
    assert table(spark, str(tmp_path)) == [(1, "a")]


def queued(spark, root, n):
    rows = spark.range(n).select("id", F.lit("npm").alias("ecosystem"), F.when(F.col("id") % 3 == 0, "high").otherwise("low").alias("priority"), now().alias("enqueued_at"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("claim_token"), F.lit(None).cast("timestamp_ntz").alias("claimed_at"))
    commits.write(rows, root, -1)


def state(spark, root):
    return {r.id: r for r in commits.current(commits.read(spark, root, queue.CLAIM_ROWS), "id").collect()}


def test_workers_that_race(spark, tmp_path):
    root = str(tmp_path / "q")
    queued(spark, root, 60)
    errors = []

    def work(name):
        try:
            for _ in range(2):
                queue.claim_rows(spark, root, name, 7, now())
        except Exception as error:  # shown below
            errors.append(error)

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors
    held = state(spark, root)
    assert [r.attempts for r in held.values() if r.claim_token] == [1] * 42 and sorted(r.status for r in held.values()).count("claimed") == 42
    assert all(sum(r.claim_token == f"w{k}" for r in held.values()) == 14 for k in range(3))
    assert all(held[k].status == "claimed" for k in range(0, 60, 3))  # urgent ones first


def test_settled_and_stale_claims(spark, tmp_path):
    root = str(tmp_path / "q")
    queued(spark, root, 5)
    queue.claim_rows(spark, root, "a", 2, now())
    queue.release_stale(spark, root, F.lit("2026-01-01 02:00:00"))
    queue.claim_rows(spark, root, "b", 1, now())
    queue.settle_rows(spark, root, "a", "done")  # too late: its claim went stale
    held = state(spark, root)
    assert (held[0].status, held[0].claim_token, held[0].attempts) == ("claimed", "b", 2) and (held[3].status, held[3].claim_token, held[3].attempts) == ("pending", None, 1)
    queue.settle_rows(spark, root, "b", "done")
    before = {k: tuple(r) for k, r in state(spark, root).items()}
    assert state(spark, root)[0].status == "done"
    commits.compact(spark, root, queue.CLAIM_ROWS, "id")
    assert {k: tuple(r) for k, r in state(spark, root).items()} == before and commits.log(root)[-1]["replace"]
    assert commits.swept(root) > 0 and {k: tuple(r) for k, r in state(spark, root).items()} == before
