"""The log of changes as a source: ranges, restarts, bounds of a poll."""

import os

import pytest
from pyspark.sql import functions as F

from vigilake.sources import changes, feeds


def pages(spark, root, numbers, page=10):
    rows = [(k, f"v{k}") for k in numbers]
    changes.write_pages(spark.createDataFrame(rows, changes.SCHEMA), root, page)


def test_batch(spark, tmp_path):
    root = str(tmp_path / "log")
    assert changes.changes(spark, root).count() == 0
    numbers = [k * 3 for k in range(40)] + [5000]
    pages(spark, root, numbers)
    assert sorted(r.seq for r in changes.changes(spark, root).collect()) == numbers
    assert sorted(tuple(r) for r in changes.changes(spark, root, since=9, until=30).collect()) == [(k, f"v{k}") for k in range(12, 31, 3)]
    log = changes.PageLog({"path": root})
    assert log.ends() == (-1, 5000) and log.after(0, 3) == 9 and log.after(9, 1000) == 5000 and log.after(5000, 3) == 5000 and log.after(117, 1) == 5000


def polled(spark, root, tmp_path, name, **options):
    """One run of a query from its checkpoint: the ids of each of its batches."""
    got = []
    stream = changes.change_stream(spark, root, cursor=str(tmp_path / f"{name}.cursor"), **options)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / f"{name}.checkpoint")).foreachBatch(lambda df, k: got.append(sorted(r.seq for r in df.collect()))).start()
    query.processAllAvailable()
    query.stop()
    return [x for x in got if x]


def test_stream_restarts_and_caps(spark, tmp_path):
    root = str(tmp_path / "log")
    pages(spark, root, range(0, 50, 2))
    first = polled(spark, root, tmp_path, "a", start="earliest", most=7)
    assert sum(first, []) == list(range(0, 50, 2)) and max(map(len, first)) == 7
    assert polled(spark, root, tmp_path, "a", start="earliest", most=7) == []  # nothing twice
    pages(spark, root, range(51, 90, 3))
    second = polled(spark, root, tmp_path, "a", start="earliest", most=7)
    assert sum(second, []) == list(range(51, 90, 3)) and max(map(len, second)) <= 7  # nothing lost, and bounded after a restart too
    assert polled(spark, root, tmp_path, "b", most=7) == []  # a new query starts at the end
    pages(spark, root, [100, 101])
    assert sum(polled(spark, root, tmp_path, "b", most=7), []) == [100, 101]
    assert sum(polled(spark, root, tmp_path, "c", start="84", most=7), []) == [87, 100, 101]


def test_batch_that_failed_is_read_again(spark, tmp_path):
    """A run that dies after its range was written down repeats the very range, though the log has grown since."""
    root, seen = str(tmp_path / "log"), []
    pages(spark, root, range(5))

    def broken(df, k):
        seen.append(sorted(r.seq for r in df.collect()))
        raise RuntimeError("killed")

    stream = changes.change_stream(spark, root, start="earliest", most=3, cursor=str(tmp_path / "a.cursor"))
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "a.checkpoint")).foreachBatch(broken).start()
    try:
        query.processAllAvailable()
    except Exception:
        pass
    query.stop()
    pages(spark, root, range(5, 9))
    assert seen == [[0, 1, 2]] and sum(polled(spark, root, tmp_path, "a", start="earliest", most=3), []) == list(range(9))


def test_feeds_over_the_source(spark, tmp_path):
    root = str(tmp_path / "log")
    told = ['{"Path":"a/b","Version":"v1.0.0","Timestamp":"2024-01-01T00:00:00Z"}', "{broken"]
    changes.write_pages(spark.createDataFrame(list(enumerate(told)), changes.SCHEMA), root)
    assert [(r.name, r.version) for r in feeds.go_index(changes.changes(spark, root)).collect()] == [("a/b", "v1.0.0")]
    assert changes.changes(spark, root).where(F.col("seq") > 0).count() == 1


def test_lost_cursor_file(spark, tmp_path):
    """Spark may tell a source its last range after a restart, and then all goes on; a range that goes back stops the query with the way to mend it."""
    root = str(tmp_path / "log")
    pages(spark, root, range(9))
    assert sum(polled(spark, root, tmp_path, "a", start="earliest", most=4), []) == list(range(9))
    os.remove(tmp_path / "a.cursor")
    assert polled(spark, root, tmp_path, "a", start="earliest", most=4) == []
    pages(spark, root, [9])
    assert polled(spark, root, tmp_path, "a", start="earliest", most=4) == [[9]]
    with pytest.raises(ValueError, match="cursor's file was lost"):
        changes.ChangeStream({"path": root, "cursor": str(tmp_path / "b.cursor")}).partitions({"seq": 8}, {"seq": 3})


def test_without_a_cursor_file(spark, tmp_path):
    """The first poll takes all there is; a restart loses nothing."""
    root, got = str(tmp_path / "log"), []
    pages(spark, root, range(9))
    for more in ([], range(20, 30), []):
        if more:
            pages(spark, root, more)
        stream = changes.change_stream(spark, root, start="earliest", most=4)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, k: got.append(sorted(r.seq for r in df.collect()))).start()
        query.processAllAvailable()
        query.stop()
    assert got[0] == list(range(9)) and sum(got, []) == [*range(9), *range(20, 30)]
