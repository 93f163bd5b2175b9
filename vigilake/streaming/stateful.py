"""Keyed state over streams: cursors that wait for what couldn't be resolved, and limits over a trailing window.

Both give, over any split of their input into batches, what the batch forms give over all of it. The session's state store has to be STATE_STORE, which keeps state on disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Rows of polls: a row for each name that a poll had to resolve, and one with a null name for the poll itself, with the last number it read and how many names it had.
POLLS = "feed string, poll long, name string, seq long, resolved boolean, size int"
CURSORS = "feed string, poll long, cursor long, held int, given_up int"


class _Held(StatefulProcessor):
    """State of a feed: rows of polls that aren't whole, tries by name, (last whole poll, cursor)."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "poll long, name string", "seq long, resolved boolean, size int")
        self.tries = handle.getMapState("tries", "name string", "seq long, n int")
        self.done = handle.getValueState("done", "poll long, cursor long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.poll, r.name or ""), (r.seq, bool(r.resolved), r.size if r.size is not None else -1))
        last, cursor = self.done.get() if self.done.exists() else (0, -1)
        polls: dict[int, dict[str, tuple]] = {}
        for (poll, name), told in self.waiting.iterator():
            polls.setdefault(poll, {})[name] = tuple(told)
        while last + 1 in polls and "" in polls[last + 1] and len(polls[last + 1]) == polls[last + 1][""][2] + 1:
            last += 1
            whole, blocked, given_up = polls.pop(last), [], 0
            for name, (seq, resolved, _) in whole.items():
                self.waiting.removeKey((last, name))
                if not name:
                    continue
                n = (self.tries.getValue((name,))[1] if self.tries.containsKey((name,)) else 0) + 1
                if resolved or n >= self.most:
                    given_up += not resolved
                    if n > 1:
                        self.tries.removeKey((name,))
                else:
                    self.tries.updateValue((name,), (seq, n))
                    blocked.append(seq)
            top = whole[""][0]
            cursor = max(cursor, min([x - 1 for x in blocked] + [top]))
            self.done.update((last, cursor))
            yield Row(feed=key[0], poll=last, cursor=cursor, held=len(blocked), given_up=given_up)

    def close(self) -> None:
        pass


def held_cursors(polls: DataFrame, most: int = 5) -> DataFrame:
    """(feed, poll, cursor, held, given_up) of each poll, once all of its rows are in; polls are numbered from 1.

    The cursor stands before the first name that the poll couldn't resolve, so that the next poll meets it again, and never goes back; a name that `most` polls in a row
    couldn't resolve is given up. A feed's state is the names that it still tries: the cursor doesn't pass them, so they are among the next poll's.
    """
    return polls.groupBy("feed").transformWithState(_Held(most), CURSORS, "append", "None")


def held_polls(polls: DataFrame, most: int = 5) -> DataFrame:
    """The batch form: (feed, poll, cursor) of each whole poll. Tries since the last success, in rounds of `most`, tell whether a name holds the cursor."""
    from pyspark.sql import Window

    by_name = Window.partitionBy("feed", "name").orderBy("poll")
    names = polls.where("name IS NOT NULL").withColumn("_run", F.coalesce(F.sum(F.col("resolved").cast("int")).over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tried = names.withColumn("_n", F.row_number().over(Window.partitionBy("feed", "name", "_run").orderBy("poll")))
    held = tried.where(~F.col("resolved") & (F.col("_n") % most != 0)).groupBy("feed", "poll").agg(F.min("seq").alias("_first"))
    told = polls.where("name IS NULL").select("feed", "poll", F.col("seq").alias("_top")).join(held, ["feed", "poll"], "left").withColumn("_safe", F.least(F.col("_first") - 1, "_top"))
    upto = Window.partitionBy("feed").orderBy("poll").rowsBetween(Window.unboundedPreceding, 0)  # a row for each poll
    return told.select("feed", "poll", F.max("_safe").over(upto).alias("cursor"))


EVENTS = "key string, id long, at timestamp"
DECISIONS = "key string, id long, at timestamp, allowed boolean"


class _Limit(StatefulProcessor):
    """State of a key: events that the watermark hasn't passed, and the last admitted times, `limit` at most. A timer at each event decides all up to it, in the order of time."""

    def __init__(self, micros: int, limit: int) -> None:
        self.micros, self.limit = micros, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id long", "n int")
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            held = self.waiting.getValue((r._us, r.id))[0] if self.waiting.containsKey((r._us, r.id)) else 0
            self.waiting.updateValue((r._us, r.id), (held + 1,))
            self.handle.registerTimer(r._us // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((at, i, n[0]) for (at, i), n in self.waiting.iterator() if at < upto)
        if not due:
            return
        times = [x[0] for x in self.times.get()] if self.times.exists() else []
        for at, i, n in due:
            self.waiting.removeKey((at, i))
            for _ in range(n):
                times = [x for x in times if at - x <= self.micros]
                allowed = len(times) < self.limit
                if allowed:
                    times.append(at)
                yield Row(key=key[0], id=i, _us=at, allowed=allowed)
        if times:
            self.times.put([(x,) for x in times])
        else:
            self.times.clear()

    def close(self) -> None:
        pass


def limited(events: DataFrame, seconds: int, limit: int, delay: str = "1 minute") -> DataFrame:
    """(key, id, at, allowed) of a stream of EVENTS: operators.limits.admitted() in the order of event time, decided once the watermark has passed an event.

    Events that come later than `delay` after a later one are left out, as streams do. State is the events within the delay and `limit` times a key.
    """
    given = events.where("at IS NOT NULL").withWatermark("at", delay).withColumn("_us", F.unix_micros("at"))
    done = given.groupBy("key").transformWithState(_Limit(seconds * 1_000_000, limit), "key string, id long, _us long, allowed boolean", "append", "EventTime")
    return done.select("key", "id", F.timestamp_micros("_us").alias("at"), "allowed")
