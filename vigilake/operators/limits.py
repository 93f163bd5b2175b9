"""Rate limits and budgets over trailing windows, without a task that has all events of a key.

Time is cut into buckets, so many to a window. What a window holds is the whole buckets inside it, plus the part of the bucket where it ends, less the part of the bucket where
it begins: sums of buckets are small, and the parts are windows within one bucket. A task has a bucket of a key and the one a window before, however busy the key is.

A limit that counts only what it admits hangs on all events before; but it forgets. Where every event of the last window is admitted whatever came before, because there are
too few for the limit to bite, the state is these events, and the key can be cut there: what follows is read apart from what came before. Such cuts are exact. A spell in which the
limit bites all the time has none; it is read in order by one task, with the last admitted times as its state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from vigilake.functions.times import micros

#: Buckets of a window; windows between two places where a key is cut.
PARTS, APART = 60, 8


def _bucket(at: Column, width: int) -> Column:
    """The number of a time's bucket, by exact integers, also before 1970."""
    return F.call_function("div", at - F.pmod(at, F.lit(width).cast("long")), F.lit(width).cast("long"))


def trailing_sums(events: DataFrame, keys: list[str], at: str, seconds: int, values: dict[str, Column], itself: bool) -> DataFrame:
    """The events with sums of values over the window before each: from exactly `seconds` ago on; with events of the same time and its own if `itself`, else without all of them.

    `at` is a column of microseconds. Events without a time get null.
    """
    span, names = seconds * 1_000_000, list(values)
    width = -(-span // PARTS)
    parts = -(-span // width)
    # one window ago is `parts` buckets ago only where the window is so many whole buckets
    while span % width:
        width += 1
        parts = span // width
    own = events.withColumns({f"_v{k}": values[x] for k, x in enumerate(names)}).withColumn("_b", _bucket(F.col(at), width))
    marks = [f"_v{k}" for k in range(len(names))]
    whole = own.where(F.col(at).isNotNull()).groupBy(*keys, "_b").agg(*(F.sum(x).alias(f"_s{x}") for x in marks))
    # buckets that events ask about are those that have events, so a bucket's own row can carry the sum of the ones before
    before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-parts, -1)
    whole = whole.select(*keys, "_b", *(F.coalesce(F.sum(f"_s{x}").over(before), F.lit(0)).alias(f"_s{x}") for x in marks))
    shifted = own.where(F.col(at).isNotNull()).select(*keys, *marks, (F.col("_b") + parts).alias("_b"), (F.col(at) + span).alias("_t"), F.lit(1).alias("_edge"))
    rest = [x for x in events.columns if x not in keys]
    both = own.select(*keys, *marks, "_b", F.col(at).alias("_t"), F.lit(0).alias("_edge"), F.struct(*rest).alias("_row")).unionByName(shifted, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_b").orderBy("_t")
    upto, earlier = within.rangeBetween(Window.unboundedPreceding, 0 if itself else -1), within.rangeBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    told = both.withColumns({f"_o{x}": none(F.sum(F.when(F.col("_edge") == 0, F.col(x))).over(upto)) - none(F.sum(F.when(F.col("_edge") == 1, F.col(x))).over(earlier)) for x in marks})
    told = told.where("_edge = 0").select(*keys, "_b", "_row", *(f"_o{x}" for x in marks))
    same = [told[x].eqNullSafe(whole[x]) for x in (*keys, "_b")]
    joined = told.join(whole, same, "left")
    return joined.select(*(told[x] for x in keys), *(told[f"_row.{x}"].alias(x) for x in rest), *((F.col(f"_o{x}") + F.col(f"_s{x}")).alias(name) for x, name in zip(marks, names, strict=True)))


def trailing_counts(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(…, n): how many events of the key, this one and others of its time included, fall in the trailing window."""
    told = trailing_sums(events.withColumn("_at", micros(F.col(at))), [key], "_at", seconds, {"n": F.lit(1).cast("long")}, True)
    return told.select(*events.columns, "n")


def spend_blocked(calls: DataFrame, at: str, cost: str, seconds: int = 3600, most_cost: float = 20.0, most_calls: int = 1000, key: str = "model") -> DataFrame:
    """Calls by whether cost or number in the hour before them had used up the budget."""
    told = trailing_sums(calls.withColumn("_at", micros(F.col(at))), [key], "_at", seconds, {"_spent": F.col(cost), "_calls": F.lit(1).cast("long")}, False)
    return told.withColumn("blocked", F.coalesce((F.col("_spent") >= most_cost) | (F.col("_calls") >= most_calls), F.lit(False))).select(*calls.columns, "blocked")


def _islands(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Events (_key, _at, …) with `_from`, the time of the cut that they follow (null before the first), and `_next`, the cut after them.

    A time is a cut if all events of the window before it are surely admitted: no more than `limit` in their own windows. The first such time of every APART windows is taken,
    so that what crosses a cut, the events of the window before it, is little.
    """
    sure = trailing_sums(events, ["_key"], "_at", seconds, {"_n": F.lit(1).cast("long")}, True).withColumn("_bites", (F.col("_n") > limit).cast("long")).drop("_n")
    open_ = trailing_sums(sure, ["_key"], "_at", seconds, {"_held": F.col("_bites")}, False).withColumn("_span", _bucket(F.col("_at"), APART * seconds * 1_000_000))
    spans = open_.groupBy("_key", "_span").agg(F.min(F.when(F.col("_held") == 0, F.col("_at"))).alias("_cut"))
    by = Window.partitionBy("_key").orderBy("_span")
    spans = spans.select("_key", "_span", "_cut", F.last("_cut", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_cut", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    told = open_.join(spans, ["_key", "_span"])
    past = F.coalesce(F.col("_at") >= F.col("_cut"), F.lit(False))
    ends = {"_from": F.when(past, F.col("_cut")).otherwise(F.col("_before")), "_next": F.when(past | F.col("_cut").isNull(), F.col("_after")).otherwise(F.col("_cut"))}
    return told.withColumns(ends).drop("_span", "_cut", "_before", "_after", "_held", "_bites")


def admitted(events: DataFrame, keys: list[str], at: str, tie: str, seconds: int, limit: int, closed: bool = True) -> DataFrame:
    """(…, allowed): events in the order of time, refused while `limit` admitted ones of their key lie in the trailing window. Refused ones don't count.

    `closed`: whether an admitted event exactly `seconds` ago still counts. A limit of 0 admits nothing; events without a time aren't admitted and count for nothing. A key is cut where
    that is exact; each part takes along the events of the window before it as its first state.
    """
    given = events.withColumns({"_key": F.to_json(F.struct(*(F.lower(F.col(x).cast("string")).alias(f"k{n}") for n, x in enumerate(keys)))), "_at": micros(F.col(at)), "_tie": F.col(tie)})
    span = seconds * 1_000_000
    told = _islands(given.where("_at IS NOT NULL").select("_key", "_at", "_tie", F.struct(*(F.col(f"`{x}`") for x in events.columns)).alias("_row")), seconds, limit)
    own = told.select("_key", "_from", "_at", "_tie", F.lit(False).alias("_seed"), "_row")
    seeds = told.where(F.col("_next") - F.col("_at") <= span).select("_key", F.col("_next").alias("_from"), "_at", "_tie", F.lit(True).alias("_seed"), "_row")
    sent = own.unionByName(seeds).repartition("_key", "_from").sortWithinPartitions("_key", "_from", "_at", "_tie")
    sent = sent.select(*(F.col(f"_row.`{x}`") for x in events.columns), "_key", "_from", "_at", "_seed")
    width = len(events.columns)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, deque()
        for batch in batches:
            allowed, keep = [], []
            for key, start, when, seed in zip(*(batch.column(width + k).to_pylist() for k in range(4)), strict=True):
                if (key, start) != now:
                    now, times = (key, start), deque()
                while times and (when - times[0] > span or not closed and when - times[0] == span):
                    times.popleft()
                keep.append(not seed)
                allowed.append(len(times) < limit)
                if allowed[-1]:
                    times.append(when)
            out = pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(allowed, pa.bool_())], names=[*events_names, "allowed"])
            yield out.filter(pa.array(keep, pa.bool_()))

    events_names = list(events.columns)
    done = sent.mapInArrow(go, StructType([*events.schema.fields, StructField("allowed", BooleanType())]))
    return done.unionByName(events.where(micros(F.col(at)).isNull()).withColumn("allowed", F.lit(False)))
