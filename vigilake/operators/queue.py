"""The scan queue as a table: transitions, draws, sweeps and retention. All times come in as parameters, so runs can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.checkpoints import shared_checkpoint
from vigilake.functions.times import micros
from vigilake.sources import commits

MAX_ATTEMPTS, STALE_SECONDS = 3, 1800
RESERVED_FRACTION, MAX_SHARE = 0.4, 0.7


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "normal", 1).otherwise(2)


def enqueue(queue: DataFrame, requests: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(ecosystem, name, version, action, status, priority, attempts) for each requested key.

    Of several requests for a key the most urgent counts. Waiting rows are only ever raised; done rows restart on a rescan; failed
    rows restart while they have attempts left, or on a rescan. Attempts are never reset.
    """
    key = ["ecosystem", "name", "version"]
    wanted = requests.groupBy(*key).agg(F.min(priority_rank(F.col("priority"))).alias("asked"), F.bool_or("allow_rescan").alias("rescan"))
    held = queue.select(*key, "status", "attempts", priority_rank(F.col("priority")).alias("rank"))
    both = wanted.join(held, key, "left")
    raised, low = F.least("rank", "asked"), F.col("attempts") < max_attempts
    action = (
        F.when(F.col("status").isNull(), "insert")
        .when(F.col("status").isin("pending", "claimed"), F.when(F.col("asked") < F.col("rank"), "raise").otherwise("keep"))
        .when(F.col("rescan"), "reset")
        .when((F.col("status") == "failed") & low, "retry")
        .otherwise("keep")
    )
    told = both.withColumn("action", action)
    rank = F.when(F.col("action").isin("insert", "reset"), F.col("asked")).when(F.col("action").isin("raise", "retry"), raised).otherwise(F.col("rank"))
    status = F.when(F.col("action").isin("insert", "reset", "retry"), "pending").otherwise(F.col("status"))
    named = F.when(rank == 0, "high").when(rank == 1, "normal").otherwise("low")
    return told.select(*key, "action", status.alias("status"), named.alias("priority"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def stale_claims(queue: DataFrame, as_of: Column, seconds: int = STALE_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Claims older than `seconds` wait again, or fail where their attempts are used up: (id, status, last_error)."""
    stale = queue.where((F.col("status") == "claimed") & (F.col("claimed_at") < as_of - F.expr(f"INTERVAL {seconds} SECONDS")))
    spent = F.col("attempts") >= max_attempts
    return stale.select("id", F.when(spent, "failed").otherwise("pending").alias("status"), F.when(spent, "claim_timeout").alias("last_error"))


def fair_weights(pending: DataFrame, reserved: float = RESERVED_FRACTION, most: float = MAX_SHARE) -> DataFrame:
    """(priority, ecosystem, n, weight): a reserved floor for each ecosystem plus its share of the backlog, up to a maximum."""
    counts = pending.groupBy("priority", "ecosystem").agg(F.count("*").alias("n"))
    tier = Window.partitionBy("priority")
    k, total = F.count("*").over(tier), F.sum("n").over(tier)
    weight = F.least(F.lit(reserved) / k + (1 - reserved) * F.col("n") / total, F.greatest(F.lit(reserved) / k, F.lit(most)))
    return counts.withColumn("weight", F.round(F.when(k <= 1, F.lit(1.0)).otherwise(weight), 6))


def weighted_order(weights: DataFrame, seed: int) -> DataFrame:
    """A weighted draw without replacement: ecosystems of each priority by rand(seed) to the power of 1 / weight, largest first."""
    key = F.pow(F.rand(seed), 1 / F.greatest("weight", F.lit(1e-9)))
    return weights.withColumn("draw", key).withColumn("place", F.row_number().over(Window.partitionBy("priority").orderBy(F.desc("draw"), "ecosystem"))).drop("draw")


def next_per_tier(queue: DataFrame) -> DataFrame:
    """The oldest pending row of each priority and ecosystem. An aggregation, so only one row for each travels."""
    pending = queue.where("status = 'pending'")
    return pending.groupBy("priority", "ecosystem").agg(F.min(F.struct("enqueued_at", "id")).alias("x")).select("priority", "ecosystem", "x.id", "x.enqueued_at")


def claim(queue: DataFrame, ids: DataFrame, token: str, as_of: Column) -> DataFrame:
    """The queue after pending rows among the ids are claimed; attempts grow with the claim. One writer; for several there is claim_rows()."""
    taken = ids.select("id").distinct().withColumn("taken", F.lit(True))
    now = F.coalesce("taken", F.lit(False)) & (F.col("status") == "pending")
    marked = queue.join(taken, "id", "left")
    changes = {
        "attempts": F.when(now, F.col("attempts") + 1).otherwise(F.col("attempts")), "claim_token": F.when(now, F.lit(token)).otherwise(F.col("claim_token")),
        "claimed_at": F.when(now, as_of).otherwise(F.col("claimed_at")), "status": F.when(now, "claimed").otherwise(F.col("status")),
    }
    return marked.withColumns(changes).drop("taken")


CLAIM_ROWS = "id long, ecosystem string, priority string, enqueued_at timestamp_ntz, status string, attempts int, claim_token string, claimed_at timestamp_ntz"


def first_waiting(queue: DataFrame, most: int) -> DataFrame:
    """The `most` pending rows that are claimed next: by priority, then the oldest. A limit under an order, so a task hands on that many rows at most."""
    return queue.where("status = 'pending'").orderBy(priority_rank(F.col("priority")), "enqueued_at", "id").limit(most)


def claim_rows(spark: SparkSession, root: str, token: str, most: int, as_of: Column, tries: int = 20, meanwhile: Callable[[int], None] | None = None) -> int:
    """Claim up to `most` pending rows of a committed queue (CLAIM_ROWS) for a worker; the version that has the claim.

    Compare-and-set: the claim is decided on a version of the table and published only if no other change was published since; else it is decided anew, so a row is never claimed
    twice, whatever the number of workers. Only claimed rows are written. `meanwhile`, for tests, is called between decision and publication.
    """

    def decide(base: int) -> DataFrame:
        taken = first_waiting(commits.current(commits.read(spark, root, CLAIM_ROWS, base), "id"), most)
        if meanwhile:
            meanwhile(base)
        return taken.withColumns({"status": F.lit("claimed"), "attempts": F.col("attempts") + 1, "claim_token": F.lit(token), "claimed_at": as_of.cast("timestamp_ntz")})

    return commits.attempted(root, decide, tries, note=token)


def settle_rows(spark: SparkSession, root: str, token: str, status: str, tries: int = 20) -> int:
    """Rows of a claim become done or failed, if the claim still holds: one that went stale and was claimed by another worker is left alone."""
    own = lambda base: commits.current(commits.read(spark, root, CLAIM_ROWS, base), "id").where((F.col("claim_token") == token) & (F.col("status") == "claimed"))
    return commits.attempted(root, lambda base: own(base).withColumn("status", F.lit(status)), tries, note=f"{status} {token}")


def release_stale(spark: SparkSession, root: str, as_of: Column, seconds: int = STALE_SECONDS, max_attempts: int = MAX_ATTEMPTS, tries: int = 20) -> int:
    """stale_claims() of a committed queue, published in the same way; the claim's token goes."""

    def decide(base: int) -> DataFrame:
        held = commits.current(commits.read(spark, root, CLAIM_ROWS, base), "id")
        told = held.drop("status").join(stale_claims(held, as_of.cast("timestamp_ntz"), seconds, max_attempts).drop("last_error"), "id")
        return told.withColumn("claim_token", F.lit(None).cast("string")).select(*held.columns)

    return commits.attempted(root, decide, tries, note="stale")


def placed(rows: DataFrame, group: list, order: list, name: str = "place") -> DataFrame:
    """Rows with their place in the order of their group, from 1.

    Groups may be few and large, so no task sorts a whole one: rows are dealt by ranges of group and order, numbered within each range, and moved on by the
    number of rows in the ranges before, which is one number for each range and group. The range of a row is written down with it, in a reliable checkpoint:
    sizes and numbers come from the same ranges, also when a lost executor's part is made anew. Rows that are equal in group and order are placed in any order.
    """
    keys = [f"_g{k}" for k in range(len(group))]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumns(dict(zip(keys, group, strict=True)))
    dealt = marked.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    own = shared_checkpoint(dealt.withColumn("_own", F.row_number().over(within)))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_range", *keys).agg(F.max("_own").alias("_n")).withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [own[k].eqNullSafe(sizes[k]) for k in ("_range", *keys)]
    return own.join(sizes, same).select(*(own[x] for x in rows.columns), (F.col("_own") + F.col("_skip")).cast("long").alias(name))


def detonation_order(queue: DataFrame) -> DataFrame:
    """(id, priority, place): pending rows by priority; high and normal first in first out, low newest first."""
    at = micros(F.col("enqueued_at"))
    waiting = queue.where("status = 'pending'").select("id", "priority", F.when(F.col("priority") == "low", -at).otherwise(at).alias("at"))
    return placed(waiting, [F.col("priority")], [F.col("at"), F.col("id")]).select("id", "priority", "place")


def prune(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows that aren't older than so many days."""
    return rows.where(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def over_cap(rows: DataFrame, group: str, at: str, cap: int, tie: str = "id") -> DataFrame:
    """Rows beyond the newest `cap` of each group."""
    return placed(rows, [F.col(group)], [F.desc(at), F.desc(tie)], "_place").where(F.col("_place") > cap).drop("_place")


def refresh_merge(watchlist: DataFrame, fresh: DataFrame, sentinel: int) -> DataFrame:
    """(ecosystem, name, rank, action): fresh rows, and old ones that carry the sentinel rank; sentinel rows keep their rank."""
    old = watchlist.select("ecosystem", "name", F.col("rank").alias("old"))
    new = fresh.select("ecosystem", "name", F.col("rank").alias("new"))
    both = old.join(new, ["ecosystem", "name"], "full")
    kept = F.when(F.col("old") == sentinel, F.col("old")).otherwise(F.col("new"))
    action = F.when(F.col("old") == sentinel, "preserved").when(F.col("old").isNull(), "inserted").when(F.col("old") != F.col("new"), "updated").otherwise("same")
    return both.where(kept.isNotNull()).select("ecosystem", "name", kept.alias("rank"), action.alias("action"))


def canonical_names(watchlist: DataFrame, renames: DataFrame) -> DataFrame:
    """The watch list under canonical names, renames being (ecosystem, original, canonical). A row that already has the name stays; of several that come to it, the best ranked."""
    one = renames.groupBy("ecosystem", F.col("original").alias("name")).agg(F.min("canonical").alias("canonical"))
    told = watchlist.join(one, ["ecosystem", "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))
    rest = [x for x in watchlist.columns if x not in ("ecosystem", "name", "rank")]
    best = told.groupBy("ecosystem", "canonical").agg(F.min(F.struct(F.col("canonical") != F.col("name"), "rank", "name", *rest)).alias("x"))
    return best.select("ecosystem", F.col("canonical").alias("name"), "x.rank", *(F.col(f"x.{x}") for x in rest))


def missing_from(wanted: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    return wanted.join(held.select(*keys).distinct(), list(keys), "left_anti")


def seed_merge(table: DataFrame, seeds: DataFrame) -> DataFrame:
    """Hash seeds into the fingerprint table: new ones are inserted, known ones get values only where they have none."""
    names = [x for x in table.columns if x != "sha256"]
    mine, theirs = table.select("sha256", *(F.col(x).alias(f"a_{x}") for x in names)), seeds.select("sha256", *(F.col(x).alias(f"b_{x}") for x in names))
    return mine.join(theirs, "sha256", "full").select("sha256", *(F.coalesce(f"a_{x}", f"b_{x}").alias(x) for x in names))


def hold_back(changes: DataFrame, unresolved: DataFrame, attempts: int = 5) -> DataFrame:
    """(cursor): the largest sequence seen, or one before the smallest that is still unresolved and not given up."""
    top = changes.agg(F.max("seq").alias("top"))
    held = unresolved.where(F.col("attempts") < attempts).agg(F.min("seq").alias("held"))
    return top.crossJoin(held).select(F.least(F.col("held") - 1, "top").alias("cursor"))  # two single rows


def candidate_batch(backlog: DataFrame, fresh: DataFrame, quota: int, overflow: int = 5000) -> DataFrame:
    """(name, seq, action) of one poll's candidates: up to half the quota from the backlog, oldest first, the rest fresh; what is left is carried over, the newest `overflow` at most."""
    both = backlog.select("name", "seq", F.lit(0).alias("kind")).unionByName(fresh.select("name", "seq", F.lit(1).alias("kind")))
    old = both.agg(F.least(F.count_if(F.col("kind") == 0), F.lit(quota // 2)).alias("old"))  # one row
    first = placed(both, [F.col("kind")], [F.col("seq"), F.col("name")]).crossJoin(F.broadcast(old))
    taken = F.when(F.col("kind") == 0, F.col("place") <= F.col("old")).otherwise(F.col("place") <= quota - F.col("old"))
    told = placed(first.select("name", "seq", taken.alias("taken")), [F.col("taken")], [F.desc("seq"), F.desc("name")], "age")
    return told.select("name", "seq", F.when(F.col("taken"), "check").when(F.col("age") <= overflow, "carry").otherwise("drop").alias("action"))


def within_budget(snippets: DataFrame, total: int = 48 << 10, each: int = 12 << 10) -> DataFrame:
    """(scan_id, path, length) of the pieces of source that fit a budget of characters: by priority and path, each cut to a maximum."""
    length = F.least(F.length("text"), F.lit(each))
    order = Window.partitionBy("scan_id").orderBy("priority", "path").rowsBetween(Window.unboundedPreceding, 0)
    return snippets.withColumn("length", length.cast("long")).withColumn("used", F.sum("length").over(order)).where(F.col("used") <= total).select("scan_id", "path", "length")
