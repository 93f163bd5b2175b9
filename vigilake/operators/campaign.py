"""From convictions to watch lists: maintainers, promotions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.intel import SENTINEL_RANK
from vigilake.operators.limits import admitted

# Limits of the maintainer sweep and of promotions.
MOST_PACKAGES, CORRELATED, CORRELATION_DAYS, DEDUP_SECONDS, ADDS_PER_HOUR = 100, 2, 30, 3600, 100
SUPPORTED = ("pypi", "npm")


def double_confirmed(scans: DataFrame, since: Column) -> DataFrame:
    """(ecosystem, name) that both the rules and the triage found malicious since a time."""
    return scans.where((F.col("verdict") == "malicious") & (F.col("llm_verdict") == "malicious") & (F.col("finished_at") >= since)).select("ecosystem", "name").distinct()


def sweep_decisions(convictions: DataFrame, catalog: DataFrame, confirmed: DataFrame, *, enabled: bool = True) -> DataFrame:
    """(scan_id, action, n_confirmed, n_clean) of rows (scan_id, ecosystem, name, maintainer, high_fidelity, evidence, blocked, swept_recently).

    catalog has (ecosystem, maintainer, name), confirmed has (ecosystem, name). Siblings are the maintainer's other packages.
    """
    owned = catalog.select("ecosystem", "maintainer", "name").distinct()
    marked = owned.join(confirmed.select("ecosystem", "name").distinct().withColumn("bad", F.lit(True)), ["ecosystem", "name"], "left")
    totals = marked.groupBy("ecosystem", "maintainer").agg(F.count("*").alias("n_all"), F.count_if(F.coalesce("bad", F.lit(False))).alias("n_bad"))
    own = marked.select("ecosystem", "maintainer", "name", F.lit(1).alias("own"), F.coalesce("bad", F.lit(False)).cast("int").alias("own_bad"))
    told = convictions.join(totals, ["ecosystem", "maintainer"], "left").join(own, ["ecosystem", "maintainer", "name"], "left")
    bad = F.coalesce("n_bad", F.lit(0)) - F.coalesce("own_bad", F.lit(0))
    clean = F.coalesce("n_all", F.lit(0)) - F.coalesce("own", F.lit(0)) - bad
    action = (
        F.when(F.lit(not enabled), "disabled")
        .when(~F.col("ecosystem").isin(*SUPPORTED), "unsupported")
        .when(F.col("blocked"), "blocklisted")
        .when(~F.col("evidence"), "no_evidence")
        .when(F.col("maintainer").isNull(), "no_maintainer")
        .when(F.col("swept_recently"), "deduped")
        .when(F.coalesce("n_all", F.lit(0)) > MOST_PACKAGES, "too_many")
        .when(~F.col("high_fidelity") & (bad < CORRELATED), "no_correlation")
        .otherwise("triggered")
    )
    return told.select("scan_id", action.alias("action"), bad.cast("long").alias("n_confirmed"), clean.cast("long").alias("n_clean"))


def clean_siblings(triggered: DataFrame, catalog: DataFrame, malicious: DataFrame) -> DataFrame:
    """(ecosystem, name) to watch: the packages of swept maintainers that are neither the convicted one nor malicious."""
    siblings = triggered.select("ecosystem", "maintainer", F.col("name").alias("convicted")).join(catalog, ["ecosystem", "maintainer"]).where("name <> convicted")
    return siblings.select("ecosystem", "name").distinct().join(malicious.select("ecosystem", "name"), ["ecosystem", "name"], "left_anti")


def deduped_sweeps(sweeps: DataFrame, seconds: int = DEDUP_SECONDS) -> DataFrame:
    """(…, first): sweeps by whether no sweep that went through came from the same maintainer, in whatever case, within the time before."""
    return admitted(sweeps, ["ecosystem", "maintainer"], "at", "scan_id", seconds, 1, closed=False).withColumnRenamed("allowed", "first")


def promotion_status(candidates: DataFrame, watchlist: DataFrame, blocked: DataFrame, *, enabled: bool = True, per_hour: int = ADDS_PER_HOUR) -> DataFrame:
    """(ecosystem, name, status) of rows (ecosystem, name, at): what adding a confirmed-malicious name to the watch list does. At most `per_hour` are added to an
    ecosystem in any hour; 0 or less sets no limit."""
    held = watchlist.groupBy("ecosystem", "name").agg(F.max(F.col("rank") == SENTINEL_RANK).alias("sentinel"))
    told = candidates.join(held, ["ecosystem", "name"], "left").join(blocked.select("ecosystem", "name").distinct().withColumn("barred", F.lit(True)), ["ecosystem", "name"], "left")
    plain = (
        F.when(F.lit(not enabled), "disabled")
        .when(F.coalesce("barred", F.lit(False)), "blocklisted")
        .when(F.col("sentinel"), "refreshed")
        .when(F.col("sentinel").isNotNull(), "already_popularity")
    )
    known = told.select("ecosystem", "name", "at", plain.alias("known"))
    fresh = known.where("known IS NULL").drop("known")
    new = admitted(fresh, ["ecosystem"], "at", "name", 3600, per_hour) if per_hour > 0 else fresh.withColumn("allowed", F.lit(True))
    added = new.select("ecosystem", "name", F.when(F.col("allowed"), "added").otherwise("rate_limited").alias("status"))
    return known.where("known IS NOT NULL").select("ecosystem", "name", F.col("known").alias("status")).unionByName(added)


def watchlist_audit(watched: DataFrame, scans: DataFrame, findings: DataFrame, secondary: tuple[str, ...]) -> DataFrame:
    """(ecosystem, name, status): whether the latest scan that a triage found malicious bears a watched name out: genuine, thin or no_scan."""
    latest = scans.where("llm_verdict = 'malicious'").groupBy("ecosystem", "name").agg(F.max_by("scan_id", F.struct("finished_at", "scan_id")).alias("scan_id"))
    strong = findings.where(F.col("severity").isin("high", "critical")).groupBy("scan_id").agg(F.collect_set("category").alias("categories"))
    told = watched.select("ecosystem", "name").join(latest, ["ecosystem", "name"], "left").join(strong, "scan_id", "left")
    some = F.coalesce("categories", F.array().cast("array<string>"))
    genuine = (F.size(F.array_except(some, F.array(*map(F.lit, secondary)))) > 0) | (F.size(some) >= 2)
    return told.select("ecosystem", "name", F.when(F.col("scan_id").isNull(), "no_scan").when(genuine, "genuine").otherwise("thin").alias("status"))
