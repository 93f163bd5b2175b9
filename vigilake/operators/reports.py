"""Operational reports over scans, findings and queues. Conditional aggregates, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("ecosystem", "status").agg(F.count("*").alias("n"))


def throughput(queue: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """(ecosystem, ingested, done, net) within so many minutes before a time."""
    since = as_of - F.expr(f"INTERVAL {minutes} MINUTES")
    ingested, done = F.count_if(F.col("enqueued_at").between(since, as_of)), F.count_if((F.col("status") == "done") & F.col("finished_at").between(since, as_of))
    return queue.groupBy("ecosystem").agg(ingested.alias("ingested"), done.alias("done"), (ingested - done).alias("net"))


def priority_counts(queue: DataFrame) -> DataFrame:
    """(ecosystem, high, normal, low) of pending rows."""
    pending = queue.where("status = 'pending'")
    return pending.groupBy("ecosystem").agg(*(F.count_if(F.col("priority") == p).alias(p) for p in ("high", "normal", "low")))


def rule_precision(findings: DataFrame, outcomes: DataFrame, least: int = 5, floor: float = 0.9, spared: tuple[str, ...] = ()) -> DataFrame:
    """(rule_id, confirmed, cleared, ambiguous, precision, deny) of rules, by what triage made of the scans they fired in.

    Rules with enough decided scans and a precision under the floor are to be denied, apart from spared ones.
    """
    fired = findings.select("rule_id", "scan_id").distinct().join(outcomes, "scan_id")
    told = fired.groupBy("rule_id").agg(
        F.count_if(F.col("llm_verdict") == "malicious").alias("confirmed"), F.count_if(F.col("llm_verdict") == "benign").alias("cleared"),
        F.count_if(F.coalesce(~F.col("llm_verdict").isin("malicious", "benign"), F.lit(True))).alias("ambiguous"),
    )
    decided = F.col("confirmed") + F.col("cleared")
    precision = F.when(decided > 0, F.round(F.col("confirmed") / decided, 6))
    deny = (decided >= least) & (precision < floor) & ~F.col("rule_id").isin(*spared)
    return told.withColumn("precision", precision).withColumn("deny", F.coalesce(deny, F.lit(False)))


def transitions(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(was, now, n, n_score): how often a replay gives another verdict, and how often another score."""
    both = stored.select("scan_id", F.col("verdict").alias("was"), F.col("score").alias("old")).join(recomputed.select("scan_id", F.col("verdict").alias("now"), "score"), "scan_id")
    return both.groupBy("was", "now").agg(F.count("*").alias("n"), F.count_if(F.col("old") != F.col("score")).alias("n_score"))


def review_queue(scans: DataFrame, versions: DataFrame, packages: DataFrame, limit: int = 50) -> DataFrame:
    """The newest inconclusive scans with their package and version. The limit is the report's."""
    told = scans.where("verdict = 'inconclusive'").join(versions, "version_id").join(packages, "package_id")
    return told.orderBy(F.desc("finished_at"), F.desc("scan_id")).limit(limit).select("scan_id", "ecosystem", "name", "version", "score")


def promotion_candidates(scans: DataFrame, findings: DataFrame, secondary: tuple[str, ...], shadow: str) -> DataFrame:
    """(ecosystem, name, n) of malicious scans with a strong primary finding that isn't on trial."""
    strong = findings.where(F.col("severity").isin("high", "critical") & ~F.col("category").isin(*secondary) & ~F.startswith("rule_id", F.lit(shadow)))
    return scans.where("verdict = 'malicious'").join(strong.select("scan_id"), "scan_id", "left_semi").groupBy("ecosystem", "name").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Of each key the row with the latest time, the largest id deciding ties."""
    names = [x for x in rows.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(at, tie)).alias("x")).select(*keys, "x.*")


def campaign_counts(fingerprints: DataFrame) -> DataFrame:
    """(campaign, n, n_exact_only, n_auto)."""
    return fingerprints.groupBy("campaign").agg(
        F.count("*").alias("n"), F.count_if(F.col("ssdeep").isNull() & F.col("tlsh").isNull()).alias("n_exact_only"), F.count_if(F.col("source").startswith("auto")).alias("n_auto")
    )


def of_campaign(campaign: str) -> Column:
    """Rows of a campaign: by its whole name, or by the package alone that automatic seeds were named after."""
    return F.col("campaign") == campaign if campaign.startswith("auto:") else F.col("campaign").like(f"auto:%:{campaign}")


def promote_campaign(fingerprints: DataFrame, campaign: str) -> DataFrame:
    """Fingerprints in which a campaign's automatic seeds are promoted: they match near copies from then on."""
    auto = F.coalesce((F.col("source") == "auto") & of_campaign(campaign), F.lit(False))
    return fingerprints.withColumn("source", F.when(auto, "promoted").otherwise(F.col("source")))


def remove_campaign(fingerprints: DataFrame, campaign: str) -> DataFrame:
    """Fingerprints without a campaign's seeds, automatic or promoted; those entered by hand stay."""
    return fingerprints.where(~F.coalesce(F.col("source").isin("auto", "promoted") & of_campaign(campaign), F.lit(False)))


def seed_candidates(findings: DataFrame, files: DataFrame, known: DataFrame, most: int = 25, entropy: float = 7.2) -> DataFrame:
    """(scan_id, sha256, path): files of strong findings that may become fingerprints: not known, not near random, at most so many of a scan."""
    strong = findings.where(F.col("severity").isin("high", "critical")).select("scan_id", F.col("file").alias("path")).distinct()
    fresh = files.join(strong, ["scan_id", "path"], "left_semi").where(F.coalesce("entropy", F.lit(0.0)) < entropy).join(known.select("sha256").distinct(), "sha256", "left_anti")
    one = fresh.groupBy("scan_id", "sha256").agg(F.min("path").alias("path"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy("path", "sha256"))).where(F.col("place") <= most).drop("place")


def source_coverage(scans: DataFrame) -> DataFrame:
    """(ecosystem, n_without, n): triaged scans, and those whose reasoning says that there was no source."""
    return scans.where(F.col("llm_reasoning").isNotNull()).groupBy("ecosystem").agg(F.count_if(F.lower("llm_reasoning").like("%no source%")).alias("n_without"), F.count("*").alias("n"))


def triage_listing(asked: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """(ecosystem, name, scan_id, n_scans, columns of findings): of each package the newest scan that triage found malicious, else the newest, with its findings."""
    keys = ["ecosystem", "name"]
    order = F.struct(F.coalesce(F.col("llm_verdict") == "malicious", F.lit(False)), "finished_at", "scan_id")
    chosen = scans.join(asked.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.max_by("scan_id", order).alias("scan_id"), F.count("*").alias("n_scans"))
    return chosen.join(findings, "scan_id").select(*keys, "scan_id", "n_scans", *(x for x in findings.columns if x != "scan_id"))


def publishers(scans: DataFrame, versions: DataFrame) -> DataFrame:
    """(scan_id, author, author_email, maintainers, upload_user) of scans whose version names any of them, rows (scan_id, version_id) and (version_id, ...)."""
    names = ["author", "author_email", "maintainers", "upload_user"]
    told = scans.select("scan_id", "version_id").join(versions.select("version_id", *names), "version_id")
    return told.where(F.length(F.concat_ws("", *names)) > 0).select("scan_id", *names)


def entries(rows: DataFrame, order: str, **equal: str) -> DataFrame:
    """A list's entries in order, those alone that have the given values."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(order)
