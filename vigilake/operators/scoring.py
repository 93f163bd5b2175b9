"""Scores and verdicts of scans. Two aggregations on the scan, the first combined before the shuffle."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.intel import BASELINE, SHADOW_PREFIX, Pack


def is_shadow(rule: Column) -> Column:
    """Rules on trial: observed, never scored."""
    return rule.startswith(SHADOW_PREFIX)


def points(severity: Column, pack: Pack = BASELINE) -> Column:
    """Points of a severity; unknown ones have none."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pack.points.items()))
    return F.coalesce(table[severity], F.lit(0))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def scan_scores(findings: DataFrame, pack: Pack = BASELINE) -> DataFrame:
    """(scan_id, score, flags): the points of a category are capped, and dynamic findings are capped by rule instead."""
    live = findings.where(~is_shadow(F.coalesce("rule_id", F.lit(""))))
    key = F.when(F.col("category") == "dynamic", F.col("rule_id")).otherwise(F.col("category"))
    by_key = live.groupBy("scan_id", key.alias("key")).agg(
        F.least(F.sum(points(F.col("severity"), pack)), F.lit(pack.thresholds["category_cap"])).alias("part"),
        F.max(severity_rank(F.col("severity"))).alias("rank"),
        F.bool_or(F.col("rule_id").isin(*sorted(pack.chains))).alias("chain"),
    )
    return by_key.groupBy("scan_id").agg(F.sum("part").alias("score"), F.max("rank").alias("rank"), F.bool_or("chain").alias("chain"))


def verdicts(scans: DataFrame, findings: DataFrame, pack: Pack = BASELINE) -> DataFrame:
    """(scan_id, score, verdict, alert_tag) for rows (scan_id, watchlist_rank, null if not watched). Scans without findings are clean."""
    scored = scans.join(scan_scores(findings, pack), "scan_id", "left")
    score, rank, chained = F.coalesce("score", F.lit(0)), F.coalesce("rank", F.lit(0)), F.coalesce("chain", F.lit(False))
    limits = pack.thresholds
    plain = (
        F.when(chained | (rank == 4) | (score >= limits["malicious_min"]), "malicious")
        .when((rank >= 3) | (score >= limits["suspicious_min"]), "suspicious")
        .otherwise("clean")
    )
    watched = F.col("watchlist_rank").isNotNull()
    raised = F.when(watched & (plain == "clean") & (rank >= 2), "suspicious").otherwise(plain)
    top = (F.col("watchlist_rank") <= 100) & (rank >= 3)
    return scored.select(
        "scan_id",
        score.cast("long").alias("score"),
        F.when(top, "malicious").otherwise(raised).alias("verdict"),
        F.when(top, "watchlist_top100").alias("alert_tag"),
    )


def top_findings(findings: DataFrame, limit: int = 8) -> DataFrame:
    """Findings of a scan grouped by rule and evidence: count, places, the worst representative; the first `limit`, and how many more there are."""
    from pyspark.sql import Window

    confidence = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    grouped = findings.groupBy("scan_id", "rule_id", "evidence").agg(
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "file", "line"))), ",").alias("places"),
        F.max(F.struct(severity_rank(F.col("severity")).alias("s"), confidence.alias("c"), "severity")).alias("worst"),
    )
    order = Window.partitionBy("scan_id").orderBy(F.desc("worst.s"), F.desc("worst.c"), "rule_id", "evidence")
    total = Window.partitionBy("scan_id")
    placed = grouped.withColumn("place", F.row_number().over(order)).withColumn("more", F.greatest(F.count("*").over(total) - limit, F.lit(0)))
    return placed.where(F.col("place") <= limit).select("scan_id", "rule_id", "evidence", "n", "places", F.col("worst.severity").alias("severity"), "place", "more")


def rule_hits(findings: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(rule_id, count) of findings, added to earlier counts."""
    now = findings.groupBy("rule_id").agg(F.count("*").alias("count"))
    return now if counted is None else now.unionByName(counted.select("rule_id", "count")).groupBy("rule_id").agg(F.sum("count").alias("count"))


def final_verdicts(scans: DataFrame, floor: float = 0.7, clear_at: float = 0.80) -> DataFrame:
    """(… , final_verdict, final_tag, alert) of rows (verdict, llm_verdict, llm_confidence, injection, exact_intel, chain, alert_tag).

    A triage result replaces a verdict, but an injection finding blocks a benign one, an exact hash match is never cleared, a chain
    only at high confidence, and malicious is only added at a confidence of `floor` or more.
    """
    rule, told, sure = F.col("verdict"), F.col("llm_verdict"), F.coalesce("llm_confidence", F.lit(0.0))
    lower = F.coalesce(told.isin("benign", "suspicious"), F.lit(False))
    told = F.when(F.coalesce("injection", F.lit(False)) & (told == "benign") & rule.isin("malicious", "suspicious"), rule).otherwise(told)
    # After the injection guard the triage verdict is read anew.
    scans = scans.withColumn("_told", told)
    told = F.col("_told")
    lower = F.coalesce(told.isin("benign", "suspicious"), F.lit(False))
    bad = rule == "malicious"
    final = (
        F.when(bad & F.coalesce("exact_intel", F.lit(False)), "malicious")
        .when(bad & F.coalesce("chain", F.lit(False)) & lower & (sure >= clear_at), told)
        .when(bad & F.coalesce("chain", F.lit(False)), "malicious")
        .when((told == "malicious") & (sure < floor) & ~bad, rule)
        .when(told.isin("malicious", "suspicious", "benign"), told)
        .when((told == "inconclusive") & ~bad, "inconclusive")
        .otherwise(rule)
    )
    is_told_bad = F.coalesce(told == "malicious", F.lit(False))
    tag = F.coalesce("alert_tag", F.when(final == "inconclusive", "needs_review").when(~lower & ~is_told_bad, "llm_unverified"))
    alert = (bad & ~lower) | (is_told_bad & (sure >= floor))
    return scans.withColumns({"final_verdict": final, "final_tag": tag, "alert": alert}).drop("_told")


def kept_archives(scans: DataFrame) -> DataFrame:
    """Rows (verdict, llm_verdict) with `keep`: the archive is put aside if triage found it malicious, or the rules did and triage didn't answer."""
    told = F.coalesce(F.col("llm_verdict") == "malicious", F.lit(False))
    return scans.withColumn("keep", told | ((F.col("verdict") == "malicious") & F.col("llm_verdict").isNull()))
