"""Findings of release metadata, and of joins that compare a release with what is known of others. All have one shape, so that they reach the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.operators import gates

# Hosts of code forges, and shapes of hosts that imitate them.
FORGES = ("github.com", "gitlab.com", "bitbucket.org", "gitea.com", "codeberg.org", "gitee.com", "git.sr.ht", "code.gitea.io", "code.forgejo.org", "git.kernel.org", "android.googlesource.com")
FORGE_DOMAINS = r"\.(?:github\.com|gitlab\.com|bitbucket\.org|googlesource\.com)$"
NUMERIC_FORGE = r"(?i)^(?:gh|git|github|gitlab|hub|go)\.\d{3,}\."
EPHEMERAL_HOST = r"(?i)\.(?:workers\.dev|pages\.dev)$"
RAPID_HOURS = 24


def finding(rule: str, severity: str, confidence: str, fires: Column, evidence: Column) -> Column:
    said = F.struct(F.lit(rule).alias("rule_id"), F.lit(rule.split(".")[0]).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit("").alias("file"), F.coalesce(evidence, F.lit("")).alias("evidence"))
    return F.when(F.coalesce(fires, F.lit(False)), said)


def imitates_forge(name: Column) -> Column:
    """A module path whose host looks like a code forge and isn't one."""
    host = F.trim(F.lower(F.split_part(name, F.lit("/"), F.lit(1))))
    shaped = F.contains(name, F.lit("/")) & F.contains(host, F.lit(".")) & ~host.isin(*FORGES) & ~host.rlike(FORGE_DOMAINS)
    return shaped & (host.rlike(EPHEMERAL_HOST) & host.rlike("github|gitlab|gh|git") | host.rlike(NUMERIC_FORGE))


def metadata_findings(releases: DataFrame) -> DataFrame:
    """(scan_id, rule_id, category, severity, confidence, file, evidence) of rows (scan_id, name, version, published_at, prev_published_at, maintainers, prev_maintainers).

    The version is inflated, the previous release is less than a day old, maintainers came or went (where both sides name any), the host imitates a forge.
    Nulls fire nothing.
    """
    low = lambda x: F.transform(x, lambda m: F.lower(m))
    now, before = low(F.col("maintainers")), low(F.col("prev_maintainers"))
    moved = (F.size(F.array_except(now, before)) > 0) | (F.size(F.array_except(before, now)) > 0)
    gap = F.col("published_at") - F.col("prev_published_at")
    each = F.array(
        finding("metadata.dependency_confusion_version", "low", "medium", gates.confusion_version(F.col("version")), F.col("version")),
        finding("metadata.rapid_release", "medium", "medium", gap < F.expr(f"INTERVAL {RAPID_HOURS} HOURS"), F.col("version")),
        finding("metadata.maintainer_change", "medium", "high", (F.size("maintainers") > 0) & (F.size("prev_maintainers") > 0) & moved, F.array_join(F.array_sort(now), ",")),
        finding("metadata.gomod_impersonating_forge_host", "high", "high", imitates_forge(F.col("name")), F.split_part("name", F.lit("/"), F.lit(1))),
    )
    return releases.select("scan_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("scan_id", "x.*")


def as_findings(rows: DataFrame, rule: str, severity: Column, confidence: str, file: Column, evidence: Column, scan: str = "scan_id") -> DataFrame:
    """Rows of a comparison as findings: archive mismatches, bad dependencies, jumps of entropy, downloads that don't match their hash."""
    return rows.select(
        F.col(scan).alias("scan_id"), F.lit(rule).alias("rule_id"), F.lit(rule.split(".")[0]).alias("category"), severity.alias("severity"), F.lit(confidence).alias("confidence"), file.alias("file"),
        F.substring(evidence.cast("string"), 1, 200).alias("evidence"),
    )


def mismatch_findings(mismatches: DataFrame) -> DataFrame:
    """Of history.archive_mismatch(), its package being a scan."""
    return as_findings(mismatches, "metadata.sdist_wheel_mismatch", F.lit("low"), "low", F.lit(""), F.col("missing"), "package")


def dependency_findings(bad: DataFrame) -> DataFrame:
    """Of matching.bad_dependencies(), its package being a scan."""
    return as_findings(bad, "dep_intel.depends_on_known_malicious", F.col("severity"), "high", F.lit(""), F.col("dependency"), "package")


def entropy_findings(jumps: DataFrame) -> DataFrame:
    """Of history.entropy_jumps()."""
    return as_findings(jumps, "entropy.suspicious_jump", F.lit("high"), "medium", F.col("path"), F.col("delta"))


def download_findings(downloads: DataFrame) -> DataFrame:
    """Of archives.verified(), rows (scan_id, path, intact, n_files): downloads that don't match their hash, releases without files."""
    wrong = as_findings(downloads.where("NOT intact AND n_files > 0"), "fetch.sha256_mismatch", F.lit("critical"), "high", F.col("path"), F.lit("the download differs from its hash"))
    return wrong.unionByName(as_findings(downloads.where("n_files = 0"), "fetch.no_release_files", F.lit("low"), "high", F.lit(""), F.lit("a release without files")))
