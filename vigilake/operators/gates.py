"""Row-level decisions. Each is one ordered CASE, so the first condition that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.operators.scoring import is_shadow

# Categories that are no primary evidence; bars of evidence.
SECONDARY = ("iocs", "dep_intel", "metadata", "version_diff")
CONFIDENCE_FLOOR, CONFIDENCE_ALONE, HIGH_FIDELITY = 0.7, 0.8, 0.95


def ingest_priority(focus: Column, watched: Column, brand_new: Column, exclusive: bool = False) -> Column:
    """Null drops the package."""
    if exclusive:
        return F.when(focus, "high")
    return F.when(focus | watched, "high").when(brand_new, "normal")


def promoted(priority: Column, hook: Column, version: Column) -> Column:
    """Normal work becomes urgent with an install hook or an inflated version."""
    return F.when((priority == "normal") & (hook | suspicious_version(version)), "high").otherwise(priority)


def _parts(version: Column) -> Column:
    return F.split(F.substring_index(F.substring_index(F.regexp_replace(F.trim(version), "^v+", ""), "-", 1), "+", 1), r"\.")


def suspicious_version(version: Column) -> Column:
    """All nines, equal parts from 9 on, or a major version from 99 on."""
    parts = _parts(version)
    numeric = (F.size(parts) >= 2) & F.forall(parts, lambda x: x.rlike("^[0-9]{1,9}$"))
    first = F.try_element_at(parts, F.lit(1)).try_cast("int")
    return F.coalesce(numeric & (F.forall(parts, lambda x: x.rlike("^9+$")) | ((F.size(F.array_distinct(F.transform(parts, lambda x: x.try_cast("int")))) == 1) & (first >= 9)) | (first >= 99)), F.lit(False))


def confusion_version(version: Column) -> Column:
    """The same for findings, where majors that may be years don't count."""
    first = F.try_element_at(_parts(version), F.lit(1)).try_cast("int")
    inflated = F.array_distinct(F.transform(_parts(version), lambda x: x.try_cast("int")))
    nines = F.forall(_parts(version), lambda x: x.rlike("^9+$"))
    numeric = (F.size(_parts(version)) >= 2) & F.forall(_parts(version), lambda x: x.rlike("^[0-9]{1,9}$"))
    return F.coalesce(numeric & (nines | ((F.size(inflated) == 1) & (first >= 9)) | ((first >= 99) & (first < 1900))), F.lit(False))


def skips_change(name: Column, deleted: Column) -> Column:
    return name.isNull() | (F.length(name) == 0) | name.startswith("_design/") | F.coalesce(deleted, F.lit(False))


def scope_of(ecosystem: Column, name: Column) -> Column:
    """The scope that a name belongs to, or null where that would be too broad."""
    low = F.lower(name)
    npm = F.nullif(F.regexp_extract(low, r"^(@[^/]+)/", 1), F.lit(""))
    go = F.when(F.size(F.split(low, "/")) >= 2, F.substring_index(low, "/", 2))
    cut = lambda sep: F.when(F.instr(low, sep) > 2, F.substring_index(low, sep, 1))
    return F.when(ecosystem == "npm", npm).when(ecosystem == "gomod", go).when(ecosystem == "pypi", F.coalesce(cut("-"), cut("_"), cut(".")))


def scope_prefixes(ecosystem: Column, name: Column) -> Column:
    """Every scope that covers a name, as an array, so that scope membership is an equi-join rather than a theta join."""
    low = F.lower(name)
    by_slash = F.transform(F.sequence(F.lit(1), F.size(F.split(low, "/"))), lambda k: F.array_join(F.slice(F.split(low, "/"), F.lit(1), k), "/"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda k: F.substr(low, k, F.lit(1)).isin("-", "_", "."))
    by_sep = F.concat(F.array(low), F.transform(at, lambda k: F.substr(low, F.lit(1), k - 1)))
    return F.when(ecosystem.isin("npm", "gomod"), by_slash).when(ecosystem == "pypi", by_sep)


def in_scope(names: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows (ecosystem, name, …) that a scope (ecosystem, scope) covers."""
    keyed = names.withColumn("_row", F.monotonically_increasing_id())
    prefixes = names.select("ecosystem", "name").distinct().select("ecosystem", "name", F.explode(scope_prefixes(F.col("ecosystem"), F.col("name"))).alias("scope"))
    covered = prefixes.join(scopes.select("ecosystem", F.lower("scope").alias("scope")).distinct(), ["ecosystem", "scope"], "left_semi").select("ecosystem", "name").distinct()
    return keyed.join(covered, ["ecosystem", "name"], "left_semi").drop("_row")


def maintainer_watched(watch: DataFrame, scans: DataFrame, as_of: Column, days: int = 180, most: int = 3) -> DataFrame:
    """Watched names within their time and with under `most` distinct versions scanned since: (ecosystem, name, n_versions)."""
    since = watch.join(scans, ["ecosystem", "name"], "left").groupBy("ecosystem", "name", "added_at").agg(F.countDistinct(F.when(F.col("started_at") >= F.col("added_at"), F.col("version"))).alias("n_versions"))
    return since.where((F.col("added_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("n_versions") < most)).select("ecosystem", "name", "n_versions")


def detonates(verdict: Column, new: Column, watched: Column, chained: Column) -> Column:
    return F.when(new | watched, True).when((verdict == "malicious") & chained, False).otherwise(verdict.isin("suspicious", "malicious"))


def non_go_rows(findings: DataFrame, files: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Findings without the given rules where a Go module holds no Go file."""
    go = files.groupBy("scan_id").agg(F.bool_or((F.col("basename") == "go.mod") | F.col("path").endswith(".go")).alias("has_go"))
    return findings.join(go, "scan_id", "left").where(~(F.col("rule_id").isin(*rules) & ~F.coalesce("has_go", F.lit(False)))).drop("has_go")


def giant_scans(files: DataFrame, most_files: int = 5000, most_bytes: int = 100_000_000) -> DataFrame:
    """(scan_id, giant): scans that skip the costly features."""
    return files.groupBy("scan_id").agg(((F.count("*") > most_files) | (F.coalesce(F.sum("size"), F.lit(0)) > most_bytes)).alias("giant"))


def promotion_gate(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """(scan_id, qualifies, reason): whether a scan's evidence suffices to watch its package, rows (verdict, llm_verdict, llm_confidence)."""
    strong = findings.where(~is_shadow(F.col("rule_id")) & F.col("severity").isin("high", "critical")).groupBy("scan_id").agg(F.collect_set("category").alias("categories"))
    joined = scans.join(strong, "scan_id", "left")
    some = F.coalesce("categories", F.array().cast("array<string>"))
    primary = F.size(F.array_except(some, F.array(*map(F.lit, SECONDARY)))) > 0
    sure = F.coalesce("llm_confidence", F.lit(0.0))
    reason = (
        F.when(F.coalesce(F.col("llm_verdict") != "malicious", F.lit(True)), "not_malicious")
        .when(~primary & (F.size(some) < 2), "thin_evidence")
        .when(sure < CONFIDENCE_FLOOR, "low_confidence")
        .when((F.col("verdict") != "malicious") & (sure < CONFIDENCE_ALONE), "uncorroborated")
        .otherwise("ok")
    )
    return joined.select("scan_id", (reason == "ok").alias("qualifies"), reason.alias("reason"))


def trigger_eligible(findings: DataFrame, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> DataFrame:
    out = findings.where(~is_shadow(F.col("rule_id")) & F.col("severity").isin("high", "critical") & ~F.col("category").isin(*SECONDARY))
    if allow:
        out = out.where(F.col("rule_id").isin(*allow))
    return out.where(~F.col("rule_id").isin(*deny)) if deny else out


def high_fidelity(scans: DataFrame, findings: DataFrame, chains: frozenset[str]) -> DataFrame:
    """(scan_id, reason) of convictions that need no second one: a chain, a fingerprint, or a very sure triage."""
    flags = findings.groupBy("scan_id").agg(F.min(F.when(F.col("rule_id").isin(*sorted(chains)), F.col("rule_id"))).alias("chain"), F.bool_or(F.col("category") == "threat_intel").alias("intel"))
    told = scans.join(flags, "scan_id", "left")
    sure = (F.col("llm_verdict") == "malicious") & (F.col("llm_confidence") >= HIGH_FIDELITY)
    reason = F.when(F.col("chain").isNotNull(), F.concat(F.lit("chain:"), "chain")).when(F.col("intel"), "threat_intel").when(sure, "llm_confidence")
    return told.where(reason.isNotNull()).select("scan_id", reason.alias("reason"))


def true_iocs(claims: Column, source: Column, kinds: tuple[str, ...] = ("url", "domain", "ip", "hash", "email", "wallet", "path")) -> Column:
    """Claimed indicators, array<struct<type, value>>, of a known type that stand in the source literally."""
    return F.filter(claims, lambda x: x.type.isin(*kinds) & (F.length(x.value) > 0) & F.contains(source, x.value))
