"""Versions against their predecessors, files against earlier scans. Windows and equi-joins on the package or scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the version anomaly gate.
SIZE_RATIO, MIN_DELTA, BIG_DELTA, MIN_BASE = 3.0, 256 * 1024, 50 * 1024, 256 * 1024
ENTROPY_JUMP = 1.5
#: Fixed value: days after which an earlier scan's findings are no longer carried forward.
REUSE_DAYS = 7


def version_anomalies(versions: DataFrame, *, min_delta: float = MIN_DELTA, big_delta: float = BIG_DELTA, min_base: float = MIN_BASE) -> DataFrame:
    """(ecosystem, name, version, flags, priority): the newest version by publish time against the one before it, where something stands out."""
    order = Window.partitionBy("ecosystem", "name").orderBy("published_at", "version")
    back = Window.partitionBy("ecosystem", "name").orderBy(F.desc("published_at"), F.desc("version"))
    held = versions.withColumns({f"prev_{c}": F.lag(c).over(order) for c in ("size", "publisher", "hook", "version")}).withColumn("age", F.row_number().over(back))
    newest = held.where((F.col("age") == 1) & F.col("prev_version").isNotNull())
    grown = F.col("size") - F.col("prev_size")
    flags = F.filter(
        F.array(
            F.when(F.col("hook") & ~F.coalesce("prev_hook", F.lit(False)), "hook_added"),
            F.when((F.col("prev_size") > 0) & (F.col("size") >= SIZE_RATIO * F.col("prev_size")) & (grown >= min_delta), "size_jump"),
            F.when((F.col("prev_size") >= min_base) & (grown >= big_delta), "size_delta"),
            F.when(F.col("publisher").isNotNull() & F.col("prev_publisher").isNotNull() & (F.col("publisher") != F.col("prev_publisher")), "publisher_change"),
        ),
        lambda x: x.isNotNull(),
    )
    priority = F.when(F.array_contains("flags", "hook_added") | (F.size("flags") >= 2), "high").otherwise("normal")
    return newest.withColumn("flags", flags).where(F.size("flags") > 0).select("ecosystem", "name", "version", F.array_join("flags", ",").alias("flags"), priority.alias("priority"))


def packument_anomalies(versions: DataFrame) -> DataFrame:
    """(name, version, flags, priority) of rows (name, version, published_at, scripts map, size, file_count, publisher): install hooks added or changed,
    hooks that run a bundled file, jumps of size and of file count (the latter never alone), a new publisher."""
    hooks = F.map_filter(F.coalesce("scripts", F.expr("map()").cast("map<string,string>")), lambda k, _: k.isin("preinstall", "install", "postinstall"))
    order = Window.partitionBy("name").orderBy("published_at", "version")
    back = Window.partitionBy("name").orderBy(F.desc("published_at"), F.desc("version"))
    rows = versions.withColumn("hooks", hooks)
    rows = rows.withColumns({f"prev_{c}": F.lag(c).over(order) for c in ("hooks", "size", "file_count", "publisher", "version")}).withColumn("age", F.row_number().over(back))
    newest = rows.where((F.col("age") == 1) & F.col("prev_version").isNotNull())
    old, now = F.col("prev_hooks"), F.col("hooks")
    added = F.size(F.array_except(F.map_keys(now), F.map_keys(old))) > 0
    changed = F.size(F.filter(F.map_keys(now), lambda k: old[k].isNotNull() & (old[k] != now[k]))) > 0
    bundled = F.exists(F.map_values(now), lambda x: x.rlike(r"(?:^|[\s;&|])(?:\./|(?:node|sh|bash|python3?)\s+(?!-))[\w./-]+"))
    flags = F.filter(
        F.array(
            F.when(added, "hook_added"), F.when(changed, "hook_changed"), F.when((added | changed) & bundled, "bundled_exec"),
            F.when((F.col("prev_size") > 0) & (F.col("size") >= 3 * F.col("prev_size")), "size_jump"),
            F.when((F.col("prev_file_count") > 0) & (F.col("file_count") >= 3 * F.col("prev_file_count")), "file_count_jump"),
            F.when(F.col("publisher") != F.col("prev_publisher"), "publisher_change"),
        ),
        lambda x: x.isNotNull(),
    )
    told = newest.withColumn("flags", flags).where((F.size("flags") > 0) & ~((F.size("flags") == 1) & F.array_contains("flags", "file_count_jump")))
    strong = F.arrays_overlap("flags", F.array(*map(F.lit, ("hook_added", "hook_changed", "bundled_exec"))))
    return told.select("name", "version", F.array_join("flags", ",").alias("flags"), F.when(strong | (F.size("flags") >= 2), "high").otherwise("normal").alias("priority"))


def new_bad_edges(versions: DataFrame, known_bad: DataFrame) -> DataFrame:
    """(name, version, dependency): a confirmed-bad dependency that the newest version declares and its predecessor didn't; the first by name."""
    order = Window.partitionBy("name").orderBy("published_at", "version")
    back = Window.partitionBy("name").orderBy(F.desc("published_at"), F.desc("version"))
    rows = versions.withColumn("before", F.lag("deps").over(order)).withColumn("age", F.row_number().over(back)).where("age = 1")
    fresh = rows.select("name", "version", F.explode(F.array_except("deps", F.coalesce("before", F.array().cast("array<string>")))).alias("dependency"))
    return fresh.join(known_bad.select(F.col("name").alias("dependency")).distinct(), "dependency", "left_semi").groupBy("name", "version").agg(F.min("dependency").alias("dependency"))


def normal_path(path: Column, archive_kind: Column) -> Column:
    """Archives whose files lie in one top folder lose it."""
    return F.when(archive_kind.isin("sdist", "crate", "gomod_zip", "npm_tarball"), F.regexp_replace(path, "^[^/]+/", "")).otherwise(path)


def finding_path(path: Column) -> Column:
    """The path of a finding as the file table has it: without the top folder of npm archives."""
    return F.regexp_replace(path, "^package/", "")


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(scan_id, archive_kind, path, sha256, entropy) of files that are new or differ from the package's previous scan, joined by (package, kind, path)."""
    old = previous.select("package", "archive_kind", "path", F.col("sha256").alias("old_sha"), F.col("entropy").alias("old_entropy"))
    return current.join(old, ["package", "archive_kind", "path"], "left").where(F.col("old_sha").isNull() | (F.col("old_sha") != F.col("sha256")))


def entropy_jumps(current: DataFrame, previous: DataFrame, jump: float = ENTROPY_JUMP) -> DataFrame:
    """(…, delta) of files that changed and whose entropy rose by `jump` bits or more; both entropies must be known."""
    both = changed_files(current, previous).where("old_sha IS NOT NULL AND entropy > 0 AND old_entropy > 0")
    return both.withColumn("delta", F.round(F.col("entropy") - F.col("old_entropy"), 6)).where(F.col("delta") >= jump)


def finding_set_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(package, new_rules, new_critical, prev_clean, findings) of the rules of two scans, rows (package, rule_id, severity)."""

    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("package").agg(F.collect_set("rule_id").alias(f"{name}_rules"), F.collect_set(F.when(F.col("severity") == "critical", F.col("rule_id"))).alias(f"{name}_critical"))

    none = F.array().cast("array<string>")
    both = sets(current, "cur").join(sets(previous, "prev"), "package", "left")
    fresh = F.array_sort(F.array_except("cur_rules", F.coalesce("prev_rules", none)))
    critical = F.array_sort(F.array_except("cur_critical", F.coalesce("prev_rules", none)))
    clean = F.coalesce(F.size("prev_rules"), F.lit(0)) == 0
    return both.select(
        "package", F.array_join(fresh, ",").alias("new_rules"), F.array_join(critical, ",").alias("new_critical"), clean.alias("prev_clean"),
        F.when(clean & (F.size(critical) > 0), "version_diff.clean_to_critical").when(clean & (F.size(fresh) > 0), "version_diff.new_rules_fired").alias("rule_id"),
    )


def metadata_diff(pairs: DataFrame) -> DataFrame:
    """(package, rule_id, severity) of rows (author, author_email, deps and their prev_ forms): a changed author, a spike of dependencies."""

    def who(prefix: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.nullif(F.col(prefix + "author_email"), F.lit("")), F.col(prefix + "author"))))

    author = who("").isNotNull() & who("prev_").isNotNull() & (who("") != who("prev_")) & (F.length(who("")) > 0) & (F.length(who("prev_")) > 0)
    fresh = F.size(F.array_except("deps", "prev_deps"))
    spike = (fresh >= 3) & (fresh > 0.5 * F.size("prev_deps"))
    each = F.array(
        F.when(author, F.struct(F.lit("version_diff.author_changed").alias("rule_id"), F.lit("high").alias("severity"))),
        F.when(spike, F.struct(F.lit("version_diff.dependency_spike").alias("rule_id"), F.lit("medium").alias("severity"))),
    )
    return pairs.select("package", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("package", "x.*")


def prior_scans(scans: DataFrame, current: DataFrame, as_of: Column, days: int = REUSE_DAYS) -> DataFrame:
    """(ecosystem, name, scan_id, prior_id): for each current scan the package's newest other scan that ended within so many days before; without one no row."""
    recent = scans.where(F.col("finished_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).select("ecosystem", "name", F.col("scan_id").alias("prior_id"), "finished_at")
    both = current.select("ecosystem", "name", "scan_id").join(recent, ["ecosystem", "name"]).where("prior_id <> scan_id")
    return both.groupBy("ecosystem", "name", "scan_id").agg(F.max_by("prior_id", F.struct("finished_at", "prior_id")).alias("prior_id"))


def carry_forward(prior_findings: DataFrame, prior_files: DataFrame, current_files: DataFrame, current_findings: DataFrame) -> DataFrame:
    """Findings of a package's prior scan whose file is unchanged now, and which the current scan doesn't have itself.

    Files are compared without npm's top folder. A finding also counts by its base name, if every current file of that name is unchanged.
    Of findings of one rule in one file the first by its path as written stays; findings without a file don't count.
    """
    base = lambda column: F.substring_index(column, "/", -1)
    old = prior_files.select("package", "path", F.col("sha256").alias("old"))
    paired = current_files.select("package", "path", "sha256").join(old, ["package", "path"], "left").withColumn("same", F.coalesce(F.col("sha256") == F.col("old"), F.lit(False)))
    by_path = paired.where("same").select("package", F.col("path").alias("_norm")).distinct().withColumn("_path", F.lit(True))
    by_base = paired.groupBy("package", base("path").alias("_base")).agg(F.bool_and("same").alias("_all")).where("_all")
    told = prior_findings.where("file <> ''").withColumn("_norm", finding_path(F.col("file"))).withColumn("_base", base("_norm"))
    kept = told.join(by_path, ["package", "_norm"], "left").join(by_base, ["package", "_base"], "left").where("_path OR _all")
    held = current_findings.select("package", "rule_id", finding_path(F.coalesce("file", F.lit(""))).alias("_norm")).distinct()
    rest = [x for x in prior_findings.columns if x not in ("package", "rule_id")]
    one = kept.join(held, ["package", "rule_id", "_norm"], "left_anti").groupBy("package", "rule_id", "_norm").agg(F.min_by(F.struct(*rest), "file").alias("x"))
    return one.select("package", "rule_id", *(F.col(f"x.{x}") for x in rest))


def noise_cap(findings: DataFrame, keep: int = 3) -> DataFrame:
    """Of each scan and weak rule the first `keep` files by path, and one row that sums up the rest where there are more."""
    order = Window.partitionBy("scan_id", "rule_id").orderBy("file", "finding_id")
    total = Window.partitionBy("scan_id", "rule_id")
    placed = findings.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(total))
    kept = placed.where(F.col("place") <= keep).select("scan_id", "rule_id", "file", F.lit(None).cast("long").alias("more"))
    summed = placed.where((F.col("place") == 1) & (F.col("n") > keep)).select("scan_id", "rule_id", F.lit("").alias("file"), (F.col("n") - keep).alias("more"))
    return kept.unionByName(summed)


def archive_mismatch(files: DataFrame, first: int = 5) -> DataFrame:
    """(package, missing): code files that a wheel has and its sdist lacks, rows (package, archive_kind, path); packages with both kinds only."""
    own = files.where(~F.col("path").rlike(r"\.(?:dist-info|data)/") & F.col("path").rlike(r"\.(?:py|so|pyd|pyz)$"))
    names = own.groupBy("package").agg(*(F.collect_set(F.when(F.col("archive_kind") == k, F.substring_index("path", "/", -1))).alias(k) for k in ("wheel", "sdist")))
    extra = F.array_sort(F.array_except(F.array_except("wheel", "sdist"), F.array(F.lit("_version.py"), F.lit("setup.py"))))
    return names.where((F.size("wheel") > 0) & (F.size("sdist") > 0)).withColumn("extra", extra).where(F.size("extra") > 0).select("package", F.array_join(F.slice("extra", 1, first), ",").alias("missing"))
