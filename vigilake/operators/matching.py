"""Names and hashes against reference sets: look-alike names, bad dependencies, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of fuzzy matches.
SSDEEP_LEAST, SSDEEP_STRONG, TLSH_MOST, TLSH_STRONG = 70, 88, 120, 40
#: Keys over which files are dealt for comparisons with a whole list.
SALTS = 256
# Names that wrap another name.
WRAPPER_PREFIXES = ("python-", "py-", "python3-", "py3-", "lib")
WRAPPER_SUFFIXES = ("-python", "-py", "-python3", "-py3", "-lib", "-sdk", "-api", "-client")


def plain_name(name: Column) -> Column:
    """Lower case without separators."""
    return F.translate(F.lower(name), "-_.", "")


def canonical_name(name: Column) -> Column:
    """Lower case, runs of separators as one dash."""
    return F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")


def requirement_name(requirement: Column) -> Column:
    """The name that a requirement starts with."""
    return F.nullif(F.regexp_extract(requirement, r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", 1), F.lit(""))


def deletions(name: Column) -> Column:
    """A name and the name without each of its characters. Names one edit apart share one of these."""
    return F.array_distinct(F.concat(F.array(name), F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda k: F.concat(F.substr(name, F.lit(1), k - 1), F.substr(name, k + 1)))))


def typosquats(names: DataFrame, top: DataFrame, prefixes=WRAPPER_PREFIXES, suffixes=WRAPPER_SUFFIXES) -> DataFrame:
    """(name, rule_id, target): names that look like a top name; rules in order, then the top name of the smallest rank. Names that are top names have none.

    One edit: an equi-join on the deletion neighbourhood of both sides, verified by the edit distance. The other rules are equi-joins as they are.
    """
    mine = names.select("name", F.lower("name").alias("low")).distinct()
    best = top.select(F.col("name").alias("target"), "rank", F.lower("name").alias("t")).distinct()
    mine = mine.join(best.select(F.col("t").alias("low")).distinct(), "low", "left_anti")
    near = mine.withColumn("k", F.explode(deletions(F.col("low")))).join(best.withColumn("k", F.explode(deletions(F.col("t")))), "k").where(F.levenshtein("low", "t", 1) == 1)
    same = mine.withColumn("k", plain_name(F.col("low"))).join(best.withColumn("k", plain_name(F.col("t"))), "k")

    def wrapped(column: Column) -> DataFrame:
        return mine.withColumn("k", F.explode(column)).where("k <> ''").join(best.withColumnRenamed("t", "k"), "k")

    heads = F.filter(F.array(*(F.when(F.startswith("low", F.lit(p)), F.substring("low", len(p) + 1, 10_000)) for p in prefixes)), lambda x: x.isNotNull())
    tails = F.filter(F.array(*(F.when(F.endswith("low", F.lit(s)), F.expr(f"substring(low, 1, length(low) - {len(s)})")) for s in suffixes)), lambda x: x.isNotNull())
    found = [(near, "candidate"), (same, "separator"), (wrapped(heads), "prefix"), (wrapped(tails), "suffix")]
    rows = None
    for k, (df, rule) in enumerate(found):
        part = df.select("name", F.lit(k).alias("k"), F.lit(f"metadata.typosquat_{rule}").alias("rule_id"), "rank", "target")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("name").agg(F.min(F.struct("k", "rank", "target", "rule_id")).alias("x")).select("name", "x.rule_id", "x.target")


def bad_dependencies(packages: DataFrame, known_bad: DataFrame) -> DataFrame:
    """(package, dependency, severity): declared dependencies that are confirmed bad; critical if newly added to a list that wasn't empty."""
    name = F.explode(F.transform("deps", lambda x: canonical_name(requirement_name(x))))
    declared = packages.select("package", name.alias("dependency"), F.transform("prev_deps", lambda x: canonical_name(requirement_name(x))).alias("before")).where("dependency IS NOT NULL").distinct()
    hits = declared.join(known_bad.select(canonical_name(F.col("name")).alias("dependency")).distinct(), "dependency", "left_semi")
    fresh = (F.coalesce(F.size("before"), F.lit(0)) > 0) & ~F.coalesce(F.array_contains("before", F.col("dependency")), F.lit(False))
    return hits.select("package", "dependency", F.when(fresh, "critical").otherwise("high").alias("severity"))


def label_severity(label: Column) -> Column:
    return F.when(label == "suspicious", "high").when(label == "pua", "medium").otherwise("critical")


def exact_matches(files: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Files whose sha256 is a fingerprint's: the columns of the files, campaign, label, severity. The largest campaign name decides ties."""
    one = fingerprints.where("sha256 IS NOT NULL").groupBy(F.lower("sha256").alias("sha256")).agg(F.max(F.struct("campaign", "label")).alias("x")).select("sha256", "x.*")
    return files.join(one, "sha256").withColumn("severity", label_severity(F.col("label")))


def fuzzy_matches(files: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(file_id, campaign, tier, similarity): files close to a fingerprint by their fuzzy hashes, rows (file_id, sha256, ssdeep, tlsh).

    Context-triggered hashes are compared only where they share a run of seven characters at one block size, which a comparable pair does:
    an equi-join on those runs. Locality hashes have no exact key at the distances asked for, so files pass the curated list whole; only
    hashes of one length are compared. Automatic seeds don't take part. Highest similarity wins,
    then lowest distance, then the smallest fingerprint.
    """
    from vigilake.functions.fuzzy import ctph_runs, ctph_similarity, tlsh_distance

    seeds = fingerprints.where(~F.coalesce(F.startswith("source", F.lit("auto")), F.lit(False)))
    mine = files.where("ssdeep IS NOT NULL").select("file_id", F.col("ssdeep").alias("a"), F.explode(ctph_runs(F.col("ssdeep"))).alias("run"))
    theirs = seeds.where("ssdeep IS NOT NULL").select(F.col("sha256").alias("seed"), "campaign", F.col("ssdeep").alias("b"), F.explode(ctph_runs(F.col("ssdeep"))).alias("run"))
    close = mine.join(theirs, "run").select("file_id", "seed", "campaign", "a", "b").distinct().withColumn("similarity", ctph_similarity("a", "b")).where(F.col("similarity") >= SSDEEP_LEAST)
    first = close.select("file_id", "seed", "campaign", F.lit(1).alias("order"), F.when(F.col("similarity") >= SSDEEP_STRONG, "strong").otherwise("fuzzy").alias("tier"), F.col("similarity").cast("int").alias("similarity"), (-F.col("similarity")).cast("int").alias("sort"))
    # The list is copied to SALTS keys and the files are dealt over them, so each task compares its own files.
    bodies = seeds.where("tlsh IS NOT NULL").select(F.col("sha256").alias("seed"), "campaign", F.col("tlsh").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    dealt = files.where("tlsh IS NOT NULL").select("file_id", F.col("tlsh").alias("a"), F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).alias("salt"))
    far = dealt.join(bodies, "salt").where(F.length("a") == F.length("b")).withColumn("distance", tlsh_distance("a", "b")).where(F.col("distance") <= TLSH_MOST)
    second = far.select("file_id", "seed", "campaign", F.lit(2).alias("order"), F.when(F.col("distance") <= TLSH_STRONG, "strong").otherwise("fuzzy").alias("tier"), F.col("distance").cast("int").alias("similarity"), F.col("distance").cast("int").alias("sort"))
    order = Window.partitionBy("file_id").orderBy("order", "sort", "seed")
    return first.unionByName(second).withColumn("place", F.row_number().over(order)).where("place = 1").select("file_id", "campaign", "seed", F.when(F.col("order") == 1, "ssdeep").otherwise("tlsh").alias("kind"), "tier", "similarity")


def lure_categories(name: Column, lures: dict[str, tuple[str, ...]]) -> Column:
    """The categories of luring words that a name holds, sorted."""
    low = F.lower(name)
    each = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(kind)) for kind, words in sorted(lures.items())]
    return F.filter(F.array(*each), lambda x: x.isNotNull())
