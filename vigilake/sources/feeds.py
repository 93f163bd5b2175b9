"""Registry feeds as tables: texts and lines that were fetched elsewhere, turned into (name, version) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEP440 = r"^v?(?:\d+!)?\d+(?:\.\d+)*(?:[-_.]?(?:a|b|c|rc|alpha|beta|pre|preview)[-_.]?\d*)?(?:-\d+|[-_.]?(?:post|rev|r)[-_.]?\d*)?(?:[-_.]?dev[-_.]?\d*)?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?$"
PSEUDO_VERSION = r"^v\d+\.\d+\.\d+-(?:.*\.)?0?\.?\d{14}-[0-9a-f]{12}(?:\+incompatible)?$"


def rss_titles(feeds: DataFrame, column: str = "value") -> DataFrame:
    """(name, version) of an RSS of releases whose item titles are "name version"; versions that aren't valid are left out."""
    titles = F.regexp_extract_all(column, F.lit(r"(?s)<item>.*?<title>\s*([^<]+?)\s*</title>"), F.lit(1))
    parts = feeds.select(F.explode(titles).alias("title")).select(F.regexp_extract("title", r"^(\S+)\s+(\S+)$", 1).alias("name"), F.regexp_extract("title", r"^(\S+)\s+(\S+)$", 2).alias("version"))
    return parts.where(F.lower("version").rlike(PEP440) & (F.length("name") > 0))


def new_names(feeds: DataFrame, column: str = "value") -> DataFrame:
    """(name) of an RSS of new packages, titles "name added to ..."."""
    titles = F.regexp_extract_all(column, F.lit(r"(?s)<item>.*?<title>\s*(\S+)\s+added to [^<]*</title>"), F.lit(1))
    return feeds.select(F.explode(titles).alias("name")).distinct()


def crate_items(feeds: DataFrame, column: str = "value") -> DataFrame:
    """(name, version) of crate feeds: "New crate created: name", "New crate version published: name v1.2.3"; without a version "latest"."""
    items = feeds.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("item"))
    title, link = F.regexp_extract("item", r"<title>\s*([^<]*?)\s*</title>", 1), F.regexp_extract("item", r"<link>[^<]*/crates/[^/<]+/([^/<\s]+)\s*</link>", 1)
    name = F.regexp_extract(title, r"(?i)^New crate (?:created|version published):\s*([\w-]+)", 1)
    version = F.coalesce(F.nullif(F.regexp_extract(title, r"\sv?(\d[\w.+-]*)$", 1), F.lit("")), F.nullif(link, F.lit("")), F.lit("latest"))
    return items.select(name.alias("name"), version.alias("version")).where("name <> ''").distinct()


def resolve_latest(items: DataFrame, resolved: DataFrame, known: DataFrame) -> DataFrame:
    """Items of new crates: known names drop out, "latest" becomes the resolved version where there is one."""
    fresh = items.join(known.select("name").distinct(), "name", "left_anti").join(resolved.select("name", F.col("version").alias("found")), "name", "left")
    return fresh.select("name", F.when(F.col("version") == "latest", F.coalesce("found", "version")).otherwise(F.col("version")).alias("version")).distinct()


def serial_changes(rows: DataFrame, since: int, most: int = 2000) -> DataFrame:
    """(name, version, serial, brand_new) of a serial log after a cursor, at most so many by serial; removals and rows without a version only tell of new names."""
    some = rows.where(F.col("serial") > since).orderBy("serial").limit(most)
    created = some.where("action = 'create'").select("name").distinct().withColumn("brand_new", F.lit(True))
    kept = some.where(F.col("version").isNotNull() & ~F.col("action").startswith("remove"))
    return kept.join(created, "name", "left").select("name", "version", "serial", F.coalesce("brand_new", F.lit(False)).alias("brand_new"))


def go_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, version, cursor) of an index of JSON lines; malformed lines and pseudo-versions are left out; the cursor is in microseconds."""
    told = lines.select(F.from_json(column, "Path string, Version string, Timestamp string").alias("x")).select("x.*")
    good = told.where(F.col("Path").isNotNull() & F.col("Version").isNotNull() & ~F.col("Version").rlike(PSEUDO_VERSION))
    return good.select(F.col("Path").alias("name"), F.col("Version").alias("version"), F.unix_micros(F.try_to_timestamp("Timestamp")).alias("cursor"))


def npm_changes(rows: DataFrame) -> DataFrame:
    """(seq, name) of change rows: design documents, deleted and unnamed ones are left out; the newest row of a name counts."""
    from vigilake.operators.gates import skips_change

    seq = F.regexp_extract(F.col("seq").cast("string"), r"^(\d+)", 1).try_cast("long")
    kept = rows.where(~skips_change(F.col("id"), F.col("deleted"))).select(seq.alias("seq"), F.col("id").alias("name"))
    return kept.groupBy("name").agg(F.max("seq").alias("seq")).select("seq", "name")


def brand_new(names: DataFrame, packages: DataFrame, queue: DataFrame) -> DataFrame:
    """Names that are neither a known package nor queued."""
    keys = ["ecosystem", "name"]
    return names.join(packages.select(*keys).distinct(), keys, "left_anti").join(queue.select(*keys).distinct(), keys, "left_anti")


def floor_version(text: Column) -> Column:
    """The lowest version that a requirement admits by ==, >=, ~=, ~ or ^."""
    return F.nullif(F.regexp_extract(text, r"(?:==|>=|~=|\^|~|=|@)\s*v?(\d[\w.+!-]*)", 1), F.lit(""))


def focus_lines(lines: DataFrame) -> DataFrame:
    """(file, ecosystem, name, version) of focus files, rows (file, line_no, line): section headers [ecosystem] hold until the next; comments and blanks are left out.

    The order of a file is a window on the file, which is one small list."""
    clean = F.trim(F.regexp_replace("line", r"(?:^|\s)#.*$", ""))
    header = F.nullif(F.regexp_extract(clean, r"^\[(\w+)\]$", 1), F.lit(""))
    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.select("file", "line_no", clean.alias("said"), F.lower(F.last(header, ignorenulls=True).over(upto)).alias("ecosystem"))
    some = told.where((F.col("said") != "") & ~F.col("said").rlike(r"^\[\w+\]$"))
    name = F.regexp_extract("said", r"^(@?[A-Za-z0-9](?:[\w./-]*\w)?)", 1)
    return some.select("file", "ecosystem", name.alias("name"), floor_version(F.col("said")).alias("version")).where("name <> ''")


def cached_downloads(packages: DataFrame, fresh: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(ecosystem, name, downloads): a cached figure within its time, else the fresh one."""
    valid = F.col("downloads_fetched_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")
    joined = packages.join(fresh.select("ecosystem", "name", F.col("downloads").alias("now")), ["ecosystem", "name"], "left")
    return joined.select("ecosystem", "name", F.coalesce(F.when(valid, F.col("downloads_weekly")), "now").alias("downloads"))
