"""More registered queries: feeds, gates and listings, each over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.checkpoints import shared_folder
from vigilake.functions import text as T
from vigilake.functions import times
from vigilake.operators import budget, campaign, closure, file_rules, gates, history, hooks, metadata, networks, queue, reports, trace
from vigilake.plans import adapters as A
from vigilake.plans.registry import query
from vigilake.sources import changes, commits, feeds
from vigilake.streaming import stateful

AS_OF = f"TIMESTAMP '{A.AS_OF}'"


def said(*parts: str | Column) -> Column:
    """Texts and columns in a row; plain strings are SQL."""
    return F.concat(*((F.expr(x) if isinstance(x, str) else x).cast("string") for x in parts))


# --- feeds -----------------------------------------------------------------------------------------------------------


@query(
    "rss_releases",
    "SELECT 'p' || p_partkey AS name, '1.' || p_size AS version FROM part UNION ALL SELECT 'q' || p_partkey, '2.0rc1' FROM part WHERE p_partkey % 2 = 0",
)
def rss_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("p_partkey") % 2 == 0, "2.0rc1").otherwise("not/a version")
    text = said("'<rss><item><title>p'", "p_partkey", "' 1.'", "p_size", "'</title></item><item><title>q'", "p_partkey", "' '", second, "'</title></item></rss>'")
    return feeds.rss_titles(A.read(spark, sf_dir, "part").select(text.alias("value")))


@query("rss_new_names", "SELECT DISTINCT 'p' || p_size AS name FROM part")
def rss_new_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said("'<item><title>p'", "p_size", "' added to PyPI</title></item><item><title>p'", "p_size", "' removed</title></item>'")
    return feeds.new_names(A.read(spark, sf_dir, "part").select(text.alias("value")))


@query(
    "crate_feed_items",
    "SELECT DISTINCT 'crate-' || p_size AS name, CASE WHEN p_partkey % 2 = 0 THEN 'latest' ELSE '1.2.' || p_partkey % 10 END AS version FROM part",
)
def crate_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 2 == 0, said("'New crate created: crate-'", "p_size")).otherwise(said("'New crate version published: crate-'", "p_size", "' v1.2.'", "p_partkey % 10"))
    return feeds.crate_items(A.read(spark, sf_dir, "part").select(said("'<item><title>'", title, "'</title></item>'").alias("value")))


@query(
    "go_index_lines",
    """SELECT 'example.com/m' || o_custkey AS name, 'v1.' || o_orderkey AS version, epoch_us(o_orderdate) + 123 AS cursor FROM orders WHERE o_orderkey % 5 NOT IN (0, 1)""",
)
def go_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("o_orderkey") % 5 == 0, "v0.0.0-20240101000000-0123456789ab").otherwise(said("'v1.'", "o_orderkey"))
    whole = said("'{\"Path\":\"example.com/m'", "o_custkey", "'\",\"Version\":\"'", version, "'\",\"Timestamp\":\"'", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "'.000123Z\"}'")
    return feeds.go_index(A.read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 1, "{broken").otherwise(whole).alias("value")))


@query(
    "npm_change_rows",
    "SELECT max(o_orderkey) AS seq, 'pkg' || o_custkey AS name FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 GROUP BY 2",
)
def npm_change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 13 == 0, said("'_design/'", "o_custkey")).otherwise(said("'pkg'", "o_custkey"))
    return feeds.npm_changes(A.read(spark, sf_dir, "orders").select(said("o_orderkey", "'-g1AAAA'").alias("seq"), name.alias("id"), F.when(F.col("o_orderkey") % 7 == 0, True).alias("deleted")))


@query(
    "focus_entries",
    """WITH l AS (SELECT l_orderkey AS file, l_linenumber, l_partkey, l_partkey % 3 = 0 AS header, CASE WHEN l_partkey % 3 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END END AS eco FROM
      (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2))
    SELECT file, ecosystem, 'pkg' || l_partkey AS name, CASE WHEN l_partkey % 2 = 0 THEN '1.' || l_partkey END AS version FROM
      (SELECT *, last_value(eco IGNORE NULLS) OVER (PARTITION BY file ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS ecosystem FROM l) WHERE NOT header""",
)
def focus_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("part")
    entry = F.when(part % 2 == 0, said("'pkg'", part, "'>=1.'", part, "'  # wanted'")).otherwise(said("'pkg'", part))
    line = F.when(part % 3 == 0, F.when(part % 2 == 0, "[npm]").otherwise("[PyPI]")).otherwise(entry)
    rows = A.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    return feeds.focus_lines(rows.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"), line.alias("line")))


@query(
    "downloads_cached",
    f"""SELECT {A._eco_sql("c_custkey")} AS ecosystem, 'pkg' || c_custkey AS name, CASE WHEN c_custkey % 15 <= 7 THEN c_custkey * 10 WHEN c_custkey % 3 <> 0 THEN c_custkey END AS downloads FROM customer""",
)
def downloads_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = A.read(spark, sf_dir, "customer").select("c_custkey", A.ecosystem("c_custkey").alias("ecosystem"), said("'pkg'", "c_custkey").alias("name"))
    age = F.make_dt_interval(days=(F.col("c_custkey") % 15).cast("int"))
    packages = people.select("ecosystem", "name", (F.col("c_custkey") * 10).alias("downloads_weekly"), (A.as_of() - age).alias("downloads_fetched_at"))
    return feeds.cached_downloads(packages, people.where("c_custkey % 3 <> 0").select("ecosystem", "name", F.col("c_custkey").alias("downloads")), A.as_of())


@query("cursor_times", "SELECT o_orderkey, epoch_us(o_orderdate) + 5000123 AS micros, strftime(o_orderdate + INTERVAL 5000123 MICROSECONDS, '%Y-%m-%dT%H:%M:%S.%fZ') AS text FROM orders")
def cursor_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = times.cursor_micros(said(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "'.000123Z'")) + 5_000_000
    return A.read(spark, sf_dir, "orders").select("o_orderkey", micros.alias("micros"), times.cursor_text(micros).alias("text"))


# --- queue and gates -------------------------------------------------------------------------------------------------


@query(
    "promoted_priority",
    f"""WITH {A.QUEUE} SELECT id, CASE WHEN priority = 'normal' AND (id % 11 = 0 OR id % 6 IN (0, 1)) THEN 'high' ELSE priority END AS priority FROM queue""",
)
def promoted_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("id") % 6 == 0, "99.9.1").when(F.col("id") % 6 == 1, "9.9.9").when(F.col("id") % 6 == 2, "9").otherwise(said("'1.'", "id"))
    return A.queue(spark, sf_dir).select("id", gates.promoted(F.col("priority"), F.col("id") % 11 == 0, version).alias("priority"))


@query(
    "scope_names",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN '@s' || p_size WHEN 2 THEN 'github.com/o' || p_size WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'abc' || p_size END END AS scope FROM part""",
)
def scope_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    pypi = F.when(F.col("p_size") % 2 == 0, said("'Abc'", "p_size", "'-tools'")).otherwise(said("'plain'", "p_size"))
    name = F.when(kind == 1, said("'@S'", "p_size", "'/x'")).when(kind == 2, said("'github.com/o'", "p_size", "'/r/v2'")).when(kind == 0, pypi).otherwise("serde-json")
    return A.read(spark, sf_dir, "part").select("p_partkey", gates.scope_of(A.ecosystem("p_partkey"), name).alias("scope"))


@query(
    "canonical_renames",
    f"""WITH {A.WATCHLIST}, told AS (SELECT ecosystem, name, rank, CASE WHEN package_id % 16 IN (8, 12) THEN 'Customer#' || lpad((package_id // 16 * 16 + 4)::VARCHAR, 9, '0')
      WHEN package_id % 16 IN (5, 9, 13) THEN 'moved' || package_id // 16 ELSE name END AS canonical FROM watchlist)
    SELECT ecosystem, canonical AS name, rank FROM told QUALIFY row_number() OVER (PARTITION BY ecosystem, canonical ORDER BY canonical <> name, rank, name) = 1""",
)
def canonical_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    target = F.when((key % 16).isin(8, 12), said("'Customer#'", "lpad(c_custkey div 16 * 16 + 4, 9, '0')")).when((key % 16).isin(5, 9, 13), said("'moved'", "c_custkey div 16"))
    renames = A.read(spark, sf_dir, "customer").select(A.ecosystem("c_custkey").alias("ecosystem"), F.col("c_name").alias("original"), target.alias("canonical")).where("canonical IS NOT NULL")
    return queue.canonical_names(A.watchlist(spark, sf_dir).select("ecosystem", "name", "rank"), renames)


@query("held_cursor", "SELECT least(max(o_orderkey), min(o_orderkey) FILTER (o_orderstatus = 'P' AND o_orderkey % 7 < 5) - 1) AS cursor FROM orders")
def held_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 7).alias("attempts"), "o_orderstatus")
    return queue.hold_back(rows.select("seq"), rows.where("o_orderstatus = 'P'").select("seq", "attempts"))


@query(
    "fingerprint_seed_merge",
    """WITH t AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0), s AS (SELECT sha256(text) AS sha256, min('seed' || lang) AS campaign FROM documents GROUP BY 1)
    SELECT sha256, CASE WHEN t.sha256 IS NOT NULL AND substr(sha256, 1, 1) < '8' THEN 'held' ELSE s.campaign END AS campaign, CASE WHEN t.sha256 IS NULL THEN 'auto' ELSE 'manual' END AS source FROM s LEFT JOIN t USING (sha256)""",
)
def fingerprint_seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    held = F.when(F.substring("sha256", 1, 1) < "8", "held").alias("campaign")
    table = docs.where("doc_id % 2 = 0").select("sha256").distinct().select("sha256", held, F.lit("manual").alias("source"))
    return queue.seed_merge(table, docs.groupBy("sha256").agg(F.min(said("'seed'", "lang")).alias("campaign"), F.lit("auto").alias("source")))


@query(
    "campaign_promotion",
    """SELECT doc_id, campaign, CASE WHEN source = 'auto' AND campaign LIKE 'auto:%:s1' THEN 'promoted' ELSE source END AS source FROM
    (SELECT doc_id, 'auto:' || lang || ':s' || doc_id % 3 AS campaign, CASE WHEN doc_id % 4 = 0 THEN 'manual' ELSE 'auto' END AS source FROM documents)""",
)
def campaign_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.promote_campaign(_campaigns(spark, sf_dir), "s1")


@query(
    "campaign_removal",
    """SELECT doc_id, campaign, source FROM
    (SELECT doc_id, 'auto:' || lang || ':s' || doc_id % 3 AS campaign, CASE WHEN doc_id % 4 = 0 THEN 'manual' ELSE 'auto' END AS source FROM documents) WHERE source = 'manual' OR coalesce(campaign, '') <> 'auto:en:s2'""",
)
def campaign_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.remove_campaign(_campaigns(spark, sf_dir), "auto:en:s2")


def _campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 4 == 0, "manual").otherwise("auto")
    return A.read(spark, sf_dir, "documents").select("doc_id", said("'auto:'", "lang", "':s'", "doc_id % 3").alias("campaign"), source.alias("source"))


@query(
    "non_go_suppression",
    f"""WITH {A.FINDINGS}, g AS (SELECT l_orderkey AS scan_id, bool_or(l_partkey % 9 < 2) AS has_go FROM lineitem GROUP BY 1)
    SELECT finding_id, category AS rule_id FROM findings LEFT JOIN g USING (scan_id) WHERE coalesce(has_go, false) OR category NOT IN ('click', 'view')""",
)
def non_go_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("l_partkey") % 9 == 0, "go.mod").when(F.col("l_partkey") % 9 == 1, "cmd/main.go").otherwise("docs/readme.md")
    files = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), path.alias("path")).withColumn("basename", F.substring_index("path", "/", -1))
    found = A.findings(spark, sf_dir).select("finding_id", "scan_id", F.col("category").alias("rule_id"))
    return gates.non_go_rows(found, files, ("click", "view")).select("finding_id", "rule_id")


@query("trigger_findings", f"WITH {A.FINDINGS} SELECT finding_id, rule_id FROM findings WHERE severity IN ('high', 'critical') AND category NOT IN ('click', 'view') AND category <> 'login'")
def trigger_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = F.when(F.col("category") == "click", "iocs").when(F.col("category") == "view", "version_diff").otherwise(F.col("category"))
    rule = F.when(F.col("category") == "login", F.lit("denied")).otherwise(F.col("rule_id"))
    return gates.trigger_eligible(A.findings(spark, sf_dir).withColumn("rule_id", rule).withColumn("category", renamed), deny=("denied",)).select("finding_id", "rule_id")


@query(
    "claimed_iocs",
    """SELECT doc_id, CASE WHEN length(w) > 0 THEN w ELSE '' END || CASE WHEN contains(t, '10.0.0.1') THEN ',10.0.0.1' ELSE '' END AS held FROM
    (SELECT doc_id, coalesce(text, '') AS t, split_part(coalesce(text, ''), ' ', 1) AS w FROM documents)""",
)
def claimed_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    first = F.split_part(text, F.lit(" "), F.lit(1))
    claims = F.array(*(F.struct(F.lit(kind).alias("type"), value.alias("value")) for kind, value in (("domain", first), ("ip", F.lit("10.0.0.1")), ("rumour", first), ("url", F.lit("")), ("hash", F.lit("never said")))))
    return A.read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(gates.true_iocs(claims, text), lambda x: x.value), ",").alias("held"))


@query(
    "own_download_suppression",
    f"""WITH {A.FINDINGS}, own AS (SELECT DISTINCT c.event_id // 4 AS scan_id FROM events c JOIN events v ON c.event_id // 4 = v.event_id // 4 AND c.user_id % 7 = v.event_id % 7)
    SELECT finding_id, scan_id, rule_id FROM (SELECT finding_id, scan_id, CASE WHEN category = 'click' THEN 'dyn_install_exfil' ELSE category END AS rule_id FROM findings)
    WHERE rule_id <> 'dyn_install_exfil' OR scan_id NOT IN (SELECT scan_id FROM own)""",
)
def own_download_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("category") == "click", "dyn_install_exfil").otherwise(F.col("category"))
    events = A.read(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("scan_id"), "event_id", "user_id")
    connects = events.select("scan_id", said("'a'", "user_id % 20", "'.cdn'", "user_id % 7", "'.io'").alias("host"))
    verified = events.select("scan_id", said("'Files.CDN'", "event_id % 7", "'.io'").alias("host"))
    return trace.without_own_downloads(A.findings(spark, sf_dir).select("finding_id", "scan_id", rule.alias("rule_id")), connects, verified)


# --- files and texts -------------------------------------------------------------------------------------------------


@query(
    "normal_paths",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'setup.py' WHEN l_returnflag IN ('A', 'R') THEN 'src/' || l_linenumber || '.js' ELSE 'package/src/' || l_linenumber || '.js' END AS path,
    CASE WHEN l_partkey % 5 = 0 THEN 'setup.py' ELSE 'src/' || l_linenumber || '.js' END AS finding_path FROM lineitem""",
)
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("l_partkey") % 5 == 0, "setup.py").otherwise(said("'package/src/'", "l_linenumber", "'.js'"))
    kind = F.when(F.col("l_returnflag") == "A", "npm_tarball").when(F.col("l_returnflag") == "R", "sdist").otherwise("wheel")
    return A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", history.normal_path(path, kind).alias("path"), history.finding_path(path).alias("finding_path"))


@query("glob_paths", f"WITH {A.FILES} SELECT scan_id, path FROM files WHERE path IN ('src/1.py', 'src/2.py', 'src/5.py')")
def glob_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.lit(False)
    for pattern in ("s*/[12].p?", "*/5.py", "1.py"):
        hit |= F.col("path").rlike(T.glob_regex(pattern))
    return A.files(spark, sf_dir).where(hit).select("scan_id", "path")


@query("shown_texts", "SELECT o_orderkey, '~' || format('{:,}', o_orderkey * 1000) AS downloads, 'hxxps://a' || o_custkey || '[.]io/x' AS url FROM orders")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "orders").select("o_orderkey", T.approximate(F.col("o_orderkey") * 1000).alias("downloads"), T.defang(said("'https://a'", "o_custkey", "'.io/x'")).alias("url"))


@query(
    "archive_mismatches",
    """WITH f AS (SELECT DISTINCT l_orderkey AS scan_id, l_linenumber % 2 AS wheel, 'm' || l_partkey % 5 || '.py' AS name FROM lineitem),
    b AS (SELECT scan_id FROM f GROUP BY 1 HAVING count(DISTINCT wheel) = 2)
    SELECT scan_id, 'metadata.sdist_wheel_mismatch' AS rule_id, string_agg(name, ',' ORDER BY name) AS evidence FROM f JOIN b USING (scan_id)
    WHERE wheel = 1 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.scan_id = f.scan_id AND g.wheel = 0 AND g.name = f.name) GROUP BY 1""",
)
def archive_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 2 == 1, "wheel").otherwise("sdist")
    files = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package"), kind.alias("archive_kind"), said("'top/m'", "l_partkey % 5", "'.py'").alias("path"))
    return metadata.mismatch_findings(history.archive_mismatch(files)).select("scan_id", "rule_id", "evidence")


# --- listings --------------------------------------------------------------------------------------------------------


@query(
    "triage_listing",
    f"""WITH {A.SCANS}, n AS (SELECT *, count(*) OVER p AS n_scans, bool_or(llm_verdict = 'malicious') OVER p AS asked,
      row_number() OVER (PARTITION BY ecosystem, name ORDER BY coalesce(llm_verdict = 'malicious', false) DESC, finished_at DESC, scan_id DESC) AS place FROM scans WINDOW p AS (PARTITION BY ecosystem, name))
    SELECT ecosystem, name, scan_id, n_scans, finding_id, rule_id, severity FROM n JOIN findings USING (scan_id) WHERE asked AND place = 1""",
)
def triage_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = A.scans(spark, sf_dir)
    asked = scans.where("llm_verdict = 'malicious'").select("ecosystem", "name")
    return reports.triage_listing(asked, scans, A.findings(spark, sf_dir).select("scan_id", "finding_id", "rule_id", "severity"))


@query(
    "scan_publishers",
    f"""WITH {A.SCANS} SELECT scan_id, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END AS author, CASE WHEN o_custkey % 2 = 0 THEN 'u' || o_custkey END AS upload_user
    FROM scans JOIN orders ON o_orderkey = scan_id WHERE o_orderpriority NOT LIKE '1%' OR o_custkey % 2 = 0""",
)
def scan_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority"))
    none = F.lit(None).cast("string")
    versions = A.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"), author.alias("author"), none.alias("author_email"), none.alias("maintainers"), F.when(F.col("o_custkey") % 2 == 0, said("'u'", "o_custkey")).alias("upload_user")
    )
    return reports.publishers(A.scans(spark, sf_dir).withColumn("version_id", F.col("scan_id")), versions).select("scan_id", "author", "upload_user")


@query("watch_entries", f"WITH {A.WATCHLIST} SELECT ecosystem, name, rank FROM watchlist WHERE ecosystem = 'npm'")
def watch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.entries(A.watchlist(spark, sf_dir).select("ecosystem", "name", "rank"), "rank", ecosystem="npm")


@query(
    "triage_source_coverage",
    f"""WITH {A.SCANS} SELECT ecosystem, count(*) FILTER (scan_id % 3 = 0) AS n_without, count(*) AS n FROM scans WHERE scan_id % 5 <> 0 GROUP BY 1""",
)
def triage_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("scan_id") % 5 != 0, F.when(F.col("scan_id") % 3 == 0, "There is No Source to read").otherwise("reads a file"))
    return reports.source_coverage(A.scans(spark, sf_dir).select("ecosystem", reason.alias("llm_reasoning")))


@query(
    "function_segments",
    """WITH f AS (SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a.py' ELSE 'a.js' END AS path, 'f' || o_custkey AS name,
      CASE WHEN o_orderkey % 2 = 0 THEN 'def f' || o_custkey || E'(x):\\n    return {x}' ELSE 'async function f' || o_custkey || E'(x) {\\n  if (x) { y }\\n}' END AS segment FROM orders)
    SELECT scan_id, path, name, CASE WHEN path = 'a.py' THEN 'FunctionDef' ELSE 'func' END AS kind, 2 AS line, CASE WHEN path = 'a.py' THEN 3 ELSE 4 END AS end_line, sha256(segment) AS sha256, strlen(segment)::INT AS size FROM f
    UNION ALL SELECT scan_id, path, 'if', 'func', 3, 3, sha256('  if (x) { y }'), 14 FROM f WHERE path = 'a.js'""",
)
def function_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.functions.segments import function_segments as found

    python = F.col("o_orderkey") % 2 == 0
    path = F.when(python, "a.py").otherwise("a.js")
    text = F.when(python, said(r"'x = 1\ndef f'", "o_custkey", r"'(x):\n    return {x}\n'")).otherwise(said(r"'// a\nasync function f'", "o_custkey", r"'(x) {\n  if (x) { y }\n}\nlet z = {}\n'"))
    files = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), path.alias("path"), text.alias("text"))
    return found(files).select("scan_id", "path", "name", "kind", "line", "end_line", "sha256", "size")


@query(
    "hook_file_findings",
    """WITH o AS (SELECT o_orderkey AS scan_id, o_orderkey % 5 AS k, o_custkey % 2 = 0 AS image FROM orders)
    SELECT scan_id, CASE WHEN image THEN 'installer.npm_install_runs_bundled_binary' ELSE 'installer.npm_install_runs_bundled_file' END AS rule_id, CASE WHEN image THEN 'critical' ELSE 'high' END AS severity,
      CASE k WHEN 0 THEN 'pkg/./tools/setup' WHEN 1 THEN 'pkg/tools/x/../setup' ELSE 'pkg/tools/setup' END AS file FROM o WHERE k < 3""",
)
def hook_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 5
    command = F.when(key == 0, "echo hi && ./tools/setup --fast").when(key == 1, "sh -e tools/x/../setup").when(key == 2, "true; bash 'tools/setup'").when(key == 3, "node tools/setup").otherwise("../tools/setup")
    orders = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), command.alias("command"), F.when(F.col("o_custkey") % 2 == 0, F.unhex(F.lit("7F454C460201"))).otherwise(F.unhex(F.lit("2321"))).alias("content"))
    manifests = orders.select("scan_id", F.lit("pkg/package.json").alias("path"), F.to_json(F.struct(F.struct(F.col("command").alias("postinstall")).alias("scripts"))).alias("text"))
    return hooks.run_file_findings(hooks.install_hooks(manifests), orders.select("scan_id", F.lit("pkg/tools/setup").alias("path"), "content")).select("scan_id", "rule_id", "severity", "file")


@query(
    "gyp_command_findings",
    """WITH o AS (SELECT o_orderkey AS scan_id, o_orderkey % 4 AS k FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT scan_id, 'installer.npm_binding_gyp_command_exec' AS rule_id, CASE k WHEN 1 THEN 'critical' ELSE 'high' END AS severity, CASE k WHEN 1 THEN 'node lib/x.js' WHEN 2 THEN 'make all' ELSE 'node -p 1 && id' END AS evidence FROM o WHERE k > 0""",
)
def gyp_command_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    command = F.when(key == 0, "node -p \"require('node-addon-api').include\"").when(key == 1, "node lib/x.js").when(key == 2, "make all").otherwise(" 'node -p 1 && id' ")
    text = said(r"'{\'x\': [\'<!('", command, r"')\', \'<!@('", command, r"')\']}'")
    orders = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), text.alias("text"))
    manifests = orders.where("scan_id % 3 <> 0").select("scan_id", F.lit("pkg/package.json").alias("path"), F.lit("{}").alias("text"))
    files = orders.select("scan_id", F.lit("pkg/binding.gyp").alias("path"), "text").union(manifests)
    return hooks.gyp_findings(files).select("scan_id", "rule_id", "severity", "evidence")


@query(
    "swept_siblings",
    f"""WITH {A.SCANS}, bad AS (SELECT DISTINCT ecosystem, maintainer, name FROM scans WHERE llm_verdict = 'malicious')
    SELECT DISTINCT s.ecosystem, s.name FROM scans s JOIN bad b ON b.ecosystem = s.ecosystem AND b.maintainer = s.maintainer AND b.name <> s.name
    WHERE NOT EXISTS (SELECT 1 FROM bad m WHERE m.ecosystem = s.ecosystem AND m.name = s.name)""",
)
def swept_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = A.scans(spark, sf_dir)
    bad = scans.where("llm_verdict = 'malicious'").select("ecosystem", "maintainer", "name").distinct()
    return campaign.clean_siblings(bad, scans.select("ecosystem", "maintainer", "name").distinct(), bad)


# --- claims ----------------------------------------------------------------------------------------------------------

#: Rows that a worker takes in a round; rounds; every second round another worker publishes in between.
CLAIMED, CLAIM_ROUNDS = 400, 4


@query(
    "claim_rounds",
    "WITH "
    + A.QUEUE
    + f""", n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, enqueued_at, id) AS place FROM queue),
    t AS (SELECT id, ecosystem, status, attempts, status = 'pending' AND place <= {CLAIMED} * {CLAIM_ROUNDS} AS took, (place - 1) // {CLAIMED} AS round FROM n)
    SELECT id, ecosystem, CASE WHEN NOT took THEN status WHEN round = 0 THEN 'done' ELSE 'claimed' END AS status, (attempts + took::INT)::INT AS attempts,
    CASE WHEN took THEN 'worker' || ['0', 'x', '2', '3'][round + 1] END AS claim_token FROM t""",
)
def claim_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after rounds of claims by workers that race: in the second round one publishes while another decides, which then decides again. The first worker's claim is settled.

    The queue is a committed table in the shared folder; every claim goes through its sink."""
    root = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    held = A.queue(spark, sf_dir).withColumns({"claim_token": F.lit(None).cast("string"), "claimed_at": F.lit(None).cast("timestamp_ntz")})
    commits.write(held.select(*(x.split()[0] for x in queue.CLAIM_ROWS.split(", "))), root, -1)
    now = A.as_of()
    queue.claim_rows(spark, root, "worker0", CLAIMED, now)
    raced: list[int] = []

    def other(base: int) -> None:
        if not raced:
            raced.append(base)
            queue.claim_rows(spark, root, "workerx", CLAIMED, now)

    queue.claim_rows(spark, root, "worker2", CLAIMED, now, meanwhile=other)
    queue.settle_rows(spark, root, "worker0", "done")
    queue.claim_rows(spark, root, "worker3", CLAIMED, now)
    return commits.current(commits.read(spark, root, queue.CLAIM_ROWS), "id").select("id", "ecosystem", "status", "attempts", "claim_token")


# --- the log of changes ----------------------------------------------------------------------------------------------


@query(
    "change_log_names",
    """SELECT name, max(seq) AS seq FROM (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 17 = 0 THEN '_design/' ELSE '' END || 'pkg' || o_custkey AS name, o_orderkey % 13 = 0 AS gone FROM orders)
    WHERE NOT gone AND name NOT LIKE '\\_design/%' ESCAPE '\\' AND seq > 100 GROUP BY name""",
)
def change_log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a registry's log after a cursor, each with its newest number: the log is written as pages to the shared folder and read through the source that streams use, too."""
    root = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    name = said("CASE WHEN o_custkey % 17 = 0 THEN '_design/' ELSE '' END", "'pkg'", "o_custkey")
    value = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("seq"), name.alias("id"), (F.col("o_orderkey") % 13 == 0).alias("deleted")))
    changes.write_pages(A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), value.alias("value")), root, 5000)
    rows = changes.changes(spark, root, since=100).select(F.from_json("value", "seq string, id string, deleted boolean").alias("x")).select("x.*")
    return feeds.npm_changes(rows)


@query(
    "held_poll_cursors",
    """WITH n AS (SELECT ['pypi', 'npm', 'gomod', 'crates'][(o_custkey % 4 + 1)::INT] AS feed, o_orderkey % 12 + 1 AS poll, 'pkg' || o_custkey AS name, max(o_orderkey) AS seq, bool_or(o_orderstatus <> 'F') AS resolved
      FROM orders GROUP BY ALL),
    r AS (SELECT *, (SELECT max(poll) FROM n b WHERE b.feed = n.feed AND b.name = n.name AND b.resolved AND b.poll < n.poll) AS since FROM n),
    t AS (SELECT *, (SELECT count(*) FROM n b WHERE b.feed = r.feed AND b.name = r.name AND b.poll <= r.poll AND b.poll > coalesce(r.since, 0)) AS tries FROM r),
    p AS (SELECT feed, poll, least(max(seq), min(seq) FILTER (NOT resolved AND tries % 2 <> 0) - 1) AS safe FROM t GROUP BY ALL)
    SELECT feed, poll, max(safe) OVER (PARTITION BY feed ORDER BY poll) AS cursor FROM p""",
)
def held_poll_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors of polls, held before names that couldn't be resolved for less than two polls in a row; the batch form of a stream's state."""
    orders = A.read(spark, sf_dir, "orders")
    names = orders.select(A.ecosystem("o_custkey").alias("feed"), (F.col("o_orderkey") % 12 + 1).alias("poll"), said("'pkg'", "o_custkey").alias("name"), "o_orderkey", (F.col("o_orderstatus") != "F").alias("ok"))
    names = names.groupBy("feed", "poll", "name").agg(F.max("o_orderkey").alias("seq"), F.bool_or("ok").alias("resolved"))
    ends = names.groupBy("feed", "poll").agg(F.max("seq").alias("seq"), F.count("*").cast("int").alias("size")).withColumns({"name": F.lit(None).cast("string"), "resolved": F.lit(None).cast("boolean")})
    return stateful.held_polls(names.unionByName(ends, allowMissingColumns=True), 2)


@query(
    "npm_hook_closure",
    """WITH RECURSIVE l AS (SELECT l_orderkey AS scan_id, l_linenumber AS n, max(l_partkey) AS part FROM lineitem GROUP BY ALL),
    e AS (SELECT scan_id, n, part % 7 + 1 AS m FROM l UNION SELECT scan_id, n, (part // 7) % 7 + 1 FROM l WHERE part % 3 = 0),
    r AS (SELECT scan_id, n FROM l WHERE n = 1 UNION SELECT e.scan_id, e.m FROM r JOIN e USING (scan_id, n) JOIN l ON l.scan_id = e.scan_id AND l.n = e.m)
    SELECT scan_id, CASE WHEN n % 2 = 0 THEN 'pkg/d' || n || '/index.js' ELSE 'pkg/f' || n || '.js' END AS path FROM r""",
)
def npm_hook_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an install hook reaches through what they load; files of an order are its lines, which load one or two others, by name, with a suffix or by folder."""
    lines = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("part"))
    name = lambda n: F.when(F.expr(f"({n}) % 2 = 0"), said("'d'", n)).when(F.col("part") % 2 == 0, said("'f'", n)).otherwise(said("'f'", n, "'.js'"))
    up = F.when(F.col("n") % 2 == 0, "../").otherwise("./")
    text = F.concat(F.lit("const a = require('"), up, name("part % 7 + 1"), F.lit("');"), F.when(F.col("part") % 3 == 0, F.concat(F.lit(' import b from "'), up, name("(part div 7) % 7 + 1"), F.lit('";'))).otherwise(""))
    path = F.when(F.col("n") % 2 == 0, said("'pkg/d'", "n", "'/index.js'")).otherwise(said("'pkg/f'", "n", "'.js'"))
    files = lines.select("scan_id", path.alias("path"), text.alias("text"))
    started = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id")).distinct().select("scan_id", F.lit("pkg/").alias("root"), F.lit("postinstall").alias("hook"), F.lit("node f1 && echo done").alias("command"))
    return closure.hook_closure(started, files).select("scan_id", "path")


# --- budgets and networks --------------------------------------------------------------------------------------------


@query(
    "reserved_budget",
    """WITH RECURSIVE p AS (SELECT doc_id % 50 AS scan_id, 'f' || doc_id AS path, doc_id % 7 = 0 AS entry, least(length(coalesce(text, '')), CASE WHEN doc_id % 7 = 0 THEN 800 ELSE 1200 END)::BIGINT AS n,
      row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id % 7 <> 0, doc_id % 3, 'f' || doc_id) AS place FROM documents),
    r AS (SELECT scan_id, 0::BIGINT AS place, '' AS path, false AS entry, 0::BIGINT AS length, 0::BIGINT AS used FROM (SELECT DISTINCT scan_id FROM p)
      UNION ALL SELECT scan_id, place, path, entry, got, used + got FROM (SELECT p.scan_id, p.place, p.path, p.entry, r.used,
        CASE WHEN p.entry AND r.used + n <= 1600 OR NOT p.entry AND r.used + n <= 4800 THEN n WHEN NOT p.entry AND 4800 - r.used > 200 THEN 4800 - r.used ELSE 0 END AS got
        FROM r JOIN p ON p.scan_id = r.scan_id AND p.place = r.place + 1))
    SELECT scan_id, path, entry, length FROM r WHERE length > 0""",
)
def reserved_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = A.read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("scan_id"), said("'f'", "doc_id").alias("path"), (F.col("doc_id") % 7 == 0).alias("entry"), (F.col("doc_id") % 3).alias("priority"), "text")
    return budget.reserved_budget(pieces, 4800, 1600, 1200, 800)


@query(
    "network_of_address",
    """WITH a AS (SELECT DISTINCT event_id % 3 = 0 AS six, user_id % 256 AS x, event_id % 256 AS y FROM events),
    n AS (SELECT DISTINCT s_suppkey % 256 AS x, s_suppkey % 7 = 0 AS narrow FROM supplier),
    m AS (SELECT a.*, n.narrow FROM a JOIN n ON a.x = n.x AND (NOT n.narrow OR a.y >= 128 AND NOT six OR six AND y < 16))
    SELECT CASE WHEN six THEN 'fd00:' || printf('%x', x) || '::' || printf('%x', y) ELSE '93.' || x || '.7.' || y END AS addr, max(CASE WHEN six THEN CASE WHEN narrow THEN 124 ELSE 32 END ELSE CASE WHEN narrow THEN 25 ELSE 16 END END)::INT AS size FROM m GROUP BY six, x, y""",
)
def network_of_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest network of each address that a trace connects to, IPv4 and IPv6; networks come from a table."""
    hexed = lambda c: F.lower(F.hex(F.expr(c)))
    six = F.concat(F.lit("fd00:"), hexed("user_id % 256"), F.lit("::"), hexed("event_id % 256"))
    events = A.read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, six).otherwise(said("'93.'", "user_id % 256", "'.7.'", "event_id % 256")).alias("addr"))
    narrow = F.col("s_suppkey") % 7 == 0
    four_net = F.when(narrow, said("'93.'", "s_suppkey % 256", "'.7.128/25'")).otherwise(said("'93.'", "s_suppkey % 256", "'.0.0/16'"))
    six_net = F.when(narrow, F.concat(F.lit("fd00:"), hexed("s_suppkey % 256"), F.lit("::/124"))).otherwise(F.concat(F.lit("fd00:"), hexed("s_suppkey % 256"), F.lit("::/32")))
    nets = A.read(spark, sf_dir, "supplier").select(F.explode(F.array(four_net, six_net)).alias("network")).distinct()
    return networks.longest(events, nets).select("addr", "size")


@query(
    "go_init_bodies",
    """SELECT doc_id, sha256(' s := `{' || replace(coalesce(text, ''), '`', '') || '`; if s != "}" { f(); /* } */ } ' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN ' g() ' ELSE '{}' END) AS bodies_sha256 FROM documents""",
)
def go_init_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of init functions of Go files that hold whole texts in literals, with braces in texts, comments and other functions around."""
    first = F.concat(F.lit(' s := `{'), F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit("")), F.lit('`; if s != "}" { f(); /* } */ } '))
    second = F.when(F.col("doc_id") % 2 == 0, " g() ").otherwise("{}")
    source = F.concat(F.lit("package p\nfunc a() { // {\n}\nfunc init() {"), first, F.lit("}\nfunc b() { func init() { x } }\nfunc  init ( ) {"), second, F.lit("}\n"))
    files = A.read(spark, sf_dir, "documents").select("doc_id", source.alias("source"))
    return files.select("doc_id", F.sha2(F.array_join(file_rules.blocks(F.col("source"), file_rules.GO_TOKENS, "func"), "\n"), 256).alias("bodies_sha256"))


# --- more of traces, packuments, promotions --------------------------------------------------------------------------


@query(
    "trace_without_noise",
    "WITH " + A.TRACE
    + """, n AS (SELECT DISTINCT s_suppkey % 256 AS x FROM supplier WHERE s_suppkey % 3 = 0),
    m AS (SELECT t.*, coalesce(category = 'network' AND split_part(addr, '.', 1) = '93' AND split_part(addr, '.', 2)::INT IN (SELECT x FROM n), false) AS inside,
      category = 'network' AND event_id % 53 = 4 AS bad, CASE WHEN category = 'network' THEN CASE WHEN event_id % 53 = 4 THEN 'x.evil.example' WHEN event_id % 7 = 0 THEN 'cdn.registry.example' ELSE 'other.example' END END AS host FROM trace t)
    SELECT event_id, bad AS abuse_host FROM m WHERE bad OR NOT coalesce(category = 'file' AND contains(path, '/lib/1') OR category = 'process' AND operation = 'exec' AND contains(bin, 'docker') AND event_id % 5 <> 0
      OR category = 'network' AND operation = 'connect' AND (inside OR host = 'cdn.registry.example'), false)""",
)
def trace_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without known noise: paths, binaries that run no local script, hosts, and networks from a table."""
    at = F.col("event_id")
    host = F.when(F.col("category") == "network", F.when(at % 53 == 4, "x.evil.example").when(at % 7 == 0, "cdn.registry.example").otherwise("other.example"))
    events = A.trace(spark, sf_dir).withColumns({"hostname": host, "arguments": F.when(at % 5 == 0, "run ./setup.js").otherwise("ps")})
    nets = A.read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(said("'93.'", "s_suppkey % 256", "'.0.0/16'").alias("network")).distinct()
    return trace.drop_noise(events, paths=("/lib/1",), binaries=("docker",), hosts=("registry.example",), abuse=("evil.example",), networks=nets).select("event_id", "abuse_host")


@query(
    "trace_log_events",
    """SELECT event_id AS pid, CASE WHEN event_id % 4 = 0 THEN 'process' WHEN event_id % 4 = 1 THEN 'network' ELSE 'file' END AS category,
    CASE WHEN event_id % 4 = 0 THEN 'exec' WHEN event_id % 4 = 1 THEN 'connect' WHEN event_id % 4 = 2 THEN 'open' ELSE 'write' END AS operation,
    CASE WHEN event_id % 4 > 1 THEN '/tmp/' || user_id END AS path, CASE WHEN event_id % 4 = 1 THEN '10.0.0.' || user_id % 256 END AS addr, CASE WHEN event_id % 4 = 1 THEN 443.0::DOUBLE END AS port, epoch_us(ts) AS micros
    FROM events WHERE user_id % 5 <> 0 AND event_id % 11 <> 0""",
)
def trace_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log of executions and probes as events; lines of other containers and broken ones give nothing."""
    k = F.expr("event_id % 4")
    process = F.struct(F.col("event_id").cast("int").alias("pid"), F.lit("/usr/bin/node").alias("binary"), F.when(F.col("user_id") % 5 == 0, "other").otherwise("abcdef0123").alias("docker"))
    arg = F.struct(F.when(k == 1, F.struct(said("'10.0.0.'", "user_id % 256").alias("daddr"), F.lit(443).alias("dport"))).alias("sock_arg"), F.when(k > 1, said("'/tmp/'", "user_id")).alias("string_arg"))
    name = F.when(k == 1, "tcp_connect").when(k == 2, "security_file_open").otherwise("__x64_sys_write")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.when(k == 0, F.to_json(F.struct(time.alias("time"), F.struct(process.alias("process")).alias("process_exec")))).otherwise(
        F.to_json(F.struct(time.alias("time"), F.struct(name.alias("function_name"), process.alias("process"), F.array(arg).alias("args")).alias("process_kprobe")))
    )
    lines = A.read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 == 0, F.substring(line, 2, 50)).otherwise(line).alias("value"))
    return trace.parse_log(lines, ("abcdef",)).select(F.col("pid").cast("long").alias("pid"), "category", "operation", "path", "addr", "port", F.unix_micros("ts").alias("micros"))


@query(
    "packument_flags",
    """WITH v AS (SELECT 'pkg' || o_custkey AS name, o_orderkey AS version, o_orderdate AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'node setup.js' WHEN o_orderkey % 3 = 1 THEN 'echo hi' END AS hook, floor(o_totalprice)::BIGINT AS size,
      o_orderkey % 40 + 1 AS files, o_orderpriority AS publisher FROM orders),
    l AS (SELECT *, lag(version) OVER w AS pv, lag(hook) OVER w AS ph, lag(size) OVER w AS ps, lag(files) OVER w AS pf, lag(publisher) OVER w AS pp, row_number() OVER (PARTITION BY name ORDER BY day DESC, version DESC) AS age FROM v WINDOW w AS (PARTITION BY name ORDER BY day, version)),
    f AS (SELECT name, version, hook IS NOT NULL AND ph IS NULL AS added, hook IS NOT NULL AND ph IS NOT NULL AND hook <> ph AS changed, coalesce(hook, '') LIKE 'node %' AS bundled, ps > 0 AND size >= 3 * ps AS jump, pf > 0 AND files >= 3 * pf AS fjump, publisher <> pp AS pub
      FROM l WHERE age = 1 AND pv IS NOT NULL),
    t AS (SELECT *, list_filter([CASE WHEN added THEN 'hook_added' END, CASE WHEN changed THEN 'hook_changed' END, CASE WHEN (added OR changed) AND bundled THEN 'bundled_exec' END, CASE WHEN jump THEN 'size_jump' END,
      CASE WHEN fjump THEN 'file_count_jump' END, CASE WHEN pub THEN 'publisher_change' END], lambda x: x IS NOT NULL) AS flags FROM f)
    SELECT name, version, array_to_string(flags, ',') AS flags, CASE WHEN added OR changed OR len(flags) >= 2 THEN 'high' ELSE 'normal' END AS priority FROM t WHERE len(flags) > 0 AND flags <> ['file_count_jump']""",
)
def packument_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of the newest version of each package against the one before."""
    key = F.col("o_orderkey")
    hook = F.when(key % 3 == 0, "node setup.js").when(key % 3 == 1, "echo hi")
    rows = A.read(spark, sf_dir, "orders").select(
        said("'pkg'", "o_custkey").alias("name"), key.alias("version"), F.col("o_orderdate").alias("published_at"), F.when(hook.isNotNull(), F.create_map(F.lit("postinstall"), hook)).alias("scripts"),
        F.floor("o_totalprice").alias("size"), (key % 40 + 1).alias("file_count"), F.col("o_orderpriority").alias("publisher"),
    )
    return history.packument_anomalies(rows)


@query(
    "promotion_states",
    "WITH " + A.WATCHLIST
    + """, c AS (SELECT DISTINCT ['pypi', 'npm', 'gomod', 'crates'][(o_custkey % 4 + 1)::INT] AS ecosystem, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS name, min(o_orderdate) AS day FROM orders GROUP BY o_custkey),
    w AS (SELECT ecosystem, name, bool_or(package_id % 10 = 0) AS sentinel FROM watchlist WHERE rank <= 300 GROUP BY ALL),
    k AS (SELECT c.*, CASE WHEN right(c.name, 1) = '7' THEN 'blocklisted' WHEN sentinel THEN 'refreshed' WHEN sentinel IS NOT NULL THEN 'already_popularity' END AS known FROM c LEFT JOIN w USING (ecosystem, name))
    SELECT ecosystem, name, known AS status FROM k WHERE known IS NOT NULL UNION ALL
    SELECT ecosystem, name, CASE WHEN row_number() OVER (PARTITION BY ecosystem, day ORDER BY name) <= 2 THEN 'added' ELSE 'rate_limited' END FROM k WHERE known IS NULL""",
)
def promotion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adding confirmed names to the watch list does, with at most two an hour for an ecosystem."""
    orders = A.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("at"))
    candidates = orders.select(A.ecosystem("o_custkey").alias("ecosystem"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"), "at")
    watched = A.watchlist(spark, sf_dir, 300).select("ecosystem", "name", F.when(F.col("package_id") % 10 == 0, campaign.SENTINEL_RANK).otherwise(F.col("rank")).alias("rank"))
    blocked = candidates.where(F.endswith("name", F.lit("7"))).select("ecosystem", "name")
    return campaign.promotion_status(candidates, watched, blocked, per_hour=2)


@query(
    "prior_scan_of_package",
    "WITH " + A.SCANS
    + """, c AS (SELECT ecosystem, name, max(scan_id) AS scan_id FROM scans GROUP BY ALL)
    SELECT c.ecosystem, c.name, c.scan_id, max_by(s.scan_id, (s.finished_at, s.scan_id)) AS prior_id FROM c JOIN scans s ON s.ecosystem = c.ecosystem AND s.name = c.name AND s.scan_id <> c.scan_id
    WHERE s.finished_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY GROUP BY ALL""",
)
def prior_scan_of_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = A.scans(spark, sf_dir)
    current = scans.groupBy("ecosystem", "name").agg(F.max("scan_id").alias("scan_id"))
    return history.prior_scans(scans, current, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query(
    "serial_log_rows",
    """WITH s AS (SELECT 'p' || o_custkey AS name, CASE WHEN o_orderkey % 4 <> 0 THEN '1.' || o_orderkey END AS version, o_orderkey AS serial, CASE WHEN o_orderkey % 4 = 0 THEN 'create' WHEN o_orderkey % 9 = 1 THEN 'remove release' ELSE 'new release' END AS action
      FROM orders WHERE o_orderkey > 200 ORDER BY serial LIMIT 3000)
    SELECT name, version, serial, name IN (SELECT name FROM s WHERE action = 'create') AS brand_new FROM s WHERE version IS NOT NULL AND action NOT LIKE 'remove%'""",
)
def serial_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll of the serial log: the rows after a cursor, at most so many."""
    key = F.col("o_orderkey")
    action = F.when(key % 4 == 0, "create").when(key % 9 == 1, "remove release").otherwise("new release")
    rows = A.read(spark, sf_dir, "orders").select(said("'p'", "o_custkey").alias("name"), F.when(key % 4 != 0, said("'1.'", "o_orderkey")).alias("version"), key.alias("serial"), action.alias("action"))
    return feeds.serial_changes(rows, 200, 3000)
