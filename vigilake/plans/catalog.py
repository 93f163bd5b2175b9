"""The registered queries: an adapter, an operator, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import text as T
from vigilake.intel import BASELINE, SENTINEL_RANK, SHADOW_PREFIX
from vigilake.operators import campaign, gates, history, limits, matching, queue, reports, scoring, trace
from vigilake.operators.signatures import BUILT_IN, MEDIA, signature_findings
from vigilake.operators.thresholds import as_sql
from vigilake.plans import adapters as A
from vigilake.plans import details  # noqa: F401  (registers its queries)
from vigilake.plans.registry import query

AS_OF = f"TIMESTAMP '{A.AS_OF}'"


def with_(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


# --- scoring ---------------------------------------------------------------------------------------------------------


@query(
    "score_verdict",
    with_(A.FINDINGS, A.SCORED, A.WATCHLIST)
    + """SELECT s.scan_id, score, CASE WHEN rank <= 100 AND (high OR critical) THEN 'malicious' WHEN rank IS NOT NULL AND verdict = 'clean' AND medium THEN 'suspicious' ELSE verdict END AS verdict,
    CASE WHEN rank <= 100 AND (high OR critical) THEN 'watchlist_top100' END AS alert_tag FROM judged s LEFT JOIN watchlist ON package_id = s.scan_id % 5000""",
)
def score_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.findings(spark, sf_dir)
    ranks = A.watchlist(spark, sf_dir).select("package_id", F.col("rank").alias("watchlist_rank"))
    scans = found.select("scan_id").distinct().withColumn("package_id", F.col("scan_id") % 5000).join(ranks, "package_id", "left")
    return scoring.verdicts(scans, found)


@query(
    "shadow_excluded_score",
    with_(A.FINDINGS.replace("findings AS", "all_findings AS", 1), "findings AS (SELECT * FROM all_findings WHERE category <> 'click')", A.SCORED)
    + "SELECT a.scan_id, coalesce(score, 0) AS score, coalesce(verdict, 'clean') AS verdict FROM (SELECT DISTINCT scan_id FROM all_findings) a LEFT JOIN judged USING (scan_id)",
)
def shadow_excluded_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.findings(spark, sf_dir)
    trial = found.withColumn("rule_id", F.when(F.col("category") == "click", F.concat(F.lit(SHADOW_PREFIX), "rule_id")).otherwise(F.col("rule_id")))
    scans = found.select("scan_id").distinct().withColumn("watchlist_rank", F.lit(None).cast("long"))
    return scoring.verdicts(scans, trial).drop("alert_tag")


@query("rule_hits", with_(A.FINDINGS) + "SELECT rule_id, count(*) AS count FROM findings GROUP BY 1")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rule_hits(A.findings(spark, sf_dir))


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(
    "top_findings_grouped",
    with_(A.FINDINGS)
    + f"""SELECT user_id AS scan_id, rule_id, evidence, n, places, ['low', 'medium', 'high', 'critical'][worst // 10] AS severity, place, more FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY worst DESC, rule_id, evidence) AS place, greatest(count(*) OVER (PARTITION BY user_id) - 8, 0) AS more FROM (
    SELECT user_id, rule_id, evidence, count(*) AS n, array_to_string(list_sort(list(DISTINCT file || ':' || line)), ',') AS places,
    max({_RANK} * 10 + CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS worst FROM findings GROUP BY 1, 2, 3)) WHERE place <= 8""",
)
def top_findings_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_findings(A.findings(spark, sf_dir).withColumn("scan_id", F.col("user_id")))


@query(
    "noise_cap",
    with_(A.FINDINGS)
    + """, placed AS (SELECT user_id AS scan_id, category AS rule_id, file, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id, category) AS n FROM findings
    WINDOW w AS (PARTITION BY user_id, category ORDER BY file, finding_id))
    SELECT scan_id, rule_id, file, NULL::BIGINT AS more FROM placed WHERE place <= 3 UNION ALL SELECT scan_id, rule_id, '' AS file, n - 3 FROM placed WHERE place = 1 AND n > 3""",
)
def noise_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.noise_cap(A.findings(spark, sf_dir).select(F.col("user_id").alias("scan_id"), F.col("category").alias("rule_id"), "file", "finding_id"))


_LLM = with_(A.SCANS, A.SCORED) + ", base AS (SELECT s.*, j.verdict, j.critical FROM scans s JOIN judged j USING (scan_id))"


def judged_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = A.scans(spark, sf_dir)
    judged = scoring.verdicts(scans.select("scan_id", F.lit(None).cast("long").alias("watchlist_rank")), A.findings(spark, sf_dir))
    return scans.join(judged, "scan_id")


@query(
    "llm_verdict_override",
    _LLM
    + """, f AS (SELECT *, scan_id % 17 = 0 AS injection, scan_id % 13 = 0 AS exact_intel, scan_id % 5 = 0 AS chain FROM base),
    t AS (SELECT *, CASE WHEN injection AND llm_verdict = 'benign' AND verdict IN ('malicious', 'suspicious') THEN verdict ELSE llm_verdict END AS told FROM f),
    u AS (SELECT *, CASE WHEN verdict = 'malicious' AND exact_intel THEN 'malicious' WHEN verdict = 'malicious' AND chain AND told IN ('benign', 'suspicious') AND llm_confidence >= 0.8 THEN told
      WHEN verdict = 'malicious' AND chain THEN 'malicious' WHEN told = 'malicious' AND llm_confidence < 0.7 AND verdict <> 'malicious' THEN verdict
      WHEN told IN ('malicious', 'suspicious', 'benign') THEN told WHEN told = 'inconclusive' AND verdict <> 'malicious' THEN 'inconclusive' ELSE verdict END AS final_verdict FROM t)
    SELECT scan_id, verdict, final_verdict, CASE WHEN final_verdict = 'inconclusive' THEN 'needs_review' WHEN coalesce(told, '') NOT IN ('benign', 'suspicious', 'malicious') THEN 'llm_unverified' END AS final_tag,
      (verdict = 'malicious' AND coalesce(told, '') NOT IN ('benign', 'suspicious')) OR (coalesce(told, '') = 'malicious' AND llm_confidence >= 0.7) AS alert FROM u""",
)
def llm_verdict_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"injection": F.col("scan_id") % 17 == 0, "exact_intel": F.col("scan_id") % 13 == 0, "chain": F.col("scan_id") % 5 == 0}
    return scoring.final_verdicts(judged_scans(spark, sf_dir).withColumns(flags)).select("scan_id", "verdict", "final_verdict", "final_tag", "alert")


@query(
    "watchlist_promotion_gate",
    _LLM
    + """, s AS (SELECT scan_id, count(DISTINCT category) AS n, bool_or(category NOT IN ('click', 'view')) AS prim FROM findings WHERE severity IN ('high', 'critical') GROUP BY 1),
    r AS (SELECT scan_id, CASE WHEN llm_verdict IS NULL OR llm_verdict <> 'malicious' THEN 'not_malicious' WHEN NOT coalesce(prim, false) AND coalesce(n, 0) < 2 THEN 'thin_evidence'
      WHEN coalesce(llm_confidence, 0) < 0.7 THEN 'low_confidence' WHEN verdict <> 'malicious' AND llm_confidence < 0.8 THEN 'uncorroborated' ELSE 'ok' END AS reason FROM base LEFT JOIN s USING (scan_id))
    SELECT scan_id, reason = 'ok' AS qualifies, reason FROM r""",
)
def watchlist_promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = F.when(F.col("category") == "click", "iocs").when(F.col("category") == "view", "metadata").otherwise(F.col("category"))
    return gates.promotion_gate(judged_scans(spark, sf_dir), A.findings(spark, sf_dir).withColumn("category", renamed))


# --- queue -----------------------------------------------------------------------------------------------------------


@query("queue_status_by_ecosystem", with_(A.QUEUE) + "SELECT ecosystem, status, count(*) AS n FROM queue GROUP BY 1, 2")
def queue_status_by_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.queue_status(A.queue(spark, sf_dir))


@query(
    "queue_throughput_window",
    with_(A.QUEUE)
    + f"""SELECT ecosystem, i AS ingested, d AS done, i - d AS net FROM (SELECT ecosystem, count(*) FILTER (enqueued_at BETWEEN {AS_OF} - INTERVAL 60 DAY AND {AS_OF}) AS i,
    count(*) FILTER (status = 'done' AND finished_at BETWEEN {AS_OF} - INTERVAL 60 DAY AND {AS_OF}) AS d FROM queue GROUP BY 1)""",
)
def queue_throughput_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.throughput(A.queue(spark, sf_dir), A.as_of(), 60 * 24 * 60)


@query(
    "queue_priority_counts",
    with_(A.QUEUE) + "SELECT ecosystem, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'normal') AS normal, count(*) FILTER (priority = 'low') AS low FROM queue WHERE status = 'pending' GROUP BY 1",
)
def queue_priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.priority_counts(A.queue(spark, sf_dir))


@query(
    "queue_fair_weights",
    with_(A.QUEUE)
    + """SELECT priority, ecosystem, n, round(CASE WHEN k <= 1 THEN 1.0 ELSE least(0.4 / k + 0.6 * n / total, greatest(0.4 / k, 0.7)) END::DOUBLE, 6) AS weight FROM (
    SELECT *, count(*) OVER w AS k, sum(n) OVER w AS total FROM (SELECT priority, ecosystem, count(*) AS n FROM queue WHERE status = 'pending' GROUP BY 1, 2) WINDOW w AS (PARTITION BY priority))""",
)
def queue_fair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.fair_weights(A.queue(spark, sf_dir).where("status = 'pending'"))


@query("queue_next_per_tier", with_(A.QUEUE) + "SELECT priority, ecosystem, id, enqueued_at FROM queue WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY priority, ecosystem ORDER BY enqueued_at, id) = 1")
def queue_next_per_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.next_per_tier(A.queue(spark, sf_dir))


@query(
    "detonation_pull_order",
    with_(A.QUEUE) + "SELECT id, priority, row_number() OVER (PARTITION BY priority ORDER BY CASE WHEN priority = 'low' THEN -epoch_us(enqueued_at) ELSE epoch_us(enqueued_at) END, id) AS place FROM queue WHERE status = 'pending'",
)
def detonation_pull_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.detonation_order(A.queue(spark, sf_dir))


@query(
    "enqueue_transitions",
    with_(A.QUEUE)
    + """, req AS (SELECT ecosystem, name, CASE WHEN id % 3 = 0 THEN version || 'x' ELSE version END AS version, (id % 3)::INT AS asked, id % 4 = 0 AS rescan FROM queue),
    j AS (SELECT r.*, q.status AS old, q.attempts, CASE q.priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END AS rank FROM req r LEFT JOIN queue q USING (ecosystem, name, version)),
    a AS (SELECT *, CASE WHEN old IS NULL THEN 'insert' WHEN old IN ('pending', 'claimed') THEN CASE WHEN asked < rank THEN 'raise' ELSE 'keep' END WHEN rescan THEN 'reset'
      WHEN old = 'failed' AND attempts < 3 THEN 'retry' ELSE 'keep' END AS action FROM j)
    SELECT ecosystem, name, version, action, CASE WHEN action IN ('insert', 'reset', 'retry') THEN 'pending' ELSE old END AS status,
      ['high', 'normal', 'low'][1 + CASE WHEN action IN ('insert', 'reset') THEN asked WHEN action IN ('raise', 'retry') THEN least(asked, rank) ELSE rank END] AS priority, coalesce(attempts, 0) AS attempts FROM a""",
)
def enqueue_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = A.queue(spark, sf_dir)
    asked = F.element_at(F.array(*map(F.lit, ("high", "normal", "low"))), (F.col("id") % 3 + 1).cast("int"))
    version = F.when(F.col("id") % 3 == 0, F.concat("version", F.lit("x"))).otherwise(F.col("version"))
    wanted = held.select("ecosystem", "name", version.alias("version"), asked.alias("priority"), (F.col("id") % 4 == 0).alias("allow_rescan"))
    return queue.enqueue(held, wanted)


@query(
    "stale_claim_sweep",
    with_(A.QUEUE) + f"SELECT id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN attempts >= 3 THEN 'claim_timeout' END AS last_error FROM queue WHERE status = 'claimed' AND claimed_at < {AS_OF} - INTERVAL 1800 SECOND",
)
def stale_claim_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.stale_claims(A.queue(spark, sf_dir), A.as_of())


@query("ttl_prune", with_(A.QUEUE) + f"SELECT id, ecosystem FROM queue WHERE finished_at >= {AS_OF} - INTERVAL 14 DAY")
def ttl_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.prune(A.queue(spark, sf_dir), "finished_at", A.as_of(), 14).select("id", "ecosystem")


@query("over_cap_evict", with_(A.QUEUE) + "SELECT id, ecosystem FROM queue QUALIFY row_number() OVER (PARTITION BY ecosystem ORDER BY enqueued_at DESC, id DESC) > 1000")
def over_cap_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.over_cap(A.queue(spark, sf_dir), "ecosystem", "enqueued_at", 1000).select("id", "ecosystem")


@query("missing_from_queue", with_(A.QUEUE, A.WATCHLIST) + "SELECT ecosystem, w.name FROM watchlist w WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE q.ecosystem = w.ecosystem AND q.name = 'pkg' || w.package_id * 2)")
def missing_from_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = A.watchlist(spark, sf_dir).select("ecosystem", F.col("name").alias("said"), F.concat(F.lit("pkg"), (F.col("package_id") * 2).cast("string")).alias("name"))
    return queue.missing_from(wanted, A.queue(spark, sf_dir), "ecosystem", "name").select("ecosystem", F.col("said").alias("name"))


@query(
    "watchlist_refresh_merge",
    with_(A.WATCHLIST)
    + f""", held AS (SELECT ecosystem, name, CASE WHEN package_id % 10 = 0 THEN {SENTINEL_RANK} ELSE rank END AS old FROM watchlist WHERE package_id % 3 <> 0),
    fresh AS (SELECT ecosystem, name, rank + package_id % 2 AS new FROM watchlist WHERE package_id % 4 <> 0)
    SELECT ecosystem, name, CASE WHEN old = {SENTINEL_RANK} THEN old ELSE new END AS rank, CASE WHEN old = {SENTINEL_RANK} THEN 'preserved' WHEN old IS NULL THEN 'inserted' WHEN old <> new THEN 'updated' ELSE 'same' END AS action
    FROM held FULL JOIN fresh USING (ecosystem, name) WHERE old = {SENTINEL_RANK} OR new IS NOT NULL""",
)
def watchlist_refresh_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = A.watchlist(spark, sf_dir)
    held = ranked.where("package_id % 3 <> 0").withColumn("rank", F.when(F.col("package_id") % 10 == 0, F.lit(SENTINEL_RANK).cast("long")).otherwise(F.col("rank")))
    fresh = ranked.where("package_id % 4 <> 0").withColumn("rank", F.col("rank") + F.col("package_id") % 2)
    return queue.refresh_merge(held, fresh, SENTINEL_RANK)


@query("watchlist_topn", with_(A.WATCHLIST) + "SELECT name, ecosystem, rank FROM watchlist WHERE rank <= 100")
def watchlist_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.watchlist(spark, sf_dir, 100).select("name", "ecosystem", "rank")


@query(
    "trailing_counts",
    "SELECT event_id, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)",
)
def trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.trailing_counts(A.read(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", 3600).select("event_id", "n")


@query(
    "trailing_rate_limit",
    """WITH RECURSIVE e AS (SELECT event_id, lower(event_type) AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY lower(event_type) ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT k, 0::BIGINT AS n, NULL::BIGINT AS event_id, false AS allowed, []::BIGINT[] AS held FROM (SELECT DISTINCT k FROM e)
      UNION ALL SELECT k, n, event_id, len(h) < 20, CASE WHEN len(h) < 20 THEN list_append(h, t) ELSE h END
      FROM (SELECT e.*, list_filter(r.held, lambda x: e.t - x <= 3600000000) AS h FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1))
    SELECT event_id, allowed FROM r WHERE n > 0""",
)
def trailing_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a limit of 20 an hour admits; the SQL twin decides event by event."""
    return limits.admitted(A.read(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["event_type"], "ts", "event_id", 3600, 20).select("event_id", "allowed")


@query(
    "spend_budget",
    """SELECT event_id, coalesce(sum(c) OVER w, 0) >= 300 OR count(*) OVER w >= 1000 AS blocked FROM (SELECT *, (event_id % 37)::DOUBLE AS c, epoch_us(ts) AS t FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)""",
)
def spend_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = A.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), "ts", (F.col("event_id") % 37).cast("double").alias("cost"))
    return limits.spend_blocked(calls, "ts", "cost", most_cost=300.0).select("event_id", "blocked")


@query(
    "ingest_gate",
    with_(A.QUEUE, A.WATCHLIST)
    + """, w AS (SELECT DISTINCT 'pkg' || package_id AS name FROM watchlist WHERE rank <= 300), d AS (SELECT DISTINCT name FROM queue WHERE status = 'done'),
    g AS (SELECT q.id, CASE WHEN q.id % 50 = 0 OR w.name IS NOT NULL THEN 'high' WHEN d.name IS NULL THEN 'normal' END AS p, q.version, q.id FROM queue q LEFT JOIN w USING (name) LEFT JOIN d USING (name))
    SELECT id, CASE WHEN p = 'normal' AND id % 9 = 0 THEN 'high' ELSE p END AS priority FROM g WHERE p IS NOT NULL""",
)
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = A.queue(spark, sf_dir).select("id", "name", "version", "status")
    watched = A.watchlist(spark, sf_dir, 300).select(F.concat(F.lit("pkg"), F.col("package_id").cast("string")).alias("name"), F.lit(True).alias("watched")).distinct()
    seen = changes.where("status = 'done'").select("name", F.lit(True).alias("seen")).distinct()
    told = changes.join(watched, "name", "left").join(seen, "name", "left")
    priority = gates.ingest_priority(F.col("id") % 50 == 0, F.coalesce("watched", F.lit(False)), F.col("seen").isNull())
    return told.withColumn("priority", priority).where("priority IS NOT NULL").select("id", gates.promoted(F.col("priority"), F.col("id") % 9 == 0, F.concat(F.lit("1."), "version")).alias("priority"))


@query(
    "scope_match",
    "SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS name FROM part WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(lower(replace(p_name, ' ', '-')), '-', 1) AS s FROM part WHERE p_partkey % 7 = 0) WHERE lower(replace(p_name, ' ', '-')) = s OR starts_with(lower(replace(p_name, ' ', '-')), s || '-'))",
)
def scope_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = A.read(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"), F.lit("pypi").alias("ecosystem"))
    scopes = parts.where("p_partkey % 7 = 0").select("ecosystem", F.split_part("name", F.lit("-"), F.lit(1)).alias("scope"))
    return gates.in_scope(parts, scopes).select("p_partkey", "name")


# --- history ---------------------------------------------------------------------------------------------------------


@query(
    "version_anomaly",
    with_(A.VERSIONS)
    + """, h AS (SELECT *, lag(size) OVER w AS ps, lag(publisher) OVER w AS pp, lag(hook) OVER w AS ph, lag(version) OVER w AS pv, row_number() OVER (PARTITION BY ecosystem, name ORDER BY published_at DESC, version DESC) AS age
      FROM versions WINDOW w AS (PARTITION BY ecosystem, name ORDER BY published_at, version)),
    f AS (SELECT ecosystem, name, version, hook AND NOT coalesce(ph, false) AS a, ps > 0 AND size >= 3 * ps AND size - ps >= 25000 AS b, ps >= 25000 AND size - ps >= 50000 AS c, publisher <> pp AS d FROM h WHERE age = 1 AND pv IS NOT NULL)
    SELECT ecosystem, name, version, concat_ws(',', CASE WHEN a THEN 'hook_added' END, CASE WHEN b THEN 'size_jump' END, CASE WHEN c THEN 'size_delta' END, CASE WHEN d THEN 'publisher_change' END) AS flags,
      CASE WHEN a OR a::INT + b::INT + c::INT + d::INT >= 2 THEN 'high' ELSE 'normal' END AS priority FROM f WHERE a OR b OR c OR d""",
)
def version_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.version_anomalies(A.versions(spark, sf_dir), min_delta=25_000, big_delta=50_000, min_base=25_000)


@query(
    "changed_files",
    with_(A.TWO_SCANS) + "SELECT c.scan_id, c.package, c.path, c.sha256, p.sha256 AS old_sha FROM cur c LEFT JOIN prev p USING (package, archive_kind, path) WHERE p.sha256 IS NULL OR p.sha256 <> c.sha256",
)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changed_files(*A.two_scans(spark, sf_dir)).select("scan_id", "package", "path", "sha256", "old_sha")


@query(
    "entropy_delta",
    with_(A.TWO_SCANS)
    + """SELECT c.scan_id, c.path, round(c.entropy - p.entropy, 6) AS delta FROM cur c JOIN prev p USING (package, archive_kind, path)
    WHERE p.sha256 <> c.sha256 AND c.entropy > 0 AND p.entropy > 0 AND round(c.entropy - p.entropy, 6) >= 1.5""",
)
def entropy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.entropy_jumps(*A.two_scans(spark, sf_dir)).select("scan_id", "path", "delta")


_HALF = "TIMESTAMP '2024-01-28 00:00:00'"


@query(
    "finding_set_diff",
    with_(A.FINDINGS)
    + f""", c AS (SELECT user_id AS package, list(DISTINCT rule_id) AS r, list(DISTINCT rule_id) FILTER (severity = 'critical') AS k FROM findings WHERE ts >= {_HALF} GROUP BY 1),
    p AS (SELECT user_id AS package, list(DISTINCT rule_id) AS pr FROM findings WHERE ts < {_HALF} AND user_id % 4 <> 0 GROUP BY 1),
    j AS (SELECT package, list_sort(list_filter(r, lambda x: NOT list_contains(coalesce(pr, []), x))) AS n, list_sort(list_filter(coalesce(k, []), lambda x: NOT list_contains(coalesce(pr, []), x))) AS nk, pr IS NULL AS clean FROM c LEFT JOIN p USING (package))
    SELECT package, array_to_string(n, ',') AS new_rules, array_to_string(nk, ',') AS new_critical, clean AS prev_clean,
      CASE WHEN clean AND len(nk) > 0 THEN 'version_diff.clean_to_critical' WHEN clean AND len(n) > 0 THEN 'version_diff.new_rules_fired' END AS rule_id FROM j""",
)
def finding_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.findings(spark, sf_dir).select(F.col("user_id").alias("package"), "rule_id", "severity", "ts")
    at = F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
    return history.finding_set_diff(found.where(F.col("ts") >= at), found.where((F.col("ts") < at) & (F.col("package") % 4 != 0)))


@query(
    "carry_forward",
    with_(A.TWO_SCANS)
    + """, pf AS (SELECT package, 'r' || (scan_id % 3) AS rule_id, path AS file FROM prev), cf AS (SELECT package, 'r' || (scan_id % 3) AS rule_id, path AS file FROM cur WHERE scan_id % 5 = 0)
    SELECT DISTINCT pf.package, pf.rule_id, pf.file FROM pf JOIN prev p ON p.package = pf.package AND p.path = pf.file JOIN cur c ON c.package = p.package AND c.path = p.path AND c.sha256 = p.sha256
    WHERE NOT EXISTS (SELECT 1 FROM cf WHERE cf.package = pf.package AND cf.rule_id = pf.rule_id AND cf.file = pf.file)""",
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur, prev = A.two_scans(spark, sf_dir)
    rule = F.concat(F.lit("r"), (F.col("scan_id") % 3).cast("string")).alias("rule_id")
    told = lambda df: df.select("package", rule, F.col("path").alias("file"))
    return history.carry_forward(told(prev), prev, cur, told(cur.where("scan_id % 5 = 0"))).select("package", "rule_id", "file")


_EDGES = "deps AS (SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS d FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), bad AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size % 25 = 0)"


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("deps"))


def _known_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "part").where("p_size % 25 = 0").select(F.col("p_name").alias("name")).distinct()


@query(
    "new_bad_edge",
    with_(A.VERSIONS, _EDGES)
    + """, h AS (SELECT name, version, d, lag(coalesce(d, [])) OVER w AS b, row_number() OVER (PARTITION BY name ORDER BY published_at DESC, version DESC) AS age
      FROM versions LEFT JOIN deps ON l_orderkey = version WINDOW w AS (PARTITION BY name ORDER BY published_at, version))
    SELECT name, version, min(x) AS dependency FROM (SELECT name, version, b, unnest(d) AS x FROM h WHERE age = 1) WHERE NOT list_contains(coalesce(b, []), x) AND x IN (SELECT bad.name FROM bad) GROUP BY 1, 2""",
)
def new_bad_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = _dependencies(spark, sf_dir).withColumnRenamed("l_orderkey", "version")
    told = A.versions(spark, sf_dir).select("name", "version", "published_at").join(deps, "version", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    return history.new_bad_edges(told, _known_bad(spark, sf_dir))


@query(
    "known_bad_dependency",
    with_(A.VERSIONS, _EDGES)
    + """, h AS (SELECT version AS package, coalesce(d, []) AS d, lag(coalesce(d, [])) OVER (PARTITION BY name ORDER BY published_at, version) AS b FROM versions LEFT JOIN deps ON l_orderkey = version),
    e AS (SELECT DISTINCT package, b, regexp_extract(x, '^\\s*([A-Za-z0-9]+)', 1) AS dependency FROM (SELECT package, b, unnest(d) AS x FROM h)),
    k AS (SELECT DISTINCT lower(regexp_extract(name, '^\\s*([A-Za-z0-9]+)', 1)) AS name FROM bad)
    SELECT DISTINCT package, lower(dependency) AS dependency, CASE WHEN len(coalesce(b, [])) > 0 AND NOT list_contains(list_transform(b, lambda y: lower(regexp_extract(y, '^\\s*([A-Za-z0-9]+)', 1))), lower(dependency)) THEN 'critical' ELSE 'high' END AS severity
    FROM e WHERE lower(dependency) IN (SELECT name FROM k)""".replace("\\\\", "\\"),
)
def known_bad_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    deps = _dependencies(spark, sf_dir).withColumnRenamed("l_orderkey", "version")
    none = F.array().cast("array<string>")
    told = A.versions(spark, sf_dir).select("name", "version", "published_at").join(deps, "version", "left").withColumn("deps", F.coalesce("deps", none))
    before = F.lag("deps").over(Window.partitionBy("name").orderBy("published_at", "version"))
    packages = told.select(F.col("version").alias("package"), "deps", before.alias("prev_deps"))
    # Names in the supplied table are several words; a requirement's name is the first.
    return matching.bad_dependencies(packages, _known_bad(spark, sf_dir).select(matching.requirement_name(F.col("name")).alias("name")))


# --- matching --------------------------------------------------------------------------------------------------------


@query(
    "intel_exact_match",
    """WITH fp AS (SELECT sha256(text) AS sha256, max(source || ':' || CASE doc_id % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious' ELSE 'pua' END) AS x FROM documents WHERE doc_id % 10 = 0 GROUP BY 1)
    SELECT doc_id, split_part(x, ':', 1) AS campaign, split_part(x, ':', 2) AS label, CASE split_part(x, ':', 2) WHEN 'suspicious' THEN 'high' WHEN 'pua' THEN 'medium' ELSE 'critical' END AS severity FROM documents JOIN fp ON sha256(text) = fp.sha256""",
)
def intel_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    label = F.when(F.col("doc_id") % 3 == 0, "malicious").when(F.col("doc_id") % 3 == 1, "suspicious").otherwise("pua")
    prints = docs.where("doc_id % 10 = 0").select("sha256", F.col("source").alias("campaign"), label.alias("label"))
    return matching.exact_matches(docs.select("doc_id", "sha256"), prints).select("doc_id", "campaign", "label", "severity")


@query(
    "typosquat_pairs",
    """WITH top AS (SELECT s_name AS target, s_suppkey AS rank, lower(s_name) AS t FROM supplier WHERE s_suppkey % 5 = 0),
    n AS (SELECT s_name AS name, lower(s_name) AS low FROM supplier UNION SELECT replace(s_name, '#', '-_'), lower(replace(s_name, '#', '-_')) FROM supplier WHERE s_suppkey % 3 = 0
      UNION SELECT 'py-' || s_name, lower('py-' || s_name) FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT s_name || '-sdk', lower(s_name || '-sdk') FROM supplier),
    m AS (SELECT * FROM n WHERE low NOT IN (SELECT t FROM top)),
    c AS (SELECT name, 0 AS k, rank, target FROM m JOIN top ON abs(length(low) - length(t)) <= 1 AND levenshtein(low, t) = 1
      UNION ALL SELECT name, 1, rank, target FROM m JOIN top ON translate(low, '-_.', '') = translate(t, '-_.', '')
      UNION ALL SELECT name, 2, rank, target FROM m JOIN top ON low IN ('python-' || t, 'py-' || t, 'python3-' || t, 'py3-' || t, 'lib' || t)
      UNION ALL SELECT name, 3, rank, target FROM m JOIN top ON low IN (t || '-python', t || '-py', t || '-python3', t || '-py3', t || '-lib', t || '-sdk', t || '-api', t || '-client'))
    SELECT name, ['metadata.typosquat_candidate', 'metadata.typosquat_separator', 'metadata.typosquat_prefix', 'metadata.typosquat_suffix'][k + 1] AS rule_id, target FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY k, rank, target) = 1""",
)
def typosquat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = A.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    name = F.col("s_name")
    parts = [supplier.select(name.alias("name")), supplier.where("s_suppkey % 3 = 0").select(F.replace(name, F.lit("#"), F.lit("-_")).alias("name"))]
    parts += [supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("py-"), name).alias("name")), supplier.select(F.concat(name, F.lit("-sdk")).alias("name"))]
    names = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return matching.typosquats(names, supplier.where("s_suppkey % 5 = 0").select(name.alias("name"), F.col("s_suppkey").alias("rank")))


_LURES = [word for _, words in sorted(BASELINE.lures.items()) for word in words]


@query(
    "lure_names",
    f"""WITH n AS (SELECT p_partkey, {_LURES}[1 + p_partkey % 18] || '-' || {_LURES}[1 + p_partkey % 7] || CASE WHEN p_partkey % 5 = 0 THEN '-Scanner-api-key' ELSE '' END AS name FROM part),
    c AS (SELECT p_partkey, """
    + ", ".join(f"({' OR '.join(f'contains(lower(name), {w!r})' for w in words)}) AS {kind}" for kind, words in sorted(BASELINE.lures.items()))
    + """ FROM n)
    SELECT p_partkey, concat_ws(',', CASE WHEN credential_secret THEN 'credential_secret' END, CASE WHEN crypto THEN 'crypto' END, CASE WHEN security_theater THEN 'security_theater' END) AS categories,
    CASE WHEN credential_secret::INT + crypto::INT + security_theater::INT >= 3 THEN 'metadata.lure_name_combo' WHEN credential_secret::INT + crypto::INT + security_theater::INT = 2 THEN 'metadata.lure_name' END AS rule_id FROM c""",
)
def lure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, key = F.array(*map(F.lit, _LURES)), F.col("p_partkey").cast("int")
    name = F.concat(F.element_at(words, 1 + key % 18), F.lit("-"), F.element_at(words, 1 + key % 7), F.when(key % 5 == 0, "-Scanner-api-key").otherwise(""))
    parts = A.read(spark, sf_dir, "part").select("p_partkey", matching.lure_categories(name, BASELINE.lures).alias("c"))
    rule = F.when(F.size("c") >= 3, "metadata.lure_name_combo").when(F.size("c") == 2, "metadata.lure_name")
    return parts.select("p_partkey", F.array_join("c", ",").alias("categories"), rule.alias("rule_id"))


@query(
    "ipv4_iocs",
    r"""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b'))) AS ip FROM documents)
    SELECT doc_id, ip, CASE WHEN ip IN ('169.254.169.254', '169.254.170.2') THEN 'metadata' WHEN regexp_matches(ip, '^(?:127\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.|169\.254\.|255\.|224\.|240\.)') THEN 'private'
      WHEN regexp_matches(ip, '^(?:192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)') THEN 'documentation' WHEN ip IN ('1.2.3.4', '4.3.2.1') THEN 'placeholder' ELSE 'routable' END AS kind FROM d""",
)
def ipv4_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.ipv4_literals(F.col("text")))).alias("ip"))
    return docs.withColumn("kind", T.ipv4_kind(F.col("ip")))


@query(
    "entropy_docs",
    """WITH c AS (SELECT doc_id, ch, count(*) AS n, any_value(length(text)) AS total FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) >= 64) WHERE ch <> '' GROUP BY 1, 2)
    SELECT doc_id, round(-sum(n / total * ln(n / total) / ln(2)), 6) AS entropy FROM c GROUP BY 1""",
)
def entropy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.read(spark, sf_dir, "documents").select("doc_id", "text").where(F.length("text") >= 64)
    return docs.select("doc_id", F.round(T.char_entropy("text"), 6).alias("entropy"))


# --- reports, campaigns ----------------------------------------------------------------------------------------------


@query(
    "rule_precision",
    with_(A.SCANS)
    + """, p AS (SELECT rule_id, count(*) FILTER (llm_verdict = 'malicious') AS confirmed, count(*) FILTER (llm_verdict = 'benign') AS cleared, count(*) FILTER (coalesce(llm_verdict, '') NOT IN ('malicious', 'benign')) AS ambiguous
      FROM (SELECT DISTINCT rule_id, scan_id FROM findings) JOIN scans USING (scan_id) GROUP BY 1)
    SELECT *, CASE WHEN confirmed + cleared > 0 THEN round(confirmed / (confirmed + cleared), 6) END AS "precision", coalesce(confirmed + cleared >= 5 AND round(confirmed / (confirmed + cleared), 6) < 0.9, false) AS deny FROM p""",
)
def rule_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rule_precision(A.findings(spark, sf_dir), A.scans(spark, sf_dir).select("scan_id", "llm_verdict"))


@query(
    "verdict_parity",
    with_(A.FINDINGS, A.SCORED)
    + """, s AS (SELECT *, CASE WHEN scan_id % 11 = 0 THEN 'suspicious' ELSE verdict END AS was, score + CASE WHEN scan_id % 7 = 0 THEN 1 ELSE 0 END AS old FROM judged)
    SELECT was, verdict AS now, count(*) AS n, count(*) FILTER (old <> score) AS n_score FROM s GROUP BY 1, 2""",
)
def verdict_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.findings(spark, sf_dir)
    now = scoring.verdicts(found.select("scan_id").distinct().withColumn("watchlist_rank", F.lit(None).cast("long")), found)
    was = F.when(F.col("scan_id") % 11 == 0, "suspicious").otherwise(F.col("verdict"))
    stored = now.select("scan_id", was.alias("verdict"), (F.col("score") + F.when(F.col("scan_id") % 7 == 0, 1).otherwise(0)).alias("score"))
    return reports.transitions(stored, now)


@query(
    "watchlist_audit",
    with_(A.SCANS)
    + """, l AS (SELECT ecosystem, name, scan_id FROM scans WHERE llm_verdict = 'malicious' QUALIFY row_number() OVER (PARTITION BY ecosystem, name ORDER BY finished_at DESC, scan_id DESC) = 1),
    s AS (SELECT scan_id, count(DISTINCT category) AS n, bool_or(category NOT IN ('click', 'view')) AS prim FROM findings WHERE severity IN ('high', 'critical') GROUP BY 1)
    SELECT w.ecosystem, w.name, CASE WHEN l.scan_id IS NULL THEN 'no_scan' WHEN coalesce(prim, false) OR coalesce(n, 0) >= 2 THEN 'genuine' ELSE 'thin' END AS status
    FROM (SELECT DISTINCT ecosystem, name FROM scans) w LEFT JOIN l USING (ecosystem, name) LEFT JOIN s ON s.scan_id = l.scan_id""",
)
def watchlist_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = A.scans(spark, sf_dir)
    return campaign.watchlist_audit(scans.select("ecosystem", "name").distinct(), scans, A.findings(spark, sf_dir), ("click", "view"))


@query(
    "review_queue",
    _LLM + "SELECT scan_id, ecosystem, name, verdict FROM base WHERE llm_verdict = 'inconclusive' ORDER BY finished_at DESC, scan_id DESC LIMIT 50",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = judged_scans(spark, sf_dir).where("llm_verdict = 'inconclusive'")
    scans = told.select("scan_id", F.lit("inconclusive").alias("verdict"), "finished_at", F.col("scan_id").alias("version_id"), "score")
    versions = told.select(F.col("scan_id").alias("version_id"), F.col("scan_id").alias("package_id"), F.col("verdict").alias("version"))
    out = reports.review_queue(scans, versions, told.select(F.col("scan_id").alias("package_id"), "ecosystem", "name"))
    return out.select("scan_id", "ecosystem", "name", F.col("version").alias("verdict"))


@query(
    "promotion_candidates",
    _LLM
    + """SELECT ecosystem, name, count(*) AS n FROM base b WHERE verdict = 'malicious' AND EXISTS (SELECT 1 FROM findings f WHERE f.scan_id = b.scan_id AND severity IN ('high', 'critical') AND category NOT IN ('click', 'view')) GROUP BY 1, 2""",
)
def promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.promotion_candidates(judged_scans(spark, sf_dir), A.findings(spark, sf_dir), ("click", "view"), SHADOW_PREFIX)


_CONFIRMED = "confirmed AS (SELECT DISTINCT ecosystem, name FROM base WHERE verdict = 'malicious' AND llm_verdict = 'malicious' AND finished_at >= TIMESTAMP '2024-01-01 00:00:00')"


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.double_confirmed(judged_scans(spark, sf_dir), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query("campaign_correlation", _LLM + ", " + _CONFIRMED + "SELECT ecosystem, name FROM confirmed")
def campaign_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirmed(spark, sf_dir)


@query(
    "maintainer_sweep",
    _LLM
    + ", "
    + _CONFIRMED
    + """, cat AS (SELECT DISTINCT ecosystem, maintainer, name FROM scans),
    m AS (SELECT cat.*, c.name IS NOT NULL AS bad FROM cat LEFT JOIN confirmed c USING (ecosystem, name)),
    t AS (SELECT ecosystem, maintainer, count(*) AS n_all, count(*) FILTER (bad) AS n_bad FROM m GROUP BY 1, 2),
    j AS (SELECT b.*, n_all, n_bad - m.bad::INT AS nb, n_all - 1 - (n_bad - m.bad::INT) AS nc FROM base b JOIN t USING (ecosystem, maintainer) JOIN m ON m.ecosystem = b.ecosystem AND m.maintainer = b.maintainer AND m.name = b.name WHERE verdict = 'malicious')
    SELECT scan_id, CASE WHEN ecosystem NOT IN ('pypi', 'npm') THEN 'unsupported' WHEN scan_id % 19 = 0 THEN 'blocklisted' WHEN scan_id % 7 = 0 THEN 'no_evidence' WHEN scan_id % 23 = 0 THEN 'deduped' WHEN n_all > 100 THEN 'too_many'
      WHEN scan_id % 5 <> 0 AND nb < 2 THEN 'no_correlation' ELSE 'triggered' END AS action, nb::BIGINT AS n_confirmed, nc::BIGINT AS n_clean FROM j""",
)
def maintainer_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = judged_scans(spark, sf_dir)
    key = F.col("scan_id")
    convicted = scans.where("verdict = 'malicious'").select(
        "scan_id", "ecosystem", "name", "maintainer", (key % 5 == 0).alias("high_fidelity"), (key % 7 != 0).alias("evidence"), (key % 19 == 0).alias("blocked"), (key % 23 == 0).alias("swept_recently")
    )
    return campaign.sweep_decisions(convicted, scans.select("ecosystem", "maintainer", "name"), _confirmed(spark, sf_dir))


@query(
    "fingerprint_stats",
    "SELECT source AS campaign, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS n_exact_only, count(*) FILTER (doc_id % 4 = 0) AS n_auto FROM documents GROUP BY 1",
)
def fingerprint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.read(spark, sf_dir, "documents")
    some = F.when(F.col("doc_id") % 3 != 0, F.lit("3:abc:def"))
    return reports.campaign_counts(docs.select(F.col("source").alias("campaign"), some.alias("ssdeep"), F.lit(None).cast("string").alias("tlsh"), F.when(F.col("doc_id") % 4 == 0, "auto:x").otherwise("manual").alias("source")))


@query("latest_scan_per_package", with_(A.SCANS) + "SELECT ecosystem, name, scan_id, finished_at FROM scans QUALIFY row_number() OVER (PARTITION BY ecosystem, name ORDER BY finished_at DESC, scan_id DESC) = 1")
def latest_scan_per_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest(A.scans(spark, sf_dir).select("ecosystem", "name", "scan_id", "finished_at"), ["ecosystem", "name"], "finished_at", "scan_id")


# --- traces ----------------------------------------------------------------------------------------------------------

_END = "TIMESTAMP '2024-01-15 00:00:00'"


def phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trace(spark, sf_dir).withColumn("phase", trace.phase(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))


@query("trace_phase", with_(A.TRACE) + f"SELECT detonation_id, CASE WHEN ts > {_END} THEN 'import' ELSE 'install' END AS phase, category, count(*) AS n FROM trace GROUP BY 1, 2, 3")
def trace_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phased(spark, sf_dir).groupBy("detonation_id", "phase", "category").agg(F.count("*").alias("n"))


_DYN = (
    with_(A.TRACE)
    + f""", kept AS (SELECT *, CASE WHEN ts > {_END} THEN 'import' ELSE 'install' END AS phase FROM trace WHERE NOT (category = 'process' AND operation = 'exec' AND coalesce(bin LIKE '%/docker', false))),
    s AS (SELECT *, bool_or(operation = 'open' AND coalesce(path IN ('/root/.ssh/id_rsa', '/proc/7/environ'), false)) OVER (PARTITION BY detonation_id) AS secret,
      operation = 'connect' AND port <> 53 AND NOT starts_with(addr, '10.') AS outside FROM kept),
    fired AS (SELECT *, 'dyn_' || phase || CASE WHEN secret THEN '_exfil' ELSE '_egress' END AS rule_id, CASE WHEN secret THEN 'high' ELSE 'low' END AS severity FROM s WHERE outside
      UNION ALL SELECT *, 'dyn_abuse_hosting_callback', 'critical' FROM s WHERE operation = 'connect' AND abuse_host
      UNION ALL SELECT *, 'dyn_credential_read', 'high' FROM s WHERE operation = 'open' AND path = '/root/.ssh/id_rsa'
      UNION ALL SELECT *, 'dyn_env_harvest', 'high' FROM s WHERE operation = 'open' AND path = '/proc/7/environ'
      UNION ALL SELECT *, 'dyn_suspicious_write', 'critical' FROM s WHERE operation = 'write' AND path = '/etc/cron.d/x'
      UNION ALL SELECT *, 'dyn_proc_inject', 'critical' FROM s WHERE operation = 'ptrace'),
    dyn AS (SELECT detonation_id, rule_id, severity, event_id FROM fired QUALIFY row_number() OVER (PARTITION BY detonation_id, rule_id ORDER BY ts, event_id) = 1)"""
)


@query("trace_dyn_findings", _DYN + " SELECT * FROM dyn")
def trace_dyn_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.dynamic_findings(trace.drop_launches(phased(spark, sf_dir)))


@query(
    "detonation_rescore",
    _DYN
    + """, p AS (SELECT detonation_id AS scan_id, least(sum(CASE severity WHEN 'critical' THEN 60 WHEN 'high' THEN 25 WHEN 'medium' THEN 8 ELSE 1 END), 30) AS part, bool_or(severity = 'critical') AS critical,
      bool_or(severity = 'high') AS high, bool_or(rule_id IN ('dyn_install_exfil', 'dyn_reverse_shell', 'dyn_proc_inject')) AS chain
      FROM (SELECT detonation_id, rule_id AS k, rule_id, severity FROM dyn UNION ALL SELECT user_id, event_type, event_type, 'low' FROM events) GROUP BY 1, k)
    SELECT scan_id, sum(part)::BIGINT AS score, CASE WHEN bool_or(chain) OR bool_or(critical) OR sum(part) >= 61 THEN 'malicious' WHEN bool_or(high) OR sum(part) >= 20 THEN 'suspicious' ELSE 'clean' END AS verdict FROM p GROUP BY 1""",
)
def detonation_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    dynamic = trace.dynamic_findings(trace.drop_launches(phased(spark, sf_dir))).select(F.col("detonation_id").alias("scan_id"), "rule_id", "severity", F.lit("dynamic").alias("category"))
    static = A.read(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("rule_id"), F.lit("low").alias("severity"), F.col("event_type").alias("category"))
    found = dynamic.unionByName(static)
    scans = found.select("scan_id").distinct().withColumn("watchlist_rank", F.lit(None).cast("long"))
    return scoring.verdicts(scans, found).drop("alert_tag")


@query(
    "trace_category_summary",
    with_(A.TRACE) + "SELECT detonation_id, category, count(*) AS n_total, count(*) FILTER (NOT (category = 'process' AND operation = 'exec' AND coalesce(bin LIKE '%/docker', false))) AS n_kept FROM trace GROUP BY 1, 2",
)
def trace_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.trace(spark, sf_dir)
    return trace.category_summary(events, trace.drop_launches(events))


@query(
    "trace_hostnames_as_of",
    with_(A.TRACE)
    + """, dns AS (SELECT addr, ts - INTERVAL 1 MINUTE AS ts, 'h' || (event_id % 50) AS host FROM trace WHERE addr IS NOT NULL AND event_id % 2 = 0)
    SELECT t.event_id, d.host AS hostname FROM (SELECT * FROM trace WHERE addr IS NOT NULL) t ASOF LEFT JOIN dns d ON t.addr = d.addr AND t.ts >= d.ts""",
)
def trace_hostnames_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    connects = A.trace(spark, sf_dir).where("addr IS NOT NULL").select("event_id", "ts", "addr")
    dns = connects.where("event_id % 2 = 0").select(F.col("addr").alias("ip"), (F.col("ts") - F.expr("INTERVAL 1 MINUTE")).alias("ts"), F.concat(F.lit("h"), (F.col("event_id") % 50).cast("string")).alias("host"))
    return trace.with_hostnames_as_of(connects, dns).select("event_id", "hostname")


# --- content ---------------------------------------------------------------------------------------------------------


#: Places of files, and inert lines that stand behind a document's text, so that rules of every ecosystem have something to look at.
PLACES = (("npm", "index.js"), ("pypi", "setup.py"), ("crates", "build.rs"), ("gomod", "main.go"), ("pypi", "pkg/start.pth"), ("npm", "test/a.js"), ("pypi", "pkg/mod.py"), ("gomod", "go.mod"))
LINES = (
    "", "eval(String.fromCharCode(97))", "exec(zlib.decompress(base64.b64decode(x)))", 'reqwest::get(u); Command::new("x")', 'func init() {\n\texec.Command("/bin/sh", "-c", x)\n}', "import os; exec('1')",
    "s = socket.socket(); s.connect(a); os.dup2(s.fileno(), 0)", "replace a => ../b", "open('~/.aws/credentials'); requests.post(u, data=os.environ)", "var u = 'https://x.workers.dev/a'", "see 93.184.216.34:8080",
)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as files of packages of all ecosystems."""
    key = F.col("doc_id")
    place = F.element_at(F.array(*(F.struct(F.lit(x).alias("ecosystem"), F.lit(y).alias("path")) for x, y in PLACES)), (key % len(PLACES) + 1).cast("int"))
    line = F.element_at(F.array(*map(F.lit, LINES)), (key % len(LINES) + 1).cast("int"))
    docs = A.read(spark, sf_dir, "documents").select(key.alias("scan_id"), place.ecosystem.alias("ecosystem"), place.path.alias("path"), F.concat_ws("\n", "text", line).alias("text"))
    pages = A.read(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("scan_id"), F.lit("npm").alias("ecosystem"), F.lit("lib/page.js").alias("path"), F.concat_ws("\n", "url", "html").alias("text"))
    return docs.unionByName(pages).withColumn("size", F.octet_length("text"))


@query("static_rules")
def static_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All static rules. No SQL twin: their patterns use lookarounds, and their goldens are in the tests."""
    from vigilake.operators.file_rules import static_findings

    return static_findings(_sources(spark, sf_dir))


def _sources_sql() -> str:
    """_sources() as a common table expression."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    ecosystems, paths, lines = (f"[{', '.join(map(quoted, x))}]" for x in ([x for x, _ in PLACES], [x for _, x in PLACES], LINES))
    return f"""sources AS (SELECT doc_id AS scan_id, {ecosystems}[(doc_id % {len(PLACES)} + 1)::INT] AS ecosystem, {paths}[(doc_id % {len(PLACES)} + 1)::INT] AS path,
    concat_ws(chr(10), text, {lines}[(doc_id % {len(LINES)} + 1)::INT]) AS text FROM documents UNION ALL SELECT -page_id - 1, 'npm', 'lib/page.js', concat_ws(chr(10), url, html) FROM pages)"""


def _signature_sql() -> str:
    each = " UNION ALL ".join(f"SELECT scan_id, 'yara.{x.name}' AS rule_id, '{x.severity}' AS severity, '{x.confidence}' AS confidence, path AS file FROM small WHERE {as_sql(x, 'text', 'path')}" for x in BUILT_IN)
    return f"WITH {_sources_sql()}, small AS (SELECT * FROM sources WHERE NOT regexp_matches(path, '{MEDIA}') AND octet_length(encode(text)) <= {5 << 20}) {each}"


@query("content_signatures", _signature_sql())
def content_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in signatures; the SQL twin is made of the same table of thresholds, for another engine's expressions."""
    told = signature_findings(_sources(spark, sf_dir).select("scan_id", "path", F.col("text").cast("binary").alias("content")), BUILT_IN)
    return told.select("scan_id", "rule_id", "severity", "confidence", "file")


@query("hidden_layers")
def hidden_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden layers of files. No SQL twin: a bounded search; goldens in the tests."""
    from vigilake.functions.decode import layers

    return layers(_sources(spark, sf_dir).select("scan_id", "path", F.col("text").cast("binary").alias("content"))).drop("layer")


@query("fuzzy_hashes")
def fuzzy_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fuzzy hashes and the byte entropy of files. No SQL twin; properties in the tests."""
    from vigilake.functions.fuzzy import byte_entropy, ctph_hash, tlsh_hash

    files = _sources(spark, sf_dir).where("size BETWEEN 64 AND 20971520").select("scan_id", F.col("text").cast("binary").alias("content"))
    return files.select("scan_id", ctph_hash("content").alias("ssdeep"), tlsh_hash("content").alias("tlsh"), F.round(byte_entropy("content"), 6).alias("entropy"))


@query(
    "url_classes",
    """WITH u AS (SELECT page_id, lower(split_part(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), ':[0-9]*$', ''), '@', -1)) AS host FROM pages)
    SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, regexp_matches(host, '(^|\\.)example\\.(com|org|net)$') AS reserved FROM u""".replace("\\\\", "\\"),
)
def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = T.url_host(F.col("url"))
    pages = A.read(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    return pages.select("page_id", "host", T.registrable(F.col("host")).alias("domain"), T.under_any(F.col("host"), ("example.com", "example.org", "example.net")).alias("reserved"))


@query(
    "confusion_versions",
    r"""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '99.99.9' WHEN 1 THEN (o_orderkey % 2000) || '.1.0' WHEN 2 THEN (o_orderkey % 13) || '.' || (o_orderkey % 13) || '.' || (o_orderkey % 13) ELSE '1.' || o_orderkey END AS version FROM orders),
    p AS (SELECT o_orderkey, version, list_transform(string_split(version, '.'), lambda x: x::INT) AS n, string_split(version, '.') AS s FROM v)
    SELECT o_orderkey, version, list_bool_and(list_transform(s, lambda x: regexp_matches(x, '^9+$'))) OR (len(list_distinct(n)) = 1 AND n[1] >= 9) OR (n[1] >= 99 AND n[1] < 1900) AS confusing,
      list_bool_and(list_transform(s, lambda x: regexp_matches(x, '^9+$'))) OR (len(list_distinct(n)) = 1 AND n[1] >= 9) OR n[1] >= 99 AS suspicious FROM p""",
)
def confusion_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    part = (key % 13).cast("string")
    version = F.when(key % 6 == 0, "99.99.9").when(key % 6 == 1, F.concat((key % 2000).cast("string"), F.lit(".1.0"))).when(key % 6 == 2, F.concat_ws(".", part, part, part)).otherwise(F.concat(F.lit("1."), key.cast("string")))
    told = A.read(spark, sf_dir, "orders").select("o_orderkey", version.alias("version"))
    return told.select("o_orderkey", "version", gates.confusion_version(F.col("version")).alias("confusing"), gates.suspicious_version(F.col("version")).alias("suspicious"))


@query(
    "detonation_gate",
    _LLM + "SELECT scan_id, CASE WHEN scan_id % 20 = 0 OR scan_id % 9 = 0 THEN true WHEN verdict = 'malicious' AND scan_id % 5 = 0 THEN false ELSE verdict IN ('suspicious', 'malicious') END AS detonate FROM base",
)
def detonation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("scan_id")
    return judged_scans(spark, sf_dir).select("scan_id", gates.detonates(F.col("verdict"), key % 20 == 0, key % 9 == 0, key % 5 == 0).alias("detonate"))


@query(
    "high_fidelity_convictions",
    _LLM
    + """, c AS (SELECT scan_id, min(rule_id) FILTER (rule_id IN ('error.1', 'purchase.2', 'click.3')) AS chain FROM findings GROUP BY 1)
    SELECT scan_id, CASE WHEN chain IS NOT NULL THEN 'chain:' || chain ELSE 'llm_confidence' END AS reason FROM base LEFT JOIN c USING (scan_id) WHERE chain IS NOT NULL OR (llm_verdict = 'malicious' AND llm_confidence >= 0.95)""",
)
def high_fidelity_convictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.high_fidelity(A.scans(spark, sf_dir), A.findings(spark, sf_dir), frozenset(("error.1", "purchase.2", "click.3")))


@query(
    "giant_scans",
    """SELECT l_orderkey AS scan_id, count(*) > 5 OR sum(l_extendedprice) > 150000 AS giant FROM lineitem GROUP BY 1""",
)
def giant_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.giant_scans(A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_extendedprice").alias("size")), 5, 150_000)


@query(
    "fingerprint_seed_candidates",
    with_(A.FILES)
    + """, strong AS (SELECT DISTINCT scan_id, path FROM files WHERE scan_id % 3 <> 1), known AS (SELECT DISTINCT sha256 FROM files WHERE scan_id % 50 = 1 AND path = 'src/1.py' AND entropy > 6),
    one AS (SELECT scan_id, sha256, min(path) AS path FROM files JOIN strong USING (scan_id, path) WHERE entropy < 7.2 AND sha256 NOT IN (SELECT sha256 FROM known) GROUP BY 1, 2)
    SELECT scan_id, sha256, path FROM one QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY path, sha256) <= 2""",
)
def fingerprint_seed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = A.files(spark, sf_dir)
    found = held.select("scan_id", F.col("path").alias("file"), F.when(F.col("scan_id") % 3 == 1, "low").otherwise("high").alias("severity"))
    return reports.seed_candidates(found, held, held.where("scan_id % 50 = 1 AND path = 'src/1.py' AND entropy > 6"), 2).select("scan_id", "sha256", "path")


@query(
    "maintainer_watch_active",
    with_(A.QUEUE)
    + f""", watch AS (SELECT ecosystem, name, min(enqueued_at) + INTERVAL 400 DAY AS added_at FROM queue GROUP BY 1, 2),
    n AS (SELECT w.ecosystem, w.name, added_at, count(DISTINCT CASE WHEN q.enqueued_at >= added_at THEN version END) AS n_versions FROM watch w LEFT JOIN queue q USING (ecosystem, name) GROUP BY 1, 2, 3)
    SELECT ecosystem, name, n_versions FROM n WHERE added_at >= {AS_OF} - INTERVAL 180 DAY AND n_versions < 3""",
)
def maintainer_watch_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = A.queue(spark, sf_dir)
    watch = held.groupBy("ecosystem", "name").agg((F.min("enqueued_at") + F.expr("INTERVAL 400 DAYS")).alias("added_at"))
    return gates.maintainer_watched(watch, held.select("ecosystem", "name", "version", F.col("enqueued_at").alias("started_at")), A.as_of())


@query("brand_new_names", with_(A.QUEUE, A.WATCHLIST) + "SELECT ecosystem, 'pkg' || package_id * 3 AS name FROM watchlist w WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE q.ecosystem = w.ecosystem AND q.name = 'pkg' || w.package_id * 3) AND package_id % 5 <> 0")
def brand_new_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.sources.feeds import brand_new

    ranked = A.watchlist(spark, sf_dir)
    names = ranked.select("package_id", "ecosystem", F.concat(F.lit("pkg"), (F.col("package_id") * 3).cast("string")).alias("name"))
    return brand_new(names, names.where("package_id % 5 = 0"), A.queue(spark, sf_dir)).select("ecosystem", "name")


@query(
    "candidate_batch",
    """WITH b AS (SELECT 'n' || o_orderkey AS name, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS kind FROM orders),
    p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq, name) AS place, least(100, count(*) FILTER (kind = 0) OVER ()) AS old FROM b),
    t AS (SELECT *, CASE WHEN kind = 0 THEN place <= old ELSE place <= 200 - old END AS taken FROM p)
    SELECT name, seq, CASE WHEN taken THEN 'check' WHEN row_number() OVER (PARTITION BY taken ORDER BY seq DESC, name DESC) <= 300 THEN 'carry' ELSE 'drop' END AS action FROM t""",
)
def candidate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = A.read(spark, sf_dir, "orders").select(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("seq"))
    return queue.candidate_batch(seen.where("seq % 7 = 0"), seen.where("seq % 7 <> 0"), 200, 300)


@query(
    "source_budget",
    """SELECT scan_id, path, length FROM (SELECT *, sum(length) OVER (PARTITION BY scan_id ORDER BY priority, path ROWS UNBOUNDED PRECEDING) AS used FROM
    (SELECT doc_id % 50 AS scan_id, doc_id % 3 AS priority, 'f' || doc_id AS path, least(length(text), 1200)::BIGINT AS length FROM documents WHERE text IS NOT NULL)) WHERE used <= 4800""",
)
def source_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.read(spark, sf_dir, "documents").where("text IS NOT NULL")
    snippets = docs.select((F.col("doc_id") % 50).alias("scan_id"), (F.col("doc_id") % 3).alias("priority"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "text")
    return queue.within_budget(snippets, 4800, 1200)


@query("decoded_findings")
def decoded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents and pages hide in encodings; a URL is encoded behind each text. No SQL twin: it holds a bounded search; goldens in the tests."""
    from vigilake.operators.decoded import decoded_findings as found

    hidden = F.base64(F.concat(F.lit("get http://c"), F.col("scan_id").cast("string"), F.lit(".odd.dev/x")).cast("binary"))
    return found(_sources(spark, sf_dir).withColumn("text", F.concat_ws("\n", "text", hidden)))


_RELEASES = """r AS (SELECT o_orderkey AS scan_id, CASE o_orderkey % 5 WHEN 0 THEN 'github.k' || o_custkey || '.workers.dev/x' WHEN 1 THEN 'gh.' || (100 + o_custkey) || '.xyz/a' WHEN 2 THEN 'github.com/a/b' ELSE 'pkg' || o_custkey END AS name,
    CASE o_orderkey % 4 WHEN 0 THEN '99.9.' || o_orderkey % 10 WHEN 1 THEN '9.9' ELSE '1.' || o_orderkey END AS version, o_orderdate AS published, lag(o_orderdate) OVER w AS earlier,
    o_orderpriority AS who, lag(o_orderpriority) OVER w AS was FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query(
    "metadata_findings",
    with_(_RELEASES)
    + """SELECT scan_id, 'metadata.dependency_confusion_version' AS rule_id, 'low' AS severity FROM r WHERE version LIKE '99.9.%' OR version = '9.9'
    UNION ALL SELECT scan_id, 'metadata.rapid_release', 'medium' FROM r WHERE published - earlier < INTERVAL 24 HOUR UNION ALL SELECT scan_id, 'metadata.maintainer_change', 'medium' FROM r WHERE lower(who) <> lower(was)
    UNION ALL SELECT scan_id, 'metadata.gomod_impersonating_forge_host', 'high' FROM r WHERE name LIKE '%.workers.dev/x' OR name LIKE 'gh.%'""",
)
def metadata_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from vigilake.operators.metadata import metadata_findings as found

    key, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    name = F.when(key % 5 == 0, F.concat(F.lit("github.k"), who, F.lit(".workers.dev/x"))).when(key % 5 == 1, F.concat(F.lit("gh."), (F.col("o_custkey") + 100).cast("string"), F.lit(".xyz/a"))).when(key % 5 == 2, "github.com/a/b").otherwise(F.concat(F.lit("pkg"), who))
    version = F.when(key % 4 == 0, F.concat(F.lit("99.9."), (key % 10).cast("string"))).when(key % 4 == 1, "9.9").otherwise(F.concat(F.lit("1."), key.cast("string")))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    releases = A.read(spark, sf_dir, "orders").select(
        key.alias("scan_id"), name.alias("name"), version.alias("version"), F.col("o_orderdate").alias("published_at"), F.lag("o_orderdate").over(order).alias("prev_published_at"),
        F.array("o_orderpriority").alias("maintainers"), F.array_compact(F.array(F.lag("o_orderpriority").over(order))).alias("prev_maintainers"),
    )
    return found(releases).select("scan_id", "rule_id", "severity")


@query(
    "entropy_jump_findings",
    with_(A.TWO_SCANS)
    + """SELECT c.scan_id, 'entropy.suspicious_jump' AS rule_id, c.path AS file FROM cur c JOIN prev p USING (package, archive_kind, path)
    WHERE p.sha256 <> c.sha256 AND c.entropy > 0 AND p.entropy > 0 AND round(c.entropy - p.entropy, 6) >= 1.5""",
)
def entropy_jump_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.operators.metadata import entropy_findings

    return entropy_findings(history.entropy_jumps(*A.two_scans(spark, sf_dir))).select("scan_id", "rule_id", "file")
