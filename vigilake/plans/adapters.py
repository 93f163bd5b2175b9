"""The supplied tables as relations of the engine: for each a DataFrame, and the same as a SQL common table expression for the oracle.

Keys are derived by integer arithmetic, so both sides agree to the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ECOSYSTEMS = ("pypi", "npm", "gomod", "crates")
#: The time at which queries over queues are asked.
AS_OF = "1998-01-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ecosystem(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, ECOSYSTEMS)), (F.col(key) % 4 + 1).cast("int"))


def _eco_sql(key: str) -> str:
    return f"['pypi', 'npm', 'gomod', 'crates'][({key} % 4 + 1)::INT]"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("(event_id * 7919 + user_id * 31) % 97")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("finding_id"), F.expr("event_id div 4").alias("scan_id"), F.col("event_type").alias("category"),
        F.concat_ws(".", "event_type", F.get_json_object("props", "$.k")).alias("rule_id"),
        F.when(k < 3, "critical").when(k < 11, "high").when(k < 35, "medium").otherwise("low").alias("severity"),
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"),
        F.concat(F.lit("src/"), (F.col("user_id") % 7).cast("string"), F.lit(".py")).alias("file"), (F.col("user_id") % 50).cast("int").alias("line"),
        F.concat(F.lit("value "), F.get_json_object("props", "$.k")).alias("evidence"), "ts", "user_id",
    )


FINDINGS = """findings AS (SELECT event_id AS finding_id, event_id // 4 AS scan_id, event_type AS category,
    event_type || '.' || json_extract_string(props, '$.k') AS rule_id,
    CASE WHEN k < 3 THEN 'critical' WHEN k < 11 THEN 'high' WHEN k < 35 THEN 'medium' ELSE 'low' END AS severity,
    CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
    'src/' || (user_id % 7) || '.py' AS file, (user_id % 50)::INT AS line, 'value ' || json_extract_string(props, '$.k') AS evidence, ts, user_id
    FROM (SELECT *, (event_id * 7919 + user_id * 31) % 97 AS k FROM events))"""


def watchlist(spark: SparkSession, sf_dir: str, most: int = 5000) -> DataFrame:
    """The customers of the highest balance, ranked. The ranking is the feature: one global order, cut before it is numbered."""
    from pyspark.sql import Window

    best = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey"))
    return best.select(F.col("c_custkey").alias("package_id"), F.col("c_name").alias("name"), ecosystem("c_custkey").alias("ecosystem"), rank.cast("long").alias("rank"))


WATCHLIST = f"""watchlist AS (SELECT c_custkey AS package_id, c_name AS name, {_eco_sql("c_custkey")} AS ecosystem, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank
    FROM customer QUALIFY rank <= 5000)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("claimed")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), ecosystem("o_custkey").alias("ecosystem"), F.concat(F.lit("pkg"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderkey").cast("string").alias("version"), F.when(kind.isin("1", "2"), "high").when(kind == "3", "normal").otherwise("low").alias("priority"),
        status.alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.col("o_orderdate").alias("enqueued_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("claimed_at"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("finished_at"),
    )


QUEUE = f"""queue AS (SELECT o_orderkey AS id, {_eco_sql("o_custkey")} AS ecosystem, 'pkg' || o_custkey AS name, o_orderkey::VARCHAR AS version,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'normal' ELSE 'low' END AS priority,
    CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'claimed' END AS status,
    (o_orderkey % 5)::INT AS attempts, o_orderdate AS enqueued_at, o_orderdate + INTERVAL 1 DAY AS claimed_at, o_orderdate + INTERVAL 2 DAY AS finished_at FROM orders)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        ecosystem("o_custkey").alias("ecosystem"), F.concat(F.lit("pkg"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("version"),
        F.col("o_orderdate").alias("published_at"), F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("publisher"), (F.col("o_orderkey") % 11 == 0).alias("hook"),
    )


VERSIONS = f"""versions AS (SELECT {_eco_sql("o_custkey")} AS ecosystem, 'pkg' || o_custkey AS name, o_orderkey AS version, o_orderdate AS published_at,
    o_totalprice AS size, o_orderpriority AS publisher, o_orderkey % 11 = 0 AS hook FROM orders)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of scans (orders), of packages (customers): one for each line number."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").alias("quantity"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("scan_id"), F.concat(F.lit("pkg"), F.col("o_custkey").cast("string")).alias("package"), F.lit("sdist").alias("archive_kind"),
        F.concat(F.lit("src/"), F.col("l_linenumber").cast("string"), F.lit(".py")).alias("path"), F.sha2((F.col("part") % 40).cast("string"), 256).alias("sha256"),
        F.round(F.col("quantity") * 0.16, 6).alias("entropy"), F.col("o_orderdate").alias("at"),
    )


FILES = """files AS (SELECT l_orderkey AS scan_id, 'pkg' || o_custkey AS package, 'sdist' AS archive_kind, 'src/' || l_linenumber || '.py' AS path, sha256((part % 40)::VARCHAR) AS sha256,
    round(quantity * 0.16, 6) AS entropy, o_orderdate AS at
    FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS part, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) JOIN orders ON o_orderkey = l_orderkey)"""


def two_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files of each package's newest scan and of the one before. Scans are ranked by an aggregation over one row for each scan."""
    from pyspark.sql import Window

    all_files = files(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), "o_custkey", "o_orderdate")
    age = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("scan_id")))
    ranked = orders.withColumn("age", age).where("age <= 2").select("scan_id", "age")
    joined = all_files.join(ranked, "scan_id")
    return joined.where("age = 1").drop("age"), joined.where("age = 2").drop("age")


TWO_SCANS = (
    FILES
    + """, ranked AS (SELECT o_orderkey AS scan_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders),
    cur AS (SELECT files.* FROM files JOIN ranked USING (scan_id) WHERE age = 1), prev AS (SELECT files.* FROM files JOIN ranked USING (scan_id) WHERE age = 2)"""
)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each scan of findings(), with what triage says of it where labels know it."""
    told = findings(spark, sf_dir).groupBy("scan_id").agg(F.max("ts").alias("finished_at"), F.max("user_id").alias("user_id"))
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("scan_id"), F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 1, "benign").otherwise("inconclusive").alias("llm_verdict"),
        (F.col("quality") * 0.5 + 0.4).alias("llm_confidence"),
    )
    return told.join(labels, "scan_id", "left").select(
        "scan_id", ecosystem("scan_id").alias("ecosystem"), F.concat(F.lit("pkg"), (F.col("scan_id") % 300).cast("string")).alias("name"),
        F.concat(F.lit("m"), (F.col("scan_id") % 300 % 40).cast("string")).alias("maintainer"), "finished_at", "llm_verdict", "llm_confidence",
    )


SCANS = (
    FINDINGS
    + f""", scans AS (SELECT scan_id, {_eco_sql("scan_id")} AS ecosystem, 'pkg' || (scan_id % 300) AS name, 'm' || (scan_id % 300 % 40) AS maintainer, finished_at, llm_verdict, llm_confidence
    FROM (SELECT scan_id, max(ts) AS finished_at FROM findings GROUP BY 1)
    LEFT JOIN (SELECT doc_id AS scan_id, CASE WHEN toxic = 1 THEN 'malicious' WHEN quality = 1 THEN 'benign' ELSE 'inconclusive' END AS llm_verdict, quality * 0.5 + 0.4 AS llm_confidence FROM labels) USING (scan_id))"""
)

#: Scores and verdicts of unwatched scans, over findings.
SCORED = """parts AS (SELECT scan_id, least(sum(CASE severity WHEN 'critical' THEN 60 WHEN 'high' THEN 25 WHEN 'medium' THEN 8 ELSE 1 END), 30) AS part,
    bool_or(severity = 'critical') AS critical, bool_or(severity = 'high') AS high, bool_or(severity IN ('medium', 'high', 'critical')) AS medium
    FROM findings GROUP BY scan_id, category),
scored AS (SELECT scan_id, sum(part)::BIGINT AS score, bool_or(critical) AS critical, bool_or(high) AS high, bool_or(medium) AS medium FROM parts GROUP BY 1),
judged AS (SELECT *, CASE WHEN critical OR score >= 61 THEN 'malicious' WHEN high OR score >= 20 THEN 'suspicious' ELSE 'clean' END AS verdict FROM scored)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trace: runs are users, kinds follow the type, details follow the ids."""
    kind = F.expr("event_id % 10")
    path = F.when(F.col("event_id") % 97 == 0, "/root/.ssh/id_rsa").when(F.col("event_id") % 89 == 0, "/proc/7/environ").when(F.col("event_id") % 83 == 0, "/etc/cron.d/x").otherwise(F.concat(F.lit("/usr/lib/"), F.col("event_id").cast("string")))
    addr = F.concat_ws(".", F.when(F.col("event_id") % 3 == 0, F.lit("10")).otherwise(F.lit("93")), (F.col("user_id") % 256).cast("string"), F.lit("7"), (F.col("event_id") % 256).cast("string"))
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("detonation_id"), "event_id", "ts", F.when(kind < 4, "file").when(kind < 7, "network").otherwise("process").alias("category"),
        F.when(kind < 3, "open").when(kind == 3, "write").when(kind < 7, "connect").when(kind == 9, "ptrace").otherwise("exec").alias("operation"),
        F.when(kind < 4, path).alias("path"), F.when(kind.between(4, 6), addr).alias("addr"), F.when(kind.between(4, 6), F.when(F.col("event_id") % 5 == 0, 53.0).otherwise(443.0)).alias("port"),
        F.when(kind.between(7, 8), F.when(F.col("event_id") % 7 == 0, "/usr/bin/docker").otherwise("/usr/bin/node")).alias("binary"), F.lit(None).cast("string").alias("arguments"),
        F.lit(None).cast("string").alias("name"), (F.col("event_id") % 211 == 5).alias("abuse_host"),
    )


TRACE = """trace AS (SELECT user_id AS detonation_id, event_id, ts, CASE WHEN kind < 4 THEN 'file' WHEN kind < 7 THEN 'network' ELSE 'process' END AS category,
    CASE WHEN kind < 3 THEN 'open' WHEN kind = 3 THEN 'write' WHEN kind < 7 THEN 'connect' WHEN kind = 9 THEN 'ptrace' ELSE 'exec' END AS operation,
    CASE WHEN kind >= 4 THEN NULL WHEN event_id % 97 = 0 THEN '/root/.ssh/id_rsa' WHEN event_id % 89 = 0 THEN '/proc/7/environ' WHEN event_id % 83 = 0 THEN '/etc/cron.d/x' ELSE '/usr/lib/' || event_id END AS path,
    CASE WHEN kind BETWEEN 4 AND 6 THEN (CASE WHEN event_id % 3 = 0 THEN '10' ELSE '93' END) || '.' || (user_id % 256) || '.7.' || (event_id % 256) END AS addr,
    CASE WHEN kind BETWEEN 4 AND 6 THEN CASE WHEN event_id % 5 = 0 THEN 53.0 ELSE 443.0 END END AS port,
    CASE WHEN kind BETWEEN 7 AND 8 THEN CASE WHEN event_id % 7 = 0 THEN '/usr/bin/docker' ELSE '/usr/bin/node' END END AS bin, event_id % 211 = 5 AS abuse_host
    FROM (SELECT *, event_id % 10 AS kind FROM events))"""
