"""Findings of what files hide in encodings: single runs of base64, hex or escapes, and layers behind several decoders, rows (scan_id, path, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import decode
from vigilake.functions import text as T
from vigilake.intel import BASELINE, Pack
from vigilake.operators.file_rules import OAST, PLACEHOLDERS

# Runs of each encoding that are looked at, the least of a decoded text, and calls that run something.
RUNS, LEAST, PRINTABLE = 400, 6, 0.85
FILE_SINK = (
    r"(?i)exec\.Command(?:Context)?\s*\(|syscall\.(?:Exec|ForkExec|StartProcess)\s*\(|\bos/exec\b|child_process|\.exec(?:File|Sync)?\s*\(|\bspawn(?:Sync)?\s*\(|execSync|os\.system"
    r"|subprocess\.(?:Popen|call|run|check_output)|CreateProcess|ShellExecute|WinExec"
)
#: Each way to call has one of these in it, in either case, and each of these one of the parts.
FILE_SINK_PARTS = ("exec", "spawn", "process", "syscall.", "os.system")
FILE_SINK_TEXTS = ("exec.command", "syscall.", "os/exec", "child_process", ".exec", "spawn", "execsync", "os.system", "subprocess.", "createprocess", "shellexecute", "winexec")
LAYER_SINK = (
    r"(?i)eval\s*\(|new\s+Function\s*\(|Function\s*\(\s*['\"]|child_process|\.exec(?:File|Sync)?\s*\(|\bspawn(?:Sync)?\s*\(|execSync|os\.system|subprocess\.(?:Popen|call|run|check_output)"
)
URL = r"https?://[^\s'\"<>()]+"


def _runs(text: str, pattern: str) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, RUNS)


def _as_text(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def single_layers(text: str) -> Column:
    """An array of readable texts that one decoding of a run gives. Runs that can't be decoded give none."""
    padded = lambda x: F.rpad(F.rtrim(x, F.lit("=")), ((F.length(F.rtrim(x, F.lit("="))) + 3) / 4).cast("int") * 4, "=")
    each = F.concat(
        F.transform(_runs(text, r"[A-Za-z0-9+/]{16,}={0,2}"), lambda x: _as_text(F.try_to_binary(padded(x), F.lit("base64")))),
        F.transform(_runs(text, r"(?:[0-9a-fA-F]{2}){12,}"), lambda x: _as_text(F.unhex(x))),
        F.transform(_runs(text, r"(?:\\x[0-9a-fA-F]{2}){4,}"), lambda x: _as_text(F.unhex(F.replace(x, F.lit("\\x"), F.lit(""))))),
    )
    return F.filter(each, lambda x: (F.length(x) >= LEAST) & (T.printable_ratio(x) >= PRINTABLE))


def runs_something(text: str) -> Column:
    """Whether a file calls what runs something. Literal texts are searched first, as few files have one."""
    has = lambda low, texts: reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in texts))
    return F.exists(F.array(F.lower(text)), lambda low: has(low, FILE_SINK_PARTS) & has(low, FILE_SINK_TEXTS)) & F.col(text).rlike(FILE_SINK)


def odd_url(url: Column, pack: Pack) -> Column:
    """A URL with a dotted host that is neither known to be harmless nor a callback host, which has a rule of its own. The host is cut out once for all of these."""
    known = sorted(pack.benign_hosts)
    benign = lambda host: host.isin(*known) | T.registrable(host).isin(*known) | host.isin(*PLACEHOLDERS) | host.rlike(r"^localhost|\.(?:localhost|test|invalid|localdomain)$") | F.contains(url, F.lit("{"))
    return F.exists(F.array(T.url_host(url)), lambda host: F.contains(host, F.lit(".")) & ~benign(host) & ~T.under_any(host, OAST))


def odd_ip(ip: Column) -> Column:
    return T.ipv4_kind(ip).isin("metadata", "routable") & ~ip.isin(*T.RESOLVERS)


def decoded_findings(files: DataFrame, pack: Pack = BASELINE) -> DataFrame:
    """(scan_id, rule_id, category, severity, confidence, file, evidence): addresses behind an encoding, hidden executables and hidden code. Documentation is left out.

    A file is read once: its layers, its long stretches (all that single runs can be in) and whether it runs something become pairs of a kind and a text, and only these travel.
    """
    some = files.where(~T.is_doc_file(F.col("path")) & F.col("text").isNotNull()).select("scan_id", "path", F.encode("text", "UTF-8").alias("content"), runs_something("text").alias("marked"))
    pairs = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    met = lambda said, pattern: F.array_distinct(F.regexp_extract_all(said, F.lit(pattern), F.lit(0)))
    only = lambda condition, value: F.when(F.coalesce(condition, F.lit(False)), F.array(value)).otherwise(F.array().cast("array<string>"))
    found = decode.layers_and_stretches(some).withColumn("said", _as_text(F.col("layer")))
    single = F.flatten(F.transform(single_layers("stretches"), lambda said: F.concat(pairs("url", met(said, URL)), pairs("ip", met(said, T.IPV4)))))
    real = F.exists(F.split("chain", ">"), lambda x: x != "reverse")
    urls = F.when(F.col("executable"), F.array().cast("array<string>")).otherwise(met("said", URL))
    hidden, code = only(real & F.col("executable"), F.col("chain")), only(real & ~F.col("executable") & F.col("said").rlike(LAYER_SINK), F.col("chain"))
    told = F.when(F.col("layer").isNull(), F.concat(single, pairs("runs", only(F.col("marked"), F.lit(""))))).otherwise(F.concat(pairs("url", urls), pairs("hidden", hidden), pairs("code", code)))
    kind, x = F.col("kind"), F.col("x")
    each = found.select("scan_id", "path", F.explode(told).alias("y")).select("scan_id", "path", "y.kind", "y.x")
    each = each.where(F.when(kind == "url", odd_url(x, pack)).when(kind == "ip", odd_ip(x)).otherwise(True)).distinct()
    each = each.withColumn("runs", F.max(kind == "runs").over(Window.partitionBy("scan_id", "path")) & F.col("scan_id").isNotNull()).where(kind != "runs")
    test, run = T.is_test_file(F.col("path")), F.col("runs")
    rule = F.when(kind == "url", "iocs.encoded_url").when(kind == "ip", "iocs.encoded_ip").when(kind == "hidden", "iocs.decoded_executable").otherwise("iocs.decoded_code")
    worst = F.when(run, F.when(test, "high").otherwise("critical")).otherwise(F.when(test, "low").otherwise("medium"))
    sure = F.when(run, F.when(test, "medium").otherwise("high")).otherwise(F.when(test, "low").otherwise("medium"))
    severity = F.when(kind == "url", "medium").when(kind == "hidden", worst).otherwise("high")
    evidence = F.concat(F.when(kind == "hidden", "an executable behind ").when(kind == "code", "calls behind ").otherwise("decoded: "), x)
    return each.select(
        "scan_id", rule.alias("rule_id"), F.lit("iocs").alias("category"), severity.alias("severity"), F.when(kind == "hidden", sure).otherwise("medium").alias("confidence"),
        F.col("path").alias("file"), F.substring(evidence, 1, 200).alias("evidence"),
    ).distinct()
