"""Sandbox traces: parsing, phases, host names, noise, rules. One window on the run carries what rules need to know of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators.networks import matches

# Paths whose reading is sensitive.
SENSITIVE_PATHS = (
    "/root/.ssh/", "/home/", "/.ssh/", "/root/.aws/", "/.aws/", "/root/.gnupg/", "/.gnupg/", "/root/.npmrc", "/.npmrc",
    "/root/.cargo/credentials", "/.cargo/credentials", "/root/.docker/config.json", "/.docker/config.json", "/root/.kube/config",
    "/.kube/config", "/.pypirc", "/.config/gh/", "/.config/gcloud/", "/.config/solana/", "/.ethereum/", "/root/.env",
    "/.git-credentials", "/etc/shadow",
)
# Shells, launchers of the harness, tools that capture a screen, places that persist.
SHELLS = ("/bin/sh", "/bin/bash", "/bin/zsh", "/bin/dash", "/usr/bin/sh", "/usr/bin/bash")
LAUNCHERS = ("docker", "podman", "runc", "nerdctl", "ctr")
CAPTURE_TOOLS = ("scrot", "maim", "grim", "spectacle", "gnome-screenshot", "ksnapshot", "flameshot", "xwd", "slurp", "xinput")
PERSISTENT = ("/etc/crontab", "/etc/cron.d/", "/etc/systemd/", "/etc/init.d/", "/etc/ld.so.preload")
SHELL_FILES = ("/root/.bashrc", "/root/.profile", "/root/.bash_profile", "/root/.zshrc", "/root/.zshenv")

LOG_SCHEMA = """time string,
    process_exec struct<process: struct<pid: int, binary: string, arguments: string, docker: string>>,
    process_kprobe struct<function_name: string, process: struct<pid: int, binary: string, docker: string>,
        args: array<struct<sock_arg: struct<daddr: string, dport: int, family: string>, string_arg: string, int_arg: int>>>"""


def parse_log(lines: DataFrame, containers: tuple[str, ...], column: str = "value") -> DataFrame:
    """(ts, category, operation, pid, binary, docker, path, addr, port, family, arguments) of JSON lines. Lines of other containers and malformed ones give nothing."""
    told = lines.select(F.from_json(column, LOG_SCHEMA).alias("x")).select("x.*")

    def ours(docker: Column) -> Column:
        return F.exists(F.array(*map(F.lit, containers)), lambda c: (F.length(docker) > 0) & (F.startswith(docker, c) | F.startswith(c, docker)))

    none = F.lit(None).cast("string")
    execs = told.where("process_exec IS NOT NULL").select("time", F.lit("process").alias("category"), F.lit("exec").alias("operation"), "process_exec.process.*")
    execs = execs.select("time", "category", "operation", "pid", "binary", "docker", none.alias("path"), none.alias("addr"), F.lit(None).cast("double").alias("port"), none.alias("family"), "arguments")
    probes = told.where("process_kprobe IS NOT NULL").select("time", "process_kprobe.*").select("time", "function_name", "process.*", F.explode("args").alias("arg"))
    fn = F.col("function_name")
    category = F.when(fn.isin("tcp_connect", "udp_sendmsg") & F.col("arg.sock_arg").isNotNull(), "network").when(fn.isin("__x64_sys_openat", "security_file_open", "__x64_sys_write", "security_file_permission") & (F.length("arg.string_arg") > 0), "file")
    operation = F.when(category == "network", "connect").when(fn.isin("__x64_sys_write", "security_file_permission"), "write").otherwise("open")
    probed = probes.select(
        "time", category.alias("category"), operation.alias("operation"), "pid", "binary", "docker", F.when(category == "file", F.col("arg.string_arg")).alias("path"),
        F.col("arg.sock_arg.daddr").alias("addr"), F.col("arg.sock_arg.dport").cast("double").alias("port"), F.col("arg.sock_arg.family").alias("family"), none.alias("arguments"),
    )
    return execs.unionByName(probed).where(F.col("category").isNotNull() & ours(F.col("docker"))).withColumn("ts", F.try_to_timestamp("time")).drop("time")


def phase(ts: Column, install_end: Column) -> Column:
    return F.when(ts > install_end, "import").otherwise("install")


def with_hostnames(events: DataFrame, dns: DataFrame) -> DataFrame:
    """Connects with the host that last resolved to their address: dns has (ip, host, ts)."""
    last = dns.groupBy(F.col("ip").alias("addr")).agg(F.max_by("host", "ts").alias("hostname"))
    return events.join(last, "addr", "left")


def with_hostnames_as_of(events: DataFrame, dns: DataFrame) -> DataFrame:
    """The same as of the time of the connect: the latest answer not after it. One union and one window on the address, no range join."""
    names = events.columns
    both = events.withColumns({"_host": F.lit(None).cast("string"), "_kind": F.lit(1)}).unionByName(
        dns.select(F.col("ip").alias("addr"), "ts", F.col("host").alias("_host"), F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    seen = Window.partitionBy("addr").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("hostname", F.last("_host", ignorenulls=True).over(seen)).where("_kind = 1").select(*names, "hostname")


def ipv4_number(addr: Column) -> Column:
    """The number of an IPv4 address, or null."""
    parts = F.transform(F.split(addr, r"\."), lambda x: x.try_cast("long"))
    good = addr.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") & F.forall(parts, lambda x: x <= 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def in_cidrs(addr: Column, cidrs: tuple[str, ...]) -> Column:
    import ipaddress

    nets = [n for n in (ipaddress.ip_network(c, strict=False) for c in cidrs) if n.version == 4]
    number = ipv4_number(addr)
    each = [number.between(int(n.network_address), int(n.broadcast_address)) for n in nets]
    return F.coalesce(reduce(lambda a, b: a | b, each, F.lit(False)), F.lit(False))


def is_external(addr: Column, port: Column) -> Column:
    """Whether a destination lies outside the sandbox; what can't be parsed does."""
    inner = in_cidrs(addr, ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "224.0.0.0/24", "0.0.0.0/32"))
    inner6 = F.lower(addr).rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff02:.*)$")
    return ~(F.coalesce(port == 53, F.lit(False)) | inner | F.coalesce(inner6, F.lit(False)))


def is_sensitive(category: Column, operation: Column, path: Column) -> Column:
    environ = path.rlike("^/proc/.*/environ$") & (path != "/proc/self/environ")
    listed = F.exists(F.array(*map(F.lit, SENSITIVE_PATHS)), lambda p: F.contains(path, p))
    return F.coalesce((category == "file") & (operation == "open") & (environ | listed), F.lit(False))


def host_matches(host: Column, pattern: Column) -> Column:
    """A pattern is a suffix on a label's border, or with "=" the host itself."""
    exact = F.startswith(pattern, F.lit("=")) & (F.concat(F.lit("="), host) == pattern)
    return exact | (~F.startswith(pattern, F.lit("=")) & ((host == pattern) | F.endswith(host, F.concat(F.lit("."), pattern))))


def drop_noise(events: DataFrame, *, paths: tuple[str, ...] = (), binaries: tuple[str, ...] = (), hosts: tuple[str, ...] = (), cidrs: tuple[str, ...] = (), abuse: tuple[str, ...] = (), networks: DataFrame | None = None) -> DataFrame:
    """Events without known noise, connects to abused hosts marked (abuse_host). Executions of a local script stay whatever runs them.

    networks: rows (network), IPv4 or IPv6, that connects may go to; a list of any length, as an address is looked up by its prefixes. Events without an address aren't joined."""

    def some(values: tuple[str, ...], test) -> Column:
        return F.coalesce(F.exists(F.array(*map(F.lit, values)), test), F.lit(False)) if values else F.lit(False)

    if networks is not None:
        sought = (F.col("category") == "network") & (F.col("operation") == "connect") & F.col("addr").isNotNull()
        inside = matches(events.where(sought), networks).select(F.col("addr").alias("_addr")).distinct()
        connects = events.where(sought)
        events = connects.join(inside, connects["addr"] == inside["_addr"], "left").withColumn("_inside", F.col("_addr").isNotNull()).drop("_addr").unionByName(events.where(~F.coalesce(sought, F.lit(False))).withColumn("_inside", F.lit(False)))
    category, operation, host = F.col("category"), F.col("operation"), F.lower(F.coalesce("hostname", F.lit("")))
    local = F.coalesce(F.col("arguments"), F.lit("")).rlike(r"(?:^|\s)(?!-)\S*\.[cm]?js(?:\s|$)")
    noise = (
        ((category == "file") & some(paths, lambda p: F.contains("path", p)))
        | ((category == "process") & (operation == "exec") & some(binaries, lambda b: F.contains("binary", b)) & ~local)
        | ((category == "network") & (operation == "connect") & (some(hosts, lambda p: host_matches(host, p)) | in_cidrs(F.col("addr"), cidrs) | (F.col("_inside") if networks is not None else F.lit(False))))
    )
    marked = events.withColumn("abuse_host", (category == "network") & some(abuse, lambda p: host_matches(host, p)))
    return marked.where(F.col("abuse_host") | ~F.coalesce(noise, F.lit(False))).drop("_inside")


def drop_launches(events: DataFrame) -> DataFrame:
    """Events without the harness's own launches."""
    return events.where(~((F.col("category") == "process") & (F.col("operation") == "exec") & F.coalesce(F.substring_index("binary", "/", -1).isin(*LAUNCHERS), F.lit(False))))


def entropy_of_label(name: Column) -> Column:
    """Bits for each character of a host's first label."""
    label = F.split(F.substring_index(name, ".", 1), "")
    chars = F.filter(label, lambda x: x != "")
    n = F.size(chars)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (F.size(F.filter(chars, lambda y: y == c)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == c)) / n))
    return F.when(n > 0, bits).otherwise(0.0)


def dynamic_findings(events: DataFrame, canaries: tuple[str, ...] = ()) -> DataFrame:
    """(detonation_id, rule_id, severity, event_id): of each run and rule the first event, by time and id, that fires it.

    Events have (detonation_id, event_id, ts, phase, category, operation, binary, path, addr, port, arguments, name, abuse_host). The rules of one event are an
    array, so events are read once.
    """
    run = Window.partitionBy("detonation_id")
    category, operation, path = F.col("category"), F.col("operation"), F.col("path")
    told = events.withColumn("secret", F.max(is_sensitive(category, operation, path)).over(run))
    connect = (category == "network") & (operation == "connect")
    opened, wrote, ran = (category == "file") & (operation == "open"), (category == "file") & (operation == "write"), (category == "process") & (operation == "exec")
    outside = connect & is_external(F.col("addr"), F.col("port"))
    words = F.transform(F.split(F.coalesce("arguments", F.lit("")), r"\s+"), lambda x: F.regexp_replace(F.regexp_replace(x, "^[\"'`(),;]+|[\"'`(),;]+$", ""), "^.*/", ""))
    tool = F.regexp_replace(F.coalesce("binary", F.lit("")), "^.*/", "")
    probes = tool.isin("which", "whereis") | F.arrays_overlap(words, F.array(*map(F.lit, ("which", "whereis", "command", "type")))) | F.contains(F.coalesce("arguments", F.lit("")), F.lit("command -v"))
    said = F.concat_ws(" ", "path", "arguments", "addr", "name", "hostname", "binary") if "hostname" in events.columns else F.concat_ws(" ", "path", "arguments", "addr", "name", "binary")
    socket = F.col("has_socket") if "has_socket" in events.columns else F.lit(False)

    def hit(condition: Column, rule: str, severity: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity")))

    fired = F.array(
        *(hit(outside & (F.col("phase") == p) & (F.col("secret") if bad else ~F.col("secret")), f"dyn_{p}_{'exfil' if bad else 'egress'}", "high" if bad else "low") for p in ("install", "import") for bad in (True, False)),
        hit(connect & F.col("abuse_host"), "dyn_abuse_hosting_callback", "critical"),
        hit(opened & F.exists(F.array(*map(F.lit, SENSITIVE_PATHS)), lambda x: F.contains(path, x)), "dyn_credential_read", "high"),
        hit(F.exists(F.array(*map(F.lit, canaries)), lambda x: F.contains(said, x)) if canaries else F.lit(False), "dyn_honeytoken_exfil", "critical"),
        hit(ran & probes & F.arrays_overlap(words, F.array(*map(F.lit, CAPTURE_TOOLS))), "dyn_screen_capture_probe", "high"),
        hit(ran & F.col("binary").isin(*SHELLS) & socket, "dyn_reverse_shell", "critical"),
        hit((category == "process") & operation.isin("ptrace", "process_vm_writev"), "dyn_proc_inject", "critical"),
        hit((category == "dns") & (operation == "query") & (entropy_of_label(F.col("name")) >= 4.0), "dyn_dns_exfil", "high"),
        hit(opened & path.rlike("^/proc/.*/environ$") & (path != "/proc/self/environ"), "dyn_env_harvest", "high"),
        hit(wrote & F.exists(F.array(*map(F.lit, PERSISTENT)), lambda x: F.startswith(path, x)), "dyn_suspicious_write", "critical"),
        hit(wrote & path.isin(*SHELL_FILES), "dyn_suspicious_write", "high"),
        hit((category == "process") & (operation == "fileless_exec"), "dyn_fileless_exec", "critical"),
        hit((category == "process") & (operation == "memfd_create"), "dyn_fileless_exec", "medium"),
    )
    each = told.select("detonation_id", "ts", "event_id", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("x")).select("detonation_id", "ts", "event_id", "x.*")
    return each.groupBy("detonation_id", "rule_id").agg(F.min(F.struct("ts", "event_id", "severity")).alias("x")).select("detonation_id", "rule_id", "x.severity", "x.event_id")


def without_own_downloads(findings: DataFrame, connects: DataFrame, verified: DataFrame) -> DataFrame:
    """Findings without install exfiltration whose host is one that a checksum-verified download names: (scan_id, host) on both sides."""

    def registrable(host: Column) -> Column:
        return F.substring_index(F.lower(host), ".", -2)

    own = connects.select("scan_id", registrable(F.col("host")).alias("host")).join(verified.select("scan_id", registrable(F.col("host")).alias("host")).distinct(), ["scan_id", "host"], "left_semi").select("scan_id").distinct()
    exfil = findings.where("rule_id = 'dyn_install_exfil'").join(own, "scan_id", "left_anti")
    return findings.where("rule_id <> 'dyn_install_exfil'").unionByName(exfil)


def category_summary(events: DataFrame, kept: DataFrame) -> DataFrame:
    """(detonation_id, category, n_total, n_kept)."""
    total = events.groupBy("detonation_id", "category").agg(F.count("*").alias("n_total"))
    return total.join(kept.groupBy("detonation_id", "category").agg(F.count("*").alias("n_kept")), ["detonation_id", "category"], "left").fillna(0, ["n_kept"])
