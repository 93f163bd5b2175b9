"""Static rules over files, rows (scan_id, ecosystem, path, size, text).

A rule is a row of a table: which files it looks at, when it fires, what it says. All rules are evaluated over one scan of the files as
one array of findings, which is exploded once; texts are never shuffled. Where one rule decides whether another counts, both are one
ordered CASE. What needs offsets within a text (one match near another) is written as one expression with a bounded gap.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import text as T
from vigilake.intel import BASELINE, Pack
from vigilake.operators.hooks import install_hooks, is_benign

#: Top-level names of the standard library of the Python that runs here.
STDLIB = tuple(sorted(x for x in sys.stdlib_module_names if not x.startswith("_")))


def body() -> Column:
    return F.col("text")


def place() -> Column:
    return F.col("path")


def base_name() -> Column:
    return F.lower(F.substring_index(place(), "/", -1))


def ext() -> Column:
    return F.lower(F.regexp_extract(place(), r"(\.[^./]+)$", 1))


def has(pattern: str) -> Column:
    return body().rlike(pattern)


def holds(*texts: str) -> Column:
    """Whether the text holds one of some texts of small letters, in any case: a search by bytes, so patterns that can't match without one needn't be tried."""
    return F.exists(F.array(F.lower(body())), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in texts)))


def runs_text() -> Column:
    """Whether EVAL matches; both of its words are looked for first."""
    return (F.contains(body(), F.lit("eval")) | F.contains(body(), F.lit("Function"))) & has(EVAL)


def each(pattern: str, group: int = 0) -> Column:
    """The distinct matches of a pattern."""
    return F.array_distinct(F.regexp_extract_all(body(), F.lit(pattern), F.lit(group)))


def when(condition: Column, evidence: str | Column = "") -> Column:
    """One piece of evidence, or none."""
    said = F.lit(evidence) if isinstance(evidence, str) else evidence
    return F.when(F.coalesce(condition, F.lit(False)), F.array(said)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str | Callable[[], Column]
    confidence: str
    files: Callable[[], Column]
    evidence: Callable[[], Column]  # an array; a finding for each element

    def findings(self) -> Column:
        severity = F.lit(self.severity) if isinstance(self.severity, str) else self.severity()
        said = F.when(F.coalesce(self.files(), F.lit(False)), self.evidence())
        kind = self.rule_id.split(".")[0]
        return F.transform(
            F.coalesce(said, F.array().cast("array<string>")),
            lambda x: F.struct(F.lit(self.rule_id).alias("rule_id"), F.lit(kind).alias("category"), severity.alias("severity"), F.lit(self.confidence).alias("confidence"), F.substring(x, 1, 200).alias("evidence")),
        )


# Patterns of the rules, as they have to match.
EVAL = r"(?:\beval\s*\(|\bnew\s+Function\s*\(|\bFunction\s*\(\s*['\"])"
CHARCODE = r"(?:\bString\.fromCharCode\b|\.charCodeAt\s*\(|(?:\d{1,4}\s*+,\s*+){40})"
DECIPHER = r"(?:\bcreateDecipher(?:iv)?\s*\()"
HIDDEN_FETCH = r"(?:\bfetch\s*\(\s*(?:atob\s*\(|Buffer\.from\s*\([^,]+,\s*['\"]base64))"
ROT_WRAPPER = r"(?s)\.replace\s*\(\s*/\[a-zA-Z\]/[gi]*\s*,\s*function\s*\([^)]*\)\s*\{[^}]*charCodeAt[^}]*%\s*26[^}]*\}"
BUNDLE = r"(?i)(?:^|/)(?:dist|build|out|static|assets|public|browser|vendor|vendors|_next|\.next|node_modules)/|(?:^|/)(?:main|chunk|runtime|polyfills?|vendors?|index|app|bundle|styles?|common|scripts|[0-9]+)[.\-][A-Za-z0-9_]{6,}\.(?:m|c)?js$|\.min\.(?:m|c)?js$"
DISCORD = r"(?i)https?://(?:ptb\.|canary\.)?discord(?:app)?\.com/api/webhooks/\d+/[\w-]+"
TELEGRAM = r"(?i)https?://api\.telegram\.org/bot[A-Za-z0-9_:.-]+/send"
SLACK = r"(?i)https?://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+"
PTH_EXEC = r"(?i)(?:exec|eval|compile|__import__|os\.system|subprocess|popen|b64decode|base64|marshal|socket|urlopen|urllib|requests|\.decode\(|fromhex|getattr\(|pickle|ctypes)"
CREDENTIAL_PATHS = (
    r"(?i)(?:\.ssh/|/\.ssh|ssh/id_rsa|ssh/id_ed25519|ssh/authorized_keys|ssh/known_hosts|\.aws/credentials|\.aws/config|\.gnupg/|/\.gnupg|\.gitconfig|/\.gitconfig"
    r"|\.npmrc|/\.npmrc|\.pypirc|/\.pypirc|\.docker/config\.json|\.kube/config|/\.kube/config|kubeconfig|/\.env(?:\b|$)|/etc/passwd|/etc/shadow"
    r"|Chrome/User Data|firefox/profiles|\.mozilla/|Exodus/|exodus/|Atomic Wallet|atomic/|electrum/|\.wallet|wallet\.dat|keystore)"
)
#: What CREDENTIAL_PATHS and INJECTION_PHRASE can't match without, and addresses.
CREDENTIAL_TEXTS = (
    ".ssh/", "/.ssh", "ssh/", ".aws/", ".gnupg/", ".gitconfig", ".npmrc", ".pypirc", ".docker/", ".kube/", "kubeconfig", "/.env", "/etc/passwd", "/etc/shadow",
    "chrome/", "firefox/", ".mozilla/", "exodus/", "atomic wallet", "atomic/", "electrum/", ".wallet", "wallet.dat", "keystore",
)
DECODERS = r"(?:marshal\.loads|zlib\.decompress|bz2\.decompress|lzma\.decompress|codecs\.decode)"
PY_EXEC = r"\bexec\s*\(|\beval\s*\(|\bcompile\s*\("
PY_CALL = r"(?i)(?:subprocess\.(?:run|Popen|call|check_call|check_output|getoutput|getstatusoutput)|os\.(?:system|popen|execv?p?e?)|commands\.(?:getoutput|getstatusoutput)|pty\.spawn|sh\.[A-Za-z_][A-Za-z0-9_]*)\s*\("
DOWNLOADERS = r"(?:powershell|pwsh|cmd\.exe|curl\s|wget\s|Invoke-WebRequest|Invoke-Expression|IEX\s|Start-Process|certutil\s.*-urlcache|bitsadmin\s.*/transfer)"
ENV_BULK = r"os\.environ(?!\[|\.get)"
ENV_SENSITIVE = r"(?i)os\.environ\s*(?:\.get\(\s*|\[\s*)['\"](?:AWS_|GITHUB_TOKEN|DATABASE_|DB_|SECRET|TOKEN|API_KEY|PRIVATE)"
HTTP_SEND = r"(?:requests\.post|httpx\.post|urllib\.request\.urlopen|urlopen|http\.client|aiohttp\.ClientSession|\.post\(|curl\b|wget\b)"
ENCODED = r"(?:[A-Za-z0-9+/]{200}|(?:\\x[0-9a-fA-F]{2}){50})"
RUST_NET = r"(?i)(?:reqwest|ureq|hyper|curl|std::net::TcpStream|std::net::UdpSocket|attohttpc|minreq|isahc)"
RUST_EXEC = r"(?:std::process::Command|Command::new|std::os::unix::process|exec::Command)"
SECRET_VARIABLES = (
    "HOME", "USERPROFILE", "SSH_AUTH_SOCK", "SSH_PRIVATE_KEY", "AWS_SECRET_ACCESS_KEY", "AWS_ACCESS_KEY_ID", "AWS_SESSION_TOKEN", "GH_TOKEN", "GITHUB_TOKEN",
    "GITLAB_TOKEN", "DOCKER_PASSWORD", "NPM_TOKEN", "CARGO_REGISTRY_TOKEN", "DATABASE_URL", "SECRET_KEY", "PRIVATE_KEY",
)
GO_NET = r"\"(?:net/http|net|net/smtp|net/rpc|golang\.org/x/net)\""
GO_EXEC_USE = r"exec\.(?:Command|CommandContext|LookPath)\b"
GO_NET_USE = r"(?:http\.(?:Get|Post|Head|Do|NewRequest|DefaultClient)|net\.(?:Dial|DialTimeout|Listen|ListenPacket|ResolveIPAddr)|smtp\.(?:SendMail|Dial)|rpc\.(?:Dial|DialHTTP))"
GO_TOOLCHAIN = r"exec\.Command\w*\([^,]+,\s*\"(?:env|version)\""
GO_FOREIGN = r"\"(?:/bin/)?(?:sh|bash|dash|zsh|ksh|ash)\"|\"(?:curl|wget|nc|ncat|socat|python[0-9.]*|perl|ruby|powershell|pwsh|cmd|osascript)\"|\"-c\"|/bin/sh"
CGO_DANGEROUS = r"(?:system\s*\(|popen\s*\(|exec[lv]p?\s*\(|socket\s*\(|connect\s*\(|getenv\s*\()"
SHELL_NET = r"(?i)\b(?:curl|wget|fetch|nc|ncat|certutil|bitsadmin|Invoke-WebRequest|iwr|scp|rsync)\b|https?://|ftp://"
SHELL_EXEC = r"(?i)\b(?:sh|bash|zsh|cmd|powershell|pwsh)\b\s+-\w*c|\beval\b|\bexec\b|\bnode\b\s+-e|\bpython3?\b\s+-c|\bperl\b\s+-e|\bruby\b\s+-e"
SHELL_DECODE = r"(?i)base64\s+(?:-d|--decode)|\batob\b|\bxxd\b\s+-r|Buffer\.from\([^)]*['\"]base64['\"]"
JS_NET = r"(?i)require\(\s*['\"](?:https?|net|dns|tls|dgram)['\"]\s*\)|\b(?:fetch|axios|node-fetch|got|undici|superagent)\b|\bhttps?\.(?:get|request)\b|\bXMLHttpRequest\b"
JS_EXEC = r"require\(\s*['\"]child_process['\"]\s*\)|\bchild_process\b|\b(?:exec|execSync|spawn|spawnSync|execFile|fork)\s*\(|\beval\s*\(|new\s+Function\s*\(|process\.binding\s*\("
JS_DECODE = r"Buffer\.from\([^)]*['\"]base64['\"]|\batob\s*\("
# Tools that generate code.
GO_TOOLS = (
    "go", "-command", "stringer", "mockgen", "mockery", "moq", "counterfeiter", "protoc", "protoc-gen-go", "protoc-gen-go-grpc", "wire", "enumer", "genny", "go-bindata",
    "easyjson", "msgp", "codecgen", "golex", "goyacc", "gotext", "go-localize", "goimports", "gofmt", "gofumpt", "oapi-codegen", "sqlboiler", "buf", "gqlgen", "ent",
    "swag", "swagger", "go-swagger", "controller-gen", "deepcopy-gen", "client-gen", "lister-gen", "informer-gen", "defaulter-gen", "conversion-gen", "openapi-gen",
    "register-gen", "applyconfiguration-gen", "fyne", "rice", "statik", "pkger", "embedme", "go-winres", "goversioninfo", "errorgen", "dagnabit", "genxdr", "tscriptify",
    "pluginrpc-gen", "vprotogen", "togo", "api", "go-enum", "xgettext", "mv", "mkdir", "rm",
)
HOST_RECON = r"(?i)\bos\.(?:hostname|userInfo)\s*\(|\b(?:whoami|systeminfo)\b|\buname\s+-|\bid\s+-un\b|echo\s+%USERNAME%"
NET_RECON = r"(?i)\bos\.networkInterfaces\s*\(|\b(?:ifconfig|ipconfig|ip\s+addr)\b"
CI_HARVEST = r"GITHUB_TOKEN|GITHUB_ACTOR|GITHUB_REPOSITORY|GH_TOKEN|NPM_TOKEN|NODE_AUTH_TOKEN|CIRCLECI|JENKINS_URL|GITLAB_CI"
PERSISTENCE = r"(?i)systemctl\s+(?:--user\s+)?enable|LaunchAgents|LaunchDaemons|launchctl\s+load|CurrentVersion\\+Run|\.config/autostart|crontab\s|schtasks\s"
DETACHED = r"(?s)detached\s*:\s*true.{0,400}?\.unref\s*\(|\.unref\s*\(\s*\)"
INJECTION_SCHEMA = r"(?i)agrees_with_rules"
INJECTION_PHRASE = (
    r"(?i)[\"']verdict[\"']\s*:\s*[\"'](?:benign|safe)|ignore\s+(?:(?:all|the|any)\s+)*+(?:previous|prior|above|preceding|earlier|system)\s+(?:instruction|prompt|message|rule)"
    r"|disregard\s+(?:(?:all|the|any)\s+)*+(?:previous|prior|above|preceding|earlier|system)\b"
)
INJECTION_TEXTS = ("verdict", "ignore", "disregard")
DOTTED = r"\d\.\d{1,3}\.\d"
CJK = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uFF66-\\uFF9F"
LOOKALIKE, WIDE = "\\u0370-\\u03FF\\u0400-\\u04FF", "\\uFF21-\\uFF3A\\uFF41-\\uFF5A"
#: A word of Latin letters and such as look like them. The first match starts a word, so no other place is tried: a long word is read in linear time.
MIXED = f"(?<![A-Za-z0-9_{LOOKALIKE}])[A-Za-z0-9_{LOOKALIKE}]*(?:[A-Za-z][{LOOKALIKE}]|[{LOOKALIKE}][A-Za-z]|[{WIDE}])[A-Za-z0-9_{LOOKALIKE}]*"
OAST = ("oastify.com", "interact.sh", "oast.fun", "oast.site", "oast.pro", "oast.live", "oast.online", "oast.me", "burpcollaborator.net", "dnslog.cn", "requestcatcher.com", "canarytokens.com", "canarytokens.org")
ABUSE_HOSTS = (
    "workers.dev", "pages.dev", "trycloudflare.com", "r2.dev", "ngrok.io", "ngrok-free.app", "ngrok.app", "ngrok.dev", "deno.dev", "val.run", "glitch.me", "repl.co",
    "replit.dev", "surge.sh", "serveo.net", "loca.lt", "telebit.io", "webhook.cool",
)
IOC_SUFFIXES = (".py", ".cfg", ".toml", ".ini", ".txt", ".md", ".rst", ".json", ".yml", ".yaml", ".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx", ".rs", ".go", ".sh", ".ps1", ".bat")
JS_SUFFIXES, CODE_SUFFIXES = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".py")
PLACEHOLDERS = ("host", "hostname", "your-host", "your_host", "yourhost", "server", "ip", "ipaddress", "ip-address", "address", "domain", "yourdomain", "example", "host1", "host2", "myhost")
GAP = 600


def near(text: Column, pairs: tuple[tuple[str, str], ...], gap: int = GAP) -> Column:
    """An array of booleans, one for each pair of patterns: whether matches of the two start within `gap` characters of each other.

    Offsets of matches are what the built-in functions don't give, so this runs in Python over Arrow batches; give it null where it can't matter.
    """

    @F.pandas_udf("array<boolean>")
    def run(data: pd.Series) -> pd.Series:
        compiled = {x: re.compile(x) for pair in pairs for x in pair}

        def told(body: str) -> list[bool]:
            starts = {x: np.array([m.start() for m in found.finditer(body)], np.int64) for x, found in compiled.items()}
            return [closest(starts[a], starts[b]) <= gap for a, b in pairs]

        return pd.Series([told(x) if x is not None else None for x in data])

    return run(text)


def closest(a: np.ndarray, b: np.ndarray) -> float:
    """The smallest distance between two sorted lists of offsets."""
    if not len(a) or not len(b):
        return np.inf
    at = np.searchsorted(b, a)
    after, before = b[np.minimum(at, len(b) - 1)] - a, a - b[np.maximum(at - 1, 0)]
    return float(min(np.abs(after).min(), np.abs(before).min()))


def pypi() -> Column:
    return F.col("ecosystem") == "pypi"


def install_file(key: str, pack: Pack = BASELINE) -> Callable[[], Column]:
    return lambda: pypi() & base_name().isin(*pack.install_files[key]) & (ext() == ".py")


def js() -> Column:
    return ext().isin(*JS_SUFFIXES) & F.col("size").between(64, 32 << 20)


def code() -> Column:
    return ext().isin(*CODE_SUFFIXES) & F.col("size").between(64, 10 << 20)


def ioc_file() -> Column:
    return ext().isin(*IOC_SUFFIXES)


def plain_ioc() -> Column:
    return ioc_file() & ~T.is_doc_file(place())


def build_rs() -> Column:
    return base_name() == "build.rs"


def go_file() -> Column:
    return (ext() == ".go") & (F.col("ecosystem") == "gomod")


def url_classes(pack: Pack = BASELINE) -> Column:
    """The distinct URLs of a file as structs (url, host, class): benign, oast, abuse or suspicious, in that order of decision."""
    urls = F.array_distinct(F.regexp_extract_all(body(), F.lit(r"https?://[^\s'\"<>()]+"), F.lit(0)))

    def told(url: Column) -> Column:
        clean = F.regexp_replace(url, r"[`),;'\"\]>]+$", "")
        host = T.url_host(clean)
        placeholder = host.isin(*PLACEHOLDERS) | host.rlike(r"^localhost|\.localhost$|[{%$]|^\.{2,}$|^:?$|^test(?:server|host|ing|bed|\.(?:com|org|net|local|example|invalid))?$|\.(?:test|invalid|localdomain)$")
        benign = host.isin(*sorted(pack.benign_hosts)) | T.registrable(host).isin(*sorted(pack.benign_hosts), "example.edu") | placeholder | F.contains(url, F.lit("{"))
        kind = F.when(benign, "benign").when(T.under_any(host, OAST), "oast").when(T.under_any(host, ABUSE_HOSTS), "abuse").otherwise("suspicious")
        return F.struct(url.alias("url"), host.alias("host"), kind.alias("kind"))

    return F.transform(urls, told)


def urls_of(kind: str) -> Column:
    return F.transform(F.filter("_urls", lambda x: x.kind == kind), lambda x: x.url)


def ips(kinds: tuple[str, ...], with_port: bool) -> Column:
    """Distinct addresses of some kinds that a port follows, or doesn't. Public resolvers with a port count as plain addresses."""
    port = rf"({T.IPV4}):([1-9]\d{{0,4}})\b"
    ported = F.filter(F.array_distinct(F.regexp_extract_all(body(), F.lit(port), F.lit(1))), lambda x: ~x.isin(*T.RESOLVERS))
    some = ported if with_port else F.array_except("_ips", ported)
    return F.filter(some, lambda x: T.ipv4_kind(x).isin(*kinds))


#: Tokens of Go: heads of init functions, texts, comments, braces, and what lies between. Loops are possessive, as below.
GO_TOKENS = r"""(?s)func\s+init\s*+\(\s*+\)\s*+\{|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`]*+`|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|//[^\n]*+|/\*.*?\*/|[{}]|[^{}"'`/f]++|."""


def blocks(text: Column, tokens: str, head: str) -> Column:
    """The bodies of top-level blocks whose head starts with `head` and ends with their brace, by the running depth of braces over the text's tokens; those in texts and
    comments, which are tokens of their own, don't count. A body that is never closed goes to the end. Only places are carried along, so a text is read in linear time."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("start"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))

    def step(held: Column, token: Column) -> Column:
        opens, closes = token.endswith("{") & ~token.startswith("/"), token == "}"
        depth = F.greatest(held.depth + opens.cast("int") - closes.cast("int"), F.lit(0))
        begins, ends = opens & (held.depth == 0) & token.startswith(head), closes & (held.depth == 1)
        return F.struct(
            (held.at + F.length(token)).alias("at"), depth.alias("depth"), F.when(begins, held.at + F.length(token)).when(ends, -1).otherwise(held.start).alias("start"),
            F.when(ends & (held.start >= 0), F.concat(held.spans, F.array(F.struct(held.start.alias("start"), (held.at - held.start).alias("size"))))).otherwise(held.spans).alias("spans"),
        )

    def finish(held: Column) -> Column:
        return F.when(held.start >= 0, F.concat(held.spans, F.array(F.struct(held.start.alias("start"), (held.at - held.start).alias("size"))))).otherwise(held.spans)

    spans = F.aggregate(F.regexp_extract_all(text, F.lit(tokens), F.lit(0)), start, step, finish)
    return F.transform(spans, lambda x: F.substring(text, x.start + 1, x.size))


def go_init() -> Column:
    """The bodies of init functions."""
    return F.when(body().rlike(r"func\s+init\s*\("), F.array_join(blocks(body(), GO_TOKENS, "func"), "\n")).otherwise("")


def secrets_in(pattern: str, text: Column | None = None) -> Column:
    return F.filter(F.regexp_extract_all(body() if text is None else text, F.lit(pattern), F.lit(1)), lambda x: x.isin(*SECRET_VARIABLES))


#: String literals. The loops are possessive: the JVM runs those without recursion, so a literal of any length is read in constant stack.
LITERALS = (r"'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'", r'"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"', r"`([^`\\]*+(?:\\.[^`\\]*+)*+)`")


def cgo_preamble() -> Column:
    """The comment right before the first import of "C", found by literal searches in linear time; empty without one."""
    before = F.regexp_replace(F.substring_index(body(), 'import "C"', 1), r"\s++$", "")
    return F.when(F.contains(body(), F.lit('import "C"')) & before.endswith("*/"), F.substring_index(before, "/*", -1)).otherwise("")


def alphabets() -> Column:
    """Distinct literals that could be the alphabet of a codec: 84 to 95 printable characters, all different but one."""
    inner = F.concat(*(F.regexp_extract_all(body(), F.lit(p), F.lit(1)) for p in LITERALS))
    return F.filter(F.array_distinct(inner), lambda s: F.length(s).between(84, 95) & s.rlike(r"^[\x21-\x7E]+$") & (F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))) >= F.length(s) - 1))


def bare_code() -> Column:
    """Code without strings and comments, of texts with letters of other scripts that rules look for there."""
    out = F.regexp_replace(body(), r"(?s)/\*.*?\*/", " ")
    for pattern in (*LITERALS, r"(?://|#)[^\n]*+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.when((F.length(body()) < F.octet_length(body())) & has(f"[{CJK}{LOOKALIKE}{WIDE}]"), out)


def credential_paths() -> Column:
    return F.when(holds(*CREDENTIAL_TEXTS), each(CREDENTIAL_PATHS))


def leading_spaces(n: int) -> Column:
    return has(rf"(?m)^ {{{n},}}\S")


def env_class() -> Column:
    return F.when(has(ENV_SENSITIVE) & has(HTTP_SEND), "sensitive").when(has(ENV_BULK) & has(HTTP_SEND), "bulk")


def rules(pack: Pack = BASELINE) -> list[Rule]:
    low_test = lambda high: (lambda: F.when(T.is_test_file(place()), "low").otherwise(high))
    bundle = lambda: F.when(place().rlike(BUNDLE), "low").otherwise("high")
    plain = plain_ioc
    init_exec = lambda: go_init().rlike(GO_EXEC_USE) & ~(go_init().rlike(GO_TOOLCHAIN) & ~go_init().rlike(GO_FOREIGN))
    return [
        Rule("iocs.llm_prompt_injection", "high", "high", ioc_file, lambda: when(holds(INJECTION_SCHEMA.removeprefix("(?i)")) & has(INJECTION_SCHEMA), "names a field of the triage schema")),
        Rule("iocs.llm_injection_phrase", "medium", "low", ioc_file, lambda: when(holds(*INJECTION_TEXTS) & has(INJECTION_PHRASE), "asks to override instructions")),
        Rule("iocs.oast_callback", "high", "high", plain, lambda: urls_of("oast")),
        Rule("iocs.oast_callback", "high", "high", plain, lambda: when(holds(*OAST) & (F.size(urls_of("oast")) == 0) & has(r"(?i)\b(?:" + "|".join(d.replace(".", r"\.") for d in OAST) + r")\b"), "a callback domain outside a URL")),
        Rule("iocs.abuse_hosting_callback", "medium", "high", plain, lambda: urls_of("abuse")),
        Rule("iocs.url_suspicious", "low", "low", lambda: plain() & ~T.is_test_file(place()), lambda: urls_of("suspicious")),
        Rule("iocs.cloud_metadata_endpoint", "medium", "high", plain, lambda: F.filter("_ips", lambda x: x.isin(*T.METADATA_IPS))),
        Rule("iocs.hardcoded_wan_ip_port", low_test("high"), "medium", lambda: plain() & (F.size("_ips") > 0) & ~has(r"(?i)iceServers|RTCPeerConnection|RTCIceServer|createDataChannel|(?:turns?|stun):"), lambda: ips(("routable",), True)),
        Rule("iocs.ipv4", "low", "low", lambda: plain() & (F.size("_ips") > 0) & ~T.is_test_file(place()), lambda: ips(("routable",), False)),
        Rule("iocs.onion", "high", "high", ioc_file, lambda: F.when(F.contains(body(), F.lit(".onion")), each(r"\b[a-z2-7]{16,56}\.onion\b"))),
        Rule("iocs.base64_blob", "medium", "low", ioc_file, lambda: F.transform(F.regexp_extract_all(body(), F.lit(r"['\"]([A-Za-z0-9+/]{160,}={0,2})['\"]"), F.lit(1)), lambda x: F.substring(x, 1, 60))),
        Rule("malware.discord_webhook", "critical", "high", lambda: pypi() & (ext() == ".py"), lambda: each(DISCORD)),
        Rule("malware.telegram_bot_exfil", "critical", "high", lambda: pypi() & (ext() == ".py"), lambda: each(TELEGRAM)),
        Rule("malware.slack_webhook", "high", "high", lambda: pypi() & (ext() == ".py"), lambda: each(SLACK)),
        Rule("malware.pth_exec_injection", "critical", "high", lambda: pypi() & (ext() == ".pth"), lambda: when(
            F.exists(F.split(body(), "\n"), lambda x: x.rlike(r"^\s*(?:import|from)\s") & F.contains(x, F.lit(";")) & x.rlike(PTH_EXEC)) & ~has(r"(?s)COVERAGE_PROCESS_(?:START|CONFIG).{0,200}coverage\.process_startup"), "an import line that runs code")),
        Rule("malware.credential_file_access", "critical", "high", install_file("credential_targets", pack), credential_paths),
        Rule("malware.deobfuscation_exec_chain", "critical", "high", install_file("deobfuscation_targets", pack), lambda: when(has(DECODERS) & has(PY_EXEC), F.array_join(F.array_sort(each(DECODERS)), ", "))),
        Rule("malware.env_bulk_exfil", "medium", "low", lambda: install_file("install_time_all", pack)(), lambda: when(env_class() == "bulk", "reads the whole environment and sends")),
        Rule("malware.env_sensitive_exfil", "high", "medium", lambda: install_file("install_time_all", pack)(), lambda: when(env_class() == "sensitive", "reads secrets from the environment and sends")),
        Rule("malware.whitespace_hidden_payload", "critical", "high", lambda: pypi() & (ext() == ".py"), lambda: when(leading_spaces(pack.thresholds["whitespace_min_leading_spaces"]), "code behind a wall of spaces")),
        Rule("malware.download_command", "critical", "high", install_file("download_targets", pack), lambda: when(has(rf"(?s){PY_CALL}.{{0,400}}?{DOWNLOADERS}"), "a download tool in a call")),
        Rule("malware.credential_store_sweep", "critical", "medium", code, lambda: when(F.size(credential_paths()) >= 3, "three credential stores or more")),
        Rule("malware.etc_shadow_read", "high", "medium", code, lambda: when(has("/etc/shadow"), "/etc/shadow")),
        Rule("obfuscation.remote_fetch_eval", "critical", "high", js, lambda: when(F.col("_near")[0], "a hidden fetch near eval")),
        Rule("obfuscation.decrypt_then_exec", "high", "high", js, lambda: when(F.col("_near")[1], "decryption near eval")),
        Rule("obfuscation.charcode_eval", bundle, "high", js, lambda: when(F.col("_near")[2], "character codes near eval")),
        Rule("obfuscation.rot_cipher_eval", "high", "high", js, lambda: when(F.contains(body(), F.lit("charCodeAt")) & runs_text() & has(ROT_WRAPPER), "a rotation cipher and eval")),
        Rule("obfuscation.rotating_alphabet_codec", "high", "high", code, lambda: when(F.size("_alphabets") >= 2, "two alphabets or more")),
        Rule("obfuscation.custom_alphabet_codec", "low", "medium", code, lambda: when(F.size("_alphabets") == 1, "one alphabet")),
        Rule("obfuscation.nonascii_identifiers", "medium", "medium", code, lambda: when(F.size(F.array_distinct(F.regexp_extract_all("_bare", F.lit(f"[{CJK}]+"), F.lit(0)))) >= 8, "identifiers in CJK script")),
        Rule("obfuscation.homoglyph_identifiers", "medium", "medium", code, lambda: F.filter(F.array(F.regexp_extract("_bare", MIXED, 0)), lambda x: x != "")),
        Rule("crates.build_rs_net_exec_chain", "critical", "high", build_rs, lambda: when(has(RUST_NET) & has(RUST_EXEC), "network and processes in a build script")),
        Rule("crates.build_rs_network", "high", "high", build_rs, lambda: when(has(RUST_NET) & ~has(RUST_EXEC), F.element_at(each(RUST_NET), 1))),
        Rule("crates.build_rs_exec", "medium", "medium", build_rs, lambda: when(has(RUST_EXEC) & ~has(RUST_NET), F.element_at(each(RUST_EXEC), 1))),
        Rule("crates.build_rs_env_harvest", "high", "high", build_rs, lambda: when(F.size(secrets_in(r"(?:std::env::var|env::var|env!)\s*\(\s*\"([^\"]+)\"")) >= 3, "three secrets or more")),
        Rule("crates.build_rs_outdir_escape", "high", "medium", build_rs, lambda: F.regexp_extract_all(body(), F.lit(r"(?:fs::write|File::create|OpenOptions)\s*\(\s*\"(/[^\"]+|(?:\$HOME|~)[^\"]*)\""), F.lit(1))),
        Rule("crates.build_rs_suspicious_include", "high", "medium", build_rs, lambda: F.regexp_extract_all(body(), F.lit(r"include_bytes!\s*\(\s*\"([^\"]+\.(?:exe|dll|so|sh|ps1|bat|cmd|bin))\""), F.lit(1))),
        Rule("crates.build_rs_encoded_payload", "medium", "medium", build_rs, lambda: when(has(ENCODED), "a long encoded literal")),
        Rule("gomod.go_generate_exec", "critical", "high", go_file, lambda: F.filter(F.regexp_extract_all(body(), F.lit(r"(?m)^//go:generate\s+(.*)$"), F.lit(1)), lambda x: x.rlike(r"(?i)\b(?:curl|wget|bash|powershell|python\d?)\b|(?:^|\s|[|;&])(?:sh|cmd|nc)\s"))),
        Rule("gomod.go_generate", "low", "medium", go_file, lambda: F.filter(F.regexp_extract_all(body(), F.lit(r"(?m)^//go:generate\s+(\S+)"), F.lit(1)), lambda x: ~F.substring_index(x, "/", -1).isin(*GO_TOOLS, "bash", "sh", "curl", "wget", "powershell"))),
        Rule("gomod.init_exec_chain", "critical", "high", go_file, lambda: when(init_exec(), "init runs a process")),
        Rule("gomod.init_net_chain", "high", "high", go_file, lambda: when(go_init().rlike(GO_NET_USE), "init uses the network")),
        Rule("gomod.init_env_harvest", "high", "high", go_file, lambda: when(F.size(secrets_in(r"os\.Getenv\s*\(\s*\"([^\"]+)\"", go_init())) >= 3, "init reads three secrets or more")),
        Rule("gomod.init_exec_coexist", "low", "medium", go_file, lambda: when(has(r"(?m)^func\s+init\s*\(") & has('"os/exec"') & ~init_exec(), "init beside os/exec")),
        Rule("gomod.init_net_coexist", "low", "medium", go_file, lambda: when(has(r"(?m)^func\s+init\s*\(") & has(GO_NET) & ~go_init().rlike(GO_NET_USE), "init beside the network")),
        Rule("gomod.cgo_exec_chain", "high", "high", go_file, lambda: when(cgo_preamble().rlike(CGO_DANGEROUS), "dangerous C beside cgo")),
        Rule("gomod.cgo_import", "medium", "medium", go_file, lambda: when(has(r"(?m)^import\s+\"C\"") & ~cgo_preamble().rlike(CGO_DANGEROUS), "cgo")),
        Rule("gomod.unsafe_import", "low", "medium", go_file, lambda: when(has('"unsafe"'), "unsafe")),
        Rule("gomod.encoded_payload", "medium", "medium", lambda: go_file() & ~T.is_test_file(place()), lambda: when(has(ENCODED), "a long encoded literal")),
        Rule("gomod.replace_local_path", "low", "high", lambda: base_name() == "go.mod", lambda: F.regexp_extract_all(body(), F.lit(r"(?m)^\s*replace\s+\S+\s+=>\s+(\.{0,2}/\S*)"), F.lit(1))),
        Rule("gomod.replace_directive", "medium", "high", lambda: base_name() == "go.mod", lambda: F.regexp_extract_all(body(), F.lit(r"(?m)^\s*replace\s+\S+\s+=>\s+([^./\s]\S*)"), F.lit(1))),
    ]


def static_findings(files: DataFrame, pack: Pack = BASELINE, changed: DataFrame | None = None) -> DataFrame:
    """(scan_id, rule_id, category, severity, confidence, file, evidence). Given changed files (scan_id, path), only those are looked at: they are joined before any rule."""
    some = files if changed is None else files.join(changed.select("scan_id", "path").distinct(), ["scan_id", "path"], "left_semi")
    # What several rules look at is computed once; the optimizer doesn't copy such columns into their uses.
    doubtful = js() & runs_text() & (has(HIDDEN_FETCH) | has(DECIPHER) | has(CHARCODE))
    some = some.withColumn("_near", near(F.when(doubtful, body()), ((HIDDEN_FETCH, EVAL), (DECIPHER, EVAL), (CHARCODE, EVAL))))
    some = some.withColumns({"_urls": F.when(plain_ioc(), url_classes(pack)), "_ips": F.when(ioc_file() & has(DOTTED), F.array_distinct(T.ipv4_literals(body()))), "_alphabets": F.when(code(), alphabets()), "_bare": F.when(code(), bare_code())})
    every = F.flatten(F.array(*(rule.findings() for rule in rules(pack))))
    return some.select("scan_id", F.col("path").alias("file"), F.explode(every).alias("x")).select("scan_id", "x.rule_id", "x.category", "x.severity", "x.confidence", "file", "x.evidence").distinct()


def told(rule: str, severity: str | Column, confidence: str = "high") -> Column:
    said = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(rule).alias("rule_id"), said.alias("severity"), F.lit(confidence).alias("confidence"))


def hook_findings(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of npm install hooks, rows (scan_id, path, text) of package.json: what a command does itself, and what the script it runs does."""
    hooks = install_hooks(manifests)
    c = F.col("command")
    net, run, dec = c.rlike(SHELL_NET), c.rlike(SHELL_EXEC), c.rlike(SHELL_DECODE)
    own = (
        F.when(net & (run | dec), told("installer.npm_lifecycle_net_exec", "critical", "high"))
        .when(net, told("installer.npm_lifecycle_network", "high", "medium"))
        .when(run | dec, told("installer.npm_lifecycle_subprocess", "medium", "medium"))
    )
    commands = hooks.where(~is_benign(c)).select("scan_id", F.lit("package.json").alias("file"), own.alias("x"), c.alias("evidence")).where("x IS NOT NULL")
    refs = hooks.select("scan_id", F.explode(F.transform(F.regexp_extract_all(c, F.lit(r"(?:^|\s)(?:\./)?([\w./-]+\.(?:[cm]?jsx?|[cm]?tsx?))\b"), F.lit(1)), lambda x: F.concat("root", x))).alias("path")).distinct()
    bodies = files.join(refs, ["scan_id", "path"], "left_semi")
    net, run = has(JS_NET), has(JS_EXEC)
    recon = has(HOST_RECON) | has(NET_RECON) | has(CI_HARVEST)
    persists, detached = has(PERSISTENCE), has(DETACHED)

    def hit(condition: Column, rule: str, severity: str, confidence: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), told(f"installer.npm_install_{rule}", severity, confidence))

    hits = F.array(
        hit(has(HOST_RECON), "host_recon", "medium", "medium"), hit(has(NET_RECON), "network_recon", "medium", "medium"), hit(has(CI_HARVEST), "ci_secret_harvest", "high", "medium"),
        hit(recon & net, "recon_exfil", "high", "high"), hit(net & run, "script_net_exec", "critical", "high"), hit(net & ~run, "script_network", "high", "medium"),
        hit(has(JS_DECODE) & run, "script_decode_exec", "high", "medium"), hit(run & (has(CHARCODE) | has(DECIPHER)), "obfuscated_entrypoint", "critical", "high"),
        hit(persists & detached, "persistence_loader", "critical", "high"), hit(persists & ~detached, "persistence", "high", "high"), hit(detached & ~persists, "detached_spawn", "high", "medium"),
        hit(has(ENCODED), "script_encoded_payload", "medium", "medium"),
    )
    followed = bodies.select("scan_id", F.col("path").alias("file"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x"), F.lit("a script that a hook runs").alias("evidence"))
    both = commands.unionByName(followed)
    return both.select("scan_id", "x.rule_id", F.lit("installer").alias("category"), "x.severity", "x.confidence", "file", "evidence").distinct()


def entropy_findings(files: DataFrame, install_files: tuple[str, ...] = BASELINE.install_files["install_time_all"]) -> DataFrame:
    """Findings of near-random content, rows (scan_id, path, size, entropy)."""
    skipped = r"(?i)\.(?:png|jpe?g|gif|webp|ico|svg|woff2?|ttf|otf|eot|mp[34]|wav|ogg|webm|pdf|zip|gz|tgz|bz2|xz|7z|whl|egg|jar|crt|pem|der|cer|p12)$"
    some = files.where(~place().rlike(skipped) & F.col("size").between(256, 20 << 20))
    high, script = F.col("entropy") >= 7.2, (F.col("entropy") >= 6.0) & ext().isin(".py", ".js", ".sh")
    rule = F.when(high, "entropy.obfuscated_payload").when(script, "entropy.high_entropy_script")
    severity = F.when(high & base_name().isin(*install_files), "high").when(high, "medium").otherwise("low")
    return some.where(rule.isNotNull()).select("scan_id", rule.alias("rule_id"), F.lit("entropy").alias("category"), severity.alias("severity"), F.when(high, "medium").otherwise("low").alias("confidence"), F.col("path").alias("file"), F.round("entropy", 2).cast("string").alias("evidence"))


# First bytes of executables, and marks of packers.
MAGICS = ("7F454C46", "4D5A", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "0061736D")
PACKERS = {
    "upx": ("$Info: This file is packed with the UPX", "UPX!"),
    "commercial": ("Themida", ".themida", "WinLicense", "VMProtect", ".vmp0", ".vmp1", ".enigma1", ".enigma2"),
    "other": ("ASPack", ".aspack", ".MPRESS1", ".MPRESS2", "PECompact2", "FSG!", ".petite", ".MEW"),
}


def is_executable(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.exists(F.array(*map(F.lit, MAGICS)), lambda m: F.startswith(head, m))


def binary_findings(files: DataFrame) -> DataFrame:
    """Findings of executables, rows (scan_id, path, content)."""
    head = F.decode(F.substring(F.col("content"), 1, 1 << 20), "ISO-8859-1")
    packed = {kind: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(head, m)) for kind, marks in PACKERS.items()}
    some = files.where(is_executable(F.col("content")) & ~place().rlike(r"(?:^|/)(?:__pycache__|\.git|node_modules)/"))
    unpacked, native = place().endswith(".upx_unpacked"), ext().isin(".so", ".dll", ".pyd", ".dylib", ".exe", ".msi", ".whl", ".egg")
    any_packed = packed["upx"] | packed["commercial"] | packed["other"]
    out = (
        F.when(any_packed & ~unpacked, told("binary.packed_executable", F.when(packed["commercial"], "critical").otherwise("high")))
        .when(ext().isin(".py", ".txt", ".json", ".cfg", ".ini", ".yml", ".yaml"), told("binary.hidden_executable", "high"))
        .when(~(native | unpacked), told("binary.compiled_artifact", F.when(ext() == "", "low").otherwise("medium")))
    )
    return some.withColumn("x", out).where("x IS NOT NULL").select("scan_id", "x.rule_id", F.lit("binary").alias("category"), "x.severity", F.lit("high").alias("confidence"), F.col("path").alias("file"), F.lit("executable content").alias("evidence"))


def manifest_findings(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of package.json, rows (scan_id, path, text): executables among bin entries, raw-URL dependencies, entry points that decode themselves."""
    root = F.regexp_extract(place(), "^(.*/)?package\\.json$", 1)

    def table_of(key: str) -> Column:
        return F.coalesce(F.from_json(F.get_json_object("text", f"$.{key}"), "map<string,string>"), F.expr("map()").cast("map<string,string>"))

    bins = manifests.select("scan_id", F.explode(F.map_values(table_of("bin"))).alias("evidence")).where(F.lower("evidence").rlike(r"\.(?:sh|ps1|bat|cmd|exe|dll|so|bin)$"))
    bins = bins.select("scan_id", told("installer.npm_suspicious_bin", "low", "low").alias("x"), F.lit("package.json").alias("file"), "evidence")
    wanted = F.concat(*(F.map_values(table_of(k)) for k in ("dependencies", "devDependencies", "optionalDependencies")))
    urls = manifests.select("scan_id", F.explode(F.filter(wanted, lambda x: x.rlike("^https?://"))).alias("evidence"))
    odd = T.under_any(T.url_host(F.col("evidence")), OAST + ABUSE_HOSTS) | F.coalesce(T.url_host(F.col("evidence")).rlike(r"^[\d.]+$"), F.lit(False))
    urls = urls.select("scan_id", told("installer.npm_url_dependency", F.when(odd, "high").otherwise("medium")).alias("x"), F.lit("package.json").alias("file"), "evidence")
    main = F.coalesce(F.get_json_object("text", "$.main"), F.lit("index.js"))
    entry = manifests.select("scan_id", F.explode(F.concat(F.array(main), F.map_values(table_of("bin")))).alias("said"), root.alias("root"))
    entry = entry.select("scan_id", F.concat("root", F.regexp_replace("said", r"^\./", "")).alias("path")).distinct()
    decodes = ~place().rlike(BUNDLE) & has(EVAL) & (has(CHARCODE) | has(DECIPHER))
    runs = files.join(entry, ["scan_id", "path"], "left_semi").where(decodes)
    runs = runs.where(F.exists(near(body(), ((CHARCODE, EVAL), (DECIPHER, EVAL))), lambda x: x))
    runs = runs.select("scan_id", told("installer.npm_runtime_obfuscated_entrypoint", "critical").alias("x"), F.col("path").alias("file"), F.lit("an entry point that decodes itself").alias("evidence"))
    every = bins.unionByName(urls).unionByName(runs)
    return every.select("scan_id", "x.rule_id", F.lit("installer").alias("category"), "x.severity", "x.confidence", "file", "evidence").distinct()


def shipped_findings(files: DataFrame) -> DataFrame:
    """Findings that need the other files of a package, rows (scan_id, path, text): bytecode outside __pycache__, .pth imports of modules that aren't shipped."""
    loader = files.where(ext() == ".py").groupBy("scan_id").agg(F.bool_or(F.coalesce(has(r"importlib\.(?:util|machinery)|SourcelessFileLoader|imp\.load_compiled"), F.lit(False))).alias("loads"))
    pyc = files.where((ext() == ".pyc") & ~place().rlike("(?:^|/)__pycache__/")).join(loader, "scan_id", "left")
    pyc = pyc.select("scan_id", told("malware.pyc_bytecode_hidden", F.when(F.col("loads"), "critical").otherwise("high")).alias("x"), F.col("path").alias("file"), F.lit("bytecode beside sources").alias("evidence"))
    stem = F.regexp_replace(F.substring_index(place(), "/", -1), r"\.py$", "")
    own = files.where(ext() == ".py").select("scan_id", F.explode(F.array(stem, F.element_at(F.split(place(), "/"), 1))).alias("module")).distinct()
    lines = files.where(ext() == ".pth").select("scan_id", F.col("path").alias("file"), F.explode(F.split("text", "\n")).alias("line"))
    named = lines.select("scan_id", "file", F.col("line").alias("evidence"), F.regexp_extract("line", r"^\s*(?:import|from)\s+([A-Za-z_]\w*)", 1).alias("module")).where("module <> '' AND NOT contains(line, ';')")
    foreign = named.where(~F.col("module").isin(*STDLIB)).join(own, ["scan_id", "module"], "left_anti")
    foreign = foreign.select("scan_id", told("malware.pth_import_injection", "high", "medium").alias("x"), "file", "evidence")
    return pyc.unionByName(foreign).select("scan_id", "x.rule_id", F.lit("malware").alias("category"), "x.severity", "x.confidence", "file", "evidence").distinct()
