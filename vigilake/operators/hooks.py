"""What npm runs while a package is installed, beside scripts that file_rules follows: files of the package that a hook runs, and commands in binding.gyp."""

from __future__ import annotations

import posixpath
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tools of builds, shells, hooks that run while a package is installed, suffixes of scripts that are followed elsewhere.
BENIGN_TOOLS = frozenset(
    "node-gyp node-gyp-build prebuild-install prebuildify tsc tsup webpack rollup vite esbuild babel gulp grunt parcel rimraf mkdirp cpy copyfiles "
    "eslint prettier jest mocha husky patch-package npm yarn pnpm echo true exit cd node is-ci cross-env shx ncc tscw nest ng".split()
)
SHELLS = frozenset("sh bash dash zsh ksh ash".split())
INSTALL_HOOKS = ("preinstall", "install", "postinstall", "prepare")
FOLLOWED = r"(?i)\.(?:[cm]?js|jsx|[cm]?ts|tsx)$"
# Command expansions of gyp files, and what tells a plain reading of settings from a run.
EXPANSION = r"<!@?\(([^)]*)\)"
RUNS_FILE = r"\b(?:node|bun|deno|sh|bash|zsh|python[0-9.]*|ruby|perl)\s+[^\s|&;<>]*\.(?:js|cjs|mjs|ts|sh|bash|py|rb|pl)\b"
READS_SETTING = r"^\s*(?:node|bun|deno|python[0-9.]*)\s+(?:-p|-e|--print|--eval|-c)\b"
SHELL_OPERATOR = r"&&|\|\||;|\||>|2>&1|`|\$\("
FETCHES = r"\b(?:curl|wget|fetch|Invoke-WebRequest|iwr)\b"


def commands(line: str) -> list[list[str] | None]:
    """The words of each command of a shell line; None for one that can't be read."""
    out: list[list[str] | None] = []
    for part in re.split(r"&&|\|\||;|\|", line):
        try:
            words = shlex.split(part)
        except ValueError:
            words = None
        if words != []:
            out.append(words)
    return out


def plainly_benign(line: str) -> bool:
    """Whether a line runs known build tools alone; node with a file isn't one."""
    told = commands(line)
    return bool(told) and all(
        words is not None and (head := posixpath.basename(words[0]).lower()) in BENIGN_TOOLS and not (head == "node" and len(words) > 1 and not words[1].startswith("-")) for words in told
    )


def run_files(line: str) -> list[str]:
    """Paths inside the package that a line runs by themselves or by a shell, as they are written."""
    out = []
    for words in filter(None, commands(line)):
        said = words[0]
        if posixpath.basename(said).lower() in SHELLS:
            said = next((x for x in words[1:] if not x.startswith("-")), said)
        if ("/" in said or said.startswith(".")) and not said.startswith("/") and posixpath.normpath(said).split("/")[0] != "..":
            out.append(said)
    return list(dict.fromkeys(out))


def is_benign(command: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([x is not None and plainly_benign(x) for x in lines], dtype=bool)

    return run(command)


def targets(command: Column) -> Column:
    """run_files() as array<struct<said, path>>, the path without detours."""

    @F.pandas_udf("array<struct<said:string,path:string>>")
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([[{"said": y, "path": posixpath.normpath(y)} for y in run_files(x or "")] for x in lines], dtype="object")

    return run(command)


def install_hooks(manifests: DataFrame) -> DataFrame:
    """(scan_id, root, hook, command) of rows (scan_id, path, text) of package.json."""
    scripts = F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")
    root = F.regexp_extract("path", r"^(.*/)?package\.json$", 1)
    return manifests.select("scan_id", root.alias("root"), F.explode(F.map_filter(scripts, lambda k, _: k.isin(*INSTALL_HOOKS))).alias("hook", "command"))


def run_file_findings(hooks: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of hooks (scan_id, root, hook, command) that run a file of the package itself, rows (scan_id, path, content): an executable image, or another file that isn't a followed script."""
    from vigilake.operators.file_rules import is_executable

    said = hooks.select("scan_id", "root", "hook", F.explode(targets(F.col("command"))).alias("x")).select("scan_id", "hook", F.col("x.said").alias("said"), F.concat("root", "x.path").alias("path"), F.concat("root", "x.said").alias("file"))
    met = said.join(files.select("scan_id", "path", is_executable(F.col("content")).alias("image")), ["scan_id", "path"])
    rule = F.when(F.col("image"), "installer.npm_install_runs_bundled_binary").when(~F.col("said").rlike(FOLLOWED), "installer.npm_install_runs_bundled_file")
    severity, sure = F.when(F.col("image"), "critical").otherwise("high"), F.when(F.col("image"), "high").otherwise("medium")
    evidence = F.concat("hook", F.lit(" runs "), "said")
    return met.select("scan_id", rule.alias("rule_id"), F.lit("installer").alias("category"), severity.alias("severity"), sure.alias("confidence"), "file", evidence.alias("evidence")).where("rule_id IS NOT NULL").distinct()


def gyp_findings(files: DataFrame) -> DataFrame:
    """Findings of binding.gyp beside a package's manifest, rows (scan_id, path, text): each command that is run while it is configured, unless it only reads a setting."""
    root = F.regexp_extract("path", r"^((?!node_modules/)[^/]+/)?[^/]+$", 1)
    own = files.where(F.col("path").rlike(r"^(?:(?!node_modules/)[^/]+/)?(?:binding\.gyp|package\.json)$")).withColumn("root", root)
    gyp = own.where(F.col("path").endswith("binding.gyp")).join(own.where(F.col("path").endswith("package.json")).select("scan_id", "root").distinct(), ["scan_id", "root"], "left_semi")

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", ""), r"^\s+|\s+$", "")

    each = gyp.select("scan_id", "path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(EXPANSION), F.lit(1)), bare))).alias("c"))
    c = F.col("c")
    loud = c.rlike(RUNS_FILE) | c.rlike(FETCHES)
    some = each.where((c != "") & ~(c.rlike(READS_SETTING) & ~(loud | c.rlike(SHELL_OPERATOR))))
    severity = F.when(loud, "critical").otherwise("high")
    return some.select(
        "scan_id", F.lit("installer.npm_binding_gyp_command_exec").alias("rule_id"), F.lit("installer").alias("category"), severity.alias("severity"), F.lit("high").alias("confidence"),
        F.col("path").alias("file"), F.substring("c", 1, 140).alias("evidence"),
    )
