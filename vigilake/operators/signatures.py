"""Content signatures, compiled to columns.

Those that come with the engine are thresholds (thresholds.py). Those of a directory are text: a name, a severity, named strings (plain, or /patterns/ with flags), and a condition over them. Strings become boolean
columns of the content read as Latin-1, conditions boolean algebra: "all of them", "any of ($a*)", "2 of ($x*)", and, or, not,
filesize < 5KB, filename matches /.../. So a directory of signatures is one pass over the files, inside code generation.

Patterns come from anybody's files, and the JVM's matcher recurses once for each round of a loop over a group of varying length, which a long file turns
into a stack overflow that ends the executor. Patterns that hold such a loop run in Python instead, over Arrow batches, where loops take no stack.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.signature_values import SIGNATURES
from vigilake.operators.thresholds import Threshold

HEADER = re.compile(r"rule\s+(\w+)[^{]*\{(.*?)\n\}", re.S)
STRING = re.compile(r"\$(\w*)\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|/((?:[^/\\\n]|\\.)+)/([is]*))((?:\s+(?:ascii|wide|nocase|fullword))*)")
#: Searches for more texts than these cost as much as a pattern.
MOST_TEXTS = 12
TOKEN = re.compile(r"\s*(\(|\)|\$\w+\*?|\d+(?:KB|MB)?|/(?:[^/\\]|\\.)+/i?|[<>]=?|,|\w+)")


@dataclass(frozen=True)
class Signature:
    name: str
    severity: str
    confidence: str
    strings: dict[str, tuple[str, bool]]  # name -> (pattern, any case)
    condition: str


def parse(text: str) -> list[Signature]:
    """Signatures of a rule file: meta values severity and confidence, strings, condition."""
    out = []
    for name, body in HEADER.findall(text):
        body = re.sub(r"(?m)(?<![:\"'/\\])//[^\n]*$", "", body)
        meta = dict(re.findall(r"(\w+)\s*=\s*\"([^\"]*)\"", body.partition("strings:")[0]))
        said, _, condition = body.partition("strings:")[2].partition("condition:")
        strings = {}
        for key, plain, pattern, flags, mods in STRING.findall(said):
            expression = pattern.replace(r"\/", "/") if pattern else re.escape(plain.encode().decode("unicode_escape"))
            if "fullword" in mods:
                expression = rf"\b(?:{expression})\b"
            strings[key] = (expression, "nocase" in mods or "i" in flags)
        out.append(Signature(name, meta.get("severity", "medium"), meta.get("confidence", "medium"), strings, condition.strip() or "any of them"))
    return out


def loops_over_groups(pattern: str) -> bool:
    """Whether a pattern repeats something of varying length without a small bound, or isn't one that Python reads (so that it can't be told)."""

    def walk(nodes) -> bool:
        for kind, value in nodes:
            name = str(kind)
            if name in ("MAX_REPEAT", "MIN_REPEAT"):
                _, most, inner = value
                least, longest = inner.getwidth()
                if most > 100 and (least != longest or len(inner) and str(inner[0][0]) in ("BRANCH", "SUBPATTERN") and any(str(k) == "BRANCH" for k, _ in flat(inner))) or walk(inner):
                    return True
            elif any(walk(x) for x in parts(kind, value)):
                return True
        return False

    def parts(kind, value) -> list:
        name = str(kind)
        if name == "BRANCH":
            return value[1]
        return [value[-1]] if name in ("SUBPATTERN", "ASSERT", "ASSERT_NOT", "ATOMIC_GROUP") and value[-1] is not None else []

    def flat(nodes):
        for kind, value in nodes:
            yield kind, value
            for some in parts(kind, value):
                yield from flat(some)

    try:
        return walk(re._parser.parse(pattern))
    except re.error:
        return False


def needed(pattern: str) -> tuple[str, ...]:
    """Texts of which a match holds one: the longest run of fixed characters of a pattern, or one of each branch. None if there is no such run of two, or it can't be told."""

    def best(nodes) -> tuple[str, ...]:
        found, run = [], ""
        for kind, value in nodes:
            name = str(kind)
            if name == "LITERAL":
                run += chr(value)
                continue
            found, run = [*found, (run,)], ""
            if name == "BRANCH":
                found.append(tuple(y for x in every for y in x) if all(every := [best(x) for x in value[1]]) else ())
            elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
                found.append(best(value[-1] if name == "SUBPATTERN" else value))
            elif name.endswith("_REPEAT") and value[0]:
                found.append(best(value[2]))
        found.append((run,))
        return max((x for x in found if x and len(x) <= MOST_TEXTS and min(map(len, x)) > 1), key=lambda x: min(map(len, x)), default=())

    try:
        return () if r"\v" in pattern else best(re._parser.parse(pattern))
    except re.error:
        return ()


def searched(content: Column, low: Column, pattern: str, any_case: bool) -> Column:
    """Whether a content has a match: what it needs is searched by bytes before the pattern is tried, and is all there is to a plain text. `low` is the content in small letters."""
    tried = content.rlike(("(?i)" if any_case else "") + pattern)
    folded, texts = any_case or re.search(r"\(\?[a-z]*i", pattern) is not None, needed(pattern)
    if not texts:
        return tried
    held = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x.lower())) if folded else F.contains(content, F.lit(x)) for x in dict.fromkeys(texts)))
    return held if pattern == re.escape(texts[0]) and texts[0].isascii() else held & tried


def matched(content: Column, patterns: tuple[tuple[str, bool], ...]) -> Column:
    """An array of booleans: which of the patterns a content holds, found by Python."""
    @F.pandas_udf("array<boolean>")
    def run(data: pd.Series) -> pd.Series:
        compiled = [re.compile(p.encode("latin-1"), re.I if any_case else 0) for p, any_case in patterns]
        return pd.Series([[x.search(bytes(d)) is not None for x in compiled] if d is not None else None for d in data])

    return run(content)


class Compiler:
    """A recursive descent over a condition. `known` holds columns of patterns that were matched before."""

    def __init__(self, signature: Signature, content: Column, size: Column, path: Column, known: dict | None = None):
        self.signature, self.size, self.path = signature, size, path
        self.columns = {k: found if (found := (known or {}).get(x)) is not None else content.rlike(("(?i)" if x[1] else "") + x[0]) for k, x in signature.strings.items()}
        self.tokens = TOKEN.findall(signature.condition)
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def column(self) -> Column:
        out = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"{self.signature.name}: can't read the condition from {self.peek()}")
        return F.coalesce(out, F.lit(False))

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.peek() == "and":
            self.take()
            out = out & self.one()
        return out

    def chosen(self) -> list[Column]:
        if self.peek() == "them":
            self.take()
            return list(self.columns.values())
        self.take()
        out = []
        while (token := self.take()) != ")":
            if token != ",":
                key = token.strip("$*")
                out += [c for k, c in self.columns.items() if (k.startswith(key) if token.endswith("*") else k == key)]
        return out

    def one(self) -> Column:
        token = self.take()
        if token == "not":
            return ~self.one()
        if token == "(":
            out = self.either()
            self.take()
            return out
        if token.startswith("$"):
            return self.columns[token[1:]]
        if token == "filesize":
            sign, told = self.take(), self.take()
            limit = int(told.rstrip("KMB")) * {"K": 1 << 10, "M": 1 << 20}.get(told.rstrip("B")[-1], 1)
            return {"<": self.size < limit, "<=": self.size <= limit, ">": self.size > limit, ">=": self.size >= limit}[sign]
        if token == "filename":
            self.take()
            pattern = self.take()
            return F.substring_index(self.path, "/", -1).rlike(("(?i)" if pattern.endswith("i") else "") + pattern.rstrip("i").strip("/"))
        if token in ("any", "all") or token.isdigit():
            self.take()
            some = self.chosen()
            least = {"any": 1, "all": len(some)}.get(token) or int(token)
            return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(False)).cast("int") for c in some), F.lit(0)) >= least
        raise ValueError(f"{self.signature.name}: unknown {token}")


MEDIA = r"(?i)\.(?:png|jpe?g|gif|webp|ico|svg|woff2?|ttf|otf|eot|mp[34]|wav|ogg|webm|pdf)$"


def signature_findings(files: DataFrame, signatures: list[Signature | Threshold], most_bytes: int = 5 << 20) -> DataFrame:
    """(scan_id, rule_id, category, severity, confidence, file, evidence) of rows (scan_id, path, content)."""
    some = files.where(~F.col("path").rlike(MEDIA) & (F.octet_length("content") <= most_bytes))
    patterns = {x for s in signatures for x in s.strings.values()}
    slow = tuple(sorted(x for x in patterns if loops_over_groups(x[0])))
    if slow:
        some = some.withColumn("_matched", matched(F.col("content"), slow))
    # Decoded once: the optimizer doesn't copy columns of several uses into them.
    some = some.withColumns({"_text": F.decode("content", "ISO-8859-1"), "_size": F.octet_length("content")}).withColumn("_low", F.lower("_text"))
    content, size = F.col("_text"), F.col("_size")
    known = {x: searched(content, F.col("_low"), *x) for x in patterns} | {x: F.col("_matched")[k] for k, x in enumerate(slow)}
    hits = [
        F.when(
            s.column(content, size, F.col("path"), known) if isinstance(s, Threshold) else Compiler(s, content, size, F.col("path"), known).column(),
            F.struct(F.lit(f"yara.{s.name}").alias("rule_id"), F.lit(s.severity).alias("severity"), F.lit(s.confidence).alias("confidence"), F.lit(", ".join(list(s.strings)[:3])).alias("evidence")),
        )
        for s in signatures
    ]
    told = some.select("scan_id", F.col("path").alias("file"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x"))
    return told.select("scan_id", "x.rule_id", F.lit("yara").alias("category"), "x.severity", "x.confidence", "file", "x.evidence")


#: The signatures that come with the engine; directories of others are read by read() or parse().
BUILT_IN = SIGNATURES


def read(spark: SparkSession, path: str) -> list[Signature]:
    """Signatures of a directory of rule files, in the order of their names. Rule files are small; they are read whole."""
    rows = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("name")).collect()
    return [x for row in sorted(rows, key=lambda r: r.name) for x in parse(row.value)]
