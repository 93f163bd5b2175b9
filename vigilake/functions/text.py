"""Functions of names, texts and addresses, all built in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
# Addresses of cloud metadata, placeholders, public resolvers.
METADATA_IPS = ("169.254.169.254", "169.254.170.2")
PLACEHOLDER_IPS = ("1.2.3.4", "4.3.2.1")
RESOLVERS = ("8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "149.112.112.112", "208.67.222.222", "208.67.220.220", "4.2.2.1", "4.2.2.2")
PRIVATE = r"^(?:127\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.|169\.254\.|255\.|224\.|240\.)"
DOCUMENTATION = r"^(?:192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)"


def ipv4_literals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IPV4), F.lit(0))


def ipv4_kind(ip: Column) -> Column:
    return (
        F.when(ip.isin(*METADATA_IPS), "metadata").when(ip.rlike(PRIVATE), "private").when(ip.rlike(DOCUMENTATION), "documentation")
        .when(ip.isin(*PLACEHOLDER_IPS), "placeholder").otherwise("routable")
    )


def char_entropy(text: str) -> Column:
    """Bits for each code point; 0 for an empty text. A histogram in Python over Arrow batches: built-in functions would make an array of single characters."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _bits(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)) for x in texts], dtype="float64")

    return run(F.col(text))


def _bits(points: np.ndarray) -> float:
    if not len(points):
        return 0.0
    counts = np.bincount(points) if points.max() < 0x3000 else np.unique(points, return_counts=True)[1]
    p = counts[counts > 0] / len(points)
    return float(-(p * np.log2(p)).sum()) + 0.0


def url_host(url: Column) -> Column:
    """The host of a URL: lower case, without user, port or a final dot."""
    rest = F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), "^.*@", ""), r":\d*$", ""), r"\.$", "")


def registrable(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def under_any(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def printable_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^\x20-\x7E\t\n\r]", "")) / F.length(text)).otherwise(0.0)


def defang(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?i)http(s?)://", "hxxp$1://"), r"(?<=[A-Za-z0-9])\.(?=[A-Za-z0-9])", "[.]")


def approximate(n: Column) -> Column:
    return F.when(n.isNotNull(), F.concat(F.lit("~"), F.format_number(n, 0)))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def is_doc_file(path: Column) -> Column:
    """Documentation by its suffix or the start of its base name."""
    names = "readme|notice|license|licence|copying|copyright|changelog|changes|history|authors|contributors|credits|thanks|security|support|code_of_conduct|code-of-conduct|governance|maintainers|contributing"
    return F.lower(F.substring_index(path, "/", -1)).rlike(rf"\.(?:md|rst)$|^(?:{names})")


def is_test_file(path: Column) -> Column:
    base = F.lower(F.substring_index(path, "/", -1))
    parts = F.array(*map(F.lit, ("test", "tests", "testdata", "testing", "__tests__", "__test__", "fixtures", "fixture", "spec", "specs", "e2e")))
    return base.rlike(r"_test\.go$|^test_.*\.py$|_test\.py$|^conftest\.py$|\.(?:test|spec)\.[cm]?[jt]sx?$") | F.arrays_overlap(F.split(F.lower(path), "/"), parts)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over whole texts."""
    import fnmatch

    return "^" + fnmatch.translate(pattern).removesuffix("\\Z").removesuffix("\\z") + "\\z"
