"""Signatures as thresholds: so many of these texts, patterns and further thresholds have to be found in a file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Found:
    """Something to look for: a regular expression, and whether case matters not."""

    expression: str
    any_case: bool = False


@dataclass(frozen=True)
class Some:
    least: int
    items: tuple[Found | Some, ...]


def text(value: str, any_case: bool = False, word: bool = False) -> Found:
    return Found(rf"\b(?:{re.escape(value)})\b" if word else re.escape(value), any_case)


def pattern(value: str, any_case: bool = False) -> Found:
    return Found(value, any_case)


def some(least: int, *items: Found | Some) -> Some:
    return Some(least, items)


def every(*items: Found | Some) -> Some:
    return Some(len(items), items)


def one_of(*items: Found | Some) -> Some:
    return Some(1, items)


@dataclass(frozen=True)
class Threshold:
    """A signature: what it needs, of files of a size (above < bytes < below) and name."""

    name: str
    severity: str
    confidence: str
    needs: Some
    above: int | None = None
    below: int | None = None
    file: str | None = None
    strings: dict[str, tuple[str, bool]] = field(init=False)

    def __post_init__(self) -> None:
        def flat(x: Found | Some) -> list[Found]:
            return [x] if isinstance(x, Found) else [y for item in x.items for y in flat(item)]

        object.__setattr__(self, "strings", {f"{k}": (x.expression, x.any_case) for k, x in enumerate(dict.fromkeys(flat(self.needs)))})

    def column(self, content: Column, size: Column, path: Column, known: dict[tuple[str, bool], Column]) -> Column:
        """Whether a file matches; `known` holds columns of patterns that were matched before."""

        def met(x: Found | Some) -> Column:
            if isinstance(x, Found):
                key = (x.expression, x.any_case)
                return F.coalesce(known[key] if key in known else content.rlike(("(?i)" if x.any_case else "") + x.expression), F.lit(False))
            if x.least in (1, len(x.items)):
                return reduce(lambda a, b: a | b if x.least == 1 else a & b, map(met, x.items))
            return reduce(lambda a, b: a + b, (met(y).cast("int") for y in x.items)) >= x.least

        out = met(self.needs)
        if self.file:
            out = F.substring_index(path, "/", -1).rlike(self.file) & out
        for bound, sign in ((self.above, size.__gt__), (self.below, size.__lt__)):
            if bound is not None:
                out = sign(bound) & out
        return F.coalesce(out, F.lit(False))


def as_sql(one: Threshold, content: str, path: str) -> str:
    """The same condition as an expression of DuckDB over a text."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def met(x: Found | Some) -> str:
        if isinstance(x, Found):
            return f"regexp_matches({content}, {quoted(x.expression)}, '{'i' if x.any_case else 'c'}')"
        if x.least in (1, len(x.items)):
            return "(" + (" OR " if x.least == 1 else " AND ").join(map(met, x.items)) + ")"
        return "(" + " + ".join(f"({met(y)})::INT" for y in x.items) + f" >= {x.least})"

    parts = [met(one.needs)]
    if one.file:
        parts.append(f"regexp_matches(regexp_extract({path}, '[^/]*$'), {quoted(one.file)})")
    if one.above is not None:
        parts.append(f"octet_length(encode({content})) > {one.above}")
    if one.below is not None:
        parts.append(f"octet_length(encode({content})) < {one.below}")
    return " AND ".join(parts)


def signature(name: str, severity: str, confidence: str, needs: Some, *, above: int | None = None, below: int | None = None, file: str | None = None) -> Threshold:
    return Threshold(name, severity, confidence, needs, above, below, file)
