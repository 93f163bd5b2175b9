"""Functions of source files, as segments with hashes: by the syntax tree of Python, by braces elsewhere. Sources are parsed, never run."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.fuzzy import ctph_hash, tlsh_hash

# Fixed value: how a function is declared in languages with braces.
DECLARED = re.compile(
    r"(?m)^[ \t]*(?:export\s+|async\s+|pub\s+|public\s+|private\s+|static\s+)*"
    r"(?:function\s+(?P<f>\w+)|func\s+(?:\([^)]*\)\s*)?(?P<g>\w+)|fn\s+(?P<r>\w+)"
    r"|(?P<j>\w+)\s*(?:=\s*(?:async\s*)?\([^)]*\)\s*=>|\([^)]*\)\s*\{))"
)
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: Where statements hold others.
HOLDERS = ("body", "cases", "handlers", "orelse", "finalbody")
#: A batch of segments is handed on when it has so many rows or bytes: one for each file would cost more than the files.
MOST_ROWS, MOST_BYTES = 2_000, 4 << 20
Segment = tuple[str | None, str, int | None, int | None, bytes | None]


def by_tree(text: str) -> Iterator[Segment]:
    """(name, kind, first line, last line, segment) of each function and class; one row of the kind "unparsed" if Python can't read the text."""
    data = text.encode("utf-8", "surrogatepass")
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield None, "unparsed", None, None, None
        return
    starts = None
    todo = [tree]
    for node in todo:
        if isinstance(node, DEFINITIONS):
            starts = starts or [0, *accumulate(map(len, re.findall(rb"[^\r\n]*(?:\r\n|\r|\n)", data)))]
            first, last = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
            yield node.name, type(node).__name__, node.lineno, node.end_lineno, data[first:last]
        for held in HOLDERS:  # definitions are statements, so expressions needn't be walked
            todo += getattr(node, held, None) or ()


def by_braces(text: str) -> Iterator[Segment]:
    """The same of declarations and the block that follows each; a block that isn't closed reaches to the end."""
    opened, closing, waiting = [], {}, []
    for found in re.finditer("[{}]", text):
        if found.group() == "{":
            opened.append(found.start())
            waiting.append(found.start())
        elif waiting:
            closing[waiting.pop()] = found.start()
    breaks = [x.start() for x in re.finditer("\n", text)]
    for found in DECLARED.finditer(text):
        k = bisect_left(opened, found.start())
        if k < len(opened):
            end = closing.get(opened[k], len(text))
            name = next(x for x in found.groups() if x)
            yield name, "func", bisect_left(breaks, found.start()) + 1, bisect_left(breaks, end) + 1, text[found.start() : end + 1].encode("utf-8", "surrogatepass")


NAMES = ("scan_id", "path", "name", "kind", "line", "end_line", "segment")
KINDS = pa.schema(list(zip(NAMES, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)))


def segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of files, batches (scan_id, path, text), in batches of their own size."""
    made, size = [], 0

    def taken() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(NAMES, zip(*made, strict=True), strict=True)), schema=KINDS)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for batch in batches:
            for scan, path, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for found in (by_tree if (path or "").endswith(".py") else by_braces)(text or ""):
                    made.append((scan, path, *found))
                    size += len(found[-1] or b"")
                    if len(made) >= MOST_ROWS or size >= MOST_BYTES:
                        yield taken()
                        made, size = [], 0
    if made:
        yield taken()


def function_segments(files: DataFrame) -> DataFrame:
    """(scan_id, path, name, kind, line, end_line, sha256, size, ssdeep, tlsh) of rows (scan_id, path, text); a null text has no functions."""
    found = files.select(F.col("scan_id").cast("long"), "path", "text").mapInArrow(segments_of, "scan_id long, path string, name string, kind string, line long, end_line long, segment binary")
    return found.select(*NAMES[:-1], F.sha2("segment", 256).alias("sha256"), F.octet_length("segment").alias("size"), ctph_hash("segment").alias("ssdeep"), tlsh_hash("segment").alias("tlsh"))
