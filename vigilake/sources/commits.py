"""Tables of numbered commits: a sink that publishes only what was decided on the table's newest state.

A table is a folder: `parts/` holds Parquet files, `log/` one small file for each commit, named by its number, which lists the parts that the commit adds and says whether
they replace what was there. A reader takes the log first, so what no commit lists isn't there: parts of a job that failed or was killed are never seen.

The sink `vigilake_commits` is told the version on which its rows were decided. Its tasks write parts; then the log entry of the next number is created, which only one writer can do:
it fails if the entry is there already. Who fails lost the race, removes its parts, reads again and decides again (`attempted`). That is compare-and-set for any change of a table.

Entries are created by linking a finished file, on file systems that machines mount, and by a move that doesn't replace, on others that pyarrow knows and that refuse it (HDFS).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, LOST = "vigilake_commits", "COMMIT_LOST"
PART_ROWS = 100_000


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _entry(folder: str, version: int) -> str:
    return f"{folder}/log/{version:020d}.json"


def _publish(files: fs.FileSystem, path: str, data: bytes) -> bool:
    """Create a file with its whole content, unless it is there already; whether it was created."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as out:
        out.write(data)
    try:
        if isinstance(files, fs.LocalFileSystem):
            os.link(draft, path)
        else:
            if files.get_file_info(path).type != fs.FileType.NotFound:
                return False
            files.move(draft, path)
            return True
    except OSError:  # FileExistsError here, a refused move there
        return False
    files.delete_file(draft)
    return True


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]
    rows: int


class CommitWriter(DataSourceArrowWriter):
    def __init__(self, root: str, base: int, replace: bool, note: str) -> None:
        self.root, self.base, self.replace, self.note = root, base, replace, note

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for about PART_ROWS rows; the name carries the version that it will belong to, and no two attempts share one."""
        files, folder = _opened(self.root)
        files.create_dir(f"{folder}/parts", recursive=True)
        paths, rows, out, held = [], 0, None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None or held >= PART_ROWS:
                if out is not None:
                    out.close()
                paths.append(f"v{self.base + 1:020d}-{uuid.uuid4().hex}.parquet")
                out, held = pq.ParquetWriter(f"{folder}/parts/{paths[-1]}", batch.schema, filesystem=files), 0
            out.write_batch(batch)
            rows, held = rows + batch.num_rows, held + batch.num_rows
        if out is not None:
            out.close()
        return Written(paths, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self.root)
        files.create_dir(f"{folder}/log", recursive=True)
        done = [x for x in messages if x is not None]
        entry = {"version": self.base + 1, "parts": [p for x in done for p in x.paths], "rows": sum(x.rows for x in done), "replace": self.replace, "note": self.note}
        if not _publish(files, _entry(folder, self.base + 1), json.dumps(entry).encode()):
            self.abort(messages)
            raise PySparkException(f"{LOST}: version {self.base + 1} of {self.root} was published by another writer")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self.root)
        for path in (p for x in messages if x is not None for p in x.paths):
            if files.get_file_info(f"{folder}/parts/{path}").type == fs.FileType.File:
                files.delete_file(f"{folder}/parts/{path}")


class CommitSource(DataSource):
    """Options: path, base (the version that the rows were decided on, -1 for none), note."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CommitWriter:
        return CommitWriter(self.options["path"], int(self.options["base"]), overwrite, self.options.get("note", ""))


def log(root: str) -> list[dict]:
    """The commits, oldest first. Numbers have no gaps, as each is created on the one before."""
    files, folder = _opened(root)
    found = files.get_file_info(fs.FileSelector(f"{folder}/log", allow_not_found=True))
    out = []
    for info in sorted((x for x in found if x.path.endswith(".json")), key=lambda x: x.path):
        with files.open_input_stream(info.path) as data:
            out.append(json.loads(data.read()))
    return out


def version(root: str) -> int:
    """The newest version, -1 if there is none."""
    return max((x["version"] for x in log(root)), default=-1)


def read(spark: SparkSession, root: str, schema: StructType | str, at: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named, with `_version`, the commit that each row came with. Read by Spark's own reader, so filters and columns are pushed down."""
    parts: list[str] = []
    for entry in log(root):
        if at is None or entry["version"] <= at:
            parts = [*([] if entry["replace"] else parts), *entry["parts"]]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("_version", F.lit(0).cast("long"))
    told = spark.read.schema(schema).parquet(*(f"{root.rstrip('/')}/parts/{x}" for x in parts))
    return told.withColumn("_version", F.regexp_extract(F.col("_metadata.file_name"), r"^v(\d+)-", 1).cast("long"))


def current(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the newest commit: the state of a table to which changes are appended. An aggregation, combined before the shuffle."""
    rest = [x for x in rows.columns if x not in keys and x != "_version"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("_x")).select(*keys, *(F.col(f"_x.{x}") for x in rest))


def write(df: DataFrame, root: str, base: int, replace: bool = False, note: str = "") -> None:
    """Publish rows as the version after `base`; raises if another writer did so first."""
    df.sparkSession.dataSource.register(CommitSource)
    df.sparkSession.createDataFrame([], "x int")  # makes the session the active one of this thread, where Spark looks for the sink
    df.write.format(FORMAT).option("path", root).option("base", base).option("note", note).mode("overwrite" if replace else "append").save()


def lost(error: BaseException) -> bool:
    """Whether an error of write() says that another writer was first; it comes from the sink through Spark, as a cause of a failed job."""
    if LOST in str(error):
        return True
    cause = getattr(error, "java_exception", None)
    while cause is not None:
        if LOST in (cause.toString() or ""):
            return True
        cause = cause.getCause()
    return False


def attempted(root: str, decide: Callable[[int], DataFrame], tries: int = 5, note: str = "") -> int:
    """Decide on the newest version and publish; whoever loses decides again on what is newest then. The version that was published.

    decide(version) gives the rows to append. Other errors than a lost race aren't tried again.
    """
    for left in range(tries - 1, -1, -1):
        base = version(root)
        try:
            write(decide(base), root, base, note=note)
            return base + 1
        except Exception as error:
            if not lost(error) or not left:
                raise
    raise AssertionError


def compact(spark: SparkSession, root: str, schema: StructType | str, *keys: str) -> int:
    """Replace all commits so far by one that has the current row of each key; a claim meanwhile makes it fail, and it is tried again."""
    for _ in range(5):
        base = version(root)
        try:
            write(current(read(spark, root, schema, base), *keys), root, base, replace=True, note="compact")
            return base + 1
        except Exception as error:
            if not lost(error):
                raise
    raise RuntimeError(f"{root} changes too often to be compacted")


def swept(root: str, keep: int = 1) -> int:
    """Delete parts that no commit from the newest `keep` versions on can see, among them those of killed writers; the number of files. Not while writers are at work."""
    files, folder = _opened(root)
    entries = log(root)
    seen: set[str] = set()
    for at in {x["version"] for x in entries[-keep:]}:
        parts: list[str] = []
        for entry in entries:
            if entry["version"] <= at:
                parts = [*([] if entry["replace"] else parts), *entry["parts"]]
        seen |= set(parts)
    old = [x.path for x in files.get_file_info(fs.FileSelector(f"{folder}/parts", allow_not_found=True)) if x.base_name not in seen]
    for path in old:
        files.delete_file(path)
    return len(old)
