"""A registry's log of changes as a source, for batches and streams: the cursor of an ingester is the offset of a stream.

A log is a sequence of rows (seq, value); `value` is what the registry said, to be read by the functions of `feeds`. Numbers grow and may have gaps. Where the log comes from is
a Log's matter: `PageLog` reads pages of JSON lines in a folder, as a fetcher writes them; another class can be named by the option `log` ("module:Class").

As a stream, a batch starts after the offset that Spark's checkpoint holds and ends at most `most` rows further on, so a backlog is worked off in bounded polls; its rows are read by
tasks, a part of the range each. Spark writes a batch's range down before it reads it and reads the same range again after a failure, so nothing is lost or read twice. A new
query starts at the log's end (`start` = "now"), at its beginning ("earliest"), or after a given number.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyarrow import json as pajson
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vigilake.sources.commits import _opened

FORMAT, SCHEMA = "vigilake_changes", "seq long, value string"
#: Rows of a poll, as the registries' cursors read them.
MOST = 2000
_ROWS = pa.schema([("seq", pa.int64()), ("value", pa.string())])


class PageLog:
    """Pages `page=<first number>` of a folder; a page holds the numbers up to the next page's first, in any order and any number of files."""

    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.folder = _opened(options["path"])

    def _pages(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(x.base_name.removeprefix("page=")) for x in found if x.base_name.startswith("page="))

    def _page(self, page: int, start: int, end: int) -> pa.Table:
        """Rows of a page with start < seq <= end, in order."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.folder}/page={page}", allow_not_found=True))
        parts = []
        for x in sorted(x.path for x in found if x.path.endswith(".json") and x.size):
            with self.files.open_input_stream(x) as data:
                parts.append(pajson.read_json(data, parse_options=pajson.ParseOptions(explicit_schema=_ROWS, unexpected_field_behavior="ignore")))
        told = pa.concat_tables(parts) if parts else _ROWS.empty_table()
        return told.filter(pc.and_(pc.greater(told["seq"], start), pc.less_equal(told["seq"], end))).sort_by("seq")

    def ends(self) -> tuple[int, int]:
        """One before the first number, and the last one; (-1, -1) for an empty log. The newest page alone is read."""
        pages = self._pages()
        for page in reversed(pages):
            told = self._page(page, -1, 2**62)
            if told.num_rows:
                return pages[0] - 1, told["seq"][-1].as_py()
        return -1, -1

    def after(self, start: int, most: int) -> int:
        """The number of the row that is `most` rows after a number, or of the last; the number itself if there is none."""
        pages, left, end = self._pages(), most, start
        for k, page in enumerate(pages):
            if k + 1 < len(pages) and pages[k + 1] <= start + 1:
                continue
            told = self._page(page, start, 2**62)
            if told.num_rows:
                end = told["seq"][min(left, told.num_rows) - 1].as_py()
                left -= told.num_rows
            if left <= 0:
                break
        return end

    def ranges(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """(page, after, up to) of the pages that have a part of a range."""
        pages = self._pages()
        tops = [*(x - 1 for x in pages[1:]), 2**62]
        return [(page, max(start, page - 1), min(end, top)) for page, top in zip(pages, tops, strict=False) if page <= end and top > start]

    def rows(self, part: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
        yield from self._page(*part).to_batches(max_chunksize=10_000)


@dataclass
class Range(InputPartition):
    part: Any


def _log(options: dict[str, str]) -> Any:
    module, _, name = options.get("log", "").partition(":")
    return getattr(importlib.import_module(module), name)(options) if name else PageLog(options)


class ChangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        log = _log(self.options)
        first, last = log.ends()
        return [Range(x) for x in log.ranges(int(self.options.get("since", first)), min(last, int(self.options.get("until", last))))]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # what Spark hands over where there are no partitions
            yield from _log(self.options).rows(partition.part)


class ChangeStream(DataSourceStreamReader):
    """Where the query began (`first`) and the end of the last range that was planned (`planned`), both kept in the file of the option `cursor`.

    Spark asks a source where to go before it tells where it is, also after a restart. The file bounds polls: it is written before a range is given to Spark, so it is never behind
    the checkpoint, and at worst, after a crash in between, one batch has two polls' rows. Which rows are read is decided by the checkpoint alone. Without the option a
    query's first poll goes up to the log's end. A file that is taken away from under a checkpoint would turn the query back; it stops instead.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.log, self.first, self.planned = options, _log(options), None, None
        self.most = int(options.get("most", MOST))
        self.cursor = options.get("cursor")
        if self.cursor:
            files, path = _opened(self.cursor)
            if files.get_file_info(path).type == fs.FileType.File:
                with files.open_input_stream(path) as data:
                    self.first, self.planned = json.loads(data.read())

    def _begin(self) -> int:
        if self.first is None:
            start = self.options.get("start", "now")
            first, last = self.log.ends()
            self.first = last if start == "now" else first if start == "earliest" else int(start)
        return self.first

    def _plan(self, end: int) -> dict:
        self.planned = end
        if self.cursor:
            files, path = _opened(self.cursor)
            with files.open_output_stream(f"{path}.new") as out:
                out.write(json.dumps([self._begin(), end]).encode())
            files.move(f"{path}.new", path)
        return {"seq": end}

    def initialOffset(self) -> dict:
        return {"seq": self._begin()}

    def latestOffset(self) -> dict:
        begin = self._begin()
        if self.planned is None and not self.cursor:
            return self._plan(max(begin, self.log.ends()[1]))
        return self._plan(self.log.after(begin if self.planned is None else self.planned, self.most))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if end["seq"] < start["seq"]:
            raise ValueError(f"the checkpoint is at {start['seq']}, the cursor's file was lost: write [{start['seq']}, {start['seq']}] to {self.cursor}")
        if self.planned is None or self.planned < end["seq"]:
            self._plan(end["seq"])
        return [Range(x) for x in self.log.ranges(start["seq"], end["seq"])]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from self.log.rows(partition.part)

    def commit(self, end: dict) -> None:
        """Nothing to forget: the log is the registry's."""


class ChangeSource(DataSource):
    """Options: path, log; of a stream also start, most, cursor; of a batch since (excluded) and until (included)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> ChangeReader:
        return ChangeReader(dict(self.options))

    def streamReader(self, schema: Any) -> ChangeStream:
        return ChangeStream(dict(self.options))


def write_pages(rows: DataFrame, root: str, page: int = 1000) -> None:
    """Append rows (seq, value) to a folder as pages. Sequence numbers are dealt by page, so a page is few files."""
    first = (F.floor(F.col("seq") / page) * page).cast("long")
    rows.select("seq", "value", first.alias("page")).repartition("page").write.mode("append").partitionBy("page").json(root)


def changes(spark: SparkSession, root: str, **options: Any) -> DataFrame:
    """The rows of a log, as a batch."""
    spark.dataSource.register(ChangeSource)
    return spark.read.format(FORMAT).options(path=root, **options).load()


def change_stream(spark: SparkSession, root: str, **options: Any) -> DataFrame:
    """The rows of a log from a cursor on, as a stream."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format(FORMAT).options(path=root, **options).load()
