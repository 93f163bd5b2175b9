"""Members of package archives, read in memory: nothing is written to a disk and nothing is run."""

from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What broken, encrypted or unknown archives raise: passwords are RuntimeError, unknown compressions NotImplementedError.
UNREADABLE = (tarfile.TarError, zipfile.BadZipFile, ValueError, EOFError, OSError, RuntimeError, NotImplementedError, KeyError, zlib.error, lzma.LZMAError)
MOST_FILES, MOST_BYTES = 25_000, 500 << 20


def safe_name(name: str) -> str | None:
    """A relative path without steps upwards, or None for an absolute one."""
    if name.startswith(("/", "\\")) or len(name) > 1 and name[1] == ":":
        return None
    return "/".join(x for x in name.replace("\\", "/").split("/") if x not in ("", ".", "..")) or None


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular files of a tar or zip archive; links and devices are left out. Archives beyond the bounds are refused as a whole."""
    if name.lower().endswith((".zip", ".whl", ".egg")):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            entries = [x for x in archive.infolist() if not x.is_dir() and (x.external_attr >> 28) != 0xA]
            _check(len(entries), sum(x.file_size for x in entries))
            for x in entries:
                if path := safe_name(x.filename):
                    yield path, archive.read(x)
        return
    with tarfile.open(fileobj=io.BytesIO(data)) as archive:
        entries = [x for x in archive if x.isreg()]
        _check(len(entries), sum(x.size for x in entries))
        for x in entries:
            if path := safe_name(x.name):
                yield path, archive.extractfile(x).read()


def _check(files: int, size: int) -> None:
    if files > MOST_FILES or size > MOST_BYTES:
        raise ValueError("an archive beyond the bounds")


def extract(archives: DataFrame) -> DataFrame:
    """(archive, path, content, error) of rows (path, content) such as spark.read.format("binaryFile") gives. What can't be read is a row with an error."""
    import pyarrow as pa

    kinds = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def go(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    files = list(members(name, data or b""))  # bounded; an archive that breaks off midway gives no file
                except UNREADABLE as error:
                    files = ()
                    yield pa.RecordBatch.from_pylist([{"archive": name, "path": None, "content": None, "error": (str(error) or type(error).__name__)[:200]}], schema=kinds)
                for path, content in files:
                    yield pa.RecordBatch.from_pylist([{"archive": name, "path": path, "content": content, "error": None}], schema=kinds)

    return archives.select("path", "content").mapInArrow(go, "archive string, path string, content binary, error string")


def listing(archives: DataFrame) -> DataFrame:
    return extract(archives).where("error IS NULL").select("archive", "path")


def verified(downloads: DataFrame) -> DataFrame:
    """Downloads with `intact`: against an SRI sha512, else a sha256, else a sha1; none of them counts as not intact. Rows (content, integrity, sha256, sha1)."""
    sri = F.regexp_extract("integrity", r"sha512-([A-Za-z0-9+/=]+)", 1)
    good = (
        F.when(F.length(sri) > 0, F.sha2("content", 512) == F.lower(F.hex(F.unbase64(sri))))
        .when(F.col("sha256").isNotNull(), F.sha2("content", 256) == F.lower("sha256"))
        .when(F.col("sha1").isNotNull(), F.sha1("content") == F.lower("sha1"))
    )
    return downloads.withColumn("intact", F.coalesce(good, F.lit(False)))
