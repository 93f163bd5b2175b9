"""Packed columns: what many small records of a task become before they travel, one row for each part they go to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from vigilake.llm.common import raw, small_batches


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length."""
    return len(columns[0]).to_bytes(4, "little") + zstandard.compress(b"".join(x.tobytes() for x in columns), 1)


def unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    n, body = int.from_bytes(data[:4], "little"), zstandard.decompress(data[4:])
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and the indices of its records."""
    order = np.argsort(part, kind="stable")
    where, edges = np.unique(part[order], return_index=True)
    for p, i, j in zip(where.tolist(), edges, [*edges[1:], len(order)], strict=True):
        yield p, order[i:j]


def parts_of(df: DataFrame, column: str, part_bytes: int, least: int) -> int:
    """A number of parts that follows the bytes of all texts."""
    n_bytes = df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return int(max(least, 1 + n_bytes // part_bytes))


def packed_text(df: DataFrame, column: str = "text") -> DataFrame:
    """The same rows with their texts compressed, for shuffles. Null becomes empty."""
    small_batches(df.sparkSession)
    schema = StructType([StructField(x.name, BinaryType()) if x.name == column else x for x in df.schema.fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            k = batch.schema.get_field_index(column)
            data = pa.array([packer.compress(x or b"") for x in raw(batch.column(k))], pa.binary())
            yield batch.set_column(k, pa.field(column, pa.binary()), data)

    return df.mapInArrow(go, schema)


def groups(order_keys: np.ndarray) -> np.ndarray:
    """Where groups start, over keys that are sorted."""
    return np.flatnonzero(np.concatenate(([True], order_keys[1:] != order_keys[:-1])))
