"""What the corpus operators share: reading tables, Arrow batches of texts, shared checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.checkpoints import shared_checkpoint  # noqa: F401

#: Memo tables on workers are emptied beyond so many entries; this bounds memory and changes no result.
MEMO_ENTRIES = 200_000
#: Rows of a batch that are unpacked at a time.
AT_A_TIME = 500
#: Rows of a batch between Spark and a worker, where the session sets none: Spark's own 10,000 texts would be held on both sides, whatever their length.
BATCH_ROWS = 1000
#: Longer pieces of text are not memoised.
MEMO_BYTES = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of a batch by BATCH_ROWS, unless the session sets a bound itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def slim(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The id and the text alone, and columns to carry along, under names of ours, so that other columns can't clash."""
    small_batches(df.sparkSession)
    more = (F.col(f"`{name}`").alias(f"carry_{k}") for k, name in enumerate(carry))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def unslim(df: DataFrame, id_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The id and carried columns under their own names again; carried ones come last, and the id is left out if it is carried itself."""
    made = [F.col("id").alias(id_col)] if id_col not in carry else []
    made += [F.col(name) for name in df.columns if name != "id" and not name.startswith("carry_")]
    return df.select(*made, *(F.col(f"carry_{k}").alias(name) for k, name in enumerate(carry)))


def with_carried(schema: str, df: DataFrame) -> str:
    return ",".join([schema, *(f"{x.name} {x.dataType.simpleString()}" for x in df.schema.fields if x.name.startswith("carry_"))])


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[bytes], tuple]]) -> DataFrame:
    """A row for each row of slim(): its id, and what a function makes of its bytes (none if null).

    make() runs once in each task and returns that function; the schema names the id first. Carried columns follow.
    """
    kinds = to_arrow(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in (whole.slice(k, AT_A_TIME) for whole in batches for k in range(0, whole.num_rows, AT_A_TIME)):
            if batch.num_rows:
                made = zip(*(one(data or b"") for data in raw(batch.column(1))), strict=True)
                arrays = [batch.column(0), *(pa.array(list(x), kind.type) for x, kind in zip(made, list(kinds)[1:], strict=True)), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kinds.names, *batch.schema.names[2:]])

    return df.mapInArrow(rows, with_carried(schema, df))


def to_arrow(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(),
        "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(","))])
