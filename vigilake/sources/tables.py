"""Reading and writing the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of Parquet files; columns that were added later are null in older files."""
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")


def without_nul(df: DataFrame) -> DataFrame:
    """Texts without U+0000, also within arrays and maps of texts."""
    clean = lambda c: F.replace(c, F.lit("\x00"), F.lit(""))
    changes = {}
    for x in df.schema.fields:
        if isinstance(x.dataType, StringType):
            changes[x.name] = clean(F.col(f"`{x.name}`"))
        elif isinstance(x.dataType, ArrayType) and isinstance(x.dataType.elementType, StringType):
            changes[x.name] = F.transform(f"`{x.name}`", clean)
        elif isinstance(x.dataType, MapType) and isinstance(x.dataType.valueType, StringType):
            changes[x.name] = F.transform_values(f"`{x.name}`", lambda _, v: clean(v))
    return df.withColumns(changes) if changes else df


def upserted(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Old and new rows, of each key the latest; of equal times the new one. One writer, so a rewrite stands for an update."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_new"))
    return both.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place", "_new")


def write_table(df: DataFrame, root: str, name: str, partition: tuple[str, ...] = ("ecosystem",)) -> None:
    have = [x for x in partition if x in df.columns]
    without_nul(df).write.mode("overwrite").partitionBy(*have).parquet(f"{root}/{name}")
