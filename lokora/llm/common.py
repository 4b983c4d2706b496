"""Helpers shared by the operators: exact column picking, staging, file systems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokora.session import stage_path, tune

# Rows a Python worker gets at once: bounds its memory when texts are long.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: those of the library, and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns alone, found by their exact names.

    Other columns may repeat a name or differ from one only by case; of several
    columns with the same name the first counts.
    """
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    wanted = {**{n: n for n in names}, **renamed}
    return plain.select(*[F.col(f"_c{df.columns.index(old)}").alias(new) for new, old in wanted.items()])


class Rows:
    """All columns of a table under plain names, to be restored by position at the end."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.plain = [f"_c{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.plain)

    def of(self, name: str) -> str:
        return self.plain[self.names.index(name)]

    def restore(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(*self.plain, *more).toDF(*self.names, *more)


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it outlives lost executors."""
    path = stage_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``stage``, as a table bucketed by ``key``: joins on it move only the other side."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    table = f"{name}_{path[-32:]}"
    n = partitions(spark)
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str | None]:
    """Values one by one, so that a batch is not held twice as Python strings."""
    for value in column:
        yield value.as_py()


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's signed longs."""
    return values.view(np.int64)


def mix(values: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: every input bit reaches every output bit."""
    z = values.copy()
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z
