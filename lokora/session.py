"""Session settings and stage tables shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the jobs rely on.  They are safe to set on a session
# that somebody else created: none of them is a static setting.
RUNTIME_CONF = {
    # AQE re-plans joins from measured sizes: it broadcasts a side only when its
    # shuffled size is under the threshold, and it splits hot join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Driver-written parquet may carry NTZ timestamps; keep them that way.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
# Set by whoever runs a small file on many cores; never decided from the data.
SCAN_PARTITIONS = "spark.lokora.scanPartitions"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    # The stock 200 shuffle partitions only make sense on a cluster.
    if context.master.startswith("local") and spark.conf.get(SHUFFLE_PARTITIONS) == "200":
        spark.conf.set(SHUFFLE_PARTITIONS, str(context.defaultParallelism))
    return spark


def local_session(
    cores: str = "8", app: str = "lokora", partitions: int | None = None, java_options: str = ""
) -> SparkSession:
    """A local session for tests and the benchmark."""
    if partitions is None:
        partitions = int(cores) if cores.isdigit() else 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.extraJavaOptions", java_options)
        .config(SHUFFLE_PARTITIONS, str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The shared folder for stage tables: ``spark.checkpoint.dir``.

    On a cluster the folder must be named by the session.  Only a local session
    may fall back to a fresh temporary folder, the same one as long as it runs.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    # The setting itself cannot be changed while a session runs.
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="lokora-")
    return _local_roots[app]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the stage root."""
    return f"{stage_root(spark)}/lokora/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it read back.

    Used where several branches read one expensive intermediate result.  Unlike
    a cache the table survives lost executors, and unlike an RDD checkpoint the
    readers still prune columns, push filters and see real table sizes.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_bytes: int) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` has at most ``max_bytes``.

    Otherwise the frame is returned as it is, and the join shuffles.
    """
    # A field takes a word of a row, and a text its bytes beside it.
    size = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
    measured = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if measured <= max_bytes else df


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Place rows by key over all shuffle partitions, for work that is heavy per row.

    The number is given, so AQE does not merge the partitions by their small size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def read_table(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """A Parquet table as it is scanned.

    Where the session sets ``SCAN_PARTITIONS``, rows are dealt anew by ``key`` to so
    many tasks: a single small file is one task otherwise.
    """
    rows = spark.read.parquet(path)
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return rows.repartition(int(wanted), *key) if wanted else rows
