"""Ordered computations that never put one group, or the whole table, in one task.

Three tools:

* ``dense_positions`` numbers the rows of each group in order.  A group is cut
  into chunks of bounded size by its own position column; rows are numbered
  inside a chunk and shifted by the running total of the chunk table.
* ``hash_partition`` hands out exact-size random samples.  Rows are counted by
  hash prefix, the cut falls inside one prefix, and only that prefix is ranked.
* ``global_index`` and ``global_prefix_sum`` give global running values over a
  range-partitioned sort that is written once before it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokora.session import stage_table

CHUNK_ROWS = 65_536
# Five hex digits: the count table has at most 16**5 rows, whatever the input.
SAMPLE_PREFIX = 5
# Three hex digits: at most 4096 buckets, small enough to broadcast always.
GROUP_PREFIX = 3


def seeded_hash(seed: int | str, *key: Column) -> Column:
    """``md5(seed|key|key…)``: a seeded order that any SQL engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def dense_positions(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    index: str = "idx",
    total: str = "n_rows",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add a gap-free 0-based ``index`` and the group size ``total``.

    ``order`` is a non-negative integer column, unique within the group.
    """
    group = list(group)
    keys = [*group, "_chunk"]
    rows = df.withColumn("_chunk", F.expr(f"`{order}` div {chunk_rows}"))
    in_group = Window.partitionBy(*group)
    before = in_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(
            *keys,
            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_before"),
            F.sum("_cnt").over(in_group).alias(total),
        )
    )
    in_chunk = Window.partitionBy(*keys).orderBy(order)
    return (
        rows.withColumn("_rank", F.row_number().over(in_chunk).cast("bigint"))
        .join(chunks, keys)
        .withColumn(index, F.col("_before") + F.col("_rank") - 1)
        .drop("_chunk", "_rank", "_before")
    )


def hash_partition(
    df: DataFrame,
    sizes: Sequence[Column | int],
    seed: int | str,
    key: Sequence[str],
    out: str = "part",
    prefix: int = SAMPLE_PREFIX,
) -> DataFrame:
    """Number each row by the exact-size random part it falls into.

    In the order of a seeded hash of ``key`` (a unique row key) the first
    ``sizes[0]`` rows form part 0, the next ``sizes[1]`` rows part 1, and so on;
    the rest get null.  A size is a number or a scalar-subquery column.

    The counting pass runs here, once, over the key columns; where the cuts fall
    is kept as a one-row table.  After that a row's part is decided in place,
    but for the rows of the few prefixes that hold a cut.
    """
    cols = df.columns
    hashed = df.withColumn("_hash", seeded_hash(seed, *[F.col(k) for k in key])).withColumn(
        "_bucket", F.substring("_hash", 1, prefix)
    )
    ends = []
    for size in sizes:
        size = size if isinstance(size, Column) else F.lit(size)
        ends.append(size.cast("bigint") + (ends[-1] if ends else F.lit(0)))

    # At most 16**prefix rows reach this window.
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .withColumn("_upto", F.sum("_cnt").over(running))
    )
    # The bucket each cut falls into: buckets before it are taken whole.
    cuts = buckets.agg(
        *[F.min(F.when(F.col("_upto") >= end, F.col("_bucket"))).alias(f"c{i}") for i, end in enumerate(ends)],
        *[
            F.max(F.when(F.col("_upto") < end, F.col("_upto"))).alias(f"b{i}")
            for i, end in enumerate(ends)
        ],
        *[F.first(end).alias(f"e{i}") for i, end in enumerate(ends)],
    )
    cut = stage_table(cuts, "sample-cuts").select(F.struct("*")).scalar()
    n = range(len(ends))
    is_cut = F.lit(False)
    for i in n:
        is_cut = is_cut | F.coalesce(F.col("_bucket") == cut[f"c{i}"], F.lit(False))

    # A cut that is past the end leaves c{i} null: everything is inside.
    whole = F.lit(None).cast("int")
    ranked = F.lit(None).cast("int")
    for i in reversed(n):
        inside = F.coalesce(F.col("_bucket") < cut[f"c{i}"], F.lit(True))
        whole = F.when(inside, F.lit(i)).otherwise(whole)
        at_cut = F.coalesce(F.col("_bucket") == cut[f"c{i}"], F.lit(False))
        taken = F.when(at_cut, F.col("_rank") + F.coalesce(cut[f"b{i}"], F.lit(0)) <= cut[f"e{i}"]).otherwise(inside)
        ranked = F.when(taken, F.lit(i)).otherwise(ranked)
    in_bucket = Window.partitionBy("_bucket").orderBy("_hash", *key)
    outside = hashed.filter(~is_cut).withColumn(out, whole)
    at_cut = (
        hashed.filter(is_cut)
        .withColumn("_rank", F.row_number().over(in_bucket))
        .withColumn(out, ranked)
    )
    return outside.select(*cols, out).unionByName(at_cut.select(*cols, out))


def group_running_sum(
    groups: DataFrame, value: str, order_hash: str, tie: str, out: str = "cum"
) -> DataFrame:
    """Inclusive running sum of ``value`` over a group table in hash order.

    The hash spreads groups evenly over prefixes; the prefix totals are a table
    of at most 4096 rows, which is what gets broadcast.
    """
    bucketed = groups.withColumn("_bucket", F.substring(order_hash, 1, GROUP_PREFIX))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.sum(value).alias("_sum"))
        .select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy("_bucket")
        .orderBy(order_hash, tie)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        bucketed.withColumn("_within", F.sum(value).over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_within", "_before")
    )


def _range_sorted(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Range-sorted rows with partition number and row number, written once.

    The range bounds come from sampling, so a second evaluation could cut
    elsewhere.  Writing the numbered rows fixes them for every later read.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return stage_table(numbered, name)


def _partition_offsets(staged: DataFrame, total: Column) -> DataFrame:
    # One row per shuffle partition.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        staged.groupBy("_pid")
        .agg(total.alias("_sum"))
        .select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )


def global_index(df: DataFrame, order: Sequence[str | Column], index: str = "row_id") -> DataFrame:
    """Add a gap-free 0-based number in the global order of ``order``."""
    staged = _range_sorted(df, order, "global-index")
    offsets = _partition_offsets(staged, F.count(F.lit(1)))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (
        staged.join(F.broadcast(offsets), "_pid")
        .withColumn(index, F.col("_before") + local)
        .drop("_pid", "_mid", "_before")
    )


def global_prefix_sum(
    df: DataFrame, order: Sequence[str | Column], value: str, out: str = "offset"
) -> DataFrame:
    """Add the exclusive running sum of ``value`` in the global order."""
    staged = _range_sorted(df, order, "prefix-sum")
    offsets = _partition_offsets(staged, F.sum(value))
    before = (
        Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        staged.withColumn("_within", F.coalesce(F.sum(value).over(before), F.lit(0)))
        .join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_pid", "_mid", "_before", "_within")
    )
