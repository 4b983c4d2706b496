"""Held-out groups, exact-size samples, row selection and overlap removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.operators.ordering import (
    global_prefix_sum,
    group_running_sum,
    hash_partition,
    seeded_hash,
)

# --- Fixed values ----------------------------------------------------------
MIN_GROUP_ROWS = 100
MAX_GROUP_ROWS = 300
TRAIN_SPLIT = 0.9
HOLDOUT_SEED = 0
SAMPLE_SEED = 33
# ---------------------------------------------------------------------------

EVAL_SPLITS = ("unknown_valid", "unknown_test", "rnd_valid", "rnd_test")


def group_offsets(counts: DataFrame, group: str = "repo", value: str = "cnt") -> DataFrame:
    """First global position of each group when groups are laid out by name."""
    return global_prefix_sum(counts, [group], value, "offset")


def eval_size(total: Column, train_split: float) -> Column:
    """Rows outside the training share: ``total - int(train_split * total)``."""
    return total - (F.lit(train_split) * total.cast("double")).cast("bigint")


def holdout_groups(
    counts: DataFrame,
    train_split: float = TRAIN_SPLIT,
    seed: int = HOLDOUT_SEED,
    min_rows: int = MIN_GROUP_ROWS,
    max_rows: int = MAX_GROUP_ROWS,
    group: str = "repo",
    strict: bool = True,
    size: Column | int | None = None,
    order: Column | None = None,
) -> DataFrame:
    """Choose whole groups for the unknown-app test and validation sets.

    ``counts`` holds ``(group, cnt)``.  Groups with ``min_rows < cnt < max_rows``
    are visited in seeded order.  With ``cum`` their inclusive running size, T the
    evaluation size and k the first group whose ``cum`` reaches T/2:

    * test: groups with ``cum < T/2``;
    * validation: groups from k on with ``cum + cnt_k < T`` (k is counted twice,
      and the group that crosses a bound is given up).

    ``strict`` raises when no group reaches T/2, or when the groups run out
    before validation is full.  ``order`` replaces the seeded hash by another
    lowercase-hex order column.
    """
    hashed = counts.withColumn(
        "_order", order if order is not None else seeded_hash(seed, F.col(group))
    )
    if size is None:
        size = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total")).scalar()
        wanted = eval_size(size, train_split)
    else:
        wanted = size if isinstance(size, Column) else F.lit(size)
    eligible = hashed.filter((F.col("cnt") > min_rows) & (F.col("cnt") < max_rows))
    summed = group_running_sum(eligible, "cnt", "_order", group)
    crossing = summed.agg(
        F.min(F.when(F.col("cum") * 2 >= wanted, F.struct("cum", "cnt"))).alias("k"),
        F.max("cum").alias("all"),
    )
    if strict:
        found = crossing.select(
            F.when(F.col("k").isNull() & (wanted > 0), F.raise_error(F.lit("holdout: no group reaches half of the evaluation size")))
            .when(
                (F.col("k.cum") < wanted) & (F.col("all") + F.col("k.cnt") < wanted),
                F.raise_error(F.lit("holdout: groups run out before validation is full")),
            )
            .otherwise(F.col("k"))
            .alias("k")
        ).scalar()
    else:
        found = crossing.select("k").scalar()
    k_cum, k_cnt = found.getField("cum"), found.getField("cnt")
    split = F.when(F.col("cum") < k_cum, F.lit("test")).when(
        (F.col("cum") >= k_cum) & (F.col("cum") + k_cnt < wanted), F.lit("valid")
    )
    return (
        summed.withColumn("split", split)
        .filter(F.col("split").isNotNull())
        .select(group, "cnt", "cum", "split")
    )


def holdout_report(chosen: DataFrame) -> DataFrame:
    """How many groups and rows each held-out set received."""
    return chosen.groupBy("split").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("cnt").alias("n_rows"),
        F.min("cnt").alias("smallest"),
        F.max("cnt").alias("largest"),
    )


def rows_of_groups(df: DataFrame, chosen: DataFrame, group: str = "repo") -> DataFrame:
    """All rows of the chosen groups."""
    return df.join(chosen.select(group), group, "left_semi")


def sample_exact(
    df: DataFrame, size: Column | int, key: Sequence[str], seed: int = SAMPLE_SEED
) -> DataFrame:
    """Exactly ``size`` rows without replacement."""
    return hash_partition(df, [size], seed, key, "_part").filter("_part = 0").drop("_part")


def halve(df: DataFrame, key: Sequence[str], seed: int = SAMPLE_SEED) -> DataFrame:
    """Add ``split``: half of the rows (rounded down) to valid, the rest to test."""
    half = df.agg(F.expr("count(1) div 2").alias("half")).scalar()
    return (
        hash_partition(df, [half], seed, key, "_part")
        .withColumn("split", F.when(F.col("_part") == 0, F.lit("valid")).otherwise(F.lit("test")))
        .drop("_part")
    )


def first_rows(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows in corpus order; a report of a few rows."""
    return df.orderBy(*order).limit(k)


def remove_ids(df: DataFrame, ids: DataFrame, key: Sequence[str] = ("row_id",)) -> DataFrame:
    """Rows whose key is not listed (id-set difference)."""
    return df.join(ids.select(*key).distinct(), list(key), "left_anti")


def select_ids(
    df: DataFrame, ids: DataFrame, key: str | Sequence[str] = "row_id", order: str = "ord"
) -> DataFrame:
    """Rows in the order of an id list; a repeated id repeats its row."""
    key = [key] if isinstance(key, str) else list(key)
    return ids.select(order, *key).join(df, key)


def remove_eval_overlap(
    train: DataFrame, evaluation: DataFrame, keys: Sequence[str] = ("src", "tgt")
) -> DataFrame:
    """Drop training rows that share any one of ``keys`` with evaluation rows.

    Evaluation values are made distinct first.  No broadcast is forced: AQE
    broadcasts them when they turn out small and otherwise splits hot values.
    """
    for name in keys:
        train = train.join(evaluation.select(name).distinct(), name, "left_anti")
    return train


def overlap_rows(train: DataFrame, *evaluation: DataFrame, key: str = "src") -> DataFrame:
    """Training rows whose ``key`` occurs in any evaluation frame."""
    values = evaluation[0].select(key)
    for other in evaluation[1:]:
        values = values.unionByName(other.select(key))
    return train.join(values.distinct(), key, "left_semi")


def locate_pairs(
    full: DataFrame,
    part: DataFrame,
    row_id: str = "row_id",
    keys: Sequence[str] = ("src", "tgt"),
    strict: bool = True,
) -> DataFrame:
    """First row id in ``full`` of every row of ``part``.

    ``strict`` fails the query on an unmatched row; otherwise its id is null.
    ``full`` is aggregated before the join: a pair with very many copies is
    down to one row per map task when it is shuffled.
    """
    first = full.groupBy(*keys).agg(F.min(row_id).alias("found_id"))
    located = part.join(first, list(keys), "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("pair not found: "), F.concat_ws(" | ", *keys)))
        located = located.withColumn(
            "found_id", F.when(F.col("found_id").isNull(), missing).otherwise(F.col("found_id"))
        )
    return located


def contextual_eval(
    full: DataFrame,
    part: DataFrame,
    gather: Sequence[str] = ("cxt_src", "cxt_tgt", "repo"),
    row_id: str = "row_id",
    strict: bool = True,
) -> DataFrame:
    """Attach contextual text and app name to evaluation pairs found in ``full``."""
    located = locate_pairs(full, part, row_id, strict=strict)
    found = full.select(F.col(row_id).alias("found_id"), *gather)
    return located.join(found, "found_id", "inner")


def rows_of_repo(df: DataFrame, repo: str) -> DataFrame:
    """All rows of one repository."""
    return df.filter(F.col("repo") == repo)


def split_stats(labelled: DataFrame) -> DataFrame:
    """Total, training and overlap counters of an assigned corpus, in one pass."""

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    split = F.col("split")
    return labelled.agg(
        F.count(F.lit(1)).alias("total"),
        count(split.isin("train", "overlap", "rnd_valid", "rnd_test")).alias("train_before"),
        count(split == "train").alias("train_after"),
        count(split == "overlap").alias("overlap"),
        *[count(split == name).alias(name) for name in EVAL_SPLITS],
    )
