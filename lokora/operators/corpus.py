"""Corpus-level operators: dedup, length filter, counts, documents, ambiguity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.functions import text as T


def with_repo(df: DataFrame, repo: Column | None = None, component: int | None = None) -> DataFrame:
    """Add the repository key.

    Default: the first two components (owner/name) of ``filepath``; ``component``
    takes one path component instead; ``repo`` is any expression.
    """
    if repo is None:
        path = F.col("filepath")
        repo = (
            T.path_component(path, component)
            if component is not None
            else F.substring_index(path, "/", 2)
        )
    return df.withColumn("repo", repo)


def dedup_pairs(
    df: DataFrame,
    keys: Sequence[str] = ("src", "tgt"),
    order: Sequence[str] = ("file_ord", "pos"),
) -> DataFrame:
    """One row per pair, the first in corpus order, with all its columns.

    The minimum is taken in every map task first, so a pair that fills a third
    of the corpus crosses the shuffle once per map task.
    """
    rest = [c for c in df.columns if c not in (*keys, *order)]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


def unique_pairs(
    df: DataFrame, keys: Sequence[str] = ("src", "tgt"), row_id: str = "row_id"
) -> DataFrame:
    """Distinct pairs with the first position (their order) and the last row id."""
    return df.groupBy(*keys).agg(
        F.min(row_id).alias("first_seen"), F.max(row_id).alias("last_id")
    )


def length_filter(df: DataFrame, max_chars: int = T.MAX_CHARS, mode: str = "or") -> DataFrame:
    return df.filter(T.within_length(F.col("src"), F.col("tgt"), max_chars, mode))


def file_counts(df: DataFrame) -> DataFrame:
    """Rows per file, largest first."""
    return (
        df.groupBy("filepath")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "filepath")
    )


def repo_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("repo").agg(F.count(F.lit(1)).alias("cnt"))


def drop_empty_or_long(
    df: DataFrame, columns: Sequence[str], max_chars: int = T.MAX_CHARS
) -> DataFrame:
    """Keep rows whose every listed column holds usable text."""
    for name in columns:
        df = df.filter(T.is_kept_text(F.col(name), max_chars))
    return df


def assemble_documents(df: DataFrame, app: str, order: str, text: str) -> DataFrame:
    """The document stream: one document per app, delimited by document tags.

    Apps come in first-seen order and their sentences in corpus order.  The
    stream is returned as rows with sort keys ``(app_ord, seq)`` instead of one
    list per app, so no app has to fit in one task: sort by the keys to write it.
    Keys: the leading delimiter is (-1, 0); each app's lines carry its first
    position and their own, and its closing delimiter sorts behind them.
    """
    apps = df.groupBy(app).agg(F.min(order).alias("app_ord"))
    lines = df.join(apps, app).select(
        "app_ord", F.col(order).cast("bigint").alias("seq"), F.col(text).alias("line")
    )
    tag = F.lit(T.DOCUMENT_TAG)
    last = F.lit(9223372036854775807)  # sorts behind every position
    closing = apps.select("app_ord", last.alias("seq"), tag.alias("line"))
    opening = df.sparkSession.range(1).select(
        F.lit(-1).cast("bigint").alias("app_ord"),
        F.lit(0).cast("bigint").alias("seq"),
        tag.alias("line"),
    )
    return lines.unionByName(closing).unionByName(opening)


def ambiguous_terms(df: DataFrame, min_targets: int = 2) -> DataFrame:
    """Source terms, case folded, that are translated in more than one way.

    One row per (term, target) with how often and in how many files it occurs.
    No per-term list is collected: a very common term may have any number of
    targets.
    """
    folded = df.withColumn("term", F.lower("src"))
    per_file = folded.groupBy("term", "tgt", "filepath").agg(F.count(F.lit(1)).alias("n"))
    per_target = per_file.groupBy("term", "tgt").agg(
        F.sum("n").alias("uses"), F.count(F.lit(1)).alias("files")
    )
    per_term = (
        per_target.groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_targets"))
        .filter(F.col("n_targets") >= min_targets)
    )
    return per_target.join(per_term, "term")
