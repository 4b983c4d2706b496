"""From PO files to the deduplicated, filtered corpus table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokora.functions import text as T
from lokora.functions.once import with_columns_once
from lokora.operators.corpus import dedup_pairs, length_filter
from lokora.sources import po


def translated_rows(raw: DataFrame) -> DataFrame:
    """Rows with text on both sides, then normalised (emptiness is tested first)."""
    src = F.coalesce(F.col("src"), F.lit(""))
    tgt = F.coalesce(F.col("tgt"), F.lit(""))
    return with_columns_once(
        raw.filter((src != "") & (tgt != "")),
        {"src": T.normalise_text(src), "tgt": T.normalise_text(tgt)},
    )


def po_corpus_rows(
    spark: SparkSession, root: str, max_bytes: int = po.MAX_ROW_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Pairs of every PO file below ``root``, and the quarantine.

    Files up to ``max_bytes`` are parsed as rows, larger ones by lines.  A file that
    cannot be read gives no pairs and a reason in the quarantine.
    """
    files = po.read_po_files(spark, root, max_bytes)
    lines = po.read_large_po_lines(spark, root, max_bytes)
    entries = po.parse_po_entries(files).unionByName(po.po_lines_to_entries(lines))
    problems = po.po_problems(files).unionByName(po.po_line_problems(lines))
    return po.po_pairs(entries), problems


def build_corpus(
    raw: DataFrame,
    max_chars: int = T.MAX_CHARS,
    mode: str = "or",
    order: Sequence[str] = ("file_ord", "pos"),
) -> DataFrame:
    """Normalise, drop untranslated rows, dedup keep-first, apply the length filter.

    ``order`` is the corpus order that decides which copy comes first.

    The length test depends only on the pair, so rows it drops never enter the
    dedup shuffle: filtering first gives the same rows for less traffic.
    """
    return dedup_pairs(length_filter(translated_rows(raw), max_chars, mode), order=order)
