"""Document fingerprints: minwise hashing over word shingles.

A fingerprint holds, for each of ``PERMUTATIONS`` universal hash functions, 16
bits of the least value over the document's shingles; the share of places in
which two fingerprints agree estimates the Jaccard similarity of the sets.
``similar_documents`` joins documents on bands of their signatures and verifies
the Jaccard similarity of what meets on full sets.

Defined cases: a null text is empty; texts without words have an empty set and
share one fingerprint, so that their likeness is 1, and 0 to any other.  Rows
are ordered by doc_id (nulls first), then by text; repeated rows follow each
other.  A single row is its own next document.  Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokora.llm.common import mix, partitions, pick, stage
from lokora.llm.neardup import full_sets
from lokora.llm.shingles import shingle_set

PERMUTATIONS, WIDTH = 128, 5
BANDS = 16
BLOCK = 256  # shingles hashed at once by all functions: their values stay in a core's cache

_rng = np.random.default_rng(42)
MULTIPLY = _rng.integers(1, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64)


def signature(text: str | None, width: int = WIDTH) -> np.ndarray:
    """16 bits of the least value of each function a * x + b over the shingles of a whole text."""
    least = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    shingles = shingle_set(text, width)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        least = np.minimum(least, (part[:, None] * MULTIPLY + ADD).min(0))
    return mix(least).astype(np.uint16)


def as_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u2").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# As written between the steps: bytes, which take less room than their text forms.
RESULT = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
NAMES = [f.split()[0] for f in RESULT.split(", ")]


def _compared(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = signature(edited)
    digest = hashlib.sha256(edited.encode()).digest()
    return (
        doc_id, len(text), digest, as_bytes(own), as_bytes(changed), likeness(own, changed), likeness(own, other)
    )


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how they compare.

    The texts are range-partitioned and sorted once; a task streams over its rows
    and sees each one's successor.  Only the ends of the partitions, two rows
    each, are matched afterwards.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    names = ["kind", "part", "text", *NAMES]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None
        blank = (None,) * (len(NAMES) - 1)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                own = signature(text)
                if last is None:
                    out.append(("head", part, text, doc_id, *blank))
                else:
                    out.append(("row", part, None, *_compared(*last, text, own)))
                last = (doc_id, text, own)
            yield _frame(out, names).astype({"n_chars": "Int64"})
        if last is not None:
            yield _frame([("tail", part, last[1], last[0], *blank)], names).astype({"n_chars": "Int64"})

    done = stage(ordered.mapInPandas(compare, "kind string, part int, text string, " + RESULT), "fingerprints")
    heads = done.filter("kind = 'head'").select("part", F.col("text").alias("following"))
    # One number per partition: which partition follows.
    everywhere = Window.orderBy("part")
    first = F.first("part").over(everywhere)
    turn = heads.select("part", F.coalesce(F.lead("part").over(everywhere), first).alias("next"))
    ends = (
        done.filter("kind = 'tail'").select("doc_id", "text", "part")
        .join(turn, "part")
        .join(heads.withColumnRenamed("part", "next"), "next")
        .select("doc_id", "text", "following")
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, following in batch.itertuples(index=False):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                out.append(_compared(doc_id, text, signature(text), following, signature(following)))
            yield _frame(out, NAMES)

    rows = done.filter("kind = 'row'").select(*NAMES).union(ends.mapInPandas(finish, RESULT))
    return rows.withColumns(
        {
            "edited_sha256": F.lower(F.hex("edited_sha256")),
            "fingerprint": F.base64("fingerprint"),
            "edited_fingerprint": F.base64("edited_fingerprint"),
        }
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, bands)``: map-only; bands are hashes of runs of the signature."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = signature(text)
                mixed = mix(own.astype(np.uint64) * weights).reshape(BANDS, -1).sum(1, dtype=np.uint64)
                bands = mix(mixed + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                out.append((doc_id, base64.b64encode(as_bytes(own)).decode(), bands if text and text.split() else []))
            yield _frame(out, ["doc_id", "fingerprint", "bands"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInPandas(sign, "doc_id long, fingerprint string, bands array<long>")


def similar_documents(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, near_id, jaccard)``: for documents that share a band with an earlier one,
    the smallest doc_id among the band leaders whose Jaccard similarity, verified on
    full sets, is ``percent`` or more.

    A band leads to its smallest doc_id only: a group of copies of any size gives
    one pair for each member and band, not all pairs.
    """
    own = fingerprints(docs, id_col, text_col).filter("doc_id is not null").select("doc_id", F.explode("bands").alias("band"))
    own = stage(own, "bands")  # read twice: signatures are the costly part
    leaders = own.groupBy("band").agg(F.min("doc_id").alias("near_id"), F.max("doc_id").alias("_last")).filter("near_id <> _last")
    pairs = own.join(leaders.drop("_last"), "band").filter("doc_id <> near_id").select("doc_id", "near_id").distinct()
    pairs = stage(pairs, "band-pairs")
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    needed = pairs.select("doc_id").union(pairs.select("near_id")).distinct()
    sets = stage(full_sets(rows.join(needed, "doc_id", "left_semi"), WIDTH), "band-sets")
    joined = pairs.join(sets.withColumnsRenamed({"rep": "doc_id", "shingles": "_a"}), "doc_id").join(
        sets.withColumnsRenamed({"rep": "near_id", "shingles": "_b"}), "near_id"
    )
    shared = F.size(F.array_intersect("_a", "_b"))
    checked = joined.withColumn("jaccard", shared / (F.size("_a") + F.size("_b") - shared))
    best = checked.filter(F.col("jaccard") * 100 >= percent).groupBy("doc_id")
    return best.agg(F.min("near_id").alias("near_id"), F.min_by("jaccard", "near_id").alias("jaccard"))
