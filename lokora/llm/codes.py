"""Vector code compression: product quantisation in whole numbers.

A vector of whole components is cut into equal consecutive parts, and each part
is replaced by the index of the nearest entry of its position's codebook.
Nearest means least ``|x|^2 - 2 x.c + |c|^2``; the products ``x.c`` of a batch
with a codebook come from float64 matrix products that are exact: integers are
broken into limbs so short that every sum of products stays below 2^53, and
the products of limbs are put together again in int64.

The passes over the vectors are map-only: a task emits sums and counts of each
entry, at most one row for each entry and component.  Codebooks (parts x
entries x components numbers, whatever the table's size) go through the driver.

Defined cases: vectors that are null, or hold null or non-finite components, are
dropped.  Components beyond a long are held at its ends, and so are errors and
their sums.  The first kept vector (smallest id, ids that are null last, then
smallest components) tells the length; a vector of another length stays, with
null code and error.  A length that is not a multiple of the parts leaves the
last parts shorter or empty.  Repeated rows are rows of their own, each in the
first codebook and in the sums.  Fewer rows than entries make smaller codebooks.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import Rows, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LONGEST = 2**63 - 1
MANTISSA = 53
# Vectors multiplied with a codebook at once: bounds the matrix of products.
BLOCK_ROWS = 2048

SUMS = "part int, entry int, at int, n long, high long, low long"


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed integers as float64 limbs, lowest first: the sum of ``limb << bits * i``."""
    out = []
    while np.abs(values.astype(float)).max(initial=0) >= 1 << bits:
        out.append((values & ((1 << bits) - 1)).astype(float))
        values = values >> bits
    return [*out, values.astype(float)]


def exact_products(a: np.ndarray, b: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """``a @ b.T`` of int64 matrices by float64 products that do not round.

    A limb has so few bits that a sum of ``a.shape[1]`` products stays below
    2^53.  ``kind`` is int64, exact if the results fit, or object (Python numbers).
    """
    width = a.shape[1]
    bits = (MANTISSA - max(1, width).bit_length()) // 2
    total = np.zeros((len(a), len(b)), kind)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            product = (x @ y.T).astype(np.int64).astype(kind)
            total += product * (1 << bits * (i + j)) if kind is object else product << np.int64(bits * (i + j))
    return total


def nearest(vectors: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row, and its exact squared distance."""
    largest = 2.0 * max(np.abs(vectors.astype(float)).max(initial=0), np.abs(codebook.astype(float)).max(initial=0))
    kind = np.int64 if largest * largest * max(1, vectors.shape[1]) < 2.0**62 else object
    entries = codebook.astype(kind)
    own, found, errors = (entries * entries).sum(1), [], []
    for at in range(0, len(vectors), BLOCK_ROWS):
        block = vectors[at : at + BLOCK_ROWS]
        partial = own - 2 * exact_products(block, codebook, kind)
        best = partial.argmin(1)
        whole = block.astype(kind)
        found.append(best)
        errors.append(partial[np.arange(len(block)), best] + (whole * whole).sum(1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(errors)


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """Equal consecutive parts; the last ones shorter or empty if the length is no multiple."""
    step = -(-length // parts)
    return [(min(length, k * step), min(length, (k + 1) * step)) for k in range(parts)]


def whole_vectors(rows: DataFrame, vec: str, scale: int) -> DataFrame:
    """``rows`` with ``v``, floor(scale * x) of each component, without the dropped vectors."""
    x = F.col(vec).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.filter(F.col(vec).isNotNull() & sound)
    return kept.withColumn("v", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)))


def matrix(column: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the given length as a matrix, and which rows they are."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    right = sizes == length
    values = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64, copy=False).reshape(int(right.sum()), length), right


def _entry_sums(length: int, books: list[np.ndarray]):
    """Sums and counts of the parts nearest to each entry, over all rows of a task."""
    bounds = part_bounds(length, len(books))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        # Two sums, of upper and lower 32 bits, so that neither overflows.
        high = [np.zeros(b.shape, np.int64) for b in books]
        low = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            vectors, _ = matrix(batch.column(0), length)
            for k, (start, end) in enumerate(bounds):
                part = vectors[:, start:end]
                entry, _ = nearest(part, books[k])
                n[k] += np.bincount(entry.astype(np.int64), minlength=len(books[k]))
                np.add.at(high[k], entry, part >> 32)
                np.add.at(low[k], entry, part & 0xFFFFFFFF)
        for k, book in enumerate(books):
            used = np.flatnonzero(n[k])
            width = book.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used) * width, k, np.int32)),
                    pa.array(np.repeat(used, width).astype(np.int32)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                    pa.array(np.repeat(n[k][used], width)),
                    pa.array(high[k][used].ravel()),
                    pa.array(low[k][used].ravel()),
                ],
                names=[c.split()[0] for c in SUMS.split(", ")],
            )

    return add


def improved(vectors: DataFrame, length: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
    sums = vectors.mapInArrow(_entry_sums(length, books), SUMS)
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    out = [b.copy() for b in books]
    for row in sums.groupBy("part", "entry", "at").agg(*wide).collect():
        total = (int(row["high"]) << 32) + int(row["low"])
        out[row["part"]][row["entry"], row["at"]] = total // int(row["n"])
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """Digest of all entries' components, in order, as decimal numbers."""
    text = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def learn_codebooks(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[int, list[np.ndarray]]:
    """Vector length and one codebook for each part, from ``(id, v)`` rows."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    length = len(first[0]["v"]) if first else 0
    held = [r["v"] for r in first if len(r["v"]) == length]
    start = np.array(held, np.int64).reshape(len(held), length)
    books = [start[:, a:b].copy() for a, b in part_bounds(length, parts)]
    if first:
        for _ in range(rounds):
            books = improved(vectors.select("v"), length, books)
    return length, books


def assign(rows: DataFrame, length: int, books: list[np.ndarray]) -> DataFrame:
    """``rows`` (with ``v`` as last column) with ``code`` and ``error`` instead of ``v``."""
    bounds = part_bounds(length, len(books))
    kept = rows.columns[:-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, right = matrix(batch.column(batch.num_columns - 1), length)
            codes = np.zeros((len(vectors), len(books)), np.uint8)
            errors = np.zeros(len(vectors), object)
            for k, (start, end) in enumerate(bounds):
                entry, error = nearest(vectors[:, start:end], books[k])
                codes[:, k] = entry
                errors += error.astype(object)
            code, error = np.full(len(right), None, object), np.full(len(right), None, object)
            code[right] = [c.tobytes().hex() for c in codes]
            error[right] = [min(int(e), LONGEST) for e in errors]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*kept, "code", "error"]
            )

    fields = rows.select(*kept).schema.add("code", "string").add("error", "long")
    return rows.mapInArrow(encode, fields)


def compress(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(id, label, code, error, label_error)`` of each kept row, and the codebooks.

    ``entries`` is 256 at most: an index is a byte of the code.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    given = Rows(df)
    named = given.df.select(
        F.col(given.of(id_col)).alias("id"), F.col(given.of(label_col)).alias("label"), F.col(given.of(vec_col)).alias("x")
    )
    rows = stage(whole_vectors(named, "x", scale).drop("x"), "vectors")
    length, books = learn_codebooks(rows, parts, entries, rounds)
    coded = stage(assign(rows, length, books), "codes")
    # Summed in the map tasks first: a label may hold any share of the rows.
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    held = F.when(total > LONGEST, F.lit(LONGEST)).otherwise(total.cast("decimal(38,0)"))
    labels = coded.groupBy("label").agg(held.cast("long").alias("label_error"))
    same = labels.select(F.col("label").alias("_label"), "label_error")
    out = coded.join(same, coded["label"].eqNullSafe(same["_label"]))
    return out.select("id", "label", "code", "error", "label_error"), books
