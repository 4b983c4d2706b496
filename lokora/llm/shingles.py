"""Sets of word shingles: of a text, of the documents asked for, and what sets share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import mix, signed

REMEMBERED_WORDS = 150_000
# Bits that tell which documents' sets are asked for; more documents only pass needlessly.
FILTER_BITS = 1 << 24
# Tokens that are columns of a matrix at once.
COLUMNS = 4096

_rng = np.random.default_rng(20240607)
POSITION = _rng.integers(1, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hash by word; emptied when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are runs of anything but ASCII white space; A-Z are lower-cased.
    """
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > REMEMBERED_WORDS:
        _hashes.clear()
    hashed = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    used = min(width, len(words))
    shingles = np.full(n, used, np.uint64)
    for k in range(used):
        shingles = mix(shingles * POSITION[k] + hashed[k : k + n])
    return np.unique(shingles)


def place(doc_id: str, version: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(version)), F.lit(FILTER_BITS))


def wanted_sets(rows: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """``(rep, shingles)`` of the classes ``wanted(hi, lo, rep, first)``.

    A table of bits tells which documents may be asked for, so that the others'
    texts are neither read as sets nor moved.
    """
    at = wanted.select(place("first.doc_id", "first.version").alias("at"))
    words = at.groupBy(F.expr("int(at div 64)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    held = words.toPandas()
    bits[held["word"].to_numpy()] = held["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            where = batch["at"].to_numpy()
            out = []
            for k in np.flatnonzero((shared.value[where // 64] >> (where % 64)) & 1):
                tokens = shingle_set(batch["text"].iloc[k], width)
                digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
                out.append((*digest, signed(tokens)))
            yield pd.DataFrame(out, columns=["hi", "lo", "shingles"])

    found = rows.select(place("doc_id", "version").alias("at"), "text").mapInPandas(sets, "hi long, lo long, shingles array<long>")
    return found.join(wanted.select("hi", "lo", "rep"), ["hi", "lo"]).select("rep", "shingles").dropDuplicates(["rep"])


def shared_tokens(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each of the sets ``left`` shares with each of the sets ``right``."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A token that one set holds is shared with nobody.
    column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        total += (has[left] @ has[right].T).astype(np.int64)
    return total
