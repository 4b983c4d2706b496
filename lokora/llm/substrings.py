"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; where it matches a mask, a
chunk ends.  The hash sees the last 32 bytes only, so boundaries depend on local
content and fall in the same places however much text is inserted before.
Chunks are compared by a 128-bit digest.  The first copy of a chunk (smallest
doc_id, then place) stays; a run of later copies is cut out once it has at least
``min_bytes``, shrunk to whole words so that no word is torn.

Defined cases: null and empty texts have no chunks and stay as they are.  Rows
with the same doc_id do not delete each other's chunks, but each text is cut at
its own repeats only; a null doc_id counts as larger than all others.  Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import Rows, mix

# Chunk sizes in bytes: a boundary in 2**MASK_BITS positions on average.
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 24, 160, 5
# Shorter runs of known chunks are left alone: phrases, license lines, headings.
MIN_RUN_BYTES = 100
NO_ID = (1 << 63) - 1

CHUNK = "doc_id long, version long, hi long, lo long, start int, size int, again boolean"


def gear_table(seed: int = 1) -> np.ndarray:
    """A 32-bit number for each byte value."""
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(seed << 32)).astype(np.uint32)


GEAR = gear_table()
# Bits 20 and up: they depend on at least the last 20 bytes.
MASK = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, for all bytes at once.

    h(i) is the sum of gear[b(i-j)] << j over the last 32 bytes; sums over 1, 2,
    4, … bytes are doubled up to 32.
    """
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes; chunks never split a character."""
    n = len(data)
    if n == 0:
        return []
    starts_character = np.append((data[1:] & 0xC0) != 0x80, True)
    wanted = np.flatnonzero(((gear_hashes(data) & MASK) == 0) & starts_character) + 1
    ends, last = [], 0
    for end in wanted.tolist():
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if end - last >= MIN_CHUNK:
            ends.append(end)
            last = end
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        while data[last] & 0xC0 == 0x80:
            last -= 1
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(rows: DataFrame) -> DataFrame:
    """The chunks of ``(doc_id, version, text)`` rows: digest, place, and whether the same text
    already held it before (``again``)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, versions, raw, starts, sizes, again = [], [], [], [], [], []
            for doc_id, version, text in zip(batch["doc_id"], batch["version"], batch["text"], strict=True):
                if not text:
                    continue
                data = text.encode("utf-8")
                ends = chunk_ends(np.frombuffer(data, np.uint8))
                begins = [0, *ends[:-1]]
                mine = [digest(data[a:b]) for a, b in zip(begins, ends, strict=True)]
                ids += [doc_id] * len(ends)
                versions += [version] * len(ends)
                raw += mine
                starts += begins
                sizes += ends
                seen: set[bytes] = set()
                for one in mine:
                    again.append(one in seen)
                    seen.add(one)
            halves = np.frombuffer(b"".join(raw), ">i8").astype(np.int64).reshape(-1, 2)
            begin = np.array(starts, np.int32)
            yield pd.DataFrame(
                {
                    "doc_id": np.array(ids, np.int64),
                    "version": np.array(versions, np.int64),
                    "hi": halves[:, 0],
                    "lo": halves[:, 1],
                    "start": begin,
                    "size": np.array(sizes, np.int32) - begin,
                    "again": np.array(again, bool),
                }
            )

    return rows.mapInPandas(split, CHUNK)


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """``(doc_id, version, start, size)`` of every chunk that is not the first of its digest.

    First copies are found by an aggregation whose buffers are plain numbers, so
    that a passage which a third of all documents share is combined in the map
    tasks; the join back has one row per digest on one side and may split the
    other.
    """
    found = chunks(rows)
    first = (
        found.groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("hi", "lo", "first_id")
    )
    return (
        found.join(first, ["hi", "lo"])
        .filter("doc_id > first_id or again")
        .select("doc_id", "version", "start", "size")
    )


def _spans(start: np.ndarray, size: np.ndarray, min_bytes: int) -> list[tuple[int, int]]:
    """Runs of adjoining chunks of at least ``min_bytes``."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order], (start + size)[order]
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    firsts, lasts = begin[new], end[np.append(new[1:] - 1, len(end) - 1)]
    return [(int(a), int(b)) for a, b in zip(firsts, lasts, strict=True) if b - a >= min_bytes]


SPACE = frozenset(b" \t\n\v\f\r")


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the spans, each shrunk to whole words, and the spans as cut."""
    kept, cut, at, n = [], [], 0, len(data)
    for a, b in spans:
        while 0 < a < b and data[a - 1] not in SPACE:
            a += 1
        while a < b < n and data[b] not in SPACE and data[b - 1] not in SPACE:
            b -= 1
        if a < b:
            kept.append(data[at:a])
            cut.append((a, b))
            at = b
    kept.append(data[at:])
    return b"".join(kept), cut


def deduplicate(
    docs: DataFrame, min_bytes: int = MIN_RUN_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and three columns more:
    ``removed_bytes``, ``removed_spans`` (byte offsets in the old text) and ``changed``.

    Every row stays, even when nothing of its text is left.
    """
    rows = Rows(docs)
    key, text = rows.of(id_col), rows.of(text_col)
    doc_key = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    # Rows may share an id, or have none: a text's own repeats are found by its hash too.
    version = F.xxhash64(text)
    repeats = (
        repeated_chunks(rows.df.select(doc_key.alias("doc_id"), version.alias("version"), F.col(text).alias("text")))
        .groupBy("doc_id", "version")
        .agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("_repeats"))
        .withColumnsRenamed({"doc_id": "_key", "version": "_version"})
    )

    @F.pandas_udf("struct<text: string, spans: array<struct<from: int, to: int>>>")
    def without(text: pd.Series, start: pd.Series, size: pd.Series) -> pd.DataFrame:
        out, cuts = [], []
        for t, a, s in zip(text, start, size, strict=True):
            cut = []
            if t and a is not None and len(a):
                data = t.encode("utf-8")
                spans = _spans(np.asarray(a, np.int64), np.asarray(s, np.int64), min_bytes)
                if spans:
                    data, cut = cut_spans(data, spans)
                    t = data.decode("utf-8")
            out.append(t)
            cuts.append([{"from": a, "to": b} for a, b in cut])
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "spans": pd.Series(cuts, dtype=object)})

    joined = rows.df.withColumns({"_key": doc_key, "_version": version}).join(repeats, ["_key", "_version"], "left")
    done = joined.withColumn("_cut", without(text, "_repeats.start", "_repeats.size")).select(
        *[F.col("_cut.text").alias(c) if c == text else c for c in rows.plain], F.col("_cut.spans").alias("removed_spans")
    )
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    done = done.withColumn("removed_bytes", removed).withColumn("changed", F.col("removed_bytes") > 0)
    return rows.restore(done, "removed_bytes", "removed_spans", "changed")
