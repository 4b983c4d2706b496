"""Byte-level byte-pair encoding and decoding.

A text is split by a pattern; each match is encoded on its own.  Its bytes form
a linked list.  Every adjacent pair that makes a known token, of lower rank than
the pairs beside it, waits in the bucket of that token's rank, and a hierarchical bitmap over the ranks tells the lowest
rank in use by find-first-set.  A merge only touches its two neighbours, so that
a match of n bytes takes about n steps, however long it is.  Entries that a
merge has overtaken stay in their bucket and are skipped when they come up.

Null and empty texts have no ids.  Ties of rank go to the leftmost pair.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import product

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import pick

# Words between blanks, and matches within them, that a worker remembers in each of two
# generations: a full memory becomes the older one, from which what is used again returns.
REMEMBERED_MATCHES = 100_000
REMEMBERED_WORDS = 250_000
# Longer ones are encoded each time, so that what is remembered stays small.
REMEMBERED_CHARS = 64
# Signs of every kind that patterns tell apart, to learn what a pattern does at a blank.
PROBES = "aZ1.'_\u00e9\u4e2d\u0301\n"
BIT = [1 << i for i in range(256)]


class Codec:
    """Ranks of one vocabulary, with what a worker has learnt about matches and pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.shift = max(ranks.values()).bit_length()
        self.none = max(ranks.values()) + 1  # above every rank
        self.pairs = self._pairs()
        self.splits_at_blanks = self._splits_at_blanks()
        self.matches = _Matches(self)
        self.words = _Words(self)
        size = max(ranks.values()) + 1
        self.flat = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)
        self.length = np.array([len(self.token.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _pairs(self) -> dict[int, int]:
        """Rank by pair of tokens, for each way to put a token together from two."""
        found, rank_of = {}, self.ranks.get
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left = rank_of(token[:at])
                if left is not None:
                    right = rank_of(token[at:])
                    if right is not None:
                        found[left << self.shift | right] = rank
        return found

    def _splits_at_blanks(self) -> bool:
        """Whether a match always ends at a single blank and the next begins with it."""
        around = ["".join(two) for two in product(PROBES, repeat=2)]
        return all(
            self.find(f"{a} {b}") == self.find(a) + self.find(f" {b}")
            for a in around
            if not a[-1].isspace()
            for b in around
            if not b[0].isspace()
        )

    def encode_match(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, shift, bit, none, n = self.pairs.get, self.shift, BIT, self.none, len(piece)
        first = self.first
        ids = [first[b] for b in piece]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        # The rank of the pair that begins at a position; places -1 and n have none.
        waits = [rank_of(a << shift | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        waits += [none, none]
        buckets: dict[int, list[int]] = {}
        # Two levels of bits: blocks of 256 ranks in use, and ranks in use in a block.
        blocks, used = 0, {}
        # Only a pair lower than both neighbours can be merged next; the others wait
        # until a merge beside them makes them the lowest of three.
        fresh, last = [], none
        for i in range(n - 1):
            rank = waits[i]
            if rank < last and rank <= waits[i + 1]:
                fresh.append(i)
            last = rank

        while True:
            for i in fresh:
                rank = waits[i]
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    block = rank >> 8
                    used[block] = used.get(block, 0) | bit[rank & 255]
                    blocks |= bit[block] if block < 256 else 1 << block
            if not blocks:
                break
            block = (blocks & -blocks).bit_length() - 1
            bits = used[block]
            lowest = bits & -bits
            rank = block << 8 | lowest.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bits ^= lowest
                used[block] = bits
                if not bits:
                    blocks &= blocks - 1
            fresh = []
            if waits[i] != rank:
                continue
            gone = after[i]
            was_right = waits[gone]
            waits[gone] = none
            ids[i] = rank
            right = after[i] = after[gone]
            if right < n:
                before[right] = i
                new = waits[i] = rank_of(rank << shift | ids[right], none)
            else:
                new = waits[i] = none
            left, new_left = before[i], none
            if left >= 0:
                was_left = waits[left]
                new_left = waits[left] = rank_of(ids[left] << shift | rank, none)
                far = before[left]
                wait = waits[far]
                if was_left < wait <= new_left and wait < waits[before[far]]:
                    fresh.append(far)
                if new_left < wait and new_left <= new:
                    fresh.append(left)
            wait = waits[right]
            if new < new_left and new <= wait:
                fresh.append(i)
            if was_right <= wait < new and wait <= waits[after[right]]:
                fresh.append(right)

        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        Where the pattern always splits at a single blank between two other
        characters (``splits_at_blanks``), words between such blanks are encoded
        apart, the blank in front of each, and remembered.
        """
        if len(self.words) > REMEMBERED_WORDS:
            self.words.age()
        if len(self.matches) > REMEMBERED_MATCHES:
            self.matches.age()
        if not self.splits_at_blanks:
            return self.encode_word(text)
        first, *words = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise UnevenSpace
            return self.encode_word(first) + b"".join(map(self.words.__getitem__, words))
        except UnevenSpace:
            first, *words = SINGLE_BLANK.split(text)
            last = self.encode_word(" " + words.pop()) if words else b""
            return self.encode_word(first) + b"".join(map(self.words.__getitem__, words)) + last

    def encode_word(self, word: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.find(word)))

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        length = self.length[numbers]
        shift = self.start[numbers] - (np.cumsum(length) - length)
        return self.flat[np.repeat(shift, length) + np.arange(int(length.sum()))].tobytes()


SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def little_endian(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class UnevenSpace(Exception):
    """White space that is more than one blank between two other characters."""


class _Memory(dict):
    """Encoded forms; computed when first asked for, and after two generations without use."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.form(key)
        if len(key) <= REMEMBERED_CHARS:
            self[key] = ids
        return ids


class _Matches(_Memory):
    """Encoded form by match."""

    def form(self, match: str) -> bytes:
        return little_endian(self.codec.encode_match(match.encode("utf-8")))


class _Words(_Memory):
    """Encoded form by word, the blank in front of it included."""

    def form(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise UnevenSpace
        matches = self.codec.find(" " + word)
        if len(matches) == 1:  # remembered once, as a word
            return self.codec.matches.form(matches[0])
        return b"".join(map(self.codec.matches.__getitem__, matches))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@cache
def codec(path: str, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(read_ranks(path), pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """The ids of a text column, as binary: little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = codec(path, pattern)
        for batch in batches:
            yield pd.Series([by.encode(t) if t else b"" for t in batch], dtype=object)

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that a binary column of ids stands for."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = codec(path, pattern)
        for batch in batches:
            yield pd.Series([by.decode(i) if i else b"" for i in batch], dtype=object)

    return decode(ids)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``docs``, also for repeated rows and null ids.

    A null or empty text has empty ids.  Other columns are ignored.  The work is
    map-only; a worker needs memory for one batch and a bounded table of matches.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", encoded(F.col("text"), path, pattern).alias("ids"))


def decode_documents(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``bytes``, what the ``ids`` of each row decode to."""
    return rows.withColumn("bytes", decoded(F.col("ids"), path, pattern))
