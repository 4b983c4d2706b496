"""Spelling variants: near words found by search schemes over bidirectional FM-indexes.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  The error lies in the left or in the right half of the word searched
for, so that the other half is matched exactly: a search takes one half letter by
letter up to its delimiter and then extends across the other half, allowing one
error, to the other delimiter.  The index holds the delimited words of one shard
and answers by suffix-rank intervals that are extended on either side.

The vocabulary is sorted twice, by the words and by the reversed words, and cut
into shards of bounded text.  All words with a given left half are neighbours in
the first order, and all with a given right half in the second, so that a word
visits one shard a side, and more only where the words of its half fill several.

Defined cases: a null text has no words; a null doc_id counts as an empty one in
the hash.  Rows that share a doc_id are read each by itself.  Ties between forms
go to the smaller word.  Texts without words and empty tables give no rows.  Words
of any length are taken whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import pick, stage
from lokora.operators.ordering import global_prefix_sum

# --- Fixed values ----------------------------------------------------------
RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 31
# ---------------------------------------------------------------------------

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
# Letters and delimiters of the words of a shard, the last word apart.
SHARD_CHARS = 1 << 20
# Searches of a shard that advance together: bounds the matrix of ranks.
BLOCK_ROWS = 8192
# A shard is known by the first letters of its first and last word.
BOUND_CHARS = 64
# After any letter that a word can hold.
AFTER = "Ā"
WORD_BITS = 64


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` of each run of letters, one in 31 with a letter deleted as its hash tells."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    lower = F.translate("text", UPPER, LOWER)
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUNS), F.lit(0))).alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    hashed = runs.withColumn("h", F.crc32(key.cast("binary")))
    return hashed.select(F.when(F.col("h") % EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(found: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``, counted in the map tasks first."""
    long = found.filter(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


class _Ranks:
    """How many letters below a given one a text holds before a place."""

    def __init__(self, letters: np.ndarray, size: int) -> None:
        blocks = len(letters) // WORD_BITS + 1
        self.bits = np.zeros((blocks, size + 1), np.uint64)
        at = np.arange(len(letters))
        place = np.uint64(1) << (at % WORD_BITS).astype(np.uint64)
        own = np.zeros((blocks, size + 1), np.uint64)
        np.bitwise_or.at(own, (at // WORD_BITS, letters + 1), place)
        # Bit planes of "below c": each holds those of all smaller letters.
        np.bitwise_or.accumulate(own, axis=1, out=self.bits)
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.before = (np.cumsum(counts, axis=0) - counts).astype(np.int32)

    def all(self, places: np.ndarray) -> np.ndarray:
        """Row of each place: the number of letters below 0, 1, ... up to the alphabet's size."""
        block = places // WORD_BITS
        mask = ((np.uint64(1) << (places % WORD_BITS).astype(np.uint64)) - np.uint64(1))[:, None]
        return self.before[block] + np.bitwise_count(self.bits[block] & mask)

    def one(self, places: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The number of letters below ``letters`` before each place."""
        block = places // WORD_BITS
        mask = (np.uint64(1) << (places % WORD_BITS).astype(np.uint64)) - np.uint64(1)
        return self.before[block, letters].astype(np.int64) + np.bitwise_count(self.bits[block, letters] & mask)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the sorted suffixes, by doubling the prefixes that are compared."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-step] = rank[step:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class Index:
    """Bidirectional FM-index over delimited words.

    A state is ``(low, back, size)``: the interval of the suffixes that begin with
    the text matched so far, the interval of the reversed text's suffixes that
    begin with its mirror image, and their common length.
    """

    def __init__(self, vocabulary: list[str]) -> None:
        joined = np.frombuffer(("\0" + "\0".join(vocabulary) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(joined, return_inverse=True)
        text = text.astype(np.int64)
        self.size = len(self.alphabet)
        starts = np.flatnonzero(text == 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        order = suffix_array(text)
        self.forward = _Ranks(text[order - 1], self.size)
        # The suffixes that begin with a delimiter come first: the word that follows each.
        self.word = np.searchsorted(starts, order[: len(starts)])
        mirrored = text[::-1]
        self.backward = _Ranks(mirrored[suffix_array(mirrored) - 1], self.size)

    def codes(self, word: str) -> np.ndarray:
        """Letters as numbers of the alphabet; -1 for one that the index does not hold."""
        letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, letters)
        at[at == self.size] = 0
        return np.where(self.alphabet[at] == letters, at, -1)

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States of the empty text."""
        zero = np.zeros(n, np.int64)
        return zero, zero.copy(), np.full(n, self.first[-1], np.int64)

    def extend(self, low, back, size, letters, left: bool):
        """States extended by one letter each, on the left or on the right."""
        ranks, own, other = (self.forward, low, back) if left else (self.backward, back, low)
        end = own + size
        below, upto = ranks.one(own, letters), ranks.one(own, letters + 1)
        below_end, upto_end = ranks.one(end, letters), ranks.one(end, letters + 1)
        own = self.first[letters] + upto - below
        other = other + below_end - below
        size = upto_end - below_end - (upto - below)
        return (own, other, size) if left else (other, own, size)

    def extend_all(self, low, back, size, left: bool):
        """``(state, letter, low, back, size)`` of every letter (no delimiter) that extends a state."""
        ranks, own, other = (self.forward, low, back) if left else (self.backward, back, low)
        begin, end = ranks.all(own).astype(np.int64), ranks.all(own + size).astype(np.int64)
        inside = end - begin
        sizes = inside[:, 1:] - inside[:, :-1]
        state, letter = np.nonzero(sizes[:, 1:])
        letter += 1
        own = self.first[letter] + begin[state, letter + 1] - begin[state, letter]
        other = other[state] + inside[state, letter]
        size = sizes[state, letter]
        return (state, letter, own, other, size) if left else (state, letter, other, own, size)

    def near(self, queries: list[str], left_exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)`` numbers of all words with exactly one error outside the half
        that is matched exactly (each pair once)."""
        found = [self._block(queries[at : at + BLOCK_ROWS], left_exact, at) for at in range(0, len(queries), BLOCK_ROWS)]
        pairs = np.unique(np.concatenate(found or [np.zeros((0, 2), np.int64)]), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _block(self, queries: list[str], left_exact: bool, offset: int) -> np.ndarray:
        halves = [_halves(q, left_exact) for q in queries]
        exact, exact_n = self._table([h[0] for h in halves])
        rest, rest_n = self._table([h[1] for h in halves])
        query = np.arange(len(queries))
        low, back, size = self.start(len(queries))
        # The exact half from the middle outwards, then its delimiter.
        for k in range(exact.shape[1] + 1):
            letters = np.where(k < exact_n[query], exact[query, min(k, exact.shape[1] - 1)], 0)
            go = (k <= exact_n[query]) & (letters >= 0)
            gone = k > exact_n[query]
            stepped = self.extend(low[go], back[go], size[go], letters[go], left_exact)
            for now, new in zip((low, back, size), stepped, strict=True):
                now[go] = new
            keep = gone | (go & (size > 0))
            query, low, back, size = query[keep], low[keep], back[keep], size[keep]
        # The other half to the other side, with no error (clean) or one (wrong).
        left = not left_exact
        none = np.zeros(0, np.int64)
        clean, wrong = (query, low, back, size), (none, none, none, none)
        hits = []
        for k in range(rest.shape[1] + 1):
            letters = rest[:, min(k, rest.shape[1] - 1)]
            # A letter more, before the next one: allowed at the very end too.
            more = self._branch(clean, left)
            at_end = rest_n[clean[0]] <= k
            hits.append(self._finish(_take(more[0], rest_n[more[0][0]] <= k), left_exact))
            hits.append(self._finish(_take(wrong, rest_n[wrong[0]] <= k), left_exact))
            clean, wrong = _take(clean, ~at_end), _take(wrong, rest_n[wrong[0]] > k)
            if not len(clean[0]) and not len(wrong[0]):
                break
            states, letter = more
            open_ = rest_n[states[0]] > k
            states, letter = _take(states, open_), letter[open_]
            replaced = _take(states, letter != letters[states[0]])
            inserted = self._step(states, letters, left)
            clean_next = self._step(clean, letters, left)
            wrong = _join(self._step(wrong, letters, left), replaced, inserted, clean)
            clean = clean_next
        return np.concatenate([np.stack([q + offset, w], 1) for q, w in hits])

    def _step(self, states, letters, left: bool):
        """States extended by the next letter of their query."""
        now = letters[states[0]]
        states, now = _take(states, now >= 0), now[now >= 0]
        stepped = (states[0], *self.extend(*states[1:], now, left))
        return _take(stepped, stepped[3] > 0)

    def _branch(self, states, left: bool):
        """States extended by any letter, and the letters."""
        state, letter, low, back, size = self.extend_all(*states[1:], left)
        return (states[0][state], low, back, size), letter

    def _finish(self, states, left_exact: bool):
        """Queries and words of the states that are whole words once delimited."""
        zero = np.zeros(len(states[0]), np.int64)
        low, _, size = self.extend(*states[1:], zero, not left_exact)
        # Words are distinct: a delimited word occurs once.
        return states[0][size > 0], self.word[low[size > 0]]

    def _table(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters as a matrix, a row for each part, and the parts' lengths."""
        sizes = np.array([len(p) for p in parts], np.int64)
        table = np.zeros((len(parts), max(1, sizes.max(initial=0))), np.int64)
        table[np.arange(table.shape[1]) < sizes[:, None]] = self.codes("".join(parts))
        return table, sizes


def _take(states, keep):
    return tuple(x[keep] for x in states)


def _join(*several):
    return tuple(np.concatenate(x) for x in zip(*several, strict=True))


def _halves(word: str, left_exact: bool) -> tuple[str, str]:
    """The exact half from the middle outwards, and the other half from the middle outwards."""
    left, right = word[: len(word) // 2], word[len(word) // 2 :]
    return (left[::-1], right) if left_exact else (right, left[::-1])


def _shards(vocabulary: DataFrame) -> DataFrame:
    """``(side, shard, key, word, n)``: the vocabulary by words (side 0) and by reversed words
    (side 1), each cut into shards of ``SHARD_CHARS``."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("key")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("key")),
    )
    rows = vocabulary.select("word", "n", F.inline(sides)).withColumn("size", F.char_length("word") + 1)
    placed = global_prefix_sum(rows, ["side", "key"], "size")
    return stage(placed.withColumn("shard", F.expr(f"offset div {SHARD_CHARS}")).drop("offset"), "shards")


def _routed(shards: DataFrame, bounds: dict[int, list]) -> DataFrame:
    """``(side, shard, word, n)``: each word at the shards that may hold words with the same half."""
    first = {side: [b[1] for b in found] for side, found in bounds.items()}
    last = {side: [b[2] for b in found] for side, found in bounds.items()}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for side, key, word, n in zip(batch["side"], batch["key"], batch["word"], batch["n"], strict=True):
                half = key[: len(key) // 2 if side == 0 else len(key) - len(key) // 2]
                begin = bisect_left(last[side], half[:BOUND_CHARS])
                end = bisect_right(first[side], half + AFTER)
                out += [(side, bounds[side][k][0], word, n) for k in range(begin, end)]
            yield pd.DataFrame(out, columns=["side", "shard", "word", "n"])

    return shards.select("side", "key", "word", "n").mapInPandas(route, "side int, shard long, word string, n long")


def _search(key: tuple, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Of each query: how many near words the shard holds, and the most frequent of them."""
    names = ["word", "n_near", "form_n", "form"]
    if queries.empty or held.empty:
        return pd.DataFrame([], columns=names)
    held = held.sort_values("word", key=lambda c: c.map(lambda w: w.encode("utf-32-be")))
    asked, vocabulary = queries["word"].to_numpy(object), held["word"].to_numpy(object)
    counts = held["n"].to_numpy(np.int64)
    left_exact = key[0] == 0
    query, near = Index(list(vocabulary)).near(list(asked), left_exact)
    if not left_exact:
        # What keeps the left half as well is found on the other side.
        own = np.array(
            [not vocabulary[w].startswith(asked[q][: len(asked[q]) // 2]) for q, w in zip(query, near, strict=True)], bool
        )
        query, near = query[own], near[own]
    order = np.lexsort((near, -counts[near], query))
    query, near = query[order], near[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    best = near[first]
    return pd.DataFrame(
        {
            "word": asked[query[first]],
            "n_near": np.diff(np.append(first, len(query))),
            "form_n": counts[best],
            "form": vocabulary[best],
        },
        columns=names,
    )


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(word, n_near, form_n, form)`` of the words ``(word, n)`` that have near words:
    how many, and the most frequent one (ties: the smallest)."""
    shards = _shards(vocabulary)
    bounds: dict[int, list] = {}
    ends = shards.groupBy("side", "shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # Two words, cut short, for each ``SHARD_CHARS`` of the vocabulary.
    short = ends.select("side", "shard", *[F.substring(c, 1, BOUND_CHARS) for c in ("low", "high")])
    for side, shard, low, high in short.orderBy("side", "shard").collect():
        bounds.setdefault(side, []).append((shard, low, high))
    routed = stage(_routed(shards, bounds), "routed")
    # Where many words visit a shard, several tasks take its words.
    sizes = routed.groupBy("side", "shard").agg(F.sum(F.char_length("word") + 1).alias("chars"))
    blocks = sizes.select("side", "shard", F.ceil(F.col("chars") / (2 * SHARD_CHARS)).alias("blocks"))
    asked = routed.join(blocks, ["side", "shard"]).withColumn("block", F.expr("pmod(xxhash64(word), blocks)"))
    held = shards.join(blocks, ["side", "shard"]).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    key = ["side", "shard", "block"]
    found = (
        asked.select(*key, "word").groupBy(*key)
        .cogroup(held.select(*key, "word", "n").groupBy(*key))
        .applyInPandas(_search, "word string, n_near long, form_n long, form string")
    )
    best = F.min(F.struct((-F.col("form_n")).alias("_n"), F.col("form").alias("_form"))).alias("_best")
    one = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return one.select("word", "n_near", (-F.col("_best._n")).alias("form_n"), F.col("_best._form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of the links ``(word, form)``, each followed to its end.

    A form is ``RATIO`` times as frequent as its word, so that there are no rings,
    and each round doubles the steps.
    """
    now = stage(links.select("word", F.col("form").alias("root")), "roots")
    while not now.join(now.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        now = stage(now.join(further, "root", "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
    return now


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of each word of the vocabulary.

    ``form`` is the most frequent near word if it is ``ratio`` (2 or more) times as
    frequent as the word; ``root`` is where the forms end.  Halves hold a letter at
    least, so that words have two letters or more.
    """
    if least_length < 2 or ratio < 2:
        raise ValueError("least_length and ratio must be 2 or more")
    held = stage(vocabulary(words(docs, id_col, text_col), least_length, least_count), "vocabulary")
    near = held.join(near_words(held), "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    formed = stage(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            *[F.when(is_form, F.col(c)).alias(c) for c in ("form", "form_n")],
        ),
        "forms",
    )
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
