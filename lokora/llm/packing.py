"""Packing of tokenised documents into sequences by repeated length patterns.

Documents become pieces of at most ``capacity`` tokens (``cut_documents``).
``pack`` then sees only the histogram of piece lengths, which has ``capacity``
numbers whatever the input: it enumerates patterns of few lengths that nearly
fill a sequence, fits how often to use each by non-negative least squares
against the histogram, rounds, does so again with what is left, and packs by best
fit only what no pattern takes.  The plan says, for each length, where its first,
second, … piece goes; pieces are numbered per length in Spark and look their place up.

Null and empty texts give one piece holding the end id alone.  Repeated rows are
packed as often as they occur.  Empty tables give no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokora.llm.common import pick, stage

# Parts of words a worker remembers with their ids in each of two generations: a full memory
# becomes the older one, from which parts that occur again return.
REMEMBERED_WORDS = 200_000
REMEMBERED_CHARS = 64
# New parts in one call of the tokenizer.
WORDS_AT_ONCE = 1_000
# Characters of texts taken apart at once, but for a longer text: bounds memory.
CHARS_AT_ONCE = 1 << 20
# Parts of the space left that are tried for the middle lengths of a pattern of three and four.
MIDDLE_CHOICES = [(8,), (4, 4)]
PATTERN_PIECES = 4
NNLS_STEPS = 200
# Orders in which patterns are fitted, tried until one meets the lower bound.  A step
# takes patterns whose longest piece is over a part of the capacity, that leave at most
# a part of a sequence empty, and that have at most a number of pieces.
ORDERS = [
    [(0.0, 0.002, 4)],
    [(0.5, 0.002, 2), (0.5, 0.02, 2), (0.5, 0.002, 4), (0.5, 0.02, 4), (0.0, 0.002, 4)],
]
# Rows of one length that are numbered in one group.
GROUP_ROWS = 5_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokens:
    """Ids of whole texts by a tokenizer that never joins across a blank or line end.

    Latin text is taken apart by the tokenizer's own rules, and its parts are remembered
    with their ids.  New parts go to the tokenizer's model many in one string, where the end
    of each shows in its last token.  Words with any other character go to the whole
    tokenizer.  A tokenizer that splits by other rules sees whole texts.
    """

    # Rules under which texts may be taken apart: composing, one blank for white
    # space, lower-casing, then this split and one letter for each byte.  Fixed values.
    NORMAL = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    BLANK = " \n\t\x0b\f\r"
    # Below: characters that composing keeps, and lower-casing changes one by one.
    LATIN = 0x250

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        normal = [r["type"] for r in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        model, vocab, letters = rules["model"], self.tokenizer.get_vocab(), _byte_letters()
        suffix = model.get("end_of_word_suffix")
        self.by_word = (
            normal == self.NORMAL and len(splits) == 2 and splits[0].get("pattern") == {"Regex": self.SPLIT}
            and self.BYTES.items() <= splits[1].items() and rules["post_processor"] is None
            and bool(suffix) and not model.get("dropout") and all(c in vocab and c + suffix in vocab for c in letters)
        )
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.by_word:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            self.letters = dict(enumerate(letters))
            self._rules()

    def _rules(self) -> None:
        """Regular expressions for parts, and for words with a character that is not plain."""
        marks = [chr(i) for i in range(self.LATIN) if chr(i).isprintable() and chr(i) not in self.BLANK]
        plain = [c for c in marks if len(c.lower()) == 1 and ord(c.lower()) < self.LATIN]
        lower = {c.lower() for c in plain}
        kinds = [re.escape("".join(sorted(c for c in lower if unicodedata.category(c)[0] == kind))) for kind in "LN"]
        every, blank = re.escape("".join(plain)), re.escape(self.BLANK)
        letter, number = kinds
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{letter}{number}{blank}]+").findall
        self.other = re.compile(rf"[^{every}{blank}]")
        inside = re.escape(self.BLANK.strip(" \n"))
        self.other_word = re.compile(rf"(?<![^ \n])[{every}{inside}]*+[^{every}{blank}][^ \n]*")

    def _encoded(self, strings: list[str]) -> Iterator[bytes]:
        for ids in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False):
            yield array("I", ids.ids).tobytes()

    def _encoded_parts(self, parts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(parts), WORDS_AT_ONCE):
            joined = " ".join(parts[at : at + WORDS_AT_ONCE])
            if not joined.isascii():
                joined = " ".join([p.encode().decode("latin-1").translate(self.letters) for p in joined.split(" ")])
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            for end in (4 * np.flatnonzero(self.ends[ids]) + 4).tolist():
                yield data[start:end]
                start = end

    def _parts(self, text: str, others: set[str]) -> list[str]:
        """The parts of a text; words with other characters are parts, and go to ``others``."""
        if not self.other.search(text):
            return self.split(text.lower())
        out, start = [], 0
        for word in self.other_word.finditer(text):
            out += self.split(text[start : word.start()].lower())
            out.append(word[0])
            others.add(word[0])
            start = word.end()
        return out + self.split(text[start:].lower())

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            yield from self._encoded(texts)
            return
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars > CHARS_AT_ONCE:
                yield from self._encoded_apart(some)
                some, chars = [], 0
        yield from self._encoded_apart(some)

    def _encoded_apart(self, texts: list[str]) -> Iterator[bytes]:
        others: set[str] = set()
        split = [self._parts(text, others) for text in texts]
        if len(self.words) > REMEMBERED_WORDS:
            self.older, self.words = self.words, {}
        new = set().union(*split).difference(self.words)
        again = new.intersection(self.older)
        self.words.update((w, self.older[w]) for w in again)
        new -= again
        latin, other = list(new.difference(others)), list(new & others)
        self.words.update(zip(latin, self._encoded_parts(latin), strict=True))
        self.words.update(zip(other, self._encoded(other), strict=True))
        for parts in split:
            yield b"".join(map(self.words.__getitem__, parts))
        for long in [w for w in new if len(w) > REMEMBERED_CHARS]:
            del self.words[long]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary (fixed by the format)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@cache
def word_tokens(path: str) -> WordTokens:
    """One per worker process and tokenizer."""
    return WordTokens(path)


def cut_documents(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the ids of each text and
    the end id, cut into pieces of ``capacity`` only where they are longer.

    The tokenizer must split at blanks and line ends; words are tokenised once
    and remembered, within a bound, by each worker.
    """
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = word_tokens(path)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch["text"]]
            for doc_id, ids in zip(batch["doc_id"], by.encode(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInPandas(cut, PIECE + ", ids binary" * with_ids)


# --- The plan: numbers per length, independent of the size of the input -------


def _patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to four lengths that fill a sequence best, zero-padded to four.

    Each begins with every length in use; lengths between are the longest in use
    below some parts of the space left, and the last is the longest that fits.
    """
    lengths = np.flatnonzero(counts)
    # The longest length in use that is at most x, by x.
    fits = np.zeros(capacity + 1, np.int64)
    fits[lengths] = lengths
    fits = np.maximum.accumulate(fits)
    rows = [np.stack([lengths, fits[capacity - lengths]], 1)]
    for choices in MIDDLE_CHOICES:
        open_rows = lengths[:, None]
        for many in choices:
            space = capacity - open_rows.sum(1)
            tried = [np.column_stack([open_rows, fits[space * part // (many + 1)]]) for part in range(1, many + 1)]
            open_rows = np.concatenate(tried)
        rows.append(np.column_stack([open_rows, fits[capacity - open_rows.sum(1)]]))
    padded = [np.pad(r, ((0, 0), (0, PATTERN_PIECES - r.shape[1]))) for r in rows]
    return np.unique(np.sort(np.concatenate(padded), axis=1)[:, ::-1], axis=0)


def _least_squares(patterns: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Repeats x >= 0 with least ``|P x - counts|² ``, wasteful patterns costing extra.

    Accelerated projected gradient over the non-zero entries of P.
    """
    goal = counts.astype(float)
    waste = 1.0 - patterns.sum(1) / capacity
    price = 0.05 * waste * max(goal.max(), 1.0)
    step = 1.0 / max(1.0, PATTERN_PIECES * np.bincount(patterns.ravel(), minlength=capacity + 1)[1:].max())
    x = np.zeros(len(patterns))
    ahead, t = x, 1.0
    for _ in range(NNLS_STEPS):
        made = np.bincount(patterns.ravel(), np.repeat(ahead, patterns.shape[1]), capacity + 1)
        miss = made - goal
        miss[0] = 0.0
        new = np.maximum(0.0, ahead - step * (miss[patterns].sum(1) + price))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = np.maximum(0.0, new + (t - 1) / t_new * (new - x))
        x, t = new, t_new
    return x


Plan = list[tuple[int, list[tuple[int, int]]]]


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """``(repeats, [(length, how many of it), …])`` for each pattern used.

    ``counts[l]`` is the number of pieces of length l; the plan holds each once.
    The plan of fewest sequences is kept: fitting all patterns at once is best
    unless lengths are spread so evenly that short pieces must be saved for long ones.
    """
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    best: Plan | None = None
    for order in ORDERS:
        used = _fitted(counts, capacity, order)
        if best is None or _sequences(used) < _sequences(best):
            best = used
        if _sequences(best) == least:
            break
    return best


def _sequences(used: Plan) -> int:
    return sum(times for times, _ in used)


def _fitted(counts: np.ndarray, capacity: int, order: list[tuple[float, float, int]]) -> Plan:
    """Patterns are enumerated, fitted and rounded again on what the rounds before
    left, until none that a step allows is left; best fit packs the residuals."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used: Plan = [(int(left[capacity]), [(capacity, 1)])] if left[capacity] else []
    left[capacity] = 0
    for longest, waste, most in order:
        over = int(longest * capacity)
        while left[over + 1 :].any():
            patterns = _patterns(left, capacity)
            allowed = (patterns[:, 0] > over) & ((patterns > 0).sum(1) <= most)
            patterns = patterns[allowed & (patterns.sum(1) >= capacity * (1 - waste))]
            placed = _rounded(left, patterns, _least_squares(patterns, left, capacity)) if len(patterns) else []
            if not placed:
                break
            used += placed
    return used + _best_fit(left, capacity)


def _rounded(left: np.ndarray, patterns: np.ndarray, fitted: np.ndarray) -> Plan:
    """Whole repeats of the patterns, taken from ``left``: the fitted repeats rounded
    down, then one more of each pattern whose rest is at least half the greatest rest,
    as far as pieces last; those of the longest pieces first, the hardest to place."""
    used: Plan = []
    whole = np.floor(fitted)
    rest = fitted - whole
    more = (rest > 0) & (rest >= rest.max() / 2)
    order = np.lexsort((-fitted, -patterns.sum(1), -patterns[:, 0]))
    for repeats in (whole.astype(np.int64), more.astype(np.int64)):
        for j in order[repeats[order] > 0]:
            lengths, many = np.unique(patterns[j][patterns[j] > 0], return_counts=True)
            times = int(min(repeats[j], (left[lengths] // many).min()))
            if times > 0:
                left[lengths] -= times * many
                used.append((times, [(int(a), int(b)) for a, b in zip(lengths[::-1], many[::-1], strict=True)]))
    return used


def _best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Sequences filled with the longest piece that still fits, in bulk; empties ``left``."""
    used: Plan = []
    while left.any():
        space, runs = capacity, []
        longest = int(np.flatnonzero(left)[-1])
        while longest:
            take = int(min(left[longest], space // longest))
            runs.append((longest, take))
            space -= take * longest
            below = np.flatnonzero(left[: min(space, longest - 1) + 1])
            longest = int(below[-1]) if len(below) else 0
        times = min(int(left[a]) // b for a, b in runs)
        for a, b in runs:
            left[a] -= times * b
        used.append((times, runs))
    return used


class Places:
    """Where the r-th piece of a length goes.  The number of intervals is bounded by the
    number of patterns, not by the number of pieces."""

    def __init__(self, used: Plan) -> None:
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for times, runs in used:
            offset = 0
            for length, many in runs:
                start = taken.get(length, 0)
                taken[length] = start + times * many
                rows.append((length, start, sequence, many, offset))
                offset += length * many
            sequence += times
        rows.sort()
        self.sequences = sequence
        columns = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = (columns[0] << np.int64(44)) | columns[1]
        self.start, self.base, self.many, self.offset = columns[1:]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << np.int64(44)) | rank, side="right") - 1
        inside = rank - self.start[at]
        return self.base[at] + inside // self.many[at], self.offset[at] + inside % self.many[at] * length


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces``, whose ``length`` is 1 to ``capacity``.

    Pieces are written once; their histogram is all that reaches the driver.
    Numbers within a length come from groups of bounded size, so that a length
    that most pieces share is spread over many tasks.
    """
    spark = pieces.sparkSession
    rows = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))

    groups = int(counts.sum()) // GROUP_ROWS + 1
    keyed = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("length", "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    ranked = (
        keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")))
        .join(offsets, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    )

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.*")


def assemble(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the sequences themselves, from packed pieces with ``ids``.

    A group has at most ``capacity`` tokens.
    """
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
