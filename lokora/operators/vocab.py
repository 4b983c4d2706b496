"""Vocabulary jobs: word counts, subword merges, dictionaries, encoding."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.operators.ordering import global_index
from lokora.session import spread, stage_table

# Ship the helpers below with their UDFs, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- Fixed values ----------------------------------------------------------
WORD_END = "</w>"
JOINER = "@@"
RESERVED = ("<s>", "<pad>", "</s>", "<unk>")
UNKNOWN_ID = 3
EOS_ID = 2
NUM_MERGES = 30_000
MIN_PAIR_COUNT = 2
MERGE_BATCH = 64
# ---------------------------------------------------------------------------

# A dictionary up to this many bytes is broadcast; a larger one is joined.
MAX_BROADCAST_BYTES = 16 << 20
# Pairs that the driver looks at in a round.
LOOK = 50_000
# Symbols that one task merges on its own: bounds its memory.
LOCAL_SYMBOLS = 2_000_000
# Words, or parts of words, remembered per task.
CACHE_WORDS = 200_000


def language_lines(df: DataFrame, columns: Sequence[str] = ("src", "tgt")) -> DataFrame:
    """Both languages as one column of lines, from one scan."""
    return df.select(F.explode(F.array(*columns)).alias("line"))


def token_counts(df: DataFrame, column: str = "line") -> DataFrame:
    """``(token, cnt)`` of blank-separated text; counted in the map tasks first."""
    return (
        df.select(F.explode_outer(F.split(F.col(column), " ", -1)).alias("token"))
        .filter(F.col("token") != "")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


subword_vocabulary = token_counts


def start_symbols(counts: DataFrame) -> DataFrame:
    """Each word as blank-separated characters, the last one with the end mark."""
    chars = F.filter(F.split("token", ""), lambda c: c != "")
    return counts.select("token", "cnt", F.concat(F.array_join(chars, " "), F.lit(WORD_END)).alias("symbols"))


def pair_counts(state: DataFrame, *more: Column) -> DataFrame:
    """Adjacent symbol pairs weighted by word count; ``more`` aggregates of ``cnt`` and the
    word's number of symbols, ``size``."""
    words = state.select("cnt", F.split("symbols", " ").alias("s"))
    pairs = F.arrays_zip(
        F.slice("s", F.lit(1), F.size("s") - 1).alias("l"),
        F.slice("s", F.lit(2), F.size("s") - 1).alias("r"),
    )
    return (
        words.filter(F.size("s") > 1)
        .select("cnt", F.size("s").alias("size"), F.inline_outer(pairs).alias("left", "right"))
        .groupBy("left", "right")
        .agg(F.sum("cnt").alias("cnt"), *more)
    )


def _join_pairs(symbols: list[str], pairs: set[tuple[str, str]]) -> list[str]:
    """One left-to-right pass that joins every listed pair."""
    out: list[str] = []
    joined = False
    for symbol in symbols:
        if out and not joined and (out[-1], symbol) in pairs:
            out[-1] += symbol
            joined = True
        else:
            out.append(symbol)
            joined = False
    return out


class _Larger(tuple):
    """A pair that comes first on a heap if it is the larger one."""

    __slots__ = ()
    __lt__ = tuple.__gt__


class _Merger:
    """Merges of some words, or parts of words, with their pair counts kept up to date.

    They hold every occurrence of the pairs that are more frequent than ``floor``;
    other pairs may also occur elsewhere, ``floor`` times at most.  A new pair holds
    one of the first pairs at its seam.  Where all its occurrences have the same one,
    they are all here, or they are ``floor`` at most.
    """

    def __init__(self, words: Sequence[str], counts: Sequence[int], floor: int, made: set[str]) -> None:
        self.words, self.counts = [w.split(" ") for w in words], [int(c) for c in counts]
        self.floor, self.made = floor, set(made)
        self.totals: dict[tuple[str, str], int] = defaultdict(int)
        self.holders: dict[tuple[str, str], set[int]] = defaultdict(set)
        for i, word in enumerate(self.words):
            for pair in zip(word, word[1:]):
                self.totals[pair] += self.counts[i]
                self.holders[pair].add(i)
        self.heap = [(-n, _Larger(p)) for p, n in self.totals.items()]
        heapify(self.heap)
        # First symbols that a made symbol may start and end with; several where it
        # was made in several ways, so that its pairs have several seams.
        self.starts: dict[str, set[str]] = {}
        self.ends: dict[str, set[str]] = {}
        self.most_starts = self.most_ends = 1
        self.unsure: list[tuple[int, _Larger]] = []

    def _best(self, heap: list[tuple[int, _Larger]]) -> tuple[int, tuple[str, str]] | None:
        while heap:
            count, pair = heap[0]
            if self.totals.get(tuple(pair)) == -count:
                return -count, tuple(pair)
            heappop(heap)
        return None

    def _most_unsure(self) -> int:
        """How often a pair with several seams may occur at most."""
        while self.unsure:
            bound, pair = self.unsure[0]
            n = self.totals.get(tuple(pair), 0)
            now = -n - (self._seams(pair) - 1) * self.floor
            if n and now == bound:
                return -bound
            heappop(self.unsure)  # ``_count`` has pushed the pair as it is now
        return 0

    def _seams(self, pair: tuple[str, str]) -> int:
        return len(self.ends.get(pair[0], "1")) * len(self.starts.get(pair[1], "1"))

    def next(self, min_count: int) -> tuple[str, str] | None:
        """The pair to merge, if it is certain that no other one comes first."""
        best = self._best(self.heap)
        # A pair of which nothing is here may have ``floor`` occurrences at each seam.
        if best is None or best[0] <= self.floor * self.most_ends * self.most_starts or best[0] < min_count:
            return None
        if self._most_unsure() >= best[0]:
            return None
        return best[1]

    def merge(self, pair: tuple[str, str]) -> None:
        """Join a pair in the words that hold it; only their pairs are counted anew."""
        symbol = pair[0] + pair[1]
        again = self.floor > 0 and symbol in self.made
        if self.floor > 0:
            old = {symbol} if again else set()
            self.starts[symbol] = self.starts.get(symbol, old) | self.starts.get(pair[0], {pair[0]})
            self.ends[symbol] = self.ends.get(symbol, old) | self.ends.get(pair[1], {pair[1]})
            self.most_starts = max(self.most_starts, len(self.starts[symbol]))
            self.most_ends = max(self.most_ends, len(self.ends[symbol]))
        self.made.add(symbol)
        changed: dict[tuple[str, str], int] = defaultdict(int)
        for i in self.holders.pop(pair):
            old = self.words[i]
            new = _join_pairs(old, {pair})
            if len(new) == len(old):
                continue  # the pair went with an earlier merge
            self.words[i] = new
            for p in zip(old, old[1:]):
                changed[p] -= self.counts[i]
            for p in zip(new, new[1:]):
                changed[p] += self.counts[i]
                self.holders[p].add(i)
        for p, n in changed.items():
            if n:
                self._count(p, self.totals[p] + n)
        self.totals.pop(pair, None)
        if again:
            for p, n in self.totals.items():
                if symbol in p and (seams := self._seams(p)) > 1:
                    heappush(self.unsure, (-n - (seams - 1) * self.floor, _Larger(p)))

    def _count(self, pair: tuple[str, str], n: int) -> None:
        if n <= 0:
            self.totals.pop(pair, None)
            return
        self.totals[pair] = n
        heappush(self.heap, (-n, _Larger(pair)))
        if self.floor > 0 and (seams := self._seams(pair)) > 1:
            heappush(self.unsure, (-n - (seams - 1) * self.floor, _Larger(pair)))


def _local_round(parts: DataFrame, floor: int, min_count: int, most: int, made: set[str]) -> list[tuple[str, str]]:
    """One task merges ``parts`` (bounded by ``LOCAL_SYMBOLS``); the merges in order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("symbols")
        merger = _Merger(group["symbols"], group["cnt"], floor, made)
        out: list[tuple[int, str, str]] = []
        while len(out) < most and (pair := merger.next(min_count)):
            merger.merge(pair)
            out.append((len(out), *pair))
        return pd.DataFrame(out, columns=["rank", "left", "right"]).astype({"rank": "int32"})

    found = parts.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "rank int, left string, right string")
    return [(r.left, r.right) for r in sorted(found.collect(), key=lambda r: r.rank)]


def _counted(found: dict[str, int]) -> pd.DataFrame:
    return pd.DataFrame({"symbols": list(found), "cnt": list(found.values())}).astype({"symbols": object, "cnt": "int64"})


def _parts(state: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(symbols, cnt)``: the runs of words in which each pair is one of ``pairs``."""
    wanted = set(pairs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = defaultdict(int)
        for batch in batches:
            for word, n in zip(batch["symbols"], batch["cnt"], strict=True):
                symbols = word.split(" ")
                start = 0
                for i in range(1, len(symbols) + 1):
                    if i == len(symbols) or (symbols[i - 1], symbols[i]) not in wanted:
                        if i - start > 1:
                            found[" ".join(symbols[start:i])] += n
                        start = i
            if len(found) > CACHE_WORDS:
                yield _counted(found)
                found.clear()
        yield _counted(found)

    cuts = state.select("symbols", "cnt").mapInPandas(cut, "symbols string, cnt bigint")
    return cuts.groupBy("symbols").agg(F.sum("cnt").alias("cnt"))


def learn_subwords(
    counts: DataFrame,
    num_merges: int = NUM_MERGES,
    batch: int = MERGE_BATCH,
    min_count: int = MIN_PAIR_COUNT,
    local_symbols: int = LOCAL_SYMBOLS,
) -> DataFrame:
    """Learn ``(rank, left, right)`` merges from word counts ``(token, cnt)``.

    Byte-pair encoding over word types (Sennrich et al. 2016), ties to the larger
    pair; the outcome does not depend on ``batch`` and ``local_symbols``.

    The corpus is read once, for ``counts``; the driver sees leading pairs and merges.
    A round counts the pairs of the word-type table, and cuts the words wherever a
    pair is none of the leading ones: what is left are short runs, most of them in
    many words, that are counted in the tasks.  At most ``local_symbols`` symbols of
    them go to one task, which merges and keeps its pair counts up to date until a
    pair that is cut elsewhere may have its turn.  Then all words are merged that far.
    ``batch`` is the number of leading pairs of the first round; it doubles as long as
    the runs are few.
    """
    spark = counts.sparkSession
    state = stage_table(spread(start_symbols(counts), "token"), "subword-state")
    merges: list[tuple[str, str]] = []
    made: set[str] = set()
    lead = batch
    while len(merges) < num_merges:
        most = num_merges - len(merges)
        symbols = state.agg(F.sum(F.size(F.split("symbols", " ")))).first()[0] or 0
        if symbols <= local_symbols:
            merges.extend(_local_round(state.select("symbols", "cnt"), 0, min_count, most, made))
            break
        leading = (
            pair_counts(state)
            .filter(F.col("cnt") >= min_count)
            .orderBy(F.desc("cnt"), F.desc("left"), F.desc("right"))
            .limit(LOOK)
            .collect()
        )
        if not leading:
            break
        # The first pair is certain, whatever follows.
        new = [(leading[0].left, leading[0].right)]
        shrunk = False
        while lead > 1:
            whole = lead >= len(leading) and len(leading) < LOOK
            floor = min_count - 1 if whole else leading[min(lead, len(leading) - 1)].cnt
            tracked = [(row.left, row.right) for row in leading[:lead] if row.cnt > floor]
            if not tracked:  # as many pairs are equally frequent
                if shrunk or lead >= len(leading):
                    break
                lead *= 2
                continue
            parts = stage_table(_parts(state, tracked), "subword-parts")
            size = parts.agg(F.sum(F.size(F.split("symbols", " ")))).first()[0]
            if size <= local_symbols:
                new = _local_round(parts, floor, min_count, most, made)
                if size <= local_symbols // 4:
                    lead = min(lead * 2, LOOK)
                break
            lead, shrunk = lead // 2, True
        lead = max(lead, 2)
        state = stage_table(_apply_merges(state, new), "subword-state")
        merges.extend(new)
        made.update(left + right for left, right in new)
    rows = [(rank, left, right) for rank, (left, right) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank int, left string, right string")


def _merge_in_order(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The listed pairs joined one after the other; a pair's turn comes once."""
    last = -1
    while len(symbols) > 1:
        turns = [r for p in zip(symbols, symbols[1:]) if (r := ranks.get(p, -1)) > last]
        if not turns:
            break
        last = min(turns)
        symbols = _join_pairs(symbols, {p for p in zip(symbols, symbols[1:]) if ranks.get(p) == last})
    return symbols


def _apply_merges(state: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """The word-type table after some merges, one-symbol words left out."""
    ranks = {pair: rank for rank, pair in enumerate(merges)}

    @F.pandas_udf("string")
    def join(words: pd.Series) -> pd.Series:
        return words.map(lambda word: " ".join(_merge_in_order(word.split(" "), ranks)))

    joined = state.withColumn("symbols", join("symbols"))
    return joined.filter(F.col("symbols").contains(" "))


def _segment(word: str, ranks: dict[tuple[str, str], int]) -> str:
    """One word in subword pieces: the earliest-learnt pair is joined first."""
    symbols = [*word[:-1], word[-1] + WORD_END]
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        symbols = _join_pairs(symbols, {best})
    symbols[-1] = symbols[-1].removesuffix(WORD_END)
    return f"{JOINER} ".join(symbols)


def apply_subwords(df: DataFrame, columns: Sequence[str], merges: DataFrame) -> DataFrame:
    """Replace each listed text column by its subword form.

    Map-only: a task keeps the words it has met, so a frequent word is segmented
    once per task and never shuffled.  The merge table is a model, as large as
    it was learnt, and sent to each executor once.
    """
    ranks = {(r.left, r.right): r.rank for r in merges.collect()}
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("string")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cached = lru_cache(CACHE_WORDS)(lambda word: _segment(word, shared.value))
        for text in batches:
            yield text.map(lambda t: " ".join(cached(w) for w in t.split(" ") if w))

    return df.withColumns({c: segment(F.coalesce(F.col(c), F.lit(""))) for c in columns})


def build_dictionary(counts: DataFrame, extra_tokens: Sequence[str] = ()) -> DataFrame:
    """``(token, cnt, id)``: most frequent first, then by token, after the reserved ids.

    ``extra_tokens`` get an entry even when the corpus does not have them.
    """
    spark = counts.sparkSession
    if extra_tokens:
        extra = spark.createDataFrame([(t, 0) for t in extra_tokens], "token string, cnt bigint")
        counts = counts.unionByName(extra).groupBy("token").agg(F.sum("cnt").alias("cnt"))
    numbered = global_index(counts, [F.desc("cnt"), F.col("token")], "_n")
    return numbered.select("token", "cnt", (F.col("_n") + len(RESERVED)).alias("id"))


def encode_corpus(
    df: DataFrame,
    column: str,
    dictionary: DataFrame,
    key: Sequence[str],
    out: str = "ids",
    eos: bool = False,
    max_broadcast: int = MAX_BROADCAST_BYTES,
    near: Sequence[str] = (),
) -> DataFrame:
    """Token ids in order, per row of ``df`` (``key`` is its unique key).

    Among rows that agree in ``near``, some columns of the key, equal lines are
    encoded once.

    Rows are placed by key first and keep that place through the token join, so
    tokens go back to their row without a second shuffle.  A token carries two numbers
    for its row, which rise as the rows are read, so that there is little to sort; only
    the first one carries the key.  Of a dictionary over ``max_broadcast`` bytes the
    frequent tokens are sent to every task, and only the other tokens of the text move
    to be looked up.
    """
    # As one value, so that rows with a null in their key join too.
    row = F.struct(*key).alias("_row")
    hashed = F.xxhash64(*(near or key)).alias("_hash")
    placed = df.select(hashed, row, F.col(column).alias("_line")).repartition("_hash")
    if near:
        # The rows of a line, in an order that any evaluation repeats.
        of_line = F.sort_array(F.collect_list("_row")).alias("_row")
        placed = placed.groupBy("_hash", *[F.col("_row")[k] for k in near], "_line").agg(of_line)
    numbered = placed.withColumn("_no", F.monotonically_increasing_id())
    tokens = numbered.select("_no", "_hash", "_row", F.posexplode_outer(F.split("_line", " ", -1)).alias("_pos", "token"))
    ids = dictionary.select("token", F.col("id").cast("int").alias("_id"))
    frequent = _first_ids(ids, max_broadcast)
    looked_up = tokens.join(F.broadcast(ids if frequent is None else frequent), "token", "left")
    # Two blanks in a row, or one at an end, have no token between them.
    place = F.col("token") != ""
    # Position and id as one number, which sorts by position.
    found = F.shiftleft(F.col("_pos").cast("long"), 32).bitwiseOR(F.coalesce("_id", F.lit(UNKNOWN_ID)).cast("long"))
    own = F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_row")).alias("_own")

    def by_row(entry: Column) -> DataFrame:
        listed = looked_up.select("_no", "_hash", own, entry.alias("_e")).groupBy("_no", "_hash")
        return listed.agg(F.first("_own", ignorenulls=True).alias("_row"), F.collect_list("_e").alias("_e"))

    if frequent is None:
        ordered = by_row(F.when(place, found))
        entries = F.col("_e")
    else:
        # Only tokens that are not frequent are looked up by a shuffle, and return to the place of their row.
        name = (F.col("_row")[0] if near else F.col("_row")).alias("_name")
        rare = looked_up.filter(place & F.col("_id").isNull()).select("_hash", name, "_pos", "token")
        others = rare.join(ids, "token", "left").select("_hash", "_name", found.alias("_o")).repartition("_hash")
        others = others.groupBy("_hash", "_name").agg(F.collect_list("_o").alias("_o"))
        others = others.withColumnsRenamed({"_hash": "_at", "_name": "_whose"})
        ordered = by_row(F.when(place & F.col("_id").isNotNull(), found)).withColumn("_name", name)
        # As a second key, an equal name would move all rows again.
        same = (F.col("_name") <= F.col("_whose")) & (F.col("_name") >= F.col("_whose"))
        ordered = ordered.join(others, (F.col("_hash") == F.col("_at")) & same, "left")
        entries = F.when(F.col("_o").isNull(), F.col("_e")).otherwise(F.concat("_e", "_o"))
    encoded = F.transform(F.sort_array(entries), lambda e: e.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    if eos:
        encoded = F.concat(encoded, F.array(F.lit(EOS_ID)))
    rows = ordered.select(F.explode("_row") if near else F.col("_row"), encoded.alias(out)).toDF("_row", out)
    return rows.select(*[F.col("_row")[k].alias(k) for k in key], out)


def _first_ids(ids: DataFrame, max_bytes: int) -> DataFrame | None:
    """The lowest ids, those of the most frequent tokens, as far as ``max_bytes`` go; none
    where all tokens are that few."""
    # A token takes two words of a row and its bytes.
    row = F.octet_length("token") + 16
    n, size = ids.agg(F.count(F.lit(1)), F.sum(row.cast("long"))).first()
    if (size or 0) <= max_bytes:
        return None
    return ids.filter(F.col("_id") < len(RESERVED) + max_bytes * n // size)


def oov_report(encoded: DataFrame, by: Sequence[str], column: str = "ids") -> DataFrame:
    """Tokens and unknown tokens per group."""
    unknown = F.size(F.filter(F.col(column), lambda i: i == UNKNOWN_ID))
    return encoded.groupBy(*by).agg(
        F.sum(F.size(column)).alias("tokens"), F.sum(unknown).alias("unknown")
    )


def dictionary_corpus(
    matrix: DataFrame,
    general: DataFrame,
    src_lang: str,
    tgt_lang: str,
    sample_rows: int = 10,
    order: Sequence[str] = ("repo", "filepath", "pos"),
) -> DataFrame:
    """``(lang, line)``: the text from which the joint dictionary is counted.

    General training text ``(src, tgt)``, the first ``sample_rows`` neighbour
    training rows (they bring the tag in), and the domain and filename sets of the
    first direction with the held-out-app evaluation sets.
    """
    first = matrix.filter(
        (F.col("direction") == f"{src_lang}-{tgt_lang}") & (F.col("eval_set") == "unknown")
    )
    is_train = F.col("split") == "train"
    sample = (
        first.filter((F.col("cxt_type") == "neighbour") & is_train)
        .orderBy(*order)
        .limit(sample_rows)
    )
    full = first.filter(F.col("cxt_type").isin("domain", "filename"))

    def by_language(df: DataFrame, src: str, tgt: str) -> DataFrame:
        def side(lang: str, column: str) -> Column:
            return F.struct(F.lit(lang).alias("lang"), F.col(column).alias("line"))

        return df.select(F.inline(F.array(side(src_lang, src), side(tgt_lang, tgt))))

    return (
        by_language(general, "src", "tgt")
        .unionByName(by_language(sample, "input", "output"))
        .unionByName(by_language(full, "input", "output"))
    )
