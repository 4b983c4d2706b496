"""Similar documents by a token-group matrix.

A document is the set of its word shingles; equal sets are one class.  Classes
are partitioned into groups of similar ones, the matrix holds which tokens the
union of a group has, and a class is compared with the members of a group only
if its overlap with the union allows a similar member.

* Tokens have one fixed order, rare ones first (counts of ``BUCKETS`` hash buckets,
  then the hash).  Of two similar sets the first ``n - ceil(t * n) + DEPTH`` tokens
  share ``DEPTH`` at least, so that only this prefix of each class enters the matrix
  and the bound stays exact.  Tokens that a single class holds are left out.
* Groups are components of classes and the leaders of their minwise buckets.  A
  large set of near copies thereby is one group, and a row of the matrix for each
  token, however many they are.
* A class that may overlap a group enough (sizes and shared prefix tokens) is first
  compared with a member that holds one of their shared tokens, and so are classes
  with their leaders and with some members of their groups.  Groups that are still
  apart in whole or in part are then opened: whoever is outside the largest part is
  compared with all others.  Blocks of both meet in cells of bounded size, where
  matrix products count the shared tokens of all pairs and only links come out.

Links are confirmed on full sets, and none is missed: the only approximation, the
minwise buckets, decides how groups are formed, not what is found.

Defined cases: a null or empty text has an empty set and is linked with nothing.
Fewer words than a shingle make one shingle of all.  Rows that share a doc_id are
one document where their sets are equal; else each is compared, and the id's
component is that of the row.  Rows without doc_id are linked with nothing.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import mix, partitions, pick, signed, stage, stage_bucketed
from lokora.llm.components import components
from lokora.llm.shingles import shared_tokens, shingle_set, wanted_sets

# Counters of the token order, in slices: a table of this size goes through the driver.
BUCKETS = 1 << 20
SLICE = 1 << 14
# Prefix tokens that two similar sets share at least.
DEPTH = 4
KEYS, BANDS, LEAST_KEYS = 8, 4, 4
# Members of a group that are compared in pairs; a wider group is opened in cells after that.
OPENED = 16
# Members, and tokens of their sets, that a block of a cell holds on average.
BLOCK_ROWS, BLOCK_TOKENS = 1024, 1 << 18

_rng = np.random.default_rng(13)
MULTIPLY = _rng.integers(1, 2**63, KEYS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, KEYS, np.uint64)
BLOCK = 8192  # tokens hashed at once by all functions

PROFILE = "doc_id long, version long, n long, hi long, lo long, keys array<long>, slice int, counts binary"


def least(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any similar set at least."""
    return -(-n * percent // 100)


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(BUCKETS - 1)).astype(np.int64)


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set in the order of their buckets' counts."""
    n = len(tokens)
    keep = min(n, n - least(n, percent) + DEPTH)
    return tokens[np.lexsort((tokens, counts[bucket(tokens)]))[:keep]]


def minwise(tokens: np.ndarray) -> np.ndarray:
    out = np.full(KEYS, 2**64 - 1, np.uint64)
    for at in range(0, len(tokens), BLOCK):
        out = np.minimum(out, (tokens[at : at + BLOCK, None] * MULTIPLY + ADD).min(0))
    return mix(out)


def profiles(rows: DataFrame, width: int) -> DataFrame:
    """Size, digest and minwise keys of each set; the bucket counts of each task in slices."""
    names = [c.split()[0] for c in PROFILE.split(", ")]

    def frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=names).astype({"doc_id": "Int64", "version": "Int64", "slice": "Int64"})

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            out = []
            for doc_id, version, text in zip(batch["doc_id"], batch["version"], batch["text"], strict=True):
                tokens = shingle_set(text, width)
                if len(tokens):
                    # Tokens of a set differ, but two may share a bucket.
                    np.add.at(counts, bucket(tokens), 1)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
                    out.append((doc_id, version, len(tokens), *digest, signed(minwise(tokens)), None, None))
                else:
                    out.append((doc_id, version, 0, 0, 0, None, None, None))
            yield frame(out)
        parts = counts.reshape(-1, SLICE)
        yield frame([(None, None, -1, 0, 0, None, k, part.tobytes()) for k, part in enumerate(parts) if part.any()])

    return rows.mapInPandas(profile, PROFILE)


def token_counts(found: DataFrame) -> np.ndarray:
    """Documents by bucket of their tokens, summed over all tasks."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch["slice"], batch["counts"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.int32).astype(np.int64)
        yield pd.DataFrame([(k, v.tobytes()) for k, v in sums.items()], columns=["slice", "counts"])

    parts = found.filter("n < 0").select("slice", "counts")
    # A task adds up what it gets row by row, however many tasks there were before.
    dealt = parts.repartition(min(partitions(found.sparkSession), BUCKETS // SLICE), "slice")
    total = np.zeros(BUCKETS, np.int64)
    for row in dealt.mapInPandas(add, "slice int, counts binary").collect():
        total[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.int64)
    return total.astype(np.float32)


def prefixes(rows: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``(hi, lo, tokens)``: digest and prefix of each set that is not empty."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                tokens = shingle_set(text, width)
                if len(tokens):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
                    out.append((digest[0], digest[1], signed(prefix(tokens, shared.value, percent))))
            yield pd.DataFrame(out, columns=["hi", "lo", "tokens"])

    return rows.mapInPandas(cut, "hi long, lo long, tokens array<long>")


class _Links:
    """The classes connected so far, by links that are confirmed on full sets."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.of = classes.select("rep", F.col("rep").alias("label"))

    def now(self, rep: str, label: str) -> DataFrame:
        return self.of.select(F.col("rep").alias(rep), F.col("label").alias(label))

    def test(self, pairs: DataFrame) -> None:
        """Confirm ``(a, b)`` on full sets and connect what is similar."""
        apart = pairs.select("a", "b").join(self.now("a", "la"), "a").join(self.now("b", "lb"), "b").filter("la <> lb")
        left = self.sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_a"))
        right = self.sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_b"))
        shared = F.size(F.array_intersect("_a", "_b"))
        enough = shared * (100 + self.percent) >= (F.size("_a") + F.size("_b")) * self.percent
        links = apart.join(left, "a").join(right, "b").filter(enough)
        self.connect(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))

    def connect(self, links: DataFrame) -> None:
        """Join the components of labels ``(a, b)``."""
        joined = components(links)
        joined = joined.select(F.col("node").alias("label"), F.col("label").alias("_label"))
        moved = self.of.join(joined, "label", "left")
        self.of = stage(moved.select("rep", F.coalesce("_label", "label").alias("label")), "labels")


def _similar_sizes(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def leader_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: classes and leaders of their minwise buckets that agree in most keys."""
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> struct(k as band, keys[k] as key))")
    banded = members.select("rep", "n", "keys", F.inline(bands))
    leaders = banded.groupBy("band", "key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"))
    leaders = leaders.filter("first <> last").select("band", "key", F.expr("if(band % 2 = 0, first, last) as leader"))
    led = banded.join(leaders, ["band", "key"]).filter("rep <> leader").select("rep", "n", "keys", "leader").distinct()
    of_leader = members.select(F.col("rep").alias("leader"), F.col("n").alias("m"), F.col("keys").alias("own"))
    agree = F.expr(f"size(filter(zip_with(keys, own, (x, y) -> x = y), e -> e)) >= {LEAST_KEYS}")
    alike = led.join(of_leader, "leader").filter(F.expr(_similar_sizes("n", "m", percent)) & agree)
    return alike.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def qualifying(tokens: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``(rep, n, group, sample)``: classes and the other groups that may hold a similar member.

    ``groups`` is ``(rep, n, group, members, turn)``.  Of two groups the smaller one asks.
    """
    rows = tokens.join(groups.select("rep", "n", "group", "members"), "rep")
    rows = rows.withColumn("place", F.struct("members", -F.col("group")))
    matrix = rows.groupBy("token", "group", "place").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("rep").alias("sample")
    )
    m = matrix.select("token", F.col("group").alias("other"), F.col("place").alias("other_place"), "low", "high", "sample")
    within = f"100 * high >= {percent} * n and 100 * n >= {percent} * low"
    met = rows.select("rep", "n", "token", "place").join(m, "token").filter(f"place < other_place and {within}")
    enough = f"hits >= least({DEPTH}, (n * {percent} + 99) div 100)"
    overlap = met.groupBy("rep", "n", "other").agg(F.count(F.lit(1)).alias("hits"), F.min("sample").alias("sample"))
    return overlap.filter(enough).select("rep", "n", F.col("other").alias("group"), "sample")


def similar_groups(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row: links are pairs with
    ``100 * |A & B| >= percent * |A | B|``, components take the smallest doc_id."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "version": F.xxhash64("text")}
    )
    found = stage(profiles(rows, width), "profiles")
    own = found.filter("n >= 0").select("doc_id", "version", "n", "hi", "lo", "keys")
    classes = stage(
        own.filter("n > 0 and doc_id is not null")
        .groupBy("hi", "lo")
        .agg(F.min(F.struct("doc_id", "version")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    led = stage(leader_pairs(classes, percent), "leader-pairs")
    groups = _grouped(classes, led)
    tokens = _shared_tokens(rows.filter("doc_id is not null"), classes, width, percent, token_counts(found))
    asked = stage(qualifying(tokens, groups, percent), "asked")

    # Only these classes can be similar to another one.
    opened = groups.join(asked.select("group").distinct(), "group", "left_semi").select("rep")
    wanted = asked.select("rep").union(opened).union(groups.filter("members > 1").select("rep")).distinct()
    wanted = stage(classes.join(wanted, "rep").select("hi", "lo", "rep", "first"), "wanted")
    sets = stage_bucketed(wanted_sets(rows, width, wanted), "token_sets", "rep")
    links = _Links(wanted, sets, percent)
    links.test(led)
    links.test(asked.select(F.col("rep").alias("a"), F.col("sample").alias("b")))
    _open(links, asked, groups, percent)

    labels = classes.select("hi", "lo", "rep", "first").join(links.of, "rep", "left")
    labels = labels.withColumn("label", F.coalesce("label", "rep"))
    smallest = labels.groupBy("label").agg(F.min("first.doc_id").alias("component_id"))
    by_set = labels.join(smallest, "label").select("hi", "lo", "component_id")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    out = own.join(by_set, ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(linked, "doc_id").alias("component_id"))


def _grouped(classes: DataFrame, led: DataFrame) -> DataFrame:
    """``(rep, n, group, members, turn)``: each class in the component of its leaders.

    ``turn`` spreads the members over as many turns as there are, in the order of a hash.
    """
    joined = components(led).select(F.col("node").alias("rep"), F.col("label").alias("_group"))
    grouped = classes.select("rep", "n").join(joined, "rep", "left")
    grouped = grouped.select("rep", "n", F.coalesce("_group", "rep").alias("group"))
    counted = grouped.join(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members")), "group")
    turn = F.expr("pmod(xxhash64(rep, 7), 1048576) / 1048576D * members")
    return stage(counted.select("rep", "n", "group", "members", turn.alias("turn")), "groups")


def _shared_tokens(rows: DataFrame, classes: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``(rep, token)``: the prefix tokens that more than one class holds."""
    cut = stage(prefixes(rows, width, percent, counts), "prefixes").dropDuplicates(["hi", "lo"])
    each = cut.join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).select("rep", F.explode("tokens").alias("token"))
    several = each.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    return stage(each.join(several.select("token"), "token"), "tokens")


def _open(links: _Links, asked: DataFrame, groups: DataFrame, percent: int) -> None:
    """Compare classes with all members of the groups ``(rep, n, group, sample)`` they asked
    for, and of their own, as far as the two are apart."""
    members = groups.filter("members > 1")
    inside = members.select("rep", "n", "group", F.lit(None).cast("long").alias("sample"), F.col("turn").alias("upto"))
    every = asked.withColumn("upto", F.lit(None).cast("double")).unionByName(inside)
    ask = every.withColumnRenamed("rep", "a").join(links.now("a", "la"), "a")
    held = groups.filter(f"turn < {OPENED}").select("group", F.col("rep").alias("b"), F.col("n").alias("m"), "turn")
    # Inside a group each pair comes once.
    once = "la <> lb and not (b <=> sample) and (upto is null or turn < upto or turn = upto and b < a)"
    met = ask.join(held.join(links.now("b", "lb"), "b"), "group")
    links.test(stage(met.filter(f"{once} and {_similar_sizes('n', 'm', percent)}").select("a", "b"), "opened"))

    wide = groups.filter(f"members > {OPENED}").select("group").distinct()
    present = groups.select("group", "rep", "n").union(asked.select("group", "rep", "n")).join(wide, "group", "left_semi")
    cells = stage(_cells(present.join(links.of, "rep")), "cells")
    compared = cells.join(links.sets, "rep").groupBy("group", "i", "j").applyInPandas(_comparer(percent), "a long, b long")
    links.connect(stage(compared, "cell-links"))


def _cells(present: DataFrame) -> DataFrame:
    """``(group, i, j, rep, label, asks)``: the blocks that meet, of the groups with several labels.

    Rows outside the largest part of their group ask: block ``i`` of them meets every block
    ``j`` of all rows.
    """
    parts = present.groupBy("group", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))

    def blocks(rows: Column, tokens: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(tokens / BLOCK_TOKENS))

    rows, tokens, most = F.sum("rows"), F.sum("tokens"), F.max(F.struct("rows", "tokens", "label"))
    sized = parts.groupBy("group").agg(
        most["label"].alias("main"),
        blocks(rows, tokens).alias("all"),
        blocks(rows - most["rows"], tokens - most["tokens"]).alias("open"),
    )
    dealt = present.join(sized.filter("open > 0"), "group")
    every = dealt.select(
        "group", F.explode(F.expr("sequence(0L, open - 1)")).alias("i"), F.expr("pmod(xxhash64(rep, 3), all)").alias("j"),
        "rep", "label", F.lit(False).alias("asks"),
    )
    outside = dealt.filter("label <> main").select(
        "group", F.expr("pmod(xxhash64(rep, 5), open)").alias("i"), F.explode(F.expr("sequence(0L, all - 1)")).alias("j"),
        "rep", "label", F.lit(True).alias("asks"),
    )
    return every.union(outside)


def _comparer(percent: int):
    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        """Labels ``(a, b)`` that links between asking and other rows of a cell connect."""
        asks = cell["asks"].to_numpy(bool)
        sizes = np.array([len(s) for s in cell["shingles"]], np.int64)
        shared = shared_tokens(list(cell["shingles"]), np.flatnonzero(asks), np.flatnonzero(~asks))
        total = sizes[asks][:, None] + sizes[~asks][None, :]
        x, y = np.nonzero(shared * (100 + percent) >= total * percent)
        labels = cell["label"].to_numpy(np.int64)
        found = np.sort(np.stack([labels[asks][x], labels[~asks][y]], 1), axis=1)
        found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return compare
