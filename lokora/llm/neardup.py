"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles.  Equal sets are one class from the
start; everything below works on one row per class.  Each of ``trees`` trees
puts the classes into nodes by one minwise token.  All pairs of a node of at most
``LEAF`` classes are candidates; the members of a larger one are compared with its pivot
(the class of most copies).  A node of more than ``SKETCH_BLOCK`` classes that still holds
several components branches on: each member into ``BRANCHES`` child nodes, by minwise
tokens that the path so far selects, ``DEPTH`` times at most.  The large nodes that remain are
compared exhaustively: whoever is outside the largest component with all others, in cells of
bounded size, the first tree's before those of the others, which leave out what
met there.  A pair of similarity 0.8 meets in a tree with a chance of 0.8, 0.96 times
as much for each branching, so that 8 trees miss it once in 390 000 times, and once in
43 000 behind two branchings; one at 0.85 once in 3 900 000 and 640 000.

Comparing is cheap first (sizes, 128-bit minwise sketches at almost five
deviations below the threshold) and exact then: links are confirmed on full
sets.  Links only matter between documents that are not connected yet.  So the
best partner of every class is tested first and components are joined; only then
are other pairs tested whose ends are still in different components, and
nodes within one component are dropped.  A large group of mutual near copies thereby
costs a few tests a member instead of all pairs, and a cell gives out links alone.

Defined cases: documents without words, or with a null text, have an empty set
and are linked with nothing.  Fewer words than a shingle make one shingle of
all.  Rows that share a doc_id are one document only where their sets are equal.
Rows without doc_id are linked with nothing and kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import Rows, mix, pick, signed, stage, stage_bucketed
from lokora.llm.components import components
from lokora.llm.shingles import shared_tokens, shingle_set, wanted_sets

SKETCH_BITS = 128
MINWISE = 64  # tokens kept to choose paths by
TREES, BRANCHES, DEPTH = 8, 2, 3
LEAF = 24
# Members of a block of a cell that compares sketches, and how many are taken at once.
# Nodes of more members than a block branch on.
SKETCH_BLOCK, SKETCH_STEP = 8192, 256
# Members, and tokens of their sets, that a block of a cell of full sets holds on average.
BLOCK_ROWS, BLOCK_TOKENS = 1024, 1 << 18
SINGLE_PAIRS = 20_000  # pairs of a cell that are intersected one by one; more by a matrix product
DEVIATIONS = 4.7

_rng = np.random.default_rng(20240607)
MULTIPLY = _rng.integers(1, 2**63, SKETCH_BITS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, SKETCH_BITS, np.uint64)
BLOCK = 8192  # shingles hashed at once by all functions

PROFILE = "doc_id long, version long, n_shingles long, hi long, lo long, mins array<int>, s1 long, s2 long"


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of ``SKETCH_BITS`` hash functions over a set."""
    least = np.full(SKETCH_BITS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        least = np.minimum(least, (part[:, None] * MULTIPLY + ADD).min(0))
    return mix(least)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Size, digest and minwise tokens of the shingle set of each ``(doc_id, version, text)``."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, version, text in zip(batch["doc_id"], batch["version"], batch["text"], strict=True):
                shingles = shingle_set(text, width)
                if len(shingles):
                    least = minwise(shingles)
                    s1, s2 = np.packbits((least & np.uint64(1)).astype(np.uint8)).view(np.int64)
                    mins = (least[:MINWISE] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
                    out.append((doc_id, version, len(shingles), digest[0], digest[1], mins, s1, s2))
                else:
                    out.append((doc_id, version, 0, 0, 0, np.zeros(0, np.int32), 0, 0))
            names = ["doc_id", "version", "n_shingles", "hi", "lo", "mins", "s1", "s2"]
            result = pd.DataFrame(out, columns=names)
            result["doc_id"] = result["doc_id"].astype("Int64")
            yield result

    return docs.mapInPandas(profile, PROFILE)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(rep, shingles)`` with the whole set of each document."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [signed(shingle_set(t, width)) for t in batch["text"]]
            yield pd.DataFrame({"rep": batch["doc_id"], "shingles": pd.Series(rows, dtype=object)})

    return docs.mapInPandas(sets, "rep long, shingles array<long>")


def _nodes(rows: DataFrame) -> DataFrame:
    """``rows`` of the nodes that hold several components, with the node's size."""
    sizes = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("_low"), F.max("label").alias("_high")
    )
    return stage(rows.join(sizes.filter("_low <> _high").select("path", "size"), "path"), "nodes")


def _with_pivots(nodes: DataFrame) -> DataFrame:
    """The members of large nodes, beside their node's class of most copies."""
    large = nodes.filter(f"size > {LEAF}")
    pivot = F.struct(*[F.col(c).alias(f"p_{c}") for c in ("rep", "label", "n_shingles", "s1", "s2")])
    pivots = large.groupBy("path").agg(F.max_by(pivot, F.struct("copies", F.xxhash64("path", "rep"))).alias("pivot"))
    return large.join(pivots.select("path", "pivot.*"), "path")


class _Search:
    """The state of one join: components so far, pairs tested so far."""

    def __init__(self, classes: DataFrame, percent: int, sets_of: Callable[[DataFrame], DataFrame]) -> None:
        self.classes, self.percent, self.sets_of = classes, percent, sets_of
        self.labels = classes.select("rep", F.col("rep").alias("label"))
        self.tested: DataFrame | None = None
        s = percent / 100
        agree = (1 + s) / 2
        cut = SKETCH_BITS * agree - DEVIATIONS * (SKETCH_BITS * agree * (1 - agree)) ** 0.5
        self.most_bits = SKETCH_BITS - int(cut)

    def candidates(self, nodes: DataFrame) -> DataFrame:
        """``(a, b, bits, every)``: pairs of different components that may be links.

        All of small nodes (``every``), and each member of a large one with its pivot.
        """
        near = (
            "{0} <> {1} and 100 * least({2}, {3}) >= " + str(self.percent) + " * greatest({2}, {3})"
            " and bit_count({4} ^ {5}) + bit_count({6} ^ {7}) <= " + str(self.most_bits)
        )
        bits = "bit_count({0} ^ {1}) + bit_count({2} ^ {3}) as bits"
        small = nodes.filter(f"size <= {LEAF}").select("path", "rep", "label", "n_shingles", "s1", "s2")
        alike = near.format("x.label", "y.label", "x.n_shingles", "y.n_shingles", "x.s1", "y.s1", "x.s2", "y.s2")
        within = small.alias("x").join(small.alias("y"), F.expr(f"x.path = y.path and x.rep < y.rep and {alike}"))
        within = within.selectExpr("x.rep as a", "y.rep as b", bits.format("x.s1", "y.s1", "x.s2", "y.s2"), "true as every")
        alike = near.format("label", "p_label", "n_shingles", "p_n_shingles", "s1", "p_s1", "s2", "p_s2")
        to_pivot = _with_pivots(nodes).filter(alike).selectExpr(
            "least(rep, p_rep) as a", "greatest(rep, p_rep) as b", bits.format("s1", "p_s1", "s2", "p_s2"), "false as every"
        )
        pairs = within.union(to_pivot).groupBy("a", "b")
        return stage(pairs.agg(F.min("bits").alias("bits"), F.max("every").alias("every")), "candidates")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs not tested yet whose ends are in different components by now."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            pairs = pairs.join(self.labels.select(F.col("rep").alias(end), F.col("label").alias(f"l{end}")), end)
        return pairs.filter("la <> lb")

    def test(self, pairs: DataFrame) -> None:
        """Test candidates on full sets: the best of each class first, then, as far as they
        are still apart, all of small nodes and the next best of each other class."""
        if pairs.isEmpty():
            return
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")))
        self._confirm(self.apart(best_partners(pairs)), sets)
        left = stage(self.apart(pairs), "apart")
        best = best_partners(left.filter("not every"))
        self._confirm(self.apart(left.filter("every").select("a", "b").union(best).distinct()), sets)

    def _confirm(self, pairs: DataFrame, sets: DataFrame) -> None:
        pairs = stage(pairs.select("a", "b", "la", "lb"), "pairs")
        if pairs.isEmpty():
            return
        done = pairs.select("a", "b")
        self.tested = done if self.tested is None else self.tested.union(done)
        left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_a"))
        right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_b"))
        shared = F.size(F.array_intersect("_a", "_b"))
        total = F.size("_a") + F.size("_b")
        links = pairs.join(left, "a").join(right, "b").filter(shared * (100 + self.percent) >= total * self.percent)
        self.connect(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))

    def connect(self, links: DataFrame) -> None:
        """Join the components of labels ``(a, b)``."""
        new = components(links).select(F.col("label").alias("_new"), F.col("node").alias("label"))
        moved = self.labels.join(new, "label", "left")
        self.labels = stage(moved.select("rep", F.coalesce("_new", "label").alias("label")), "labels")

    def alive(self, nodes: DataFrame) -> DataFrame:
        """Members of the large nodes that still hold several components: their place in the
        trees, label, and the node's size."""
        large = nodes.filter(f"size > {LEAF}").select("path", "tree", "first", "rep").join(self.labels, "rep")
        several = large.groupBy("path").agg(
            F.count(F.lit(1)).alias("size"), F.min("label").alias("_low"), F.max("label").alias("_high")
        )
        return stage(large.join(several.filter("_low <> _high").select("path", "size"), "path"), "alive")

    def compare(self, nodes: DataFrame, done: DataFrame | None) -> None:
        """Compare all members of different components in the nodes ``(path, rep)``.

        Whoever is outside the largest component of its node is compared with all others:
        in cells of two blocks, by sketches first, then those with a similar sketch on full
        sets.  Only links come out of a cell.  ``done(rep, done)``: classes of the same
        ``done`` have been compared before.
        """
        rows = nodes.select("path", "rep").join(self.labels, "rep")
        rows = rows.join(self.classes.select("rep", "n_shingles", "s1", "s2"), "rep")
        own = F.xxhash64("rep", F.lit(99))
        if done is not None:
            rows = rows.join(done, "rep", "left").withColumn("done", F.coalesce("done", own))
        else:
            rows = rows.withColumn("done", own)
        rows = stage(rows, "compare")
        cells = _cells(rows, SKETCH_BLOCK, None)
        near = cells.groupBy("path", "i", "j").applyInPandas(_near_rows(self.percent, self.most_bits), "path long, rep long")
        near = stage(rows.join(near.distinct(), ["path", "rep"]), "near-rows")
        if near.isEmpty():
            return
        sets = self.sets_of(near.select("rep"))
        cells = stage(_cells(near, BLOCK_ROWS, BLOCK_TOKENS), "cells").join(sets, "rep")
        links = cells.groupBy("path", "i", "j").applyInPandas(_linked_rows(self.percent, self.most_bits), "a long, b long")
        self.connect(stage(links, "cell-links"))


def _cells(rows: DataFrame, most_rows: int, most_tokens: int | None) -> DataFrame:
    """``rows`` dealt to cells ``(path, i, j)`` of the nodes with several labels: block ``i``
    of those who ask, outside the largest label, meets each block ``j`` of all."""
    parts = rows.groupBy("path", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("tokens"))

    def blocks(rows: Column, tokens: Column) -> Column:
        by_rows = F.ceil(rows / most_rows)
        return by_rows if most_tokens is None else F.greatest(by_rows, F.ceil(tokens / most_tokens))

    n, tokens, most = F.sum("rows"), F.sum("tokens"), F.max(F.struct("rows", "tokens", "label"))
    sized = parts.groupBy("path").agg(
        most["label"].alias("main"),
        blocks(n, tokens).alias("all"),
        blocks(n - most["rows"], tokens - most["tokens"]).alias("open"),
    )
    dealt = rows.join(sized.filter("open > 0"), "path")
    others = F.explode(F.expr("sequence(0L, open - 1)")).alias("i")
    every = dealt.select(*rows.columns, others, F.expr("pmod(xxhash64(rep, 3), all)").alias("j"), F.lit(False).alias("asks"))
    asking = dealt.filter("label <> main").select(
        *rows.columns, F.expr("pmod(xxhash64(rep, 5), open)").alias("i"),
        F.explode(F.expr("sequence(0L, all - 1)")).alias("j"), F.lit(True).alias("asks"),
    )
    return every.union(asking)


def _near(x: pd.DataFrame, y: pd.DataFrame, percent: int, most_bits: int) -> np.ndarray:
    """Which rows of ``x`` and ``y`` may be links that are not known yet."""
    bits = sum(
        np.bitwise_count(x[s].to_numpy().view(np.uint64)[:, None] ^ y[s].to_numpy().view(np.uint64)) for s in ("s1", "s2")
    )
    n, m = x["n_shingles"].to_numpy()[:, None], y["n_shingles"].to_numpy()[None, :]
    fits = (bits <= most_bits) & (100 * n >= percent * m) & (100 * m >= percent * n)
    for known in ("label", "done"):
        fits &= x[known].to_numpy()[:, None] != y[known].to_numpy()[None, :]
    return fits


def _near_rows(percent: int, most_bits: int):
    def near(cell: pd.DataFrame) -> pd.DataFrame:
        """The rows of a cell whose sketch is like one on the other side."""
        x, y = (cell[cell["asks"] == side].copy() for side in (True, False))
        left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for at in range(0, len(x), SKETCH_STEP):
            fits = _near(x.iloc[at : at + SKETCH_STEP], y, percent, most_bits)
            left[at : at + SKETCH_STEP] = fits.any(1)
            right |= fits.any(0)
        return pd.concat([x[left], y[right]])[["path", "rep"]].drop_duplicates()

    return near


def _linked_rows(percent: int, most_bits: int):
    def links(cell: pd.DataFrame) -> pd.DataFrame:
        """Labels ``(a, b)`` that links between asking and other rows of a cell connect."""
        x, y = (cell[cell["asks"] == side] for side in (True, False))
        a, b = np.nonzero(_near(x, y, percent, most_bits))
        sets = [*x["shingles"], *y["shingles"]]
        if len(a) <= SINGLE_PAIRS:
            shared = np.array([len(np.intersect1d(sets[i], sets[len(x) + j], True)) for i, j in zip(a, b, strict=True)], np.int64)
        else:
            shared = shared_tokens(sets, np.arange(len(x)), np.arange(len(x), len(sets)))[a, b]
        total = x["n_shingles"].to_numpy()[a] + y["n_shingles"].to_numpy()[b]
        is_link = shared * (100 + percent) >= total * percent
        found = np.stack([x["label"].to_numpy()[a], y["label"].to_numpy()[b]], 1)[is_link]
        found = np.unique(np.sort(found, axis=1), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return links


def best_partners(pairs: DataFrame) -> DataFrame:
    """``(a, b)``: of each class, the pair whose sketches differ least."""
    ends = pairs.select(F.col("a").alias("own"), F.col("b").alias("other"), "bits").union(
        pairs.select("b", "a", "bits")
    )
    best = ends.groupBy("own").agg(F.min_by("other", F.struct("bits", "other")).alias("other"))
    return best.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()


def _child_rows(alive: DataFrame, classes: DataFrame) -> DataFrame:
    """Each member in ``BRANCHES`` child nodes, by minwise tokens that its path selects."""
    chosen = f"int(pmod(xxhash64(path, k), {MINWISE}))"
    paths = F.expr(
        f"transform(sequence(1, {BRANCHES}), k -> struct(xxhash64(path, k, mins[{chosen}]) as path, first and k = 1 as first))"
    )
    rows = alive.join(classes.select("rep", "copies", "mins", "n_shingles", "s1", "s2"), "rep")
    return rows.select("tree", "rep", "copies", "label", "n_shingles", "s1", "s2", F.inline(paths))


def _version(text: str) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(text)


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, version, n_shingles, first)`` of each row; ``first`` has doc_id and version
    of the document that stays of its group, and is null for rows linked with nothing."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "version": _version("text")}
    )
    found = stage(profiles(rows, width), "profiles")
    classes = stage(
        found.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("hi", "lo")
        .agg(
            F.min(F.struct("doc_id", "version")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            *[F.first(c).alias(c) for c in ("n_shingles", "mins", "s1", "s2")],
        )
        # Ids may repeat: a class goes by a number of its own.
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )

    def sets_of(reps: DataFrame) -> DataFrame:
        wanted = stage(classes.join(reps.distinct(), "rep").select("hi", "lo", "rep", "first"), "wanted")
        return stage_bucketed(wanted_sets(rows, width, wanted), "sets", "rep")

    search = _Search(classes, percent, sets_of)
    roots = F.expr(
        f"transform(sequence(0, {TREES - 1}), t -> struct(t as tree, t = 0 as first, xxhash64(t, mins[t * 5]) as path))"
    )
    label = F.col("rep").alias("label")
    nodes = _nodes(classes.select("rep", "copies", label, "n_shingles", "s1", "s2", F.inline(roots)))
    search.test(search.candidates(nodes))
    alive = search.alive(nodes)
    whole = alive.filter(f"size <= {SKETCH_BLOCK}")
    for _ in range(DEPTH):
        wide = alive.filter(f"size > {SKETCH_BLOCK}")
        if wide.isEmpty():
            break
        nodes = _nodes(_child_rows(wide, classes))
        search.test(search.candidates(nodes))
        alive = search.alive(nodes)
        whole = whole.union(alive.filter(f"size <= {SKETCH_BLOCK}"))
    whole = whole.union(alive.filter(f"size > {SKETCH_BLOCK}"))
    # Each class is in one node of the first tree's first branches at most.
    once = whole.filter("first").select("path", "rep")
    search.compare(once, None)
    search.compare(whole.filter("not first"), once.select("rep", F.col("path").alias("done")))

    own = classes.select("hi", "lo", "rep", "first").join(search.labels, "rep")
    groups = own.groupBy("label").agg(F.min("first").alias("first"))
    by_set = own.select("hi", "lo", "label").join(groups, "label").select("hi", "lo", "first")
    out = found.select("doc_id", "version", "n_shingles", "hi", "lo").join(by_set, ["hi", "lo"], "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("first"))
    return out.select("doc_id", "version", "n_shingles", linked.alias("first"))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|``;
    ``component_id`` is the smallest doc_id reachable by links.
    """
    out = _linked(docs, width, percent, id_col, text_col)
    component = F.coalesce("first.doc_id", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id.

    Of equal rows of this doc_id one stays.  Rows without doc_id all stay.
    """
    rows = Rows(docs)
    key = rows.of(id_col)
    drop = (
        _linked(docs, width, percent, id_col, text_col)
        .filter("first.doc_id <> doc_id or first.version <> version")
        .select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
        .distinct()
    )
    own = rows.df.withColumns({"_id": F.col(key).cast("long"), "_version": _version(rows.of(text_col))})
    kept = own.join(drop, ["_id", "_version"], "left_anti")
    with_id = kept.filter(F.col(key).isNotNull()).dropDuplicates([key, "_version"])
    return rows.restore(with_id.unionByName(kept.filter(F.col(key).isNull())))
