"""Uniform shuffle into shards of exact size, by a drawn communication matrix.

How many rows each partition sends to each shard is drawn first, exactly as a
uniform shuffle would have it: the counts follow the multivariate hypergeometric
distribution with the partition sizes as row sums and the shard sizes as column
sums.  Then every partition permutes its rows and deals them out by its row of
the matrix, and every shard permutes what it got.

Everything is DataFrame and SQL expressions.  Partitions are those of the scan,
so no key can make one large.  The matrix is drawn in two levels, first for
chunks of partitions and then within each chunk, by sequential univariate draws.
The permuted rows are written once, so that a lost task cannot draw again.

Defined cases: rows with nulls, repeated rows and rows without a key are rows
like all others.  An empty table gives no rows.  Extra columns are carried along
under their own names; the new columns come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokora.llm.common import Rows, stage

# Partitions drawn one after the other in one row.
CHUNK_PARTITIONS = 512
# Rows of a shard that are permuted and numbered in one group.
GROUP_ROWS = 4_000


def unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of its arguments, in steps of 2**-53."""
    columns = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows are marked, when ``marked`` of ``total`` rows are; from
    one uniform number ``u``.

    Probabilities go by their recurrence from the mode outwards, as far as 13
    deviations, which is beyond the resolution of a double.  A first pass sums
    them above and below the mode, a second walks to where ``u`` falls.
    """
    state = F.struct(
        total.cast("double").alias("t"), marked.cast("double").alias("k"), drawn.cast("double").alias("n"), u.alias("u")
    )

    def up(s: Column, i: Column) -> Column:
        """p(i + 1) / p(i)"""
        return ((s["k"] - i) * (s["n"] - i)) / ((i + 1) * (s["t"] - s["k"] - s["n"] + i + 1))

    def down(s: Column, i: Column) -> Column:
        """p(i - 1) / p(i)"""
        return (i * (s["t"] - s["k"] - s["n"] + i)) / ((s["k"] - i + 1) * (s["n"] - i + 1))

    def draw(s: Column) -> Column:
        t, k, n = s["t"], s["k"], s["n"]
        low, high = F.greatest(F.lit(0.0), n + k - t), F.least(n, k)
        mode = F.least(F.greatest(F.floor((n + 1) * (k + 1) / (t + 2)).cast("double"), low), high)
        spread = n * (k / t) * (1 - k / t) * (t - n) / F.greatest(t - 1, F.lit(1.0))
        reach = F.ceil(13 * F.sqrt(spread)) + 40
        last, first = F.least(high, mode + reach), F.greatest(low, mode - reach)
        above = F.when(last > mode, F.sequence(mode.cast("long"), last.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
        below = F.when(first < mode, F.sequence(mode.cast("long"), first.cast("long") + 1)).otherwise(F.array().cast("array<long>"))
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))

        def mass(path: Column, ratio) -> Column:
            def step(a: Column, i: Column) -> Column:
                p = a["p"] * ratio(s, i.cast("double"))
                return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"))

            return F.aggregate(path, start, step, lambda a: a["sum"])

        def walk(path: Column, ratio, target: Column, by: int) -> Column:
            begin = F.struct(F.lit(1.0).alias("p"), target.alias("left"), mode.cast("long").alias("at"))

            def step(a: Column, i: Column) -> Column:
                p = a["p"] * ratio(s, i.cast("double"))
                go = a["left"] > 0
                return F.struct(
                    p.alias("p"), F.when(go, a["left"] - p).otherwise(a["left"]).alias("left"),
                    F.when(go, i + by).otherwise(a["at"]).alias("at"),
                )

            return F.aggregate(path, begin, step, lambda a: a["at"])

        sums = F.struct(mass(above, up).alias("a"), mass(below, down).alias("b"))

        def decide(m: Column) -> Column:
            target = s["u"] * (1 + m["a"] + m["b"])
            return (
                F.when(target <= 1, mode.cast("long"))
                .when(target <= 1 + m["a"], walk(above, up, target - 1, 1))
                .otherwise(walk(below, down, target - 1 - m["a"], -1))
            )

        return F.when(t <= 0, F.lit(0).cast("long")).otherwise(_let(sums, decide))

    return _let(state, draw)


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def draw_matrix(sizes: Column, shares: Column, seed: Column) -> Column:
    """One array of counts by shard for each of ``sizes``, in order; the columns sum to
    ``shares``.  Both are arrays of longs with the same sum."""
    long_array = "array<long>"

    def one(left: Column, size: Column, index: Column) -> Column:
        """Counts by shard of one partition, when ``left`` rows of each shard are free."""
        start = F.struct(
            F.aggregate(left, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"),
            size.alias("size"), F.array().cast(long_array).alias("counts"),
        )

        def step(a: Column, share: Column) -> Column:
            u = unit(seed, index, F.size(a["counts"]))
            drawn = hypergeometric(a["total"], share, a["size"], u)
            return _let(
                drawn,
                lambda h: F.struct(
                    (a["total"] - share).alias("total"), (a["size"] - h).alias("size"),
                    F.concat(a["counts"], F.array(h)).alias("counts"),
                ),
            )

        return F.aggregate(left, start, step, lambda a: a["counts"])

    begin = F.struct(shares.cast(long_array).alias("left"), F.array().cast("array<array<long>>").alias("rows"))

    def next_row(a: Column, size: Column) -> Column:
        return _let(
            one(a["left"], size, F.size(a["rows"])),
            lambda row: F.struct(
                F.zip_with(a["left"], row, lambda x, y: x - y).alias("left"),
                F.concat(a["rows"], F.array(row)).alias("rows"),
            ),
        )

    return F.aggregate(sizes.cast(long_array), begin, next_row, lambda a: a["rows"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(_p, before)`` from ``(_p, n)``: for each partition the numbers of its rows that
    go to shards before the first, second, …, and its size at the end.

    Shard sizes differ by one at most.  The chunk table has one row per
    ``CHUNK_PARTITIONS`` partitions.
    """
    chunks = (
        sizes.withColumn("_chunk", F.expr(f"_p div {CHUNK_PARTITIONS}"))
        .groupBy("_chunk")
        .agg(F.array_sort(F.collect_list(F.struct("_p", "n"))).alias("parts"), F.sum("n").alias("n"))
    )
    whole = chunks.groupBy().agg(F.array_sort(F.collect_list(F.struct("_chunk", "n"))).alias("chunks"), F.sum("n").alias("n"))
    share = F.expr(f"transform(sequence(0, {shards - 1}), s -> n div {shards} + if(s < n % {shards}, 1, 0))")
    top = whole.select("chunks", draw_matrix(F.col("chunks.n"), share, F.lit(seed)).alias("rows"))
    by_chunk = top.select(F.explode(F.arrays_zip("chunks", "rows")).alias("z")).select(
        F.col("z.chunks._chunk").alias("_chunk"), F.col("z.rows").alias("shares")
    )
    drawn = chunks.join(by_chunk, "_chunk").select(
        "parts", draw_matrix(F.col("parts.n"), F.col("shares"), F.xxhash64(F.lit(seed), F.col("_chunk"))).alias("rows")
    )
    rows = drawn.select(F.explode(F.arrays_zip("parts", "rows")).alias("z"))
    sums = F.aggregate(
        "counts", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    return rows.select(F.col("z.parts._p").alias("_p"), F.col("z.rows").alias("counts")).select("_p", sums.alias("before"))


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0
    in each shard), both uniformly at random; shard sizes are at most one apart."""
    rows = Rows(docs)
    # Permute each partition: a random order within it, numbered without a shuffle.
    mine = rows.df.withColumns({"_p": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    order = F.xxhash64(F.lit(seed), F.lit("local"), "_id")
    local = mine.sortWithinPartitions(order, "_id").withColumn("_r", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    local = stage(local.drop("_id"), "permuted")

    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    matrix = stage(communication_matrix(sizes, shards, seed), "matrix")
    shard = F.size(F.filter("before", lambda b: b <= F.col("_r"))) - 1
    narrow = local.select("_p", "_r").join(matrix, "_p")
    # Permute each shard: groups of a shard by hash, then a random order in each group.
    n_groups = 1 + local.count() // (shards * GROUP_ROWS)
    place = {
        "shard": shard,
        "_h": F.xxhash64(F.lit(seed), F.lit("shard"), "_p", "_r"),
    }
    group = F.pmod(F.shiftrightunsigned("_h", 16), F.lit(n_groups)).cast("long")
    counts = narrow.withColumns(place).withColumn("_g", group).groupBy("shard", "_g").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))

    dealt = local.join(matrix, "_p").withColumns(place).withColumn("_g", group).drop("before")
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("shard", "_g").orderBy("_h", "_p", "_r")))
    out = ranked.join(offsets, ["shard", "_g"]).withColumn("slot", (F.col("_before") + F.col("_k") - 1).cast("long"))
    return rows.restore(out, "shard", "slot")
