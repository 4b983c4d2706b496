import random

import pytest
from pyspark.sql import functions as F

from lokora.operators import ordering as O
from lokora.operators import splits as S
from lokora.plans.splits import assign_splits, split_matrix
from lokora.session import stage_table


def selection_rule(counts, wanted):
    """The holdout rule stated as a walk over the groups in visiting order."""
    i, filled, test = 0, 0, []
    while filled < wanted:
        if 100 < counts[i] < 300:
            test.append(i)
            filled += counts[i]
            if filled >= wanted / 2:
                break
        i += 1
    crossing = test.pop() if test else None
    valid = []
    while filled < wanted:
        if 100 < counts[i] < 300:
            valid.append(i)
            filled += counts[i]
        i += 1
    if valid:
        valid.pop()
    return test, valid, crossing


def chosen(spark, counts, wanted, **kw):
    rows = [(f"g{i}", c, f"{i:08x}") for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "repo string, cnt bigint, h string")
    got = S.holdout_groups(df, size=wanted, order=F.col("h"), **kw).collect()
    pick = lambda name: sorted(int(r.repo[1:]) for r in got if r.split == name)
    return pick("test"), pick("valid")


def test_holdout_literal(spark):
    assert chosen(spark, [150, 50, 200, 120, 180, 250], 1000) == ([0, 2, 3], [4])


def test_holdout_failure(spark):
    with pytest.raises(Exception, match="no group reaches"):
        chosen(spark, [150, 50], 1000)
    with pytest.raises(Exception, match="run out"):
        chosen(spark, [150, 200, 120], 900)
    assert chosen(spark, [150, 50], 1000, strict=False) == ([], [])


def test_holdout_random(spark):
    rng = random.Random(1)
    done = 0
    while done < 12:
        counts = [rng.choice([50, 101, 299, 300, rng.randint(100, 300)]) for _ in range(rng.randint(3, 25))]
        wanted = rng.randint(100, 2500)
        try:
            test, valid, _ = selection_rule(counts, wanted)
        except IndexError:
            continue
        assert chosen(spark, counts, wanted) == (sorted(test), sorted(valid)), (counts, wanted)
        done += 1


def test_prefix_sums(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 4)], "repo string, cnt bigint")
    got = {r.repo: r.offset for r in S.group_offsets(df).collect()}
    assert got == {"a": 0, "b": 3, "c": 5}


def test_global_index(spark):
    keys = [f"{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    got = {r.k: r.row_id for r in O.global_index(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_dense_positions(spark):
    rows = [(f, p) for f, n in (("a", 50), ("b", 1), ("c", 7)) for p in range(0, n * 3, 3)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "filepath string, pos bigint")
    for chunk in (1, 4, 1000):
        got = O.dense_positions(df, ["filepath"], "pos", chunk_rows=chunk).collect()
        assert all(r.idx == r.pos // 3 for r in got) and len(got) == 58
        assert {r.filepath: r.n_rows for r in got} == {"a": 50, "b": 1, "c": 7}


@pytest.mark.parametrize("prefix", [1, 2, 5])
def test_hash_partition(spark, prefix):
    df = spark.range(500).withColumn("k", F.col("id").cast("string"))
    order = [r.id for r in df.orderBy(O.seeded_hash(5, F.col("k")), "k").collect()]
    for sizes in ([0, 10], [37, 63], [1, 1], [250, 250], [400, 300], [600]):
        got = O.hash_partition(df, sizes, 5, ["k"], prefix=prefix).collect()
        assert len(got) == 500
        start = 0
        for i, size in enumerate(sizes):
            want = set(order[start : start + size])
            assert {r.id for r in got if r.part == i} == want, (sizes, i)
            start += size


def test_halve(spark):
    df = spark.range(11).withColumnRenamed("id", "row_id")
    got = {r.split: r["count"] for r in S.halve(df, ["row_id"]).groupBy("split").count().collect()}
    assert got == {"valid": 5, "test": 6}


def test_overlap(spark):
    train = spark.createDataFrame([("s1", "t1"), ("s2", "t2"), ("s3", "t3")], "src string, tgt string")
    ev = spark.createDataFrame([("s1", "q"), ("r", "t2")], "src string, tgt string")
    assert [tuple(r) for r in S.remove_eval_overlap(train, ev).select("src", "tgt").collect()] == [("s3", "t3")]
    assert {r.src for r in S.overlap_rows(train, ev, ev).collect()} == {"s1"}


def test_locate_pairs(spark):
    full = spark.createDataFrame(
        [(0, "a", "b", "r0"), (1, "c", "d", "r1"), (2, "a", "b", "r2")],
        "row_id bigint, src string, tgt string, repo string",
    )
    part = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, tgt string")
    got = sorted((r.src, r.found_id) for r in S.locate_pairs(full, part).collect())
    assert got == [("a", 0), ("c", 1)]
    assert sorted(r.repo for r in S.contextual_eval(full, part, ["repo"]).collect()) == ["r0", "r1"]
    lost = part.unionByName(spark.createDataFrame([("x", "y")], "src string, tgt string"))
    with pytest.raises(Exception, match="pair not found"):
        S.locate_pairs(full, lost).collect()
    assert S.locate_pairs(full, lost, strict=False).filter("found_id is null").count() == 1


def test_select_and_remove_ids(spark):
    df = spark.range(5).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("v"))
    ids = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "ord int, row_id bigint")
    assert [r.v for r in S.select_ids(df, ids).orderBy("ord").collect()] == [30, 10, 30]
    assert sorted(r.v for r in S.remove_ids(df, ids).collect()) == [0, 20, 40]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for repo in range(14):
        for i in range(rng.randint(105, 190)):
            rows.append(
                (f"o/r{repo}", f"o/r{repo}/f{i % 3}.po", i, f"s{rng.randint(0, 3000)}", f"t{rng.randint(0, 3000)}", f"m{i % 5}.c:1")
            )
    df = spark.createDataFrame(rows, "repo string, filepath string, pos bigint, src string, tgt string, cxt string")
    return stage_table(df, "test-corpus")


def test_assign_splits_invariants(spark, corpus):
    total = corpus.count()
    labelled = assign_splits(corpus, 0.5).cache()
    n = {r.split: r["count"] for r in labelled.groupBy("split").count().collect()}
    wanted = total - int(0.5 * total)
    assert sum(n.values()) == total
    assert n["rnd_valid"] == n["rnd_test"] == wanted // 2
    assert n["unknown_test"] > 0 and n["unknown_valid"] > 0
    train = labelled.filter("split = 'train'")
    ev = labelled.filter("split like 'unknown%' or split like 'rnd%'")
    for c in ("src", "tgt"):
        assert train.join(ev, c, "left_semi").count() == 0
    unknown = labelled.filter("split like 'unknown%'").select("repo").distinct()
    other = labelled.filter("split not like 'unknown%'").select("repo").distinct()
    assert unknown.intersect(other).count() == 0
    # Every overlap row has a reason.
    over = labelled.filter("split = 'overlap'")
    assert S.remove_eval_overlap(over, ev).count() == 0
    stats = S.split_stats(labelled).first()
    assert stats.total == total and stats.train_after == n["train"]
    again = assign_splits(corpus.repartition(7), 0.5)
    assert again.exceptAll(labelled.select(again.columns)).count() == 0


def test_split_matrix_directions(spark, corpus):
    labelled = assign_splits(corpus, 0.5)
    m = split_matrix(labelled).cache()
    kept = labelled.filter("split <> 'overlap'").count()
    assert m.count() == kept * 8
    none = m.filter("cxt_type = 'none'")
    assert none.filter("direction='en-de' and not input like 's%'").count() == 0
    dom = m.filter("cxt_type = 'domain' and direction='de-en'").first()
    assert dom.input.startswith(dom.repo + "## t") and dom.output.startswith("s")
    assert m.filter("cxt_type='neighbour' and not input like '% <tag> % <tag>  %'").count() == 0
