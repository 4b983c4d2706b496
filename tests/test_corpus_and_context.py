import random

import pytest
from pyspark.sql import functions as F

from lokora.operators import context as X
from lokora.operators import corpus as C
from lokora.plans.corpus import build_corpus

PAIRS = [("f1", 0, 0, "A", "X"), ("f1", 0, 1, "B", "Y"), ("f2", 1, 0, "A", "X"), ("f2", 1, 1, "A", "Z")]
SCHEMA = "filepath string, file_ord bigint, pos bigint, src string, tgt string"


def test_dedup_first(spark):
    df = spark.createDataFrame(PAIRS, SCHEMA)
    for frame in (df, df.orderBy(F.desc("filepath")).repartition(3)):
        got = sorted((r.filepath, r.pos) for r in C.dedup_pairs(frame).collect())
        assert got == [("f1", 0), ("f1", 1), ("f2", 1)]
    once = C.dedup_pairs(df)
    assert C.dedup_pairs(once).exceptAll(once).count() == 0


def test_dedup_plan_has_one_exchange(spark):
    plan = C.dedup_pairs(spark.createDataFrame(PAIRS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_min" in plan


def test_unique_last(spark):
    df = spark.createDataFrame(PAIRS, SCHEMA).withColumn("row_id", F.col("file_ord") * 2 + F.col("pos"))
    got = [r.last_id for r in C.unique_pairs(df).orderBy("first_seen").collect()]
    assert got == [2, 1, 3]


def test_build_corpus(spark):
    rows = [("f", 0, 0, "a \n", "b"), ("f", 0, 1, "a", "b "), ("f", 0, 2, "", "x"), ("f", 0, 3, "x" * 200, "y" * 200), ("f", 0, 4, "c", None)]
    got = [(r.pos, r.src, r.tgt) for r in build_corpus(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(0, "a", "b")]


def test_documents(spark):
    rows = [("p", 0, "1"), ("q", 1, "2"), ("p", 2, "3")]
    df = spark.createDataFrame(rows, "app string, ord bigint, line string")
    got = [r.line for r in C.assemble_documents(df, "app", "ord", "line").orderBy("app_ord", "seq").collect()]
    assert got == ["<d>", "1", "3", "<d>", "2", "<d>"]


def test_ambiguous_terms(spark):
    rows = [("Read", "Gelesen", "f1"), ("read", "Lesen", "f2"), ("read", "Lesen", "f2"), ("Open", "Auf", "f1")]
    df = spark.createDataFrame(rows, "src string, tgt string, filepath string")
    got = sorted((r.term, r.tgt, r.uses, r.files, r.n_targets) for r in C.ambiguous_terms(df).collect())
    assert got == [("read", "Gelesen", 1, 1, 2), ("read", "Lesen", 2, 1, 2)]


def ring(values, size):
    n = len(values)
    out = []
    for i in range(n):
        left = [values[(i - k) % n] for k in range(size, 0, -1)]
        right = [values[(i + k) % n] for k in range(1, size + 1)]
        out.append(f"{' '.join(left)} <tag> {' '.join(right)} <tag> ")
    return out


def neighbours(spark, files, size, **kw):
    rows = [(f, p * 2, v, v) for f, vs in files.items() for p, v in enumerate(vs)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "filepath string, pos bigint, src string, tgt string")
    got = X.neighbour_context(df, size, **kw).orderBy("filepath", "pos").collect()
    out = {}
    for r in got:
        out.setdefault(r.filepath, []).append(r.cxt_src)
    return out


def test_neighbour_literals(spark):
    got = neighbours(spark, {"f": ["a", "b", "c"]}, 1)
    assert got == {"f": ["c <tag> b <tag> ", "a <tag> c <tag> ", "b <tag> a <tag> "]}
    assert neighbours(spark, {"f": ["a"]}, 2) == {"f": ["a a <tag> a a <tag> "]}


@pytest.mark.parametrize("size,chunk", [(1, 4), (3, 4), (3, 2), (5, 5), (2, 1000)])
def test_neighbours_across_chunks(spark, size, chunk):
    files = {f"f{n}": [f"v{i}" for i in range(n)] for n in (1, 2, 3, 4, 5, 8, 9, 23)}
    got = neighbours(spark, files, size, chunk_rows=chunk)
    assert got == {f: ring(v, size) for f, v in files.items()}


def test_neighbours_open(spark):
    got = neighbours(spark, {"f": ["a", "b", "c"]}, 2, wrap=False, chunk_rows=2)
    assert got == {"f": [" <tag> b c <tag> ", "a <tag> c <tag> ", "a b <tag>  <tag> "]}


def test_directions(spark):
    df = spark.createDataFrame([("s", "t", "cs", "ct"), ("s", "t", None, None)], "src string, tgt string, cxt_src string, cxt_tgt string")
    got = [tuple(r) for r in X.direction_rows(df, "en", "de").collect()]
    assert got == [("en-de", "cs s", "t"), ("de-en", "ct t", "s"), ("en-de", "s", "t"), ("de-en", "t", "s")]


def test_prefix_has_two_blanks(spark):
    df = spark.createDataFrame([("f", 0, "a", "x"), ("f", 1, "b", "y")], "filepath string, pos bigint, src string, tgt string")
    rows = X.direction_rows(X.add_context(df, "neighbour"), "en", "de").filter("direction='en-de' and pos=0").first()
    assert rows.input == "b <tag> b <tag>  a"


def test_domain_and_filename(spark):
    df = spark.createDataFrame([("r", "s", "t", "src/main.c:12")], "repo string, src string, tgt string, cxt string")
    row = X.add_context(df, "domain").select(X.contextual(F.col("cxt_src"), F.col("src"))).first()
    assert row[0] == "r## s"
    assert X.add_context(df, "filename").first().cxt_src == "src main c 12"
    assert X.add_context(df, "none").first().cxt_src is None
    with pytest.raises(ValueError):
        X.add_context(df, "sent_cluster")
