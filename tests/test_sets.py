"""The exported sets and the written matrix move rows before they are expanded."""

import re

from pyspark.sql import functions as F

from lokora.catalog.corpus_queries import exported_rows
from lokora.plans.splits import contextual_rows, expand_matrix, split_matrix
from lokora.session import stage_table
from lokora.sinks import writers as W
from lokora.sources.lines import numbered_lines


def labelled(spark):
    split = F.element_at(
        F.array(*[F.lit(s) for s in ("train", "overlap", "rnd_test", "rnd_valid", "unknown_test")]),
        (F.col("id") % 5 + 1).cast("int"),
    )
    df = spark.range(300).select(
        F.concat(F.lit("o/r"), F.col("id") % 4).alias("repo"),
        F.concat(F.lit("f"), F.col("id") % 23).alias("filepath"),
        F.expr("id div 23").alias("pos"),
        F.when(F.col("id") % 11 != 3, F.concat(F.lit("s:"), "id")).otherwise("").alias("src"),
        F.concat(F.lit("t "), "id").alias("tgt"),
        F.when(F.col("id") % 3 > 0, F.lit("a/b.c:<cxt>")).otherwise("").alias("cxt"),
        split.alias("split"),
    )
    return stage_table(df, "labelled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_expanding_moves_no_row(spark):
    rows = stage_table(contextual_rows(labelled(spark)), "contextual")
    assert "Exchange" not in plan(expand_matrix(rows)) and "Union" not in plan(split_matrix(labelled(spark)))


def test_both_exports_write_the_same_files(spark, tmp_path):
    rows = labelled(spark)
    W.write_exported_sets(split_matrix(rows), str(tmp_path / "a"))
    W.write_labelled_sets(rows, str(tmp_path / "b"), "en", "de")
    for column in ("input", "output"):
        a, b = (numbered_lines(spark, str(tmp_path / x / column), column, W.SET) for x in "ab")
        assert a.count() == b.count() == 240 * 8
        assert a.exceptAll(b.select(a.columns)).count() == 0
    a, b = (spark.read.parquet(str(tmp_path / x / "references")) for x in "ab")
    assert a.count() == b.count() > 0 and a.exceptAll(b.select(a.columns)).count() == 0


def test_numbering_lines_moves_no_line(spark, tmp_path):
    spark.range(1000).repartition(7).select(F.col("id").cast("string")).write.text(str(tmp_path / "x"), lineSep="\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        lines = numbered_lines(spark, str(tmp_path / "x"), "v")
        assert not re.search(r"Exchange (hash|range)partitioning\([^)]*value", plan(lines)) and "SortMergeJoin" not in plan(lines)
        got = [r.v for r in lines.orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = sorted(p for p in (tmp_path / "x").iterdir() if p.suffix == ".txt")
    assert got == [line for p in parts for line in p.read_text().splitlines()]


def test_exported_lines_move_once(spark):
    """Inputs, outputs and references move by the whole key, and not again for the second join."""
    key = "cxt_type string, direction string, eval_set string, split string, row_id long"
    inputs, outputs = (spark.createDataFrame([("none", "en-de", "rnd", "test", 0, "x")], f"{key}, {c} string") for c in ("input", "output"))
    refs = spark.createDataFrame([("en-de", "rnd", 0, "r")], "direction string, eval_set string, row_id long, ref string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = exported_rows(inputs, outputs, refs)
        text = plan(rows)
        assert [(r.input, r.output, r.ref) for r in rows.collect()] == [("x", "x", "r")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    moves = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert text.count("SortMergeJoin") == 2 and len(moves) == 3 and all("split#" in move for move in moves)
