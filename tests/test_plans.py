"""The physical plans keep the properties the design relies on."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lokora import catalog
from lokora.operators import splits as S
from lokora.operators import vocab as V
from lokora.operators.context import neighbour_context
from lokora.session import stage_table
from lokora.sources import po

DATA = Path("/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.range(400).select(
        F.concat(F.lit("f"), F.col("id") % 7).alias("filepath"),
        F.expr("id div 7").alias("pos"),
        F.concat(F.lit("s "), F.col("id") % 50).alias("src"),
        F.concat(F.lit("t "), F.col("id") % 90).alias("tgt"),
    )
    return stage_table(df, "plans")


@pytest.fixture()
def no_broadcast(spark):
    """Joins as they are planned for inputs too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["po_entries", "po_blocks", "corpus_table", "split_matrix", "corpus_bleu", "encoded_corpus", "tokenised_corpus"])
def test_no_python_in_the_plan(spark, name):
    text = plan(catalog.QUERIES[name](spark, str(DATA)))
    assert not re.search(r"Python|BatchEval|Pandas", text)


def test_po_parsing_moves_no_row(spark, tmp_path):
    (tmp_path / "a.po").write_text('msgid "a"\nmsgstr "b"\n')
    text = plan(po.po_pairs(po.parse_po_entries(po.read_po_files(spark, str(tmp_path)))))
    assert "Exchange" not in text


def test_neighbours_move_rows_twice(spark, stored, no_broadcast):
    text = plan(neighbour_context(stored, 1))
    # Rows move by chunk and by cell; the chunk table (one row per chunk) is
    # counted by chunk, summed by file, and joined by chunk.
    assert len(re.findall(r"Exchange hashpartitioning\(filepath#\d+, _c", text)) == 4
    assert text.count("Exchange hashpartitioning") == 5
    # No window over rows is keyed by the file alone.
    row_windows = [w for w in text.splitlines() if "Window [row_number" in w or "Window [lag" in w]
    assert row_windows and all("_c" in w.split("[filepath")[-1] for w in row_windows)


def test_overlap_is_an_anti_join_on_distinct_keys(spark, stored, no_broadcast):
    text = plan(S.remove_eval_overlap(stored, stored.limit(5)))
    assert text.count("LeftAnti") == 2 and "CartesianProduct" not in text and "NestedLoop" not in text


def test_encoding_returns_tokens_without_a_second_shuffle(spark, stored):
    d = spark.createDataFrame([("s", 1, 4)], "token string, cnt bigint, id bigint")
    text = plan(V.encode_corpus(stored, "src", d, ["filepath", "pos"]))
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text


def test_sample_does_not_sort_everything(spark, stored):
    text = plan(S.sample_exact(stored, 10, ["filepath", "pos"]))
    assert "rangepartitioning" not in text and "TakeOrdered" not in text


def test_scan_reads_needed_columns_only(spark, stored):
    text = plan(V.token_counts(stored, "src"))
    assert re.search(r"ReadSchema: struct<src:string>", text)
