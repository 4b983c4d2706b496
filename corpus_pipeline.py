"""The corpus pipeline: language ID, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept; ``run`` writes each result to the shared folder and reads it
back.  All but the last return the columns of ``documents``.  Extra columns are
carried along.  An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokora.llm import langid, neardup, packing, substrings
from lokora.llm.common import Rows, pick, prepare, stage

# A text is rejected where no language can be told: it has no letter, or even the best
# language is hardly likely.  With two families of two languages no text with a letter
# scores below 0.25, so that only texts without letters go; with more, others may.
LEAST_SCORE = 0.2
CAPACITY = 2048
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    The model learns from the labelled documents at hand.  If none has a label,
    every text with a letter stays.
    """
    prepare(spark)
    rows = Rows(docs)
    labelled = pick(docs, doc_id="doc_id", text="text", lang="lang")
    model = langid.fit(labelled.filter(~langid.held_out(F.col("doc_id"))))
    scored = rows.df.withColumn("_p", langid.predicted(model, F.col(rows.of("text")), spark))
    told = (F.col("_p.lang") != langid.UNDETERMINED) & (F.col("_p.score") >= LEAST_SCORE)
    if not model.families:
        told = F.col(rows.of("text")).rlike(r"\p{L}")
    return rows.restore(scored.filter(told))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    prepare(spark)
    return neardup.drop_near_duplicates(docs, 5, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages that another one before it holds; ``n_chars``
    follows the text."""
    prepare(spark)
    rows = Rows(substrings.deduplicate(docs))
    size, text = rows.of("n_chars"), rows.of("text")
    counted = F.when(F.col(rows.plain[-1]), F.char_length(text).cast("long")).otherwise(F.col(size))
    out = rows.df.withColumn(size, counted).select(*rows.plain[: len(docs.columns)])
    return out.toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the sequence of 2048 tokens each goes to."""
    prepare(spark)
    return packing.pack(packing.cut_documents(docs, WORD_TOKENIZER, CAPACITY, 0), CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pack", pack),
]

# Hashes, trained models and tokenizers: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
