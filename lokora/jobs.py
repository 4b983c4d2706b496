"""Command line: the steps from hits and PO files to scored output.

    spark-submit --py-files lokora.zip -m lokora.jobs <step> …
    python -m lokora.jobs <step> …
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lokora.functions import text as T
from lokora.operators import splits as S
from lokora.operators import vocab as B
from lokora.operators.corpus import with_repo
from lokora.operators.metrics import align_hypotheses
from lokora.plans.corpus import build_corpus, po_corpus_rows
from lokora.plans.evaluation import plain_hypotheses, score_report
from lokora.plans.splits import assign_splits
from lokora.plans.subwords import joint_merges, with_subwords
from lokora.session import stage_table, tune
from lokora.sinks import writers as W
from lokora.sources.lines import ENTRY_COLUMNS, read_hits, read_hypotheses
from lokora.streaming.hits import hits_to_urls, stream_hits, write_new_urls, write_url_stream

FULL_COLUMNS = ("src", "tgt", "cxt", "name", "filepath")


def urls(spark: SparkSession, args: argparse.Namespace) -> None:
    """Hits to raw PO-file URLs, as a batch or as a stream."""
    if args.checkpoint:
        write = write_new_urls if args.distinct else write_url_stream
        write(stream_hits(spark, args.hits, args.lang), args.out, args.checkpoint).awaitTermination()
    else:
        hits_to_urls(read_hits(spark, args.hits), args.lang).write.mode("overwrite").parquet(args.out)


def path_below(path: Column, root: str) -> Column:
    """A path relative to ``root``, whatever scheme either is written with."""
    plain = F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    top = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    return F.when(plain.startswith(top), F.substring(plain, len(top) + 1, 1 << 30)).otherwise(plain)


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """PO files to the corpus table, aligned column files, the counts and the quarantine list."""
    pairs, problems = po_corpus_rows(spark, args.root, args.max_bytes)
    corpus = build_corpus(pairs, args.max_chars, args.length_mode, order=("filepath", "pos"))
    relative = path_below(F.col("filepath"), args.root)
    repo = F.regexp_extract(relative, args.repo_pattern, 1)
    W.write_entries(with_repo(corpus, repo), f"{args.out}/entries")
    entries = spark.read.parquet(f"{args.out}/entries")
    # A line is a row: what else may hold a line end in its path or context has a blank there.
    lines = entries.withColumn("name", F.col("filepath"))
    lines = lines.withColumn("path", F.col("filepath")).withColumns({c: F.translate(c, "\r\n", "  ") for c in FULL_COLUMNS})
    W.write_aligned(lines, {c: c for c in FULL_COLUMNS}, args.out, "full", ("path", "pos"))
    W.write_counts(entries, f"{args.out}/counts")
    W.write_entries_csv(entries.withColumn("name", F.col("filepath")), f"{args.out}/csv", ENTRY_COLUMNS)
    W.write_directory_list(entries.select("filepath").distinct(), f"{args.out}/directories")
    problems.write.mode("overwrite").parquet(f"{args.out}/quarantine")


def subwords(spark: SparkSession, args: argparse.Namespace) -> None:
    """Joint subword merges of a corpus."""
    entries = spark.read.parquet(args.entries)
    joint_merges(entries, args.src_lang, args.tgt_lang, args.num_merges).write.mode(
        "overwrite"
    ).parquet(args.out)


def splits(spark: SparkSession, args: argparse.Namespace) -> None:
    """The split matrix of every context type."""
    entries = spark.read.parquet(args.entries)
    if args.merges:
        merges = spark.read.parquet(args.merges)
        entries = stage_table(
            with_subwords(entries, merges, args.src_lang, args.tgt_lang), "subword-entries"
        )
    labelled = stage_table(
        assign_splits(entries, args.train_split, min_rows=args.min_rows, max_rows=args.max_rows),
        "labelled",
    )
    S.split_stats(labelled).show(truncate=False)
    W.write_splits(labelled, args.out, args.src_lang, args.tgt_lang, args.neighbour_size)


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    """Line-aligned text of every split, and the numbered raw references."""
    W.write_exported_sets(spark.read.parquet(args.matrix), args.out)


def dictionary(spark: SparkSession, args: argparse.Namespace) -> None:
    """The joint dictionary, and every split encoded with it."""
    matrix = spark.read.parquet(args.matrix)
    general = spark.read.parquet(args.general) if args.general else spark.createDataFrame(
        [], "src string, tgt string"
    )
    lines = B.dictionary_corpus(matrix, general, args.src_lang, args.tgt_lang)
    tags = [T.NEIGHBOUR_TAG]
    B.build_dictionary(B.token_counts(lines), tags).write.mode("overwrite").parquet(f"{args.out}/dictionary")
    ids = spark.read.parquet(f"{args.out}/dictionary")
    part = ["cxt_type", "direction", "eval_set", "split"]
    rows = matrix.filter((F.col("split") == "train") | (F.col("eval_set") == "rnd"))
    for column in ("input", "output"):
        encoded = B.encode_corpus(rows, column, ids, [*part, "filepath", "pos"], eos=True)
        W.rebalanced(encoded, part).write.mode("overwrite").partitionBy(*part).parquet(f"{args.out}/{column}")


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scores of one log per configuration against the raw references.

    ``--log cxt_type:direction:seed=path``; sentence n of a log is row n of the
    references ``(direction, eval_set, row_id, ref)``.
    """
    references = spark.read.parquet(args.references).filter(F.col("eval_set") == args.eval_set)
    hypotheses = None
    for item in args.log:
        name, path = item.split("=", 1)
        cxt_type, direction, seed = name.split(":")
        log = read_hypotheses(spark, path).select(F.col("sent_id").alias("row_id"), "hyp")
        log = plain_hypotheses(log, direction.split("-")[1]).select(
            "*",
            F.lit(cxt_type).alias("cxt_type"),
            F.lit(direction).alias("direction"),
            F.lit(args.eval_set).alias("eval_set"),
            F.lit(seed).alias("seed"),
        )
        hypotheses = log if hypotheses is None else hypotheses.unionByName(log)
    pairs = stage_table(align_hypotheses(hypotheses, references, system=["cxt_type", "seed"]), "pairs")
    score_report(pairs).write.mode("overwrite").parquet(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lokora.jobs")
    steps = top.add_subparsers(dest="step", required=True)

    def step(function, *options):
        sub = steps.add_parser(function.__name__, help=function.__doc__.splitlines()[0])
        sub.set_defaults(run=function)
        for flags, kw in options:
            sub.add_argument(flags, **kw)

    need = {"required": True}
    langs = [("--src_lang", {"default": "en"}), ("--tgt_lang", {"default": "de"})]
    step(urls, ("--hits", need), ("--out", need), ("--lang", {"default": None}),
         ("--checkpoint", {"default": None}), ("--distinct", {"action": "store_true"}))
    step(extract, ("--root", need), ("--out", need),
         ("--repo_pattern", {"default": r"\A([^/]+/[^/]+)/"}),
         ("--max_bytes", {"type": int, "default": 64 * 1024 * 1024}),
         ("--max_chars", {"type": int, "default": T.MAX_CHARS}),
         ("--length_mode", {"choices": ["or", "and"], "default": "or"}))
    step(subwords, ("--entries", need), ("--out", need),
         ("--num_merges", {"type": int, "default": B.NUM_MERGES}), *langs)
    step(splits, ("--entries", need), ("--out", need), ("--merges", {"default": None}),
         ("--train_split", {"type": float, "default": S.TRAIN_SPLIT}),
         ("--neighbour_size", {"type": int, "default": 1}),
         ("--min_rows", {"type": int, "default": S.MIN_GROUP_ROWS}),
         ("--max_rows", {"type": int, "default": S.MAX_GROUP_ROWS}), *langs)
    step(export, ("--matrix", need), ("--out", need))
    step(dictionary, ("--matrix", need), ("--out", need), ("--general", {"default": None}), *langs)
    step(score, ("--log", {"action": "append", "required": True}), ("--references", need),
         ("--out", need), ("--eval_set", {"default": "rnd"}))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(tune(SparkSession.builder.getOrCreate()), args)


if __name__ == "__main__":
    main()
