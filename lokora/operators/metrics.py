"""Scoring of system output against references."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.functions import distance
from lokora.functions.moves import move_blocks
from lokora.functions.ngrams import clipped_counts
from lokora.functions.once import with_columns_once
from lokora.functions.tokens import tokens_13a
from lokora.session import spread

# --- Fixed values ----------------------------------------------------------
BLEU_ORDER = 4
SCORE_DIGITS = 4
# ---------------------------------------------------------------------------


def align_hypotheses(
    hypotheses: DataFrame,
    references: DataFrame,
    on: Sequence[str] = ("direction", "eval_set", "row_id"),
    system: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Hypotheses with the raw reference of their row, for every context type.

    ``strict``: a hypothesis without reference fails the query, and so does a
    reference that one of the systems (the values of the ``system`` columns that
    occur for its other key columns) has no hypothesis for.
    """
    on, system = list(on), list(system)
    if not strict:
        return hypotheses.join(references, on, "inner")
    # A system is a few configurations, not data.
    part = on[:-1]
    runs = hypotheses.select(*part, *system).distinct()
    wanted = references.join(runs, part).withColumn("_ref", F.lit(True))
    found = hypotheses.withColumn("_hyp", F.lit(True))
    both = found.join(wanted, [*on, *system], "full")
    complete = F.col("_hyp").isNotNull() & F.col("_ref").isNotNull()
    message = F.concat(F.lit("hypotheses and references differ at row "), F.col(on[-1]).cast("string"))
    checked = both.withColumn("hyp", F.when(complete, F.col("hyp")).otherwise(F.raise_error(message)))
    return checked.select(*hypotheses.columns, *[c for c in references.columns if c not in hypotheses.columns])


def unmatched_rows(
    hypotheses: DataFrame,
    references: DataFrame,
    on: Sequence[str] = ("direction", "eval_set", "row_id"),
) -> DataFrame:
    """Per key but the row: hypotheses without reference, and references without hypothesis."""
    on = list(on)
    hyp = hypotheses.select(*on).distinct().withColumn("_h", F.lit(1))
    ref = references.select(*on).distinct().withColumn("_r", F.lit(1))
    both = hyp.join(ref, on, "full")
    return both.groupBy(*on[:-1]).agg(
        F.count_if(F.col("_r").isNull()).alias("no_reference"),
        F.count_if(F.col("_h").isNull()).alias("no_hypothesis"),
    )


def ngram_matches(
    pairs: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    tokens: Callable[[Column], Column] = tokens_13a,
    order: int = BLEU_ORDER,
) -> DataFrame:
    """Per group and n: clipped matches, hypothesis n-grams and reference n-grams.

    ``key`` identifies a row inside its group.  Rows are placed by their key
    before their n-grams, many times the size of the text, are counted row by row,
    without being taken apart; only sums leave the task.
    """
    by, key = list(by), list(key)
    row = [*by, *key]
    placed = spread(pairs.select(*row, "hyp", "ref"), *row)
    sided = with_columns_once(placed.select(*row, tokens(F.col("hyp")).alias("h"), tokens(F.col("ref")).alias("r")), {
        "_n": _counts("h", "r", order)
    })
    numbers = [F.get("_n", F.lit(k * order) + F.col("n") - 1) for k in range(3)]
    listed = sided.select(*by, "_n", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n"))
    counted = listed.select(*by, "n", *[c.alias(name) for c, name in zip(numbers, "mhr", strict=True)])
    return counted.filter((F.col("h") > 0) | (F.col("r") > 0)).groupBy(*by, "n").agg(
        F.sum("m").alias("matches"),
        F.sum("h").alias("hyp_ngrams"),
        F.sum("r").alias("ref_ngrams"),
    )


def _counts(left: str, right: str, order: int) -> Column:
    """The numbers of ``clipped_counts`` of two token lists, one behind the other."""

    @F.arrow_udf("array<bigint>")
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        numbers = clipped_counts(left, right, order)
        offsets = pa.array(range(0, numbers.size + 1, 3 * order), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(numbers.ravel()))

    return count(left, right)


def edit_distance(left: Column, right: Column) -> Column:
    """Exact edit distance in characters."""

    @F.pandas_udf("int")
    def distances(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([
            None if a is None or b is None else distance.edit_distance(a, b)
            for a, b in zip(lefts, rights, strict=True)
        ], dtype="Int32")

    return distances(left, right)


def corpus_bleu(
    pairs: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    tokens: Callable[[Column], Column] = tokens_13a,
    smooth: str = "exp",
    order: int = BLEU_ORDER,
) -> DataFrame:
    """Corpus BLEU per group (Papineni et al. 2002).

    ``smooth="exp"``: the j-th order without a match counts 1/2^j matches;
    ``"none"``: such a corpus scores 0.
    """
    if smooth not in ("exp", "none"):
        raise ValueError("smooth must be 'exp' or 'none'")
    counts = ngram_matches(pairs, by, key, tokens, order)

    def at(n: int, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == n, F.col(column))), F.lit(0))

    wide = counts.groupBy(*by).agg(
        *[at(n, "matches").alias(f"m{n}") for n in range(1, order + 1)],
        *[at(n, "hyp_ngrams").alias(f"t{n}") for n in range(1, order + 1)],
        at(1, "hyp_ngrams").alias("hyp_len"),
        at(1, "ref_ngrams").alias("ref_len"),
    )
    logs = F.lit(0.0)
    usable = F.lit(True)
    misses = F.lit(0)
    for n in range(1, order + 1):
        match, total = F.col(f"m{n}"), F.col(f"t{n}")
        usable = usable & (total > 0) & (F.lit(smooth == "exp") | (match > 0))
        misses = misses + F.when(match == 0, 1).otherwise(0)
        log_miss = -misses * F.lit(math.log(2.0)) - F.ln(total.cast("double"))
        logs = logs + F.when(match > 0, F.ln(match / total)).otherwise(log_miss)
    penalty = F.when(
        F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))
    ).otherwise(F.lit(1.0))
    # As the usual scorer does: no unigram match at all is a plain zero.
    score = F.when(usable & (F.col("m1") > 0), 100 * penalty * F.exp(logs / order)).otherwise(0.0)
    return wide.select(
        *by, "hyp_len", "ref_len", *[f"m{n}" for n in range(1, order + 1)],
        F.round(score, SCORE_DIGITS).alias("bleu"),
    )


def _edits(hyp: str, ref: str) -> Column:
    """Character edits, block moves and their cost, as ``with_edits`` has them."""

    @F.pandas_udf("edits int, moves int, move_cost double")
    def measure(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hyps, refs in rows:
            out = []
            for hyp, ref in zip(hyps, refs, strict=True):
                if hyp is None or ref is None:
                    out.append((None, 0, 0.0))
                    continue
                best = (distance.edit_distance(hyp, ref), 0, 0.0)
                words, moved = move_blocks(hyp.split(" "), ref.split(" ")) if best[0] else ([], [])
                if moved:
                    after = distance.edit_distance(" ".join(words), ref)
                    cost = sum(sum(map(len, run)) / len(run) for run in moved)
                    best = (after, len(moved), cost) if after + cost < best[0] else best
                out.append(best)
            yield pd.DataFrame(out, columns=["edits", "moves", "move_cost"]).astype({"edits": "Int32"})

    return measure(hyp, ref)


def with_edits(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``edits`` (characters), ``moves`` and ``move_cost`` of each row.

    A block move costs the mean length of its words, whatever its length; what
    is left after the moves is counted in characters.  Where that is not cheaper
    than to edit the text as it is, nothing is moved.
    """
    measured = with_columns_once(pairs, {"_e": _edits("hyp", "ref")})
    return measured.select(*pairs.columns, "_e.*")


def character_edit_rate(
    pairs: DataFrame, by: Sequence[str], key: Sequence[str] = ("row_id",)
) -> DataFrame:
    """Character edits and block moves per hypothesis character: over the corpus, and row mean.

    Edits are insertions, deletions and substitutions of characters, and moves of
    word blocks (``with_edits``).  An empty hypothesis for a non-empty reference
    counts as rate 1.  Rows are first spread over all tasks, longest texts too.
    """
    placed = spread(pairs.select(*by, *key, "hyp", "ref"), *by, *key)
    size, total = F.col("size"), F.col("edits") + F.col("move_cost")
    measured = with_edits(placed).withColumn("size", F.char_length("hyp"))
    rate = F.when(size > 0, total / size).otherwise(F.when(total > 0, 1.0).otherwise(0.0))
    return measured.groupBy(*by).agg(
        F.sum("edits").alias("edits"),
        F.sum("moves").alias("moves"),
        F.round(F.sum("move_cost"), SCORE_DIGITS).alias("move_cost"),
        F.sum(size).alias("hyp_chars"),
        F.round(F.sum(total) / F.nullif(F.sum(size), F.lit(0)), SCORE_DIGITS).alias("edit_rate"),
        F.round(F.avg(rate), SCORE_DIGITS).alias("mean_rate"),
        F.count(F.lit(1)).alias("rows"),
    )
