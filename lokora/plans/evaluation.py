"""From system logs to one score table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokora.functions.text import remove_subwords
from lokora.functions.tokens import detokenise
from lokora.operators.metrics import character_edit_rate, corpus_bleu


def plain_hypotheses(hyps: DataFrame, lang: str = "en") -> DataFrame:
    """Subword pieces joined and tokens detokenised."""
    return hyps.withColumn("hyp", detokenise(remove_subwords(F.col("hyp")), lang))


def score_report(
    pairs: DataFrame,
    by: Sequence[str] = ("cxt_type", "direction", "eval_set", "seed"),
    key: Sequence[str] = ("row_id",),
    smooth: str = "exp",
) -> DataFrame:
    """BLEU and character edit rate of every configuration in one query."""
    bleu = corpus_bleu(pairs, by, key, smooth=smooth)
    rate = character_edit_rate(pairs, by, key)
    return rate.join(bleu.select(*by, "bleu"), list(by), "left")
