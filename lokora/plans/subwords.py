"""Subword form of the corpus, beside its raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokora.functions.tokens import tokenise
from lokora.operators.vocab import apply_subwords, language_lines, learn_subwords, token_counts

# The language whose rules tokenise the context column.
CONTEXT_LANG = "en"


def tokenised(entries: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """``src``, ``tgt`` and ``cxt`` as tokens; the raw text moves to ``*_raw``."""
    return entries.withColumns({"src_raw": F.col("src"), "tgt_raw": F.col("tgt")}).withColumns(
        {
            "src": tokenise(F.col("src"), src_lang),
            "tgt": tokenise(F.col("tgt"), tgt_lang),
            "cxt": tokenise(F.col("cxt"), CONTEXT_LANG),
        }
    )


def joint_merges(entries: DataFrame, src_lang: str, tgt_lang: str, num_merges: int) -> DataFrame:
    """Merges learnt from both languages of a corpus."""
    rows = tokenised(entries.select("src", "tgt", "cxt"), src_lang, tgt_lang)
    return learn_subwords(token_counts(language_lines(rows)), num_merges)


def with_subwords(entries: DataFrame, merges: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """Tokenised and segmented columns in place of the text, raw text kept."""
    return apply_subwords(tokenised(entries, src_lang, tgt_lang), ["src", "tgt", "cxt"], merges)
