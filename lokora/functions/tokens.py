"""Word tokenising and its inverse as regular-expression chains.

The rules are this project's own, in the usual style of translation tooling:
separate punctuation, keep numbers and hyphenated words whole, split contractions
by language, and escape the characters that subword tools reserve.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ----------------------------------------------------------
# Reserved characters and their escapes; the ampersand is escaped first.
ESCAPES = (
    ("&", "&amp;"),
    ("|", "&#124;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ("'", "&apos;"),
    ('"', "&quot;"),
    ("[", "&#91;"),
    ("]", "&#93;"),
)
SEPARATE = (
    (r"[\s\x{00}-\x{1F}\p{Z}]+", " "),
    (r"([^\p{L}\p{N}\p{M}\s.'`,\-])", " $1 "),
    (r"(\.\.+)", " $1 "),
    (r"([^\p{N}]),", "$1 , "),
    (r",([^\p{N}])", " , $1"),
    (r",\z", " ,"),
)
APOSTROPHE = (
    (r"([^\p{L}])'([^\p{L}])", "$1 ' $2"),
    (r"([^\p{L}\p{N}])'(\p{L})", "$1 ' $2"),
    (r"(\p{L})'([^\p{L}])", "$1 ' $2"),
)
# How a contraction is split between two letters.
CONTRACTION = {"en": "$1 '$2", "fr": "$1' $2", "it": "$1' $2"}
OTHER_CONTRACTION = "$1 ' $2"
PERIOD = (
    (r"([\p{L}\p{N}])\. +(\p{Lu})", "$1 . $2"),
    (r"([^.\s])\.\s*\z", "$1 ."),
    (r" +", " "),
)
JOIN = (
    (r" +([,.;:!?%)\]}])", "$1"),
    (r"([(\[{]) +", "$1"),
)
JOIN_CONTRACTION = {"en": (r"(\p{L}) '(\p{L})", "$1'$2"), "fr": (r"(\p{L}') (\p{L})", "$1$2"),
                    "it": (r"(\p{L}') (\p{L})", "$1$2")}
# Tokenisation of the published mteval v13a scorer.
V13A_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
V13A = (
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
# ---------------------------------------------------------------------------


def _chain(text: Column, rules) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def _literal(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def tokenise(text: Column, lang: str = "en", escape: bool = True) -> Column:
    """Tokens separated by single blanks."""
    split = CONTRACTION.get(lang, OTHER_CONTRACTION)
    rules = (*SEPARATE, *APOSTROPHE, (r"(\p{L})'(\p{L})", split), *PERIOD)
    tokens = F.trim(_chain(F.coalesce(text, F.lit("")), rules))
    return _literal(tokens, ESCAPES) if escape else tokens


def detokenise(text: Column, lang: str = "en") -> Column:
    """Plain text from tokens: escapes undone, punctuation joined to its word."""
    plain = _literal(text, [(to, frm) for frm, to in reversed(ESCAPES)])
    rules = JOIN + ((JOIN_CONTRACTION[lang],) if lang in JOIN_CONTRACTION else ())
    return F.trim(_chain(plain, rules))


def words(text: Column) -> Column:
    """The non-empty tokens of blank-separated text."""
    return F.filter(F.split(text, " ", -1), lambda t: t != "")


def tokens_13a(text: Column) -> Column:
    """Scoring tokens as the mteval v13a rules define them."""
    line = F.replace(F.coalesce(text, F.lit("")), F.lit("<skipped>"), F.lit(""))
    line = F.replace(F.replace(line, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    padded = F.concat(F.lit(" "), _literal(line, V13A_ENTITIES), F.lit(" "))
    return F.filter(F.split(_chain(padded, V13A), r"\s+", -1), lambda t: t != "")
