"""Column expressions over text: normalising, cleaning, filters, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lokora.functions.once import let

# --- Fixed values ----------------------------------------------------------
# Whitespace as Python's str.rstrip() understands it (Java's \s is ASCII only).
UNICODE_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
CONTEXT_MARK = "<cxt>"
NEIGHBOUR_TAG = "<tag>"
DOCUMENT_TAG = "<d>"
DOMAIN_MARK = "##"
CREDITS_ENTRY = "translator-credits"
PUNCTUATION_RUN = r"[,.;@#?!&$/-]+ *"
MAX_CHARS = 200
MAX_TOKENS = 100
# ---------------------------------------------------------------------------


def rstrip(text: Column) -> Column:
    """Trailing whitespace of any kind removed."""
    return F.regexp_replace(text, UNICODE_SPACE + r"+\z", "")


def strip(text: Column) -> Column:
    """Leading and trailing whitespace of any kind removed."""
    return F.regexp_replace(rstrip(text), r"\A" + UNICODE_SPACE + "+", "")


def normalise_text(text: Column) -> Column:
    """Trailing whitespace off, remaining newlines to blanks, null to empty."""
    return F.translate(rstrip(F.coalesce(text, F.lit(""))), "\n", " ")


def clean_text(text: Column) -> Column:
    """Drop newlines, double quotes and underscores; collapse runs of blanks."""
    no_newline = F.regexp_replace(
        F.regexp_replace(text, "\n", ""), UNICODE_SPACE + "{2,}", " "
    )
    no_quote = F.regexp_replace(
        F.regexp_replace(no_newline, '"', ""), UNICODE_SPACE + "{2,}", " "
    )
    return F.regexp_replace(no_quote, "_", "")


def is_kept_text(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Neither blank, nor over ``max_chars``, nor the credits placeholder."""

    def usable(bare: Column) -> Column:
        return (bare != "") & (F.char_length(bare) <= max_chars) & (bare != CREDITS_ENTRY)

    return let(strip(text), usable)


def replace_punct(text: Column) -> Column:
    """Runs of punctuation (with the blanks behind them) and colons to one blank."""
    return F.translate(F.regexp_replace(text, PUNCTUATION_RUN, " "), ":", " ")


def within_length(
    src: Column, tgt: Column, max_chars: int = MAX_CHARS, mode: str = "or"
) -> Column:
    """Length filter on a pair.

    ``mode="or"`` keeps a pair when either side is short, ``"and"`` when both are.
    """
    if mode not in ("or", "and"):
        raise ValueError("mode must be 'or' or 'and'")
    short_src = F.char_length(src) < max_chars
    short_tgt = F.char_length(tgt) < max_chars
    return (short_src | short_tgt) if mode == "or" else (short_src & short_tgt)


def is_translated(src: Column, tgt: Column, obsolete: Column, fuzzy: Column) -> Column:
    """A usable entry: current, confirmed, and non-empty on both sides."""
    return ~obsolete & ~fuzzy & (src != "") & (tgt != "")


def with_context(context: Column, text: Column) -> Column:
    """Context in front of the text, joined by one blank."""
    return F.concat(context, F.lit(" "), text)


def token_count(text: Column) -> Column:
    """Tokens between single blanks; empty tokens count."""
    return F.size(F.split(text, " ", -1))


def within_tokens(
    cxt_src: Column, src: Column, cxt_tgt: Column, tgt: Column, max_tokens: int = MAX_TOKENS
) -> Column:
    """Both sides, with their context, stay below ``max_tokens``."""
    return (token_count(with_context(cxt_src, src)) < max_tokens) & (
        token_count(with_context(cxt_tgt, tgt)) < max_tokens
    )


def first_occurrence_context(paths: Column) -> Column:
    """First occurrence path with its mark; empty when there is no occurrence."""
    return F.coalesce(
        F.concat(F.get(paths, F.lit(0)), F.lit(CONTEXT_MARK)), F.lit("")
    )


def domain_tag(repo: Column) -> Column:
    return F.concat(repo, F.lit(DOMAIN_MARK))


def dirname(path: Column) -> Column:
    """Parent directory with its trailing slash; empty when there is none."""
    return F.regexp_extract(path, r"\A(.*/)[^/]*\z", 1)


def basename(path: Column) -> Column:
    return rstrip(F.substring_index(path, "/", -1))


def path_component(path: Column, n: int) -> Column:
    """The n-th (0-based) component of a slash path, null when there is none."""
    return F.get(F.split(path, "/", -1), F.lit(n))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as ISO-8859-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def remove_subwords(text: Column) -> Column:
    """Join subword pieces (``@@`` continuation marks) back into words."""
    return F.regexp_replace(text, r"@@( |\z)", "")
