"""PO file sources and entry extraction.

Explodes here are the outer kind with a null filter behind them: for the inner
kind the optimizer repeats the exploded expression in a filter below it, and the
expressions here are the costly part.

A PO file normally arrives as one row, and all its entries are cut out of that
row by column expressions: no shuffle, no Python.  Files too large for one row
are scanned line by line instead; Spark splits them, and only the state carried
from one block of lines to the next is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lokora.functions import text as T
from lokora.functions.once import let, with_columns_once
from lokora.session import stage_table

# --- Fixed values: the published PO line format ------------------------------
_OBSOLETE = r"(?:#~[ \t]*)?"
_QUOTED = r'"[^\n]*"[ \t]*(?:\n|\z)'
_MORE = rf"(?:{_OBSOLETE}{_QUOTED})*+"
_MSGSTR = rf"^{_OBSOLETE}msgstr(?:\[\d+\])?[ \t]*{_QUOTED}{_MORE}"
# Lines up to a msgstr, then all msgstr blocks in a row.  \G ties each entry to
# the end of the one before, so text behind the last entry is looked at once.
_ENTRY = rf"(?dm)\G(?:(?!{_OBSOLETE}msgstr)[^\n]*+\n)*+(?:{_MSGSTR})++"
_STRING = r'"(?:[^"\\\n]|\\[^\n])*+'
_KEYWORD = r"(?:msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)[ \t]*"
_COMMENT = rf'#(?!~[ \t]*(?:{_KEYWORD})?")[^\n]*+'
_GOOD_LINE = rf'(?:{_COMMENT}|{_OBSOLETE}(?:{_KEYWORD})?{_STRING}"[ \t]*)'
_READABLE = rf"(?d)\A(?:{_GOOD_LINE}(?:\n|\z))*+\z"
_HAS_KEYWORD = rf"(?dm)^{_OBSOLETE}msg(?:id|str)"
_HAS_ENTRY = rf'(?dm)^{_OBSOLETE}msgstr(?:\[\d+\])?[ \t]*"'
_OPEN_STRING = rf"(?dm)^{_OBSOLETE}(?:{_KEYWORD})?{_STRING}$"
_OLD_BLOCK = "#:([^#]*)"
_NEWLINE = r"\r\n?|\n"
# White space and byte order marks (also one read as ISO-8859-1) lead no line.
_LEADING = r"(?:\s|\x{FEFF}|\x{EF}\x{BB}\x{BF})+"
_TRAILING = r"[ \t\f\x0B]+"
_ESCAPES = (
    ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'),
    ("\\a", "\a"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v"),
)
_NUMERIC = r"\\(?:[0-7]|x[0-9A-Fa-f])"
_NUMERIC_PIECE = r"(\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\|[^\\]+)"
# ---------------------------------------------------------------------------

# Above this size a file is read by lines, not as one row.
MAX_ROW_BYTES = 64 * 1024 * 1024
# Lines per block when lines come from a row instead of a file split.
BLOCK_LINES = 65_536


def _path() -> Column:
    """The file's path as it is spelled on disk."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _po_options(reader, glob: str):
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)


def read_po_files(
    spark: SparkSession, root: str, max_bytes: int = MAX_ROW_BYTES, glob: str = "*.po"
) -> DataFrame:
    """``(filepath, content)`` of every ``*.po`` below ``root`` up to ``max_bytes``.

    Each file is decoded as UTF-8, or as ISO-8859-1 where it is not valid UTF-8.
    """
    return (
        _po_options(spark.read.format("binaryFile"), glob)
        .load(root)
        .filter(F.col("length") <= max_bytes)
        .select(_path().alias("filepath"), T.decode_text(F.col("content")).alias("content"))
    )


def read_large_po_lines(
    spark: SparkSession, root: str, min_bytes: int = MAX_ROW_BYTES, glob: str = "*.po"
) -> DataFrame:
    """Lines of the ``*.po`` files over ``min_bytes``, in splittable form.

    Returns ``(filepath, blk, ln, value)``: ``blk`` is the start of the file split
    and ``ln`` grows with the lines of a split.
    """
    return (
        _po_options(spark.read, glob)
        .text(root)
        .filter(F.col("_metadata.file_size") > min_bytes)
        .select(
            _path().alias("filepath"),
            F.col("_metadata.file_block_start").alias("blk"),
            F.monotonically_increasing_id().alias("ln"),
            "value",
        )
    )


def po_lines(files: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The line form of ``(filepath, content)`` rows."""
    return files.select(
        "filepath", F.posexplode_outer(F.split("content", _NEWLINE, -1)).alias("ln", "value")
    ).filter(F.col("value").isNotNull()).select("filepath", F.expr(f"bigint(ln div {block_lines})").alias("blk"), "ln", "value")


def _unquote(block: Column) -> Column:
    """The text of a quoted block: pieces joined, escapes resolved."""
    joined = F.regexp_replace(block, r'"[ \t]*\n(?:#~[ \t]*)?"', "")

    def resolve(piece: Column) -> Column:
        for escape, char in _ESCAPES:
            piece = F.replace(piece, F.lit(escape), F.lit(char))
        return F.when(piece.rlike(_NUMERIC), numbered(piece)).otherwise(piece)

    def numbered(piece: Column) -> Column:
        """Octal and hexadecimal escapes."""
        parts = F.regexp_extract_all(piece, F.lit(_NUMERIC_PIECE), F.lit(1))

        def code(part: Column, start: int, base: int) -> Column:
            return F.char(F.conv(F.substring(part, start, 3), base, 10).cast("int"))

        return F.array_join(
            F.transform(
                parts,
                lambda p: F.when(p.startswith("\\x"), code(p, 3, 16))
                .when(p.rlike(r"\A\\[0-7]"), code(p, 2, 8))
                .otherwise(p),
            ),
            "",
        )

    def unescape(inner: Column) -> Column:
        # Double backslashes separate the pieces, so no placeholder is needed.
        pieces = F.split(inner, r"\\\\", -1)
        return F.when(~inner.contains("\\"), inner).otherwise(
            F.array_join(F.transform(pieces, resolve), "\\")
        )

    return let(F.regexp_extract(joined, r'(?s)\A"(.*)"\s*\z', 1), unescape)


def _field(entry: Column, keyword: str) -> Column:
    pattern = rf"(?dm)^{_OBSOLETE}{keyword}[ \t]*({_QUOTED}{_MORE})"
    return _unquote(F.regexp_extract(entry, pattern, 1))


def _occurrences(entry: Column) -> Column:
    refs = F.array_join(F.regexp_extract_all(entry, F.lit(r"(?dm)^#:(.*)$"), F.lit(1)), " ")
    tokens = F.filter(F.split(refs, r"\s+"), lambda t: t != "")
    line = r"\A(.*):(\d+)\z"

    def occurrence(token: Column) -> Column:
        numbered = token.rlike(line)
        return F.struct(
            F.when(numbered, F.regexp_extract(token, line, 1)).otherwise(token).alias("path"),
            F.when(numbered, F.regexp_extract(token, line, 2)).otherwise(F.lit("")).alias("line"),
        )

    return F.transform(tokens, occurrence)


def _tidy(content: Column) -> Column:
    """One newline style, no white space around lines, no marks, no blank lines."""
    lines = F.regexp_replace(content, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, rf"(?dm)^{_LEADING}", ""), rf"(?dm){_TRAILING}$", "")


def _entry_fields(rows: DataFrame) -> DataFrame:
    """Fields of ``(filepath, entry_no, entry)`` rows holding one entry's text."""
    entry = F.col("entry")
    plural = rf"(?dm)^{_OBSOLETE}msgstr\[\d+\][ \t]*({_QUOTED}{_MORE})"
    flags = F.array_join(F.regexp_extract_all(entry, F.lit(r"(?dm)^#,(.*)$"), F.lit(1)), ",")
    has_context = entry.rlike(rf'(?dm)^{_OBSOLETE}msgctxt[ \t]*"')
    forms = F.transform(F.regexp_extract_all(entry, F.lit(plural), F.lit(1)), _unquote)
    flag_list = F.filter(F.transform(F.split(flags, ","), lambda f: F.trim(f)), lambda f: f != "")

    def having(mark: str, value: Column, none: Column) -> Column:
        """``value``, looked for only in entries that hold its mark at all."""
        return F.when(entry.contains(mark), value).otherwise(none)

    texts, places = F.array().cast("array<string>"), F.array().cast("array<struct<path:string,line:string>>")
    fields = {
        "msgctxt": having("msgctxt", F.when(has_context, _field(entry, "msgctxt")), F.lit(None)),
        "msgid": _field(entry, "msgid"),
        "msgid_plural": having("msgid_plural", _field(entry, "msgid_plural"), F.lit("")),
        "msgstr": _field(entry, "msgstr"),
        "msgstr_plural": having("msgstr[", forms, texts),
        "flags": having("#,", flag_list, texts),
        "obsolete": entry.contains("#~") & entry.rlike(rf'(?dm)^#~[ \t]*{_KEYWORD}"'),
        "occurrences": having("#:", _occurrences(entry), places),
    }
    return with_columns_once(rows, fields).select("filepath", "entry_no", *fields)


def _tidied(files: DataFrame) -> DataFrame:
    tidy = _tidy(F.coalesce(F.col("content"), F.lit("")))
    return with_columns_once(files, {"_tidy": tidy})


def parse_po_entries(files: DataFrame) -> DataFrame:
    """All entries of ``(filepath, content)`` rows, header included. Map-only.

    A file that cannot be read gives no rows; ``po_problems`` tells why.
    """
    readable = _tidied(files).filter(F.col("_tidy").rlike(_READABLE))
    entries = F.regexp_extract_all("_tidy", F.lit(_ENTRY), F.lit(0))
    return _entry_fields(
        readable.select("filepath", F.posexplode_outer(entries).alias("_no", "entry"))
        .filter(F.col("entry").isNotNull())
        .select("filepath", F.col("_no").cast("bigint").alias("entry_no"), "entry")
    )


def po_problems(files: DataFrame) -> DataFrame:
    """The quarantine: files that give no entries, with the reason."""
    tidy = F.col("_tidy")
    reason = (
        F.when(~tidy.rlike(_HAS_KEYWORD), F.lit("no entries"))
        .when(tidy.rlike(_READABLE), F.when(~tidy.rlike(_HAS_ENTRY), F.lit("no entries")))
        .when(tidy.rlike(_OPEN_STRING), F.lit("unterminated string"))
        .otherwise(F.lit("unexpected line"))
    )
    return with_columns_once(_tidied(files), {"reason": reason}).filter(
        F.col("reason").isNotNull()
    ).select("filepath", "reason")


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"\A{_LEADING}|\s+\z", "")


def po_line_problems(lines: DataFrame) -> DataFrame:
    """The quarantine of files in line form; one flag row per task and file moves."""
    checked = with_columns_once(
        lines, {"_line": _trimmed(F.col("value"))}
    )
    line = F.col("_line")
    flags = checked.groupBy("filepath").agg(
        F.bool_or(line.rlike(_HAS_KEYWORD)).alias("_any"),
        F.bool_or(line.rlike(_HAS_ENTRY)).alias("_entry"),
        F.bool_or(line.rlike(_OPEN_STRING)).alias("_open"),
        F.bool_or(~line.rlike(_READABLE)).alias("_bad"),
    )
    reason = (
        F.when(~F.col("_any"), F.lit("no entries"))
        .when(~F.col("_bad"), F.when(~F.col("_entry"), F.lit("no entries")))
        .when(F.col("_open"), F.lit("unterminated string"))
        .otherwise(F.lit("unexpected line"))
    )
    return flags.select("filepath", reason.alias("reason")).filter(F.col("reason").isNotNull())


def po_lines_to_entries(lines: DataFrame) -> DataFrame:
    """All entries of a file given as ``(filepath, blk, ln, value)`` lines.

    An entry opens at a comment or keyword line other than ``msgstr`` that follows a
    ``msgstr``.  Lines are classified, moved and windowed once, by block, and the lines of
    an entry are put together where they are and written; what a block must know from
    earlier ones (the last keyword, how many entries were opened, whether the
    whole file is valid UTF-8) comes from the block table, one row per block.  Only
    entries at the edge of a block meet their other parts.
    Files with an unreadable line give no rows.
    """
    keys = ["filepath", "blk"]
    value = F.col("value")
    trimmed = with_columns_once(
        lines, {"_line": _trimmed(value)}
    ).filter(F.col("_line") != "")
    # Keywords, quotes and comment marks are ASCII: the class of a line does not
    # depend on the encoding.
    line = F.col("_line")
    keyword = F.regexp_extract(line, rf'\A{_OBSOLETE}({_KEYWORD})"', 1)
    kind = F.when(
        line.startswith("#") & ~line.rlike(rf'\A#~[ \t]*(?:{_KEYWORD})?"'), F.lit("#")
    ).otherwise(F.nullif(F.rtrim(keyword), F.lit("")))
    rows = with_columns_once(
        trimmed,
        {
            "_kind": kind,
            "_bad": ~line.rlike(_READABLE),
            "_utf8": F.is_valid_utf8(value),
            # Other comments are no field's input; a long run of them is never gathered.
            "_used": ~line.startswith("#") | line.rlike(rf'\A#[:,]|\A#~[ \t]*(?:{_KEYWORD})?"'),
        },
    ).drop("_line")

    def opens(kind: Column, previous: Column) -> Column:
        return F.coalesce(
            ~kind.startswith("msgstr") & previous.startswith("msgstr"), F.lit(False)
        )

    # Parts of a block: 0 is what comes before its first keyword or comment, 1 begins there.
    in_block = Window.partitionBy(*keys).orderBy("ln")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.last("_kind", ignorenulls=True).over(earlier)
    begun = F.coalesce("_kind", "_prev").isNotNull().cast("int")
    numbered = (
        rows.withColumn("value", F.when(F.col("_used"), F.col("value"))).drop("_used")
        .withColumn("_prev", previous)
        .withColumn("_part", F.sum(opens(F.col("_kind"), F.col("_prev")).cast("int")).over(upto) + begun)
    )
    known = F.when(F.col("_kind").isNotNull(), F.col("ln"))
    used = F.when(F.col("value").isNotNull(), F.struct("ln", "value"))
    parts = stage_table(
        numbered.groupBy(*keys, "_part").agg(
            F.array_join(F.array_sort(F.collect_list(used))["value"], "\n").alias("text"),
            F.min_by("_kind", known).alias("_first"),
            F.max_by("_kind", known).alias("_last"),
            F.bool_and("_utf8").alias("_utf8"),
            F.bool_or("_bad").alias("_bad"),
        ),
        "po-parts",
    )
    in_file = Window.partitionBy("filepath")
    by_block = in_file.orderBy("blk")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    # Written too, so that its size is known where it is joined.
    blocks = stage_table(
        parts.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_part") == 1, F.col("_first"))).alias("_first"),
            F.max_by("_last", "_part").alias("_last"),
            F.min("_part").alias("_least"),
            F.max("_part").alias("_most"),
            F.bool_and("_utf8").alias("_utf8_block"),
            F.bool_or("_bad").alias("_bad_block"),
        )
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        .withColumn("_first_opens", opens(F.col("_first"), F.col("_carry")).cast("int"))
        .select(
            *keys,
            "_first_opens",
            "_most",
            ((F.col("_least") == 0) | F.lag("blk").over(by_block).isNotNull()).alias("_continued"),
            F.lead("blk").over(by_block).isNotNull().alias("_continues"),
            F.coalesce(
                F.sum(F.greatest(F.col("_most") - 1, F.lit(0)) + F.col("_first_opens")).over(before), F.lit(0)
            ).alias("_before"),
            F.min("_utf8_block").over(in_file).alias("_utf8_file"),
            F.max("_bad_block").over(in_file).alias("_bad_file"),
        ),
        "po-blocks",
    )
    part = F.col("_part")
    placed = parts.select(*keys, "_part", "text").join(blocks, keys).filter(~F.col("_bad_file")).filter("text <> ''")
    placed = placed.withColumn(
        "entry_no", F.col("_before") + F.greatest(part - 1, F.lit(0)) + F.when(part > 0, F.col("_first_opens")).otherwise(0)
    )
    at_edge = (F.col("_continued") & (part <= 1)) | (F.col("_continues") & (part == F.col("_most")))
    joined = (
        placed.filter(at_edge).groupBy("filepath", "entry_no")
        .agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("blk", "_part", "text")))["text"], "\n").alias("text"),
            F.bool_and("_utf8_file").alias("_utf8_file"),
        )
    )
    columns = ["filepath", "entry_no", "text", "_utf8_file"]
    whole = placed.filter(~at_edge).select(*columns).union(joined.select(*columns))
    text = F.when(F.col("_utf8_file"), F.col("text")).otherwise(F.decode(F.col("text").cast("binary"), "ISO-8859-1"))
    entries = with_columns_once(whole, {"entry": _tidy(text)}).filter(F.col("entry").rlike(rf"(?dm){_MSGSTR}"))
    return _entry_fields(entries)


def is_translated() -> Column:
    """Current, confirmed, and translated (every plural form counts)."""
    plural = F.col("msgstr_plural")
    done = (F.col("msgstr") != "") | (
        (F.size(plural) > 0) & F.forall(plural, lambda form: form != "")
    )
    return ~F.col("obsolete") & ~F.array_contains("flags", "fuzzy") & done


def po_pairs(entries: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Corpus rows ``(filepath, pos, src, tgt, cxt, name)`` of parsed entries.

    Only translated entries with text on both sides are kept; ``keep_empty`` also
    keeps those with an empty side (plural-only entries).  The header is no entry.
    """
    header = (F.col("msgid") == "") & F.col("msgctxt").isNull() & (F.size("msgstr_plural") == 0)
    keep = is_translated() & ~header
    if not keep_empty:
        keep = keep & (F.col("msgid") != "") & (F.col("msgstr") != "")
    return entries.filter(keep).select(
        "filepath",
        F.col("entry_no").alias("pos"),
        T.normalise_text(F.col("msgid")).alias("src"),
        T.normalise_text(F.col("msgstr")).alias("tgt"),
        T.first_occurrence_context(F.col("occurrences.path")).alias("cxt"),
        F.col("filepath").alias("name"),
    )


def parse_po_blocks(files: DataFrame) -> DataFrame:
    """The older block form of extraction: ``(filepath, block_no, cxt, src, tgt)``.

    A block runs from one ``#:`` to the next ``#``.  Blocks without both keywords
    only pass their first line on, in front of the next full block's context.
    Map-only: the carry is an array slice inside the file's row.
    """
    files = files.withColumn(
        "_b", F.regexp_extract_all("content", F.lit(_OLD_BLOCK), F.lit(1))
    )
    blocks = F.col("_b")
    full = F.filter(
        F.transform(
            blocks,
            lambda b, i: F.when(b.contains("msgid") & b.contains("msgstr"), i),
        ),
        lambda i: i.isNotNull(),
    )
    files = files.withColumn("_full", full)

    def with_prefix(at: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("_full"), k - 1) + 1)
        heads = F.transform(
            F.slice(blocks, start + 1, at - start + 1), lambda b: F.substring_index(b, "\n", 1)
        )
        return F.struct(F.array_join(heads, "").alias("cxt"), F.get(blocks, at).alias("block"))

    cut = files.select(
        "filepath", F.posexplode_outer(F.transform("_full", with_prefix)).alias("block_no", "_e")
    ).filter(F.col("block_no").isNotNull())
    block = F.col("_e.block")
    source = F.regexp_extract(block, r"(?s)msgid(.*?)msgstr", 1)
    rows = with_columns_once(
        cut,
        {
            "cxt": T.clean_text(T.strip(F.col("_e.cxt"))),
            # The character in front of the closing keyword goes too.
            "src": T.clean_text(F.regexp_replace(source, r"(?s).\z", "")),
            "tgt": T.clean_text(F.regexp_extract(block, r"(?s)msgstr(.*)\z", 1)),
        },
    ).select("filepath", F.col("block_no").cast("bigint").alias("block_no"), "cxt", "src", "tgt")
    kept = F.lit(True)
    for name in ("src", "tgt", "cxt"):
        kept = kept & T.is_kept_text(F.col(name))
    return rows.filter(kept)
