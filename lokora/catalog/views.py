"""Corpus-shaped views over the given tables, in Spark and as SQL.

The tables hold no PO files, so each operator gets a deterministic view of a
whole table.  Every expression in ``SHARED`` style strings means the same in
both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokora.plans.corpus import build_corpus
from lokora.session import read_table, stage_table

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


ROW_KEYS = {
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", *ROW_KEYS[name])


def sql_rstrip(text: str) -> str:
    return rf"regexp_replace({text}, '{SPACE}+\z', '')"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({sql_rstrip(text)}, '\A{SPACE}+', '')"


def sql_normalise(text: str) -> str:
    return f"replace({sql_rstrip(f'coalesce({text}, chr(32))')}, chr(10), ' ')"


# --- Corpus rows from documents: line 2k is a source, line 2k+1 its target ----

REPO = "source || '/r' || cast({div} as varchar(20))"
_PATH = "repo || '/po/d' || cast(doc_id as varchar(20)) || '.po'"
_CXT = (
    "case when k % 5 = 4 then '' "
    "else 'src/m' || cast(k % 7 as varchar(20)) || '.c<cxt>' end"
)


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its line pairs: no line list is copied per pair."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")
    )
    lines = F.col("lines")
    pairs = F.transform(
        F.sequence(F.lit(0), F.expr("int((size(lines) + 1) div 2 - 1)")),
        lambda k: F.struct(
            k.cast("bigint").alias("k"),
            F.get(lines, k * 2).alias("src"),
            F.coalesce(F.get(lines, k * 2 + 1), F.lit("")).alias("tgt"),
        ),
    )
    return (
        docs.withColumn("repo", F.expr(REPO.format(div="doc_id div 1000")))
        .withColumn("filepath", F.expr(_PATH))
        .select("repo", "filepath", F.col("doc_id").alias("file_ord"), pairs.alias("pairs"))
    )


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line pairs of all documents, as they come."""
    return (
        document_pairs(spark, sf_dir)
        .select("repo", "filepath", "file_ord", F.inline_outer("pairs"))
        .select(
            "repo", "filepath", "file_ord", F.col("k").alias("pos"), "src", "tgt",
            F.expr(_CXT).alias("cxt"),
        )
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplicated, filtered corpus, computed in the query."""
    return build_corpus(raw_entries(spark, sf_dir))


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus table as later jobs read it, for queries with several branches."""
    return stage_table(entries(spark, sf_dir), "entries")


DOC_SQL = f"""
doc_lines as (
  select doc_id, {REPO.format(div="doc_id // 1000")} as repo,
         string_split(coalesce(text, ''), chr(10)) as lines
  from documents
),
doc_pairs as (
  select repo, {_PATH} as filepath, doc_id as file_ord, k,
         lines[2 * k + 1] as src, coalesce(lines[2 * k + 2], '') as tgt
  from (select *, unnest(range(0, (len(lines) + 1) // 2)) as k from doc_lines)
),
raw_entries as (
  select repo, filepath, file_ord, k as pos, src, tgt, {_CXT} as cxt from doc_pairs
)"""

ENTRIES_SQL = DOC_SQL + f""",
norm as (
  select repo, filepath, file_ord, pos, {sql_normalise('src')} as src,
         {sql_normalise('tgt')} as tgt, cxt
  from raw_entries where src <> '' and tgt <> ''
),
entries as (
  select repo, filepath, file_ord, pos, src, tgt, cxt from (
    select *, row_number() over (partition by src, tgt order by file_ord, pos) as rn from norm
  ) where rn = 1 and (length(src) < 200 or length(tgt) < 200)
)"""


# --- Corpus rows from conversations: a user turn and the answer to it ---------

_CONV = """
    'conv/r' || cast(u.conv_id % 10 as varchar(20)) as repo,
    'conv/r' || cast(u.conv_id % 10 as varchar(20)) || '/c' || cast(u.conv_id as varchar(20))
      || '.po' as filepath,
    u.conv_id as file_ord, u.turn as pos, u.text as src, a.text as tgt,
    'ui/v' || cast(u.turn % 3 as varchar(20)) || '.c<cxt>' as cxt
  from conversations u join conversations a
    on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant'
"""
CONV_SQL = f"conv as (select {_CONV})"


def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        f"select {_CONV.replace('conversations', '{t}')}", t=table(spark, sf_dir, "conversations")
    )


# --- Search hits from pages --------------------------------------------------

_LANG = "regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)"
_HIT = f"""
    page_id,
    case when page_id % 11 = 5 then null else
      case page_id % 3 when 0 then 'github.com' when 1 then 'gitlab.com'
        else regexp_extract(url, '^https?://([^/]+)/', 1) end
      || '/' || regexp_extract(url, '^https?://([^./]+)', 1) || '/app' end as repository,
    md5(url) as commit,
    case page_id % 4 when 0 then 'po/' || {_LANG} || '.po'
      when 1 then 'locale/' || {_LANG} || '_' || upper({_LANG}) || '.po'
      when 2 then 'locale/' || {_LANG} || '/LC_MESSAGES/app.po'
      else 'doc/' || {_LANG} || '.txt' end as path
  from pages
"""
HITS_SQL = f"hits as (select {_HIT})"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"select {_HIT.replace('from pages', 'from {t}')}", t=table(spark, sf_dir, "pages"))


# --- PO text from document pairs ---------------------------------------------


def _escaped(text: str) -> str:
    for char, to in ((92, "chr(92)"), (34, "chr(34)"), (9, "'t'"), (13, "'r'")):
        text = f"replace({text}, chr({char}), chr(92) || {to})"
    return text


def _po_lines(keyword: str, text: str) -> str:
    quoted = f"chr(34) || {_escaped(text)} || chr(34)"
    mark = "case when p.k % 11 = 5 then '#~ ' else '' end"
    return (
        f"{mark} || '{keyword} ' || case when p.k % 3 = 1 "
        f"then chr(34) || chr(34) || chr(10) || {mark} || {quoted} else {quoted} end || chr(10)"
    )


PO_ENTRY = (
    "case when p.k % 5 = 4 then '' else '#: src/m' || cast(p.k % 7 as varchar(20)) || '.c:' "
    "|| cast(p.k + 1 as varchar(20)) || ' src/alt.c:1' || chr(10) end "
    "|| case when p.k % 7 = 3 then '#, fuzzy, c-format' || chr(10) else '' end "
    f"|| {_po_lines('msgid', 'p.src')} || {_po_lines('msgstr', 'p.tgt')}"
)
PO_HEADER = (
    "'msgid ' || chr(34) || chr(34) || chr(10) || 'msgstr ' || chr(34) || "
    "'Content-Type: text/plain; charset=UTF-8' || chr(92) || 'n' || chr(34) || chr(10) || chr(10)"
)
# Entries the PO form keeps: neither obsolete nor fuzzy, text on both sides.
PO_KEPT = "k % 11 <> 5 and k % 7 <> 3 and src <> '' and tgt <> ''"


def po_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(filepath, content)``: each document as the text of one PO file."""
    body = F.expr(f"array_join(transform(pairs, p -> {PO_ENTRY}), chr(10))")
    return document_pairs(spark, sf_dir).select(
        "filepath", "file_ord", F.concat(F.expr(PO_HEADER), body).alias("content")
    )


PO_SQL = DOC_SQL + f""",
po_files as (
  select filepath, file_ord, {PO_HEADER} || string_agg({PO_ENTRY}, chr(10) order by p.k) as content
  from doc_pairs p group by filepath, file_ord
)"""


# --- System output log from conversations --------------------------------------

# A changed target, on one line, with subword marks.
_CHANGED = "replace(replace(replace(tgt, chr(10), ' '), 'en ', 'em '), 'ch', 'ch@@ ')"
LOG_ROWS = f"""
  select file_ord * 2147483648 + pos as row_id, src, tgt, {_CHANGED} as out_text from {{conv}}
"""
LOG_SQL = CONV_SQL + f""",
log_rows as ({LOG_ROWS.format(conv='conv')})"""


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG_ROWS.replace("{conv}", "{t}"), t=conversation_entries(spark, sf_dir))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoder's log: source, hypothesis and score lines."""
    rows = log_rows(spark, sf_dir)
    return rows.select(
        F.explode(
            F.array(
                F.expr("'S-' || row_id || chr(9) || replace(src, chr(10), ' ')"),
                F.expr("'H-' || row_id || chr(9) || '-0.' || (row_id % 10) || chr(9) || out_text"),
                F.expr("'P-' || row_id || chr(9) || '-0.5 -0.25'"),
            )
        ).alias("value")
    )
