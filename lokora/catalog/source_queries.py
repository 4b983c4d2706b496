"""Queries for sources, sinks, URLs and text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokora.catalog import views as V
from lokora.catalog.registry import query
from lokora.functions import text as T
from lokora.functions import urls as U
from lokora.operators.context import filter_max_tokens
from lokora.operators.corpus import drop_empty_or_long, file_counts, length_filter
from lokora.session import stage_path
from lokora.sinks import writers as W
from lokora.sources import lines as L
from lokora.sources import po
from lokora.streaming import hits as H

RAW_URL_SQL = """
  case when repository like 'github.com/%'
      then 'https://raw.githubusercontent.com/' || substr(repository, 12) || '/' || commit || '/' || path
    when repository like 'gitlab.com/%'
      then 'https://gitlab.com/' || substr(repository, 12) || '/-/raw/' || commit || '/' || path
  end"""
URLS_SQL = V.HITS_SQL + f""",
urls as (
  select * from (select *, {RAW_URL_SQL} as url from hits where repository is not null)
  where url is not null and url like '%.po'
)"""


# --- Search hits and URLs ------------------------------------------------------


@query("search_hit_scan", f"with {V.HITS_SQL} select repository, commit, path from hits")
def search_hit_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "hits")
    V.hits(spark, sf).drop("page_id").write.json(path)
    return L.read_hits(spark, path)


@query("search_hit_json", f"with {V.HITS_SQL} select repository, commit, path from hits")
def search_hit_json(spark: SparkSession, sf: str) -> DataFrame:
    text = V.hits(spark, sf).select(F.to_json(F.struct("repository", "commit", "path")).alias("value"))
    return L.hits_from_json(text)


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return H.hits_to_urls(V.hits(spark, sf))


@query("raw_urls", f"with {URLS_SQL} select page_id, url from urls")
def raw_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("page_id", "url")


@query(
    "locale_paths",
    f"with {V.HITS_SQL} select page_id, path from hits "
    r"where regexp_matches(path, '(?i)/fr(.fr)?\.po$')",
)
def locale_paths(spark: SparkSession, sf: str) -> DataFrame:
    return V.hits(spark, sf).filter(U.matches_locale(F.col("path"), "fr")).select("page_id", "path")


@query("url_list_scan", f"with {URLS_SQL} select url from urls")
def url_list_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "urls")
    W.write_lines(_urls(spark, sf), "url", path)
    return L.read_lines(spark, path, "url")


@query(
    "url_paths",
    f"""with {URLS_SQL}, every as (select page_id, url from urls union all select page_id, url from pages)
    select page_id, url, case when contains(url, 'https://raw.githubusercontent.com/')
        then replace(url, 'https://raw.githubusercontent.com/', '')
      when contains(url, 'https://gitlab.com/') then replace(url, 'https://gitlab.com/', '') end as rel_path
    from every""",
)
def url_paths(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.table(spark, sf, "pages").select("page_id", "url")
    every = _urls(spark, sf).select("page_id", "url").unionByName(pages)
    return every.withColumn("rel_path", U.url_to_path(F.col("url")))


@query(
    "url_provenance",
    f"""with {URLS_SQL}
    select page_id, case when repository like 'github.com/%' then 'raw.githubusercontent.com'
        else 'gitlab.com' end as host,
      string_split(repository, '/')[2] as owner, string_split(repository, '/')[3] as repo, commit, path
    from urls""",
)
def url_provenance(spark: SparkSession, sf: str) -> DataFrame:
    urls = _urls(spark, sf).select("page_id", "url")
    return U.with_provenance(urls).drop("url")


@query("url_stream", f"with {URLS_SQL} select repository, commit, path, url from urls")
def url_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as files in a folder, streamed to a table of URLs."""
    source, out, state = (stage_path(spark, n) for n in ("hit-stream", "url-table", "url-state"))
    V.hits(spark, sf).drop("page_id").repartition(4).write.json(source)
    run = H.write_url_stream(H.stream_hits(spark, source, max_files=2), out, state)
    run.awaitTermination()
    return spark.read.schema("repository string, commit string, path string, url string").parquet(out)


@query("url_stream_distinct", f"with {URLS_SQL} select distinct url from urls")
def url_stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    source, out, state = (stage_path(spark, n) for n in ("hit-stream", "url-table", "url-state"))
    hits = V.hits(spark, sf).drop("page_id")
    hits.unionByName(hits).repartition(4).write.json(source)
    H.write_new_urls(H.stream_hits(spark, source, max_files=2), out, state).awaitTermination()
    return H.read_new_urls(spark, out).select("url")


@query(
    "directory_list",
    f"with {V.DOC_SQL} select distinct filepath, repo || '/po' as dirpath from raw_entries",
)
def directory_list(spark: SparkSession, sf: str) -> DataFrame:
    files = V.document_pairs(spark, sf).select("filepath")
    # One row per file already; the path is kept beside its directory.
    return files.select("filepath", W.parent_directory(F.col("filepath")).alias("dirpath"))


@query(
    "path_parts",
    f"""with {V.DOC_SQL} select distinct filepath, repo || '/po/' as dir,
      'd' || file_ord || '.po' as base, string_split(repo, '/')[1] as owner,
      string_split(filepath, '/')[3] as third, cast(null as varchar) as ninth from raw_entries""",
)
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("filepath")
    return V.document_pairs(spark, sf).select(
        "filepath",
        T.dirname(path).alias("dir"),
        T.basename(path).alias("base"),
        T.path_component(path, 0).alias("owner"),
        T.path_component(path, 2).alias("third"),
        T.path_component(path, 9).alias("ninth"),
    )


# --- PO files ----------------------------------------------------------------

PO_PAIRS_SQL = f"""with {V.DOC_SQL}
  select filepath, {V.sql_normalise('src')} as src, {V.sql_normalise('tgt')} as tgt, cxt
  from (select *, pos as k from raw_entries) where {V.PO_KEPT}"""


@query("po_entries", PO_PAIRS_SQL)
def po_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = po.parse_po_entries(V.po_files(spark, sf))
    return po.po_pairs(entries).select("filepath", "src", "tgt", "cxt")


@query("po_entries_by_line", PO_PAIRS_SQL)
def po_entries_by_line(spark: SparkSession, sf: str) -> DataFrame:
    lines = po.po_lines(V.po_files(spark, sf), block_lines=64)
    return po.po_pairs(po.po_lines_to_entries(lines)).select("filepath", "src", "tgt", "cxt")


@query(
    "po_file_scan",
    PO_PAIRS_SQL.replace("select filepath, ", "select "),
)
def po_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """PO files on storage: found below a root, decoded, parsed."""
    path = stage_path(spark, "po-files")
    V.po_files(spark, sf).select("content").write.option("maxRecordsPerFile", 50).text(path)
    files = po.read_po_files(spark, path, glob="*.txt")
    return po.po_pairs(po.parse_po_entries(files)).select("src", "tgt", "cxt")


@query(
    "po_large_file_scan",
    PO_PAIRS_SQL.replace("select filepath, ", "select "),
)
def po_large_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same files read by lines, as files too large for one row are."""
    path = stage_path(spark, "po-large")
    V.po_files(spark, sf).select("content").write.text(path)
    lines = po.read_large_po_lines(spark, path, min_bytes=0, glob="*.txt")
    return po.po_pairs(po.po_lines_to_entries(lines)).select("src", "tgt", "cxt")


@query(
    "po_quarantine",
    """select doc_id, case doc_id % 10 when 3 then 'unterminated string'
      when 4 then 'unexpected line' else 'no entries' end as reason
    from documents where doc_id % 10 in (3, 4, 5)""",
)
def po_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("file_ord") % 10
    content = (
        F.when(turn == 3, F.concat("content", F.lit('\nmsgid "open\nmsgstr "x"\n')))
        .when(turn == 4, F.concat("content", F.lit("\nnoise\n")))
        .when(turn == 5, F.lit("# nothing here\n"))
        .otherwise(F.col("content"))
    )
    files = V.po_files(spark, sf).select(F.col("file_ord").alias("filepath"), content.alias("content"))
    return po.po_problems(files).select(F.col("filepath").alias("doc_id"), "reason")


_HAS = "contains(block, 'msgid') and contains(block, 'msgstr')"
PO_BLOCKS_SQL = f"""with {V.PO_SQL},
blocks as (
  select filepath, i, list[i] as block, {_HAS.replace('block', 'list[i]')} as full_block
  from (select filepath, list, unnest(range(1, len(list) + 1)) as i
        from (select filepath, regexp_extract_all(content, '#:([^#]*)', 1) as list from po_files))
),
runs as (
  select *, coalesce(sum(cast(full_block as int)) over (
    partition by filepath order by i rows between unbounded preceding and 1 preceding), 0) as run
  from blocks
),
heads as (
  select filepath, run, string_agg(string_split(block, chr(10))[1], '' order by i) as cxt,
    max(case when full_block then block end) as block
  from runs group by filepath, run
),
cut as (
  select filepath, {{strip_cxt}} as cxt,
    regexp_replace(regexp_extract(block, '(?s)msgid(.*?)msgstr', 1), '(?s).\\z', '') as src,
    regexp_extract(block, '(?s)msgstr(.*)\\z', 1) as tgt
  from heads where block is not null
)""".replace("{strip_cxt}", V.sql_strip("cxt"))


def _sql_clean(text: str) -> str:
    squeeze = f"'{V.SPACE}{{2,}}', ' ', 'g')"
    once = f"regexp_replace(replace({text}, chr(10), ''), {squeeze}"
    return f"replace(regexp_replace(replace({once}, chr(34), ''), {squeeze}, '_', '')"


def _sql_usable(text: str) -> str:
    bare = V.sql_strip(text)
    return f"({bare} <> '' and length({bare}) <= 200 and {bare} <> 'translator-credits')"


@query(
    "po_blocks",
    PO_BLOCKS_SQL
    + f""", clean as (select filepath, {_sql_clean('cxt')} as cxt, {_sql_clean('src')} as src,
      {_sql_clean('tgt')} as tgt from cut)
    select * from clean where {_sql_usable('cxt')} and {_sql_usable('src')} and {_sql_usable('tgt')}""",
)
def po_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return po.parse_po_blocks(V.po_files(spark, sf)).drop("block_no")


@query(
    "occurrence_context",
    f"""with {V.DOC_SQL} select filepath, pos, cxt,
      case when cxt = '' then '' else replace(cxt, '<cxt>', '') || ':' || (pos + 1) || ' src/alt.c:1' end as refs
    from raw_entries where src <> ''""",
)
def occurrence_context(spark: SparkSession, sf: str) -> DataFrame:
    """All occurrences of each entry, and the first one as its context."""
    entries = po.parse_po_entries(V.po_files(spark, sf)).filter("msgid <> ''")
    refs = F.transform("occurrences", lambda o: F.concat(o["path"], F.lit(":"), o["line"]))
    return entries.select(
        "filepath",
        (F.col("entry_no") - 1).alias("pos"),  # entry 0 is the header
        T.first_occurrence_context(F.col("occurrences.path")).alias("cxt"),
        F.array_join(refs, " ").alias("refs"),
    )


@query(
    "decode_fallback",
    "select doc_id, md5(text) as digest from documents",
)
def decode_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Every second text that has an ISO-8859-1 form arrives in it, the others as UTF-8."""
    docs = V.table(spark, sf, "documents")
    narrow = (F.col("doc_id") % 2 == 0) & F.col("text").rlike(r"\A[\x{00}-\x{FF}]*\z")
    content = F.when(narrow, F.encode("text", "ISO-8859-1")).otherwise(
        F.encode("text", "UTF-8")
    )
    return docs.select("doc_id", F.md5(T.decode_text(content)).alias("digest"))


# --- Line files, aligned files, CSV ------------------------------------------


@query(
    "line_file_scan",
    f"""select line, count(*) as cnt from (
      select {V.sql_rstrip('line')} as line from (
        select unnest(string_split(text, chr(10))) as line from documents)) group by line""",
)
def line_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "lines")
    W.write_lines(V.table(spark, sf, "documents"), "text", path)
    return L.read_lines(spark, path, "line").groupBy("line").agg(F.count(F.lit(1)).alias("cnt"))


ORDERED_SQL = f"""with {V.ENTRIES_SQL}, ordered as (
  select *, row_number() over (order by repo, filepath, pos) - 1 as row_id from entries)"""
ORDER = ("repo", "filepath", "pos")


@query("aligned_files", ORDERED_SQL + " select row_id, src, tgt, filepath from ordered")
def aligned_files(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus columns written as line files in corpus order and zipped again."""
    path = stage_path(spark, "aligned")
    rows = V.entries(spark, sf)
    W.write_aligned(rows, {"src": "en", "tgt": "de", "filepath": "path"}, path, "full", ORDER)
    return L.read_aligned(
        spark, {"src": f"{path}/full.en", "tgt": f"{path}/full.de", "filepath": f"{path}/full.path"}
    )


@query(
    "attached_columns",
    ORDERED_SQL + " select row_id, filepath, pos, '* ' || src as src, '* ' || tgt as tgt from ordered",
)
def attached_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Changed text columns from line files take the place of the table's own."""
    from lokora.operators.ordering import global_index

    path = stage_path(spark, "attached")
    rows = V.entries(spark, sf)
    changed = rows.withColumns({c: F.concat(F.lit("* "), c) for c in ("src", "tgt")})
    W.write_aligned(changed, {"src": "en", "tgt": "de"}, path, "tok", ORDER)
    aligned = L.read_aligned(spark, {"src": f"{path}/tok.en", "tgt": f"{path}/tok.de"})
    numbered = global_index(rows, ORDER)
    return L.attach_aligned(numbered, aligned).select("row_id", "filepath", "pos", "src", "tgt")


@query(
    "entries_csv",
    f"with {V.ENTRIES_SQL} select src, tgt, cxt, filepath as name, filepath from entries",
)
def entries_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "csv")
    rows = V.entries(spark, sf).withColumn("name", F.col("filepath"))
    W.write_entries_csv(rows, path, L.ENTRY_COLUMNS)
    read = L.read_entries_csv(spark, path)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in L.ENTRY_COLUMNS])


@query(
    "disambiguation_scan",
    f"""with {V.ENTRIES_SQL}, lines as (
      select '''' || src || ''', ''' || tgt || ''', ''' || filepath || '''' as line from entries
    ), fields as (select line, $$'(.*)', '(.*)', '(.*)'$$ as form from lines)
    select regexp_extract(line, form, 1) as src, regexp_extract(line, form, 2) as tgt,
      regexp_extract(line, form, 3) as url from fields""",
)
def disambiguation_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "disambiguation")
    """Texts with apostrophes too: the fields are what the greedy pattern reads."""
    rows = V.entries(spark, sf)
    line = F.concat(F.lit("'"), F.concat_ws("', '", "src", "tgt", "filepath"), F.lit("'"))
    W.write_lines(rows.select(line.alias("line")), "line", path)
    return L.read_disambiguation(spark, path)


@query(
    "hypothesis_scan",
    f"with {V.LOG_SQL} select row_id as sent_id, cast('-0.' || (row_id % 10) as double) as score, "
    f"{V.sql_rstrip('out_text')} as hyp from log_rows",
)
def hypothesis_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "log")
    W.write_lines(V.log_lines(spark, sf), "value", path)
    return L.read_hypotheses(spark, path)


# --- Sinks -------------------------------------------------------------------


@query(
    "per_repository_output",
    f"with {V.ENTRIES_SQL} select repo, count(*) as cnt, min(src) as low, max(tgt) as high "
    "from entries group by repo",
)
def per_repository_output(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "by-repo")
    W.write_entries(V.entries(spark, sf), path, ["repo"])
    return spark.read.parquet(path).groupBy("repo").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("src").alias("low"), F.max("tgt").alias("high")
    )


@query(
    "grouped_overwrite",
    f"with {V.ENTRIES_SQL} select repo, filepath, pos, "
    "case when repo like '%5/%' then '* ' || src else src end as src from entries",
)
def grouped_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Some repositories are written again; the others stay as they were."""
    path = stage_path(spark, "overwrite")
    rows = V.entries(spark, sf).select("repo", "filepath", "pos", "src")
    W.overwrite_files(rows, path, ["repo"])
    again = rows.filter(F.col("repo").like("%5/%")).withColumn("src", F.concat(F.lit("* "), "src"))
    W.overwrite_files(again, path, ["repo"])
    return spark.read.parquet(path).select("repo", "filepath", "pos", "src")


@query(
    "count_list",
    f"with {V.ENTRIES_SQL} select row_number() over (order by cnt desc) - 1 as row_id, "
    "cast(cnt as varchar) as cnt from (select count(*) as cnt from entries group by filepath)",
)
def count_list(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "counts")
    W.write_counts(V.entries(spark, sf), path)
    return L.numbered_lines(spark, path, "cnt")


# --- Text expressions ----------------------------------------------------------


@query(
    "normalised_text",
    f"select doc_id, {V.sql_normalise('text')} as norm, length({V.sql_normalise('text')}) as n from documents",
)
def normalised_text(spark: SparkSession, sf: str) -> DataFrame:
    norm = T.normalise_text(F.col("text"))
    return V.table(spark, sf, "documents").select(
        "doc_id", norm.alias("norm"), F.char_length(norm).cast("bigint").alias("n")
    )


@query(
    "cleaned_text",
    f"select doc_id, {_sql_clean('text')} as clean from documents",
)
def cleaned_text(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(
    "translated_rows",
    f"with {V.DOC_SQL} select filepath, pos, src, tgt from raw_entries "
    "where pos % 11 <> 5 and pos % 7 <> 3 and src <> '' and tgt <> ''",
)
def translated_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.raw_entries(spark, sf)
    keep = T.is_translated(
        F.col("src"), F.col("tgt"), F.col("pos") % 11 == 5, F.col("pos") % 7 == 3
    )
    return rows.filter(keep).select("filepath", "pos", "src", "tgt")


@query(
    "length_filtered",
    f"""with {V.DOC_SQL} select filepath, pos, 'or' as mode from raw_entries
      where length(src) < 200 or length(tgt) < 200
    union all select filepath, pos, 'and' as mode from raw_entries
      where length(src) < 200 and length(tgt) < 200""",
)
def length_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.raw_entries(spark, sf)
    either = length_filter(rows).select("filepath", "pos", F.lit("or").alias("mode"))
    both = length_filter(rows, mode="and").select("filepath", "pos", F.lit("and").alias("mode"))
    return either.unionByName(both)


@query(
    "usable_text",
    f"with {V.DOC_SQL} select filepath, pos, src, tgt from raw_entries "
    f"where {_sql_usable('src')} and {_sql_usable('tgt')}",
)
def usable_text(spark: SparkSession, sf: str) -> DataFrame:
    return drop_empty_or_long(V.raw_entries(spark, sf), ["src", "tgt"]).select(
        "filepath", "pos", "src", "tgt"
    )


_PUNCT_SQL = "replace(regexp_replace({0}, '[,.;@#?!&$/-]+ *', ' ', 'g'), ':', ' ')"


@query(
    "punctuation_replaced",
    f"select doc_id, {_PUNCT_SQL.format('text')} as plain, {_PUNCT_SQL.format('source')} as tag from documents",
)
def punctuation_replaced(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select(
        "doc_id",
        T.replace_punct(F.col("text")).alias("plain"),
        T.replace_punct(F.col("source")).alias("tag"),
    )


@query(
    "token_limited",
    f"""with {V.DOC_SQL} select filepath, pos from raw_entries
    where len(string_split(cxt || ' ' || src, ' ')) < 30
      and len(string_split(cxt || ' ' || tgt, ' ')) < 30""",
)
def token_limited(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.raw_entries(spark, sf).withColumns({"cxt_src": F.col("cxt"), "cxt_tgt": F.col("cxt")})
    return filter_max_tokens(rows, 30).select("filepath", "pos")


@query(
    "repository_keys",
    f"with {V.DOC_SQL} select distinct filepath, repo, string_split(filepath, '/')[3] as part from raw_entries",
)
def repository_keys(spark: SparkSession, sf: str) -> DataFrame:
    from lokora.operators.corpus import with_repo

    files = V.document_pairs(spark, sf).select("filepath")
    by_part = with_repo(files, component=2).withColumnRenamed("repo", "part")
    return with_repo(by_part)


@query(
    "subwords_joined",
    f"with {V.LOG_SQL} select row_id, regexp_replace(out_text, '@@( |\\z)', '', 'g') as hyp from log_rows",
)
def subwords_joined(spark: SparkSession, sf: str) -> DataFrame:
    return V.log_rows(spark, sf).select("row_id", T.remove_subwords(F.col("out_text")).alias("hyp"))


@query(
    "file_union_counts",
    f"with {V.DOC_SQL} select filepath, count(*) as cnt from raw_entries group by filepath",
)
def file_union_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per file before deduplication."""
    return file_counts(V.raw_entries(spark, sf))
