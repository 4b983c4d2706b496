"""Queries for the corpus table, contexts and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokora.catalog import views as V
from lokora.catalog.registry import query
from lokora.catalog.source_queries import ORDER, ORDERED_SQL
from lokora.functions import text as T
from lokora.operators import corpus as C
from lokora.operators import splits as S
from lokora.operators.context import CONTEXT_TYPES, add_context, neighbour_context
from lokora.operators.ordering import global_index
from lokora.plans.corpus import translated_rows
from lokora.plans.splits import assign_splits, split_matrix
from lokora.session import stage_path, stage_table
from lokora.sinks import writers as W
from lokora.sources.lines import numbered_lines

# Share of training rows used by the split queries; the rest is evaluation.
SHARE = 0.6
# Tables too small for any eligible group give empty held-out sets (strict=False).
WITH_ENTRIES = f"with {V.ENTRIES_SQL}"
# A position is an index into one text, so it is under 2**31.
ROW_ID = "file_ord * 2147483648 + pos"


def _with_row_id(df: DataFrame) -> DataFrame:
    return df.withColumn("row_id", F.expr(ROW_ID))


# --- Corpus ------------------------------------------------------------------


@query(
    "corpus_repositories",
    WITH_ENTRIES + """ select repo, count(*) as pairs, count(distinct filepath) as files,
      cast(sum(length(src)) as bigint) as src_chars, cast(sum(length(tgt)) as bigint) as tgt_chars
    from entries group by repo""",
)
def corpus_repositories(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: raw rows to deduplicated, filtered corpus, summed per repository."""
    per_file = V.entries(spark, sf).groupBy("repo", "filepath").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.char_length("src").cast("bigint")).alias("s"),
        F.sum(F.char_length("tgt").cast("bigint")).alias("t"),
    )
    return per_file.groupBy("repo").agg(
        F.sum("n").alias("pairs"),
        F.count(F.lit(1)).alias("files"),
        F.sum("s").alias("src_chars"),
        F.sum("t").alias("tgt_chars"),
    )


@query(
    "corpus_table",
    WITH_ENTRIES + " select repo, filepath, file_ord, pos, src, tgt, cxt from entries",
)
def corpus_table(spark: SparkSession, sf: str) -> DataFrame:
    return V.entries(spark, sf)


@query(
    "pairs_first_kept",
    f"""with {V.ENTRIES_SQL}
    select filepath, pos, src, tgt from (
      select *, row_number() over (partition by src, tgt order by file_ord, pos) as rn from norm
    ) where rn = 1""",
)
def pairs_first_kept(spark: SparkSession, sf: str) -> DataFrame:
    rows = translated_rows(V.raw_entries(spark, sf))
    return C.dedup_pairs(rows).select("filepath", "pos", "src", "tgt")


@query(
    "pairs_unique",
    f"""with {V.ENTRIES_SQL} select src, tgt, min({ROW_ID}) as first_seen, max({ROW_ID}) as last_id
    from norm group by src, tgt""",
)
def pairs_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pairs in first-seen order, each with its last row id."""
    rows = _with_row_id(translated_rows(V.raw_entries(spark, sf)))
    return C.unique_pairs(rows)


@query("file_counts", WITH_ENTRIES + " select filepath, count(*) as cnt from entries group by filepath")
def file_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.file_counts(V.entries(spark, sf))


@query("repository_counts", WITH_ENTRIES + " select repo, count(*) as cnt from entries group by repo")
def repository_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.repo_counts(V.entries(spark, sf))


@query(
    "document_stream",
    WITH_ENTRIES + """, apps as (select repo, min(file_ord * 2147483648 + pos) as app_ord from entries group by repo)
    select app_ord, file_ord * 2147483648 + pos as seq, src as line from entries join apps using (repo)
    union all select app_ord, 9223372036854775807 as seq, '<d>' as line from apps
    union all select -1 as app_ord, 0 as seq, '<d>' as line""",
)
def document_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_row_id(V.stored_entries(spark, sf))
    return C.assemble_documents(rows, "repo", "row_id", "src")


@query(
    "document_stream_order",
    WITH_ENTRIES + """, apps as (select repo, min(file_ord * 2147483648 + pos) as app_ord from entries group by repo),
    stream as (
      select app_ord, file_ord * 2147483648 + pos as seq, src as line from entries join apps using (repo)
      union all select app_ord, 9223372036854775807 as seq, '<d>' as line from apps
      union all select -1 as app_ord, 0 as seq, '<d>' as line)
    select row_number() over (order by app_ord, seq) - 1 as line_no, line from stream""",
)
def document_stream_order(spark: SparkSession, sf: str) -> DataFrame:
    """The same stream with its line numbers, as a writer would lay it out."""
    stream = document_stream(spark, sf)
    return global_index(stream, ["app_ord", "seq"], "line_no").select("line_no", "line")


@query(
    "ambiguous_terms",
    f"""with {V.ENTRIES_SQL}, words as (
      select filepath, lower(src) as term, tgt from norm),
    targets as (select term, tgt, count(*) as uses, count(distinct filepath) as files from words group by term, tgt),
    terms as (select term, count(*) as n_targets from targets group by term having count(*) >= 2)
    select * from targets join terms using (term)""",
)
def ambiguous_terms(spark: SparkSession, sf: str) -> DataFrame:
    return C.ambiguous_terms(translated_rows(V.raw_entries(spark, sf)))


# --- Contexts ----------------------------------------------------------------

RING_SQL = WITH_ENTRIES + """, ring as (
  select filepath, pos, src, tgt, repo, cxt,
    row_number() over (partition by filepath order by pos) - 1 as idx,
    count(*) over (partition by filepath) as n from entries)"""


def _ring_side(column: str, size: int) -> str:
    left = " || ' ' || ".join(f"l{k}.{column}" for k in range(size, 0, -1))
    right = " || ' ' || ".join(f"r{k}.{column}" for k in range(1, size + 1))
    return f"{left} || ' <tag> ' || {right} || ' <tag> '"


def _ring_joins(size: int) -> str:
    def join(alias: str, offset: int) -> str:
        at = f"((i.idx + ({offset})) % i.n + i.n) % i.n"
        return f"join ring {alias} on {alias}.filepath = i.filepath and {alias}.idx = {at}"

    return " ".join(join(f"l{k}", -k) + " " + join(f"r{k}", k) for k in range(1, size + 1))


def _ring_query(size: int) -> str:
    return (
        RING_SQL + f" select i.filepath, i.pos, {_ring_side('src', size)} as cxt_src, "
        f"{_ring_side('tgt', size)} as cxt_tgt from ring i {_ring_joins(size)}"
    )


@query("neighbour_context", _ring_query(1))
def neighbour_one(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_context(V.stored_entries(spark, sf), 1).select(
        "filepath", "pos", "cxt_src", "cxt_tgt"
    )


@query("neighbour_context_wide", _ring_query(3))
def neighbour_three(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_context(V.stored_entries(spark, sf), 3).select(
        "filepath", "pos", "cxt_src", "cxt_tgt"
    )


@query(
    "neighbour_context_open",
    WITH_ENTRIES + """ select filepath, pos,
      coalesce(lag(src) over w, '') || ' <tag> ' || coalesce(lead(src) over w, '') || ' <tag> ' as cxt_src
    from entries window w as (partition by filepath order by pos)""",
)
def neighbour_open(spark: SparkSession, sf: str) -> DataFrame:
    """Without the ring: a file's first row has no left neighbour."""
    rows = neighbour_context(V.stored_entries(spark, sf), 1, columns=["src"], wrap=False)
    return rows.select("filepath", "pos", "cxt_src")


_PUNCT = "replace(regexp_replace(cxt, '[,.;@#?!&$/-]+ *', ' ', 'g'), ':', ' ')"


def _context_sql(value: str) -> str:
    cast = f"cast({value} as varchar)"
    return WITH_ENTRIES + f" select filepath, pos, {cast} as cxt_src, {cast} as cxt_tgt from entries"


def _context(spark: SparkSession, sf: str, cxt_type: str) -> DataFrame:
    rows = add_context(V.entries(spark, sf), cxt_type)
    return rows.select("filepath", "pos", "cxt_src", "cxt_tgt")


@query("no_context", _context_sql("null"))
def no_context(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf, "none")


@query("domain_context", _context_sql("repo || '##'"))
def domain_context(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf, "domain")


@query("filename_context", _context_sql(_PUNCT))
def filename_context(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf, "filename")


@query(
    "contextual_sides",
    WITH_ENTRIES + " select filepath, pos, repo || '## ' || src as full_src, repo || '## ' || tgt as full_tgt from entries",
)
def contextual_sides(spark: SparkSession, sf: str) -> DataFrame:
    rows = add_context(V.entries(spark, sf), "domain")
    return rows.select(
        "filepath",
        "pos",
        T.with_context(F.col("cxt_src"), F.col("src")).alias("full_src"),
        T.with_context(F.col("cxt_tgt"), F.col("tgt")).alias("full_tgt"),
    )


# --- Groups, holdout, order --------------------------------------------------

COUNTS_SQL = V.ENTRIES_SQL + f""",
counts as (select repo, count(*) as cnt from entries group by repo),
size as (
  select cast(sum(cnt) as bigint) as total,
    cast(sum(cnt) - trunc(cast({SHARE} as double) * sum(cnt)) as bigint) as wanted from counts
),
summed as (
  select repo, cnt, cast(sum(cnt) over (order by md5('0|' || repo), repo) as bigint) as cum
  from counts where cnt > 100 and cnt < 300
),
crossing as (
  select cum as k_cum, cnt as k_cnt from summed, size where 2 * cum >= wanted order by cum limit 1
),
chosen as (
  select repo, cnt, cum, case when cum < k_cum then 'test' else 'valid' end as split
  from summed, crossing, size where cum < k_cum or cum + k_cnt < wanted
)"""


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    return S.holdout_groups(C.repo_counts(V.stored_entries(spark, sf)), SHARE, strict=False)


@query("held_out_groups", f"with {COUNTS_SQL} select repo, cnt, cum, split from chosen")
def held_out_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf)


@query(
    "held_out_report",
    f"""with {COUNTS_SQL} select split, count(*) as groups, cast(sum(cnt) as bigint) as n_rows,
      min(cnt) as smallest, max(cnt) as largest from chosen group by split""",
)
def held_out_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.holdout_report(_chosen(spark, sf))


@query(
    "held_out_rows",
    f"with {COUNTS_SQL} select filepath, pos from entries where repo in (select repo from chosen)",
)
def held_out_rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.rows_of_groups(V.stored_entries(spark, sf), _chosen(spark, sf)).select("filepath", "pos")


@query(
    "group_offsets",
    f"""with {COUNTS_SQL} select repo, cnt, cast(coalesce(sum(cnt) over (
      order by repo rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from counts""",
)
def group_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return S.group_offsets(C.repo_counts(V.stored_entries(spark, sf)))


@query("corpus_order", ORDERED_SQL + " select row_id, repo, filepath, pos from ordered")
def corpus_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.entries(spark, sf).select("repo", "filepath", "pos")
    return global_index(rows, ORDER)


@query(
    "first_rows",
    WITH_ENTRIES + " select repo, filepath, pos, src from entries order by repo, filepath, pos limit 10",
)
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.entries(spark, sf).select("repo", "filepath", "pos", "src")
    return S.first_rows(rows, ORDER, 10)


# --- Samples and id sets -----------------------------------------------------

RANKED_SQL = f"""with {COUNTS_SQL}, ranked as (
  select *, row_number() over (
    order by md5('33|' || filepath || '|' || pos), filepath, pos) as rn from entries)"""
KEY = ("filepath", "pos")


@query(
    "exact_sample",
    RANKED_SQL + " select filepath, pos, src from ranked, size where rn <= wanted // 2",
)
def exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.stored_entries(spark, sf)
    wanted = S.eval_size(rows.agg(F.count(F.lit(1)).alias("n")).scalar(), SHARE)
    return S.sample_exact(rows, F.floor(wanted / 2), KEY).select("filepath", "pos", "src")


@query(
    "halved_set",
    RANKED_SQL + """ select filepath, pos, case when rn <= (select count(*) from entries) // 2
      then 'valid' else 'test' end as split from ranked""",
)
def halved_set(spark: SparkSession, sf: str) -> DataFrame:
    return S.halve(V.stored_entries(spark, sf), KEY).select("filepath", "pos", "split")


@query(
    "rows_without_ids",
    RANKED_SQL + " select filepath, pos from ranked, size where rn > wanted // 2",
)
def rows_without_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.stored_entries(spark, sf)
    return S.remove_ids(rows, exact_sample(spark, sf), KEY).select("filepath", "pos")


@query(
    "rows_by_id_list",
    f"""with {V.ENTRIES_SQL}, ids as (
      select doc_id * 7 as ord, doc_id as file_ord, quality as pos from labels
      union all select doc_id * 7 + 1 as ord, doc_id as file_ord, 0 as pos from labels)
    select ord, file_ord, cast(pos as bigint) as pos, src, tgt from ids join entries using (file_ord, pos)""",
)
def rows_by_id_list(spark: SparkSession, sf: str) -> DataFrame:
    """Rows picked by a list of ids, in list order, repeats included."""
    ids = spark.sql(
        "select doc_id * 7 as ord, doc_id as file_ord, quality as pos from {t} "
        "union all select doc_id * 7 + 1 as ord, doc_id as file_ord, 0 as pos from {t}",
        t=V.table(spark, sf, "labels"),
    )
    rows = S.select_ids(V.entries(spark, sf), ids, ["file_ord", "pos"])
    return rows.select("ord", "file_ord", F.col("pos").cast("bigint").alias("pos"), "src", "tgt")


@query(
    "repository_rows",
    WITH_ENTRIES + " select filepath, pos, src, tgt from entries where repo = 'src7/r0'",
)
def repository_rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.rows_of_repo(V.entries(spark, sf), "src7/r0").select("filepath", "pos", "src", "tgt")


# --- Overlap and pair location -----------------------------------------------

# Documents with a label form the evaluation side, the others the training side.
LABELLED_SQL = f"""with {V.ENTRIES_SQL}, n as (select *, {ROW_ID} as row_id from norm),
ev as (select * from n where file_ord in (select doc_id from labels)),
tr as (select * from n where file_ord not in (select doc_id from labels))"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _with_row_id(translated_rows(V.raw_entries(spark, sf)))
    labelled = V.table(spark, sf, "labels").select(F.col("doc_id").alias("file_ord"))
    return rows.join(labelled, "file_ord", "left_anti"), rows.join(labelled, "file_ord", "left_semi")


@query(
    "overlap_removed",
    LABELLED_SQL + """ select filepath, pos from tr
    where src not in (select src from ev) and tgt not in (select tgt from ev)""",
)
def overlap_removed(spark: SparkSession, sf: str) -> DataFrame:
    train, evaluation = _sides(spark, sf)
    return S.remove_eval_overlap(train, evaluation).select("filepath", "pos")


@query(
    "source_overlap_removed",
    LABELLED_SQL + " select filepath, pos from tr where src not in (select src from ev)",
)
def source_overlap_removed(spark: SparkSession, sf: str) -> DataFrame:
    train, evaluation = _sides(spark, sf)
    return S.remove_eval_overlap(train, evaluation, ["src"]).select("filepath", "pos")


@query(
    "overlap_rows",
    LABELLED_SQL + """ select row_id from tr where src in (
      select src from ev union select line from (
        select unnest(string_split(text, chr(10))) as line from benchmark))""",
)
def overlap_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows seen in the validation or the test side (labels, benchmark)."""
    train, valid = _sides(spark, sf)
    test = V.table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("src"))
    return S.overlap_rows(train, valid, test).select("row_id")


@query(
    "located_pairs",
    LABELLED_SQL + """, f as (select src, tgt, min(row_id) as found_id from n group by src, tgt)
    select row_id, found_id from ev join f using (src, tgt)""",
)
def located_pairs(spark: SparkSession, sf: str) -> DataFrame:
    train, evaluation = _sides(spark, sf)
    full = train.unionByName(evaluation).select("src", "tgt", "row_id")
    part = evaluation.select("src", "tgt", F.col("row_id").alias("part_id"))
    found = S.locate_pairs(full, part)
    return found.select(F.col("part_id").alias("row_id"), "found_id")


@query(
    "contextual_evaluation",
    LABELLED_SQL + """, f as (select src, tgt, min(row_id) as found_id from n group by src, tgt)
    select e.row_id, n.repo || '##' as cxt_src, n.repo from ev e join f using (src, tgt) join n on n.row_id = f.found_id""",
)
def contextual_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    train, evaluation = _sides(spark, sf)
    full = add_context(train.unionByName(evaluation), "domain")
    part = evaluation.select("src", "tgt", F.col("row_id").alias("part_id"))
    found = S.contextual_eval(full, part, ["cxt_src", "repo"])
    return found.select(F.col("part_id").alias("row_id"), "cxt_src", "repo")


# --- Split assembly ----------------------------------------------------------

SPLITS_SQL = COUNTS_SQL + """,
known as (select e.*, c.split as held from entries e left join chosen c using (repo)),
pool as (
  select * exclude (held), row_number() over (
    order by md5('33|' || filepath || '|' || pos), filepath, pos) as rn
  from known where held is null
),
drawn as (
  select * exclude (held), 'unknown_' || held as split from known where held is not null
  union all by name
  select * exclude (rn, total, wanted), case when rn <= wanted // 2 then 'rnd_valid'
    when rn <= 2 * (wanted // 2) then 'rnd_test' end as split from pool, size
),
ev as (select * from drawn where split is not null),
labelled as (
  select * exclude (split), coalesce(split, case when src in (select src from ev)
    or tgt in (select tgt from ev) then 'overlap' else 'train' end) as split from drawn
)"""


def labelled_entries(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(V.stored_entries(spark, sf), SHARE, strict=False)


@query("assigned_splits", f"with {SPLITS_SQL} select filepath, pos, split from labelled")
def assigned_splits(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_entries(spark, sf).select("filepath", "pos", "split")


@query(
    "three_way_split",
    f"""with {SPLITS_SQL} select split, count(*) as n, cast(sum(length(src)) as bigint) as chars
    from labelled where split in ('train', 'unknown_valid', 'unknown_test') group by split""",
)
def three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    kept = labelled_entries(spark, sf).filter(F.col("split").isin("train", "unknown_valid", "unknown_test"))
    return kept.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("src").cast("bigint")).alias("chars")
    )


@query(
    "split_stats",
    f"""with {SPLITS_SQL} select count(*) as total,
      count(*) filter (split not like 'unknown%') as train_before,
      count(*) filter (split = 'train') as train_after, count(*) filter (split = 'overlap') as overlap,
      count(*) filter (split = 'unknown_valid') as unknown_valid,
      count(*) filter (split = 'unknown_test') as unknown_test,
      count(*) filter (split = 'rnd_valid') as rnd_valid, count(*) filter (split = 'rnd_test') as rnd_test
    from labelled""",
)
def split_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_stats(labelled_entries(spark, sf))


@query(
    "evaluation_union",
    f"with {SPLITS_SQL} select split, filepath, pos, src, tgt from ev",
)
def evaluation_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled_entries(spark, sf)
    frames = [rows.filter(F.col("split") == name) for name in S.EVAL_SPLITS]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union.select("split", "filepath", "pos", "src", "tgt")


MATRIX_SQL = SPLITS_SQL + f""",
ring as (
  select *, row_number() over (partition by filepath order by pos) - 1 as idx,
    count(*) over (partition by filepath) as n from labelled
),
contexts as (
  select filepath, pos, src, tgt, split, repo, 'none' as cxt_type, '' as cs, '' as ct from labelled
  union all
  select filepath, pos, src, tgt, split, repo, 'domain', repo || '## ', repo || '## ' from labelled
  union all
  select filepath, pos, src, tgt, split, repo, 'filename', {_PUNCT} || ' ', {_PUNCT} || ' ' from labelled
  union all
  select i.filepath, i.pos, i.src, i.tgt, i.split, i.repo, 'neighbour',
    {_ring_side('src', 1)} || ' ', {_ring_side('tgt', 1)} || ' ' from ring i {_ring_joins(1)}
),
matrix as (
  select *, regexp_replace(split, '^(rnd|unknown)_', '') as part,
    case when split like 'rnd%' then 'rnd' else 'unknown' end as eval_set
  from contexts where split <> 'overlap'
),
directed as (
  select repo, filepath, pos, cxt_type, eval_set, part as split, 'en-de' as direction,
    cs || src as input, tgt as output from matrix
  union all
  select repo, filepath, pos, cxt_type, eval_set, part, 'de-en', ct || tgt, src from matrix
)"""


@query(
    "split_matrix",
    f"with {MATRIX_SQL} select filepath, pos, cxt_type, direction, eval_set, split, input, output from directed",
)
def full_split_matrix(spark: SparkSession, sf: str) -> DataFrame:
    labelled = stage_table(labelled_entries(spark, sf), "labelled")
    return split_matrix(labelled).select(
        "filepath", "pos", "cxt_type", "direction", "eval_set", "split", "input", "output"
    )


@query(
    "split_matrix_written",
    f"""with {MATRIX_SQL} select cxt_type, direction, eval_set, split, count(*) as n,
      cast(sum(length(input)) as bigint) as input_chars, cast(sum(length(output)) as bigint) as output_chars
    from directed group by cxt_type, direction, eval_set, split""",
)
def split_matrix_written(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix as the sink lays it out, read back by partition."""
    path = stage_path(spark, "matrix")
    labelled = stage_table(labelled_entries(spark, sf), "labelled")
    W.write_splits(labelled, path, "en", "de")
    return spark.read.parquet(path).groupBy("cxt_type", "direction", "eval_set", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.char_length("input").cast("bigint")).alias("input_chars"),
        F.sum(F.char_length("output").cast("bigint")).alias("output_chars"),
    )


@query(
    "exported_sets",
    f"""with {MATRIX_SQL}, lines as (
      select cxt_type, direction, eval_set, split, input, output,
        row_number() over (partition by cxt_type, direction, eval_set, split order by filepath, pos) - 1 as row_id
      from directed)
    select *, case when split = 'test' then output end as ref from lines""",
)
def exported_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Exported line files read back by line number, with the references of their rows."""
    path = stage_path(spark, "exported")
    labelled = stage_table(labelled_entries(spark, sf), "labelled")
    W.write_labelled_sets(labelled, path, "en", "de")
    inputs, outputs = (numbered_lines(spark, f"{path}/{c}", c, W.SET) for c in ("input", "output"))
    return exported_rows(inputs, outputs, spark.read.parquet(f"{path}/references"))


def exported_rows(inputs: DataFrame, outputs: DataFrame, references: DataFrame) -> DataFrame:
    """Lines of the same number beside one another, with the references of their rows."""
    # A reference holds for every context type. The split comes with it, as a constant would
    # drop out of the key, and the lines would move again for the full join.
    types = F.array(*[F.struct(F.lit(c).alias("cxt_type"), F.lit("test").alias("split")) for c in CONTEXT_TYPES])
    refs = references.select("*", F.inline(types))
    key = [*W.SET, "row_id"]
    # References first: a full join keeps no placement for a later one.
    return inputs.join(outputs.join(refs, key, "left"), key, "full")
