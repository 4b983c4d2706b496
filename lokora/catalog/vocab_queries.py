"""Queries for tokens, subwords, dictionaries, encoding and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokora.catalog import views as V
from lokora.catalog.corpus_queries import MATRIX_SQL, WITH_ENTRIES, labelled_entries
from lokora.catalog.registry import query
from lokora.functions import text as T
from lokora.functions import tokens as K
from lokora.operators import metrics as M
from lokora.operators import vocab as B
from lokora.plans.evaluation import plain_hypotheses, score_report
from lokora.plans.splits import split_matrix
from lokora.session import stage_table

def sql_chain(text: str, rules) -> str:
    """The same rules as nested SQL replacements."""
    for pattern, to in rules:
        to = to.replace("$", "\\").replace("'", "''")
        pattern = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


def sql_literal(text: str, pairs) -> str:
    for old, new in pairs:
        old, new = old.replace("'", "''"), new.replace("'", "''")
        text = f"replace({text}, '{old}', '{new}')"
    return text


def sql_tokenise(text: str, lang: str, escape: bool = True) -> str:
    split = K.CONTRACTION.get(lang, K.OTHER_CONTRACTION)
    rules = (*K.SEPARATE, *K.APOSTROPHE, (r"(\p{L})'(\p{L})", split), *K.PERIOD)
    tokens = f"trim({sql_chain(text, rules)}, ' ')"
    return sql_literal(tokens, K.ESCAPES) if escape else tokens


def sql_detokenise(text: str, lang: str) -> str:
    plain = sql_literal(text, [(to, frm) for frm, to in reversed(K.ESCAPES)])
    rules = K.JOIN + ((K.JOIN_CONTRACTION[lang],) if lang in K.JOIN_CONTRACTION else ())
    return f"trim({sql_chain(plain, rules)}, ' ')"


# --- Tokens ------------------------------------------------------------------


@query(
    "tokenised_corpus",
    WITH_ENTRIES + f""" select filepath, pos, {sql_tokenise('src', 'en')} as src,
      {sql_tokenise('tgt', 'de')} as tgt, {sql_tokenise('cxt', 'en')} as cxt from entries""",
)
def tokenised_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return V.entries(spark, sf).select(
        "filepath",
        "pos",
        K.tokenise(F.col("src"), "en").alias("src"),
        K.tokenise(F.col("tgt"), "de").alias("tgt"),
        K.tokenise(F.col("cxt"), "en").alias("cxt"),
    )


@query(
    "tokenised_documents",
    "select doc_id, case lang "
    + " ".join(f"when '{lg}' then {sql_tokenise('text', lg)}" for lg in ("en", "fr", "it"))
    + f" else {sql_tokenise('text', 'de')} end as tokens from documents",
)
def tokenised_documents(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    tokens = K.tokenise(text, "de")
    for lang in ("en", "fr", "it"):
        tokens = F.when(F.col("lang") == lang, K.tokenise(text, lang)).otherwise(tokens)
    return V.table(spark, sf, "documents").select("doc_id", tokens.alias("tokens"))


@query(
    "detokenised_corpus",
    WITH_ENTRIES + f""", t as (select filepath, pos, {sql_tokenise('src', 'en')} as s,
      {sql_tokenise('tgt', 'fr')} as t from entries)
    select filepath, pos, {sql_detokenise('s', 'en')} as src, {sql_detokenise('t', 'fr')} as tgt from t""",
)
def detokenised_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return V.entries(spark, sf).select(
        "filepath",
        "pos",
        K.detokenise(K.tokenise(F.col("src"), "en"), "en").alias("src"),
        K.detokenise(K.tokenise(F.col("tgt"), "fr"), "fr").alias("tgt"),
    )


TOKENS_SQL = V.ENTRIES_SQL + f""",
tok as (select filepath, pos, {sql_tokenise('src', 'en')} as src, {sql_tokenise('tgt', 'de')} as tgt from entries),
lines as (select src as line from tok union all select tgt from tok),
counts as (
  select token, count(*) as cnt from (select unnest(string_split(line, ' ')) as token from lines)
  where token <> '' group by token
)"""


def _tokenised(spark: SparkSession, sf: str) -> DataFrame:
    return V.entries(spark, sf).select(
        "filepath",
        "pos",
        K.tokenise(F.col("src"), "en").alias("src"),
        K.tokenise(F.col("tgt"), "de").alias("tgt"),
    )


@query("language_union", f"with {TOKENS_SQL} select line, count(*) as cnt from lines group by line")
def language_union(spark: SparkSession, sf: str) -> DataFrame:
    return B.language_lines(_tokenised(spark, sf)).groupBy("line").agg(F.count(F.lit(1)).alias("cnt"))


@query("word_counts", f"with {TOKENS_SQL} select token, cnt from counts")
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return B.token_counts(B.language_lines(_tokenised(spark, sf)))


@query(
    "symbol_pairs",
    f"""with {TOKENS_SQL}, symbols as (
      select cnt, list_concat(string_split(token, '')[1:-2], [string_split(token, '')[-1] || '</w>']) as s from counts),
    pairs as (select cnt, s[i] as "left", s[i + 1] as "right"
      from (select *, unnest(range(1, len(s))) as i from symbols))
    select "left", "right", cast(sum(cnt) as bigint) as cnt from pairs group by all""",
)
def symbol_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted pair counts of the first merge round."""
    return B.pair_counts(B.start_symbols(word_counts(spark, sf)))


# --- Subwords ----------------------------------------------------------------


def _merges(spark: SparkSession, sf: str) -> DataFrame:
    """The merge table as later jobs read it."""
    return stage_table(learned_subwords(spark, sf), "merges")


@query("learned_subwords")
def learned_subwords(spark: SparkSession, sf: str) -> DataFrame:
    """Joint merges of both languages; checked against brute force in the tests."""
    return B.learn_subwords(word_counts(spark, sf))


@query("subword_corpus")
def subword_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return B.apply_subwords(_tokenised(spark, sf), ["src", "tgt"], _merges(spark, sf))


@query(
    "subword_roundtrip",
    f"with {TOKENS_SQL} select filepath, pos, src, tgt from tok",
)
def subword_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Segmented and joined back: the tokenised text again."""
    pieces = subword_corpus(spark, sf)
    return pieces.withColumns({c: T.remove_subwords(F.col(c)) for c in ("src", "tgt")})


@query("subword_vocabulary")
def subword_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return B.subword_vocabulary(B.language_lines(subword_corpus(spark, sf)))


# --- Dictionary and encoding ---------------------------------------------------

DICTIONARY_SQL = TOKENS_SQL + """,
extended as (
  select token, cast(sum(cnt) as bigint) as cnt from (
    select * from counts union all select '<tag>', 0 union all select '<d>', 0) group by token
),
dictionary as (
  select token, cnt, 3 + row_number() over (order by cnt desc, token) as id from extended
)"""


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return B.build_dictionary(word_counts(spark, sf), ["<tag>", "<d>"])


@query("joint_dictionary", f"with {DICTIONARY_SQL} select token, cnt, id from dictionary")
def joint_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return _dictionary(spark, sf)


# The dictionary of one side encodes the other, so that unknown tokens occur.
SIDE_SQL = TOKENS_SQL + """,
side as (
  select token, 3 + row_number() over (order by count(*) desc, token) as id
  from (select unnest(string_split(src, ' ')) as token from tok) where token <> '' group by token
),
words as (
  select filepath, pos, unnest(string_split(tgt, ' ')) as token,
    unnest(range(0, len(string_split(tgt, ' ')))) as i from tok
),
found as (
  select filepath, pos, i, coalesce(id, 3) as id from words left join side using (token) where token <> ''
)"""


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    tok = stage_table(_tokenised(spark, sf), "tokenised")
    side = B.build_dictionary(B.token_counts(tok, "src"))
    return B.encode_corpus(tok, "tgt", side, ["filepath", "pos"])


@query(
    "encoded_corpus",
    f"""with {SIDE_SQL} select filepath, pos, coalesce(string_agg(id, ' ' order by i), '') as ids
    from tok left join found using (filepath, pos) group by filepath, pos""",
)
def encoded_corpus(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return _encoded(spark, sf).select("filepath", "pos", ids.alias("ids"))


@query(
    "encoded_unknowns",
    f"""with {SIDE_SQL} select filepath, count(id) as tokens, count(id) filter (id = 3) as unknown
    from tok left join found using (filepath, pos) group by filepath""",
)
def encoded_unknowns(spark: SparkSession, sf: str) -> DataFrame:
    return B.oov_report(_encoded(spark, sf), ["filepath"])


@query(
    "dictionary_corpus",
    f"""with {MATRIX_SQL}, {V.CONV_SQL},
    base as (select * from directed where direction = 'en-de' and eval_set = 'unknown'),
    sample as (
      select * from base where cxt_type = 'neighbour' and split = 'train'
      order by repo, filepath, pos limit 10),
    parts as (
      select src as en, tgt as de from conv
      union all select input, output from sample
      union all select input, output from base where cxt_type in ('domain', 'filename'))
    select lang, line, count(*) as cnt from (
      select 'en' as lang, en as line from parts union all select 'de', de from parts) group by all""",
)
def dictionary_corpus(spark: SparkSession, sf: str) -> DataFrame:
    labelled = stage_table(labelled_entries(spark, sf), "labelled")
    general = V.conversation_entries(spark, sf)
    lines = B.dictionary_corpus(split_matrix(labelled), general, "en", "de")
    return lines.groupBy("lang", "line").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "encoded_matrix",
    f"""with {MATRIX_SQL}, dictionary as (
      select token, 3 + row_number() over (order by count(*) desc, token) as id from (
        select unnest(string_split(input, ' ')) as token from directed
        where cxt_type in ('domain', 'filename') and split = 'train' and direction = 'en-de')
      where token <> '' group by token),
    sides as (
      select 'input' as side, input as line, * from directed
      union all select 'output', output, * from directed),
    words as (
      select side, cxt_type, direction, split, unnest(string_split(line, ' ')) as token from sides
      where split = 'train' or eval_set = 'rnd')
    select side, cxt_type, direction, split, count(*) as tokens, count(*) filter (id is null) as unknown
    from words left join dictionary using (token) where token <> '' group by all""",
)
def encoded_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of every context type and direction encoded with one fixed dictionary.

    The evaluation part comes from the known-app sets.
    """
    labelled = stage_table(labelled_entries(spark, sf), "labelled")
    matrix = stage_table(split_matrix(labelled), "matrix")
    is_train = F.col("split") == "train"
    corpus = matrix.filter(
        is_train & F.col("cxt_type").isin("domain", "filename") & (F.col("direction") == "en-de")
    )
    dictionary = B.build_dictionary(B.token_counts(corpus, "input"))
    group = ["side", "cxt_type", "direction", "split"]
    rows = matrix.filter(is_train | (F.col("eval_set") == "rnd"))
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("line")) for c in ("input", "output")])
    both = rows.select("cxt_type", "direction", "split", "filepath", "pos", F.inline(sides))
    # Context types share sentences: as outputs, and as inputs without context.
    encoded = B.encode_corpus(both, "line", dictionary, [*group, "filepath", "pos"], near=["filepath", "pos"])
    return B.oov_report(encoded, group)


# --- Scores ------------------------------------------------------------------

BY = ("cxt_type", "direction", "eval_set", "seed")
# One simulated system per context type, each with its own kind of error.
_ERRORS = {"none": ("e", "a"), "domain": ("n ", "m "), "filename": ("ie", "ei"), "neighbour": ("zz", "z")}
_HYP = "case cxt_type " + " ".join(
    f"when '{c}' then replace(hyp, '{a}', '{b}')" for c, (a, b) in _ERRORS.items()
) + " end"
CONFIGS = "(values ('none'), ('domain'), ('filename'), ('neighbour')) c(cxt_type)"

PAIRS_SQL = V.LOG_SQL + f""",
plain as (
  select row_id, replace(tgt, chr(10), ' ') as ref, {sql_detokenise("regexp_replace(out_text, '@@( |\\z)', '', 'g')", 'de')} as hyp
  from log_rows
),
pairs as (
  select cxt_type, 'en-de' as direction, case row_id % 2 when 0 then 'rnd' else 'unknown' end as eval_set,
    2 as seed, row_id, {_HYP} as hyp, ref
  from plain, {CONFIGS}
)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses of every configuration joined to the one raw reference."""
    keyed = V.log_rows(spark, sf).withColumns(
        {
            "direction": F.lit("en-de"),
            "eval_set": F.when(F.col("row_id") % 2 == 0, "rnd").otherwise("unknown"),
        }
    )
    on = ["direction", "eval_set", "row_id"]
    references = keyed.select(*on, F.translate("tgt", "\n", " ").alias("ref"))
    plain = plain_hypotheses(keyed.select(*on, F.col("out_text").alias("hyp")), "de")
    types = F.array(*[F.lit(c) for c in _ERRORS])
    hypotheses = plain.withColumn("cxt_type", F.explode(types)).withColumn("hyp", F.expr(_HYP))
    return M.align_hypotheses(hypotheses, references, on).withColumn("seed", F.lit(2))


@query(
    "aligned_hypotheses",
    f"with {PAIRS_SQL} select cxt_type, direction, eval_set, row_id, hyp, ref from pairs",
)
def aligned_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("cxt_type", "direction", "eval_set", "row_id", "hyp", "ref")


@query(
    "detokenised_hypotheses",
    f"with {PAIRS_SQL} select row_id, hyp from plain",
)
def detokenised_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.log_rows(spark, sf).select("row_id", F.col("out_text").alias("hyp"))
    return plain_hypotheses(rows, "de")


def _sql_13a(text: str) -> str:
    line = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    padded = f"(' ' || {sql_literal(line, K.V13A_ENTITIES)} || ' ')"
    return f"list_filter(regexp_split_to_array({sql_chain(padded, K.V13A)}, '\\s+'), lambda t: t <> '')"


BLEU_SQL = PAIRS_SQL + f""",
toks as (
  select {', '.join(BY)}, row_id, {_sql_13a('hyp')} as h, {_sql_13a('ref')} as r from pairs
),
grams as (
  select {', '.join(BY)}, row_id, n, array_to_string(h[i:i + n - 1], ' ') as gram, 1 as h, 0 as r
  from (select *, unnest(range(1, len(h) - n + 2)) as i from toks, (select unnest([1, 2, 3, 4]) as n))
  union all
  select {', '.join(BY)}, row_id, n, array_to_string(r[i:i + n - 1], ' ') as gram, 0, 1
  from (select *, unnest(range(1, len(r) - n + 2)) as i from toks, (select unnest([1, 2, 3, 4]) as n))
),
clipped as (
  select {', '.join(BY)}, n, gram, sum(h) as h, sum(r) as r from grams group by {', '.join(BY)}, row_id, n, gram
),
sums as (
  select {', '.join(BY)}, n, sum(least(h, r)) as m, sum(h) as t, sum(r) as rt from clipped group by {', '.join(BY)}, n
),
wide as (
  select {', '.join(BY)},
    {', '.join(f'cast(coalesce(sum(m) filter (n = {n}), 0) as bigint) as m{n}' for n in range(1, 5))},
    {', '.join(f'cast(coalesce(sum(t) filter (n = {n}), 0) as bigint) as t{n}' for n in range(1, 5))},
    cast(sum(rt) filter (n = 1) as bigint) as ref_len
  from sums group by {', '.join(BY)}
),
scored as (
  select *, t1 as hyp_len, round(case when least(t1, t2, t3, t4) = 0 or m1 = 0 then 0.0 else
    100 * case when t1 < ref_len then exp(1 - ref_len / t1) else 1 end
    * exp(({' + '.join(
        f"case when m{n} > 0 then ln(m{n} / t{n}) else "
        f"-ln(2) * ({' + '.join(f'cast(m{k} = 0 as int)' for k in range(1, n + 1))}) - ln(t{n}) end"
        for n in range(1, 5)
    )}) / 4) end, 4) as bleu
  from wide
)"""


@query(
    "corpus_bleu",
    f"with {BLEU_SQL} select {', '.join(BY)}, hyp_len, ref_len, m1, m2, m3, m4, bleu from scored",
)
def corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    return M.corpus_bleu(_pairs(spark, sf), BY, ["row_id"])


# SQL has no block moves, and its edit distance counts bytes: tested against brute force.
@query("character_edit_rate")
def character_edit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return M.character_edit_rate(_pairs(spark, sf), BY)


@query("score_report")
def full_score_report(spark: SparkSession, sf: str) -> DataFrame:
    """Both scores of every configuration."""
    return score_report(stage_table(_pairs(spark, sf), "pairs"), BY)
