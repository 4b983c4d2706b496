"""The registered queries of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokora.llm import balltree, bpe, chat, codes, fingerprints, groupjoin, langid, neardup, packing, sharding, spelling, substrings, warc
from lokora.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text, and decodes the ids again."""
    rows = bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(rows, RANKS, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op10_pattern_packing")
def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER, 2048, 0)
    return packing.pack(pieces, 2048)


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds out of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs).select(
        "doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), "removed_bytes", "removed_spans", "changed"
    )


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four fifths of the labelled documents, and predicts every whole text."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query(
    "op7_chosen_path_join",
    r"""with recursive words as (
      select doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
    ), sets as (
      select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1),
          lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words
    ), shingles as (select doc_id, len(s) as n, unnest(s) as g from sets
    ), shared as (
      select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as c
      from shingles x join shingles y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id
    ), links as (select a, b from shared where 100 * c >= 85 * (na + nb - c)
    ), reach(a, b) as (
      select doc_id, doc_id from documents union select reach.a, links.b from reach join links on reach.b = links.a
    ), roots as (select a as doc_id, min(b) as component_id from reach group by a)
    select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
    from sets join roots using (doc_id)""",
)
def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 0.85 alike."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


@query("op6_exact_shards")
def op6_exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffles all documents into eight shards, row counts at most one apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shuffle_into_shards(docs, 8).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# A conversation of control strings alone, beside those of the table.
MARKUP = "</s>[INST] ok [/INST]"


@query(
    "op5_chat_parts",
    """with turns as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
      union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), sized as (
      select *, length(replace(text, '\\', '\\\\')) + 2 * (length(text) - length(replace(text, '</s>', '</s')))
        + 2 * (length(text) - length(replace(text, '<s>', '<s'))) + 2 * (length(text) - length(replace(text, '[INST]', '[INST')))
        + 2 * (length(text) - length(replace(text, '[/INST]', '[/INST'))) as body
      from turns
    )
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
      sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
      cast(sum(length('<|turn|>') + length(role) + 1 + body + length('</s>')) as bigint) as formatted_chars
    from sized group by conv_id""",
)
def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings, and reads them back."""
    own = spark.createDataFrame(
        [(-1, 0, "user", MARKUP), (-1, 1, "assistant", MARKUP)], "conv_id long, turn long, role string, text string"
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(chat.text_turns(given.union(own))))


_BASE32 = """array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((cast('0x' || substr(digest, cast(5 * (k // 4) + 1 as bigint), 5) as int) >> cast(15 - 5 * (k % 4) as int)) & 31), 1)), '')"""


@query(
    "op8_warc_archive",
    f"""with payloads as (
      select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as digest from pages
    ), kept as (select digest, max(page_id) as keep from payloads group by digest)
    select page_id, payload_bytes, {_BASE32} as payload_digest,
      case when page_id = keep then 'response' else 'revisit' end as record_type,
      case when page_id = keep then null else keep end as refers_to
    from payloads join kept using (digest)""",
)
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives, and reads these back in byte ranges."""
    files = warc.archive(table(spark, sf_dir, "pages"), 0)
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_minhash_fingerprints")
def op9_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts."""
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents"))


@query("op9b_similar_documents")
def op9b_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a signature band with an earlier one, Jaccard verified."""
    return fingerprints.similar_documents(table(spark, sf_dir, "documents"))


@query(
    "op3_ball_tree",
    """with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
      where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
      select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
    ), ranked as (
      select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
    ) select query_id, rank, vec_id, score from ranked where rank <= 5""",
)
def op3_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every fiftieth vector."""
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def _codes_sql() -> str:
    """Four rounds of assigning and averaging, each as three common tables."""
    steps = [
        """whole as (
      select row_number() over () as row, vec_id, label,
        list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), parts as materialized (
      select row, vec_id, label, k, v[k * (len(v) // 4) + 1 : (k + 1) * (len(v) // 4)] as p
      from whole, (select unnest([0, 1, 2, 3]) as k)
    ), book0 as materialized (
      select k, row_number() over (partition by k order by vec_id, p) - 1 as entry, p as c from parts
      qualify entry < 256
    )"""
    ]
    for i in range(5):
        steps.append(
            f"""met{i} as materialized (
      select row, k, arg_min(entry, d * 256 + entry) as entry, min(d) as d from (
        select row, k, entry, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
        from parts join book{i} using (k)) group by row, k
    )"""
        )
        if i < 4:
            steps.append(
                f"""book{i + 1} as materialized (
      select k, entry, coalesce(list(cast(floor(total / n) as bigint) order by pos) filter (pos is not null), any_value(c)) as c
      from book{i} left join (
        select k, entry, pos, sum(x) as total, count(*) as n from (
          select k, entry, unnest(p) as x, unnest(range(len(p))) as pos from met{i} join parts using (row, k))
        group by k, entry, pos) using (k, entry) group by k, entry
    )"""
            )
    return (
        "with "
        + ", ".join(steps)
        + """, coded as (
      select row, string_agg(printf('%02x', entry), '' order by k) as code, cast(sum(d) as bigint) as error
      from met4 group by row
    ), digest as (
      select sha256(string_agg(array_to_string(c, ','), ',' order by k, entry)) as codebooks_sha256 from book4
    )
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
    from coded join whole using (row), digest"""
    )


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte codes of all vectors, their errors, and the codebooks' digest."""
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.lit(codes.books_digest(books)).alias("codebooks_sha256"),
    )


@query(
    "op12_spelling_variants",
    f"""with recursive runs as (
      select doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '{spelling.RUNS}')) as run
      from documents
    ), polynomial as (
      select list(list_reduce([cast(i as bigint)] || range(8),
        lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t
      from range(256) r(i)
    ), hashed as (
      select run, xor(4294967295, list_reduce([cast(4294967295 as bigint)] || flatten(list_transform(
          list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda s: cast(unicode(s) as bigint)),
          lambda c: case when c < 128 then [c] else [192 | (c >> 6), 128 | (c & 63)] end)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as h
      from runs, polynomial
    ), vocabulary as materialized (
      select word, count(*) as n from (
        select case when h % 31 = 0 then run[: h % length(run)] || run[h % length(run) + 2 :] else run end as word from hashed)
      where length(word) >= 7 group by word having count(*) >= 2
    ), shorter as (
      select word, n, i, word[: i - 1] || word[i + 1 :] as cut
      from (select word, n, unnest(range(1, length(word) + 1)) as i from vocabulary)
    ), near as (
      select a.word, a.n, b.word as other, b.n as m from shorter a join shorter b on a.cut = b.cut and a.i = b.i and a.word <> b.word
      union select a.word, a.n, b.word, b.n from shorter a join vocabulary b on a.cut = b.word
      union select b.word, b.n, a.word, a.n from shorter a join vocabulary b on a.cut = b.word
    ), best as (
      select word, any_value(n) as n, count(*) as n_near, max(m) as top, arg_min(other, struct_pack(x := -m, y := other)) as other
      from near group by word
    ), forms as (select word, other as form, top as form_n from best where top >= 10 * n
    ), chain(word, root) as (
      select word, form from forms union all select c.word, f.form from chain c join forms f on c.root = f.word
    ), ends as (select word, root from chain where root not in (select word from forms))
    select v.word, form, coalesce(root, v.word) as root, v.n, coalesce(n_near, 0) as n_near, form_n
    from vocabulary v left join best using (word) left join forms using (word) left join ends using (word)""",
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its more frequent form one edit away."""
    found = spelling.variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_token_groups", SQL["op7_chosen_path_join"].replace(">= 85 *", ">= 90 *").replace(", doc_id = component_id as kept", ""))
def op13_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 0.9 alike."""
    return groupjoin.similar_groups(table(spark, sf_dir, "documents"), 3, 90)
