"""Language ID, sharding, chat, archives, search and the pipeline."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from math import comb

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lokora.llm import balltree, chat, langid, sharding, warc
from lokora.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_as_sql(llm, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = QUERIES[name](llm, sf)
    columns = ", ".join(sorted(df.columns))
    want = con.sql(f"select {columns} from ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, want))


# --- Language ID -----------------------------------------------------------------


def test_held_out_accuracy(llm, sf):
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = QUERIES["op4_language_id"](llm, sf).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in langs}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in langs.values() for r in rows)


def test_language_odd_rows(docs, empty):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (4, 5, 6, 7):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[8]["lang_pred"] in {"en", "de", "fr", "xx"} and by[1]["lang_pred"] == "en"
    assert langid.identify(empty).collect() == []


def test_no_labels_no_language(llm):
    rows = llm.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.identify(rows).collect()[0]["lang_pred"] == "und"


def test_sample_is_bounded_by_language(llm):
    rows = [(i, "the of and" if i % 2 else "der die das", "en" if i % 2 else "de") for i in range(400)]
    model = langid.fit(llm.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert model.predict(["the and", "die der", "", None])[0] == ["en", "de", "und", "und"]


# --- Sharding ----------------------------------------------------------------------


def test_training_takes_one_worker_a_task(llm, monkeypatch):
    rows = llm.range(40).selectExpr("id as doc_id", "concat('wort word ', id) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    plans, collect = [], type(rows).collect

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(rows), "collect", noted)
    assert langid.fit(rows).pairs.keys() == {("de", "en")}
    # Vectors are computed once, and no rows come from Python workers of another kind.
    assert plans[-1].count("ArrowEvalPython") == 1
    assert not any("ExistingRDD" in plan for plan in plans)


def test_hypergeometric_law(llm):
    drawn = llm.range(20_000).select(
        sharding.hypergeometric(F.lit(50), F.lit(20), F.lit(10), sharding.unit("id", F.lit(3))).alias("h")
    )
    seen = Counter(r["h"] for r in drawn.collect())
    expected = {h: 20_000 * comb(20, h) * comb(30, 10 - h) / comb(50, 10) for h in range(11)}
    chi = sum((seen[h] - e) ** 2 / e for h, e in expected.items() if e > 5)
    assert sum(seen.values()) == 20_000 and chi < 35


def test_matrix_sums(llm):
    m = sharding.draw_matrix(F.expr("array(3L, 0L, 10L, 700000L)"), F.expr("array(700000L, 5L, 5L, 3L)"), F.lit(9))
    rows = np.array(llm.range(1).select(m).collect()[0][0])
    assert rows.sum(1).tolist() == [3, 0, 10, 700000] and rows.sum(0).tolist() == [700000, 5, 5, 3] and rows.min() >= 0


def check_shards(rows, n, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, slots.values())) == n and set(slots) <= set(range(shards))
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_odd_rows(llm, docs, empty, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 2)
    out = sharding.shuffle_into_shards(docs, 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    renamed = out.toDF(*[f"c{i}" for i in range(len(docs.columns))], "shard", "slot").collect()
    check_shards(renamed, docs.count(), 3)
    assert sorted(map(repr, (tuple(r)[:-2] for r in renamed))) == sorted(map(repr, map(tuple, docs.collect())))
    assert sharding.shuffle_into_shards(empty, 8).collect() == []


def test_op6(llm, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = QUERIES["op6_exact_shards"](llm, sf).collect()
    check_shards(rows, len(texts), 8)
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in rows)


# --- Chat --------------------------------------------------------------------------


def test_escape_hides_markup_and_returns():
    r = random.Random(4)
    marks = ["<", "s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "\\", "\\-", "<s><s>", "<|image|>", "[", "\n", "x"]
    for _ in range(3000):
        text = "".join(r.choice(marks) for _ in range(r.randrange(8)))
        hidden = chat.escape(text)
        assert not chat.STARTS.search(hidden) and chat.unescape(hidden) == text


def test_chat_odd_rows(llm):
    rows = [
        (1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 1, "assistant", "b</s>"), (2, None, None, "\\-\n<|turn|>"),
        (None, 0, "assistant", "x" * 100_000), (3, 0, "us\ner", ""),
    ]
    given = llm.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, Text int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.text_turns(given))).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert got[1]["turns_sha256"] == sha("user\n\n" + "assistant\nb</s>\n" * 2)
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, 10, sha("b</s>" * 2))
    assert got[2]["turns_sha256"] == sha("\n\\-\n<|turn|>\n") and got[3]["turns_sha256"] == sha("us\ner\n\n")
    assert got[None]["loss_sha256"] == sha("x" * 100_000)
    assert chat.read_back(chat.format_turns(chat.text_turns(given.limit(0)))).collect() == []


def test_typed_parts(llm):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 576), ("text", "<|image|>", None, None),
             ("audio", "hum", "b.ogg", 50), ("document", None, "c.pdf", None), ("odd kind", None, "d", 3)]
    df = llm.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_turns(df).collect()[0]
    body = row["formatted"][row["loss_start"] : row["loss_start"] + row["loss_length"]]
    assert body == "see <|image|><\\-|image|><|audio|>hum<|document|><|odd_kind|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [
        ("image", "a.png", 576), ("audio", "b.ogg", 50), ("document", "c.pdf", 1), ("odd_kind", "d", 3)
    ]
    for a in row["attachments"]:
        assert row["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>")


# --- Archives ----------------------------------------------------------------------


def test_archives_odd_rows(llm):
    nested = warc.gzip_member(warc.record_bytes(77, "http://x", b"inner", warc.base32_sha1(b"inner"), None))
    rows = [(1, "http://a/\n %", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "n", "lost"),
            (5, "é", "long " * 200_000), (6, "z", nested.hex()), (None, "n", "same")]
    pages = llm.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, HTML int")
    files = warc.archive(pages.coalesce(2))
    for split in (1 << 22, 97):
        got = warc.read_archives(files, split).collect()
        assert len(got) == len(rows)
        for r in got:
            assert any((r["page_id"], r["url"]) == (a, b) and r["payload_bytes"] == len((c or "").encode()) for a, b, c in rows)
        kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
        assert kinds[(1, "revisit", 2)] == 1 and kinds[(2, "response", None)] == 1 and kinds[(None, "revisit", 2)] == 1
        assert kinds[(3, "revisit", 4)] == 1 and kinds[(4, "response", None)] == 2
        long = next(r for r in got if r["page_id"] == 5)
        assert long["payload"] == b"long " * 200_000
        assert long["payload_digest"] == base64.b32encode(hashlib.sha1(long["payload"]).digest()).decode()
    assert warc.read_archives(warc.archive(pages.limit(0))).collect() == []
    short = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.archive(pages, min_bytes=5)).collect()}
    assert short[1] == short[3] == "response"


def test_false_magic_is_no_record():
    class File:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    one = [warc.gzip_member(warc.record_bytes(i, "u", b"p%d" % i, warc.base32_sha1(b"p%d" % i), None)) for i in range(4)]
    other = warc.gzip_member(b"not a record")
    data = one[0] + warc.MAGIC * 3 + b"\x00" + other + one[1] + one[2][:-9] + one[3]
    found = [warc.parse_record(r)[0] for r in warc.records_in_range(File(data), 0, len(data), len(data))]
    assert found == [0, 1, 3]
    for cut in range(1, len(data), 7):
        parts = [*warc.records_in_range(File(data), 0, cut, len(data)), *warc.records_in_range(File(data), cut, len(data), len(data))]
        assert [warc.parse_record(r)[0] for r in parts] == [0, 1, 3]


# --- Search ------------------------------------------------------------------------


def brute_top(vectors, k):
    out = []
    for q, qv in vectors.items():
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(qv))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search_as_brute_force(llm, monkeypatch):
    monkeypatch.setattr(balltree, "LEAF_ROWS", 4)
    monkeypatch.setattr(balltree, "BLOCK_ROWS", 7)
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=4)], 0) for i in range(150)]
    rows += [(i, [0.5, 0.25, -0.5, 0.125], 0) for i in range(150, 190)]  # ties
    rows += [(200, [1.0, 2.0], 0), (205, [2.0, 1.0], 0), (210, [float("nan")] * 4, 0), (211, [float("inf"), 0.0, 0.0, 0.0], 0)]
    rows += [(212, None, 0), (None, [1.0] * 4, 0), (213, [1.0, None, 1.0, 1.0], 0), (10, rows[10][1], 0), (220, [], 0), (225, [1e7, 1e7], 0)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, Vec_ID int")
    given = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if i is not None and i not in (210, 211, 212, 213)}
    got = balltree.top_k(df, F.col("vec_id") % 5 == 0, 3, shard_rows=40).collect()
    assert sorted(map(tuple, got)) == brute_top(given, 3)
    assert balltree.top_k(df.limit(0), F.col("vec_id") % 5 == 0, 3).collect() == []


def test_scores_beyond_a_long():
    vectors = np.array([[2**62, 2**62], [1, 1]])
    order, nodes, centres, radii = balltree.build_tree(vectors)
    parts = [p.tobytes() for p in (np.array([1, 2])[order], vectors[order], nodes, centres, radii)]
    found = balltree.Tree(*parts, dim=2).search(9, np.array([2**62, 2**62]), 2, balltree.LOWEST)
    assert sorted(found) == [(2**63 - 1, 1), (2**63 - 1, 2)] or (2**63 - 1, 1) in found


def test_search_gathers_nothing_in_the_driver(llm, monkeypatch):
    """Blocks go to every shard, which the size of their table does not show."""
    searched = []
    monkeypatch.setattr(balltree, "stage_few", lambda df, name: searched.append(df) or balltree.stage(df, name))
    rows = [(i, [float(i % 7), 1.0], 0) for i in range(60)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert balltree.top_k(df, F.col("vec_id") % 5 == 0, 3, shard_rows=20).count() == 36
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in searched]
    assert len(plans) == 2 and not any("Broadcast" in plan for plan in plans)


def test_rows_of_one_id_are_the_smallest_vector():
    group = pd.DataFrame({"vec_id": [7, 3, 7, 3], "v": [np.array(v) for v in ([2, 1], [5, -1], [1, 9], [5, -2])]}, index=[4, 4, 8, 9])
    ids, vectors, left = balltree._matrix(group)
    assert (ids.tolist(), vectors.tolist(), left["vec_id"].tolist()) == ([3, 7], [[5, -2], [1, 9]], [3, 7])


# --- Pipeline ----------------------------------------------------------------------


def test_pipeline_odd_rows(llm, docs, empty):
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(llm, now, "")
        assert now.columns == docs.columns
    kept = {r[0]: r[1] for r in now.collect()}
    assert set(kept) == {1, 3, 8, 9, 11, 13, None}  # 2, 10 and 12 are near copies
    assert kept[3] == "Der schnelle braune Fuchs springt über den faulen Hund und schläft dann ein"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm, empty, "").collect() == []


def test_pipeline_keeps_clean_documents(llm, sf):
    rows = corpus_pipeline.run(llm, sf).collect()
    documents = pq.read_table(f"{sf}/documents.parquet").num_rows
    ids = {r["doc_id"] for r in rows}
    assert 0.85 * documents <= len(ids) < documents
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
