"""Byte-level encoding and packing against the public libraries."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lokora.llm import bpe, packing
from lokora.llm.queries import QUERIES, RANKS, WORD_TOKENIZER

CODEC = bpe.codec(RANKS, public_tokenizers.PATTERN)
PUBLIC = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={}
)


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t'sé1. 　\x1c世\U0001f600t"), max_size=40))
def test_encode_as_the_library(text):
    assert ids(text) == PUBLIC.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 5_000 + "x", "the" * 3_000, "x\n\n  y \n"])
def test_long_matches(text):
    assert ids(text) == PUBLIC.encode_ordinary(text)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(bpe, "REMEMBERED_MATCHES", 3)
    own = bpe.Codec(CODEC.ranks, public_tokenizers.PATTERN)
    for k in range(30):
        text = f"some more{k} words{k} here{k}"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == PUBLIC.encode_ordinary(text)
        assert len(own.words) < 12


def test_encode_documents(docs, empty):
    got = bpe.decode_documents(
        bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN
    ).collect()
    texts = [r[1] or "" for r in docs.collect()]
    assert sorted(bytes(r["bytes"]) for r in got) == sorted(t.encode() for t in texts)
    assert sorted(len(r["ids"]) // 4 for r in got) == sorted(len(PUBLIC.encode_ordinary(t)) for t in texts)
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_op2(llm, sf):
    got = {r["doc_id"]: r for r in QUERIES["op2_byte_bpe"](llm, sf).collect()}
    for row in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        want, r = PUBLIC.encode_ordinary(row["text"] or ""), got[row["doc_id"]]
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()


# --- Packing -----------------------------------------------------------------


def check_packed(rows, capacity):
    """Places are gapless; the number of sequences is that of distinct numbers."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plan_holds_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=33) if lengths else np.zeros(33, np.int64)
    used = packing.plan(counts, 32)
    made = np.zeros(33, np.int64)
    for times, runs in used:
        assert times > 0 and sum(a * b for a, b in runs) <= 32
        for a, b in runs:
            made[a] += times * b
    assert (made[1:] == counts[1:]).all()
    places = packing.Places(used)
    seen = set()
    for length in range(1, 33):
        if counts[length]:
            s, o = places.find(np.full(counts[length], length), np.arange(counts[length]))
            for a, b in zip(s.tolist(), o.tolist(), strict=True):
                cells = {(a, x) for x in range(b, b + length)}
                assert not cells & seen
                seen |= cells


def test_plan_is_near_the_bound():
    counts = np.random.default_rng(1).integers(0, 50, 2049)
    counts[0] = 0
    sequences = sum(times for times, _ in packing.plan(counts, 2048))
    assert sequences <= 1.015 * (counts @ np.arange(2049)) / 2048 + 2  # the optimum is 1.013 at least


def test_most_pieces_are_placed_by_patterns(monkeypatch):
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 5000), 1, 2048).astype(int), minlength=2049)
    residuals, best_fit = [], packing._best_fit

    def seen(left, capacity):
        residuals.append(int(left.sum()))
        return best_fit(left, capacity)

    monkeypatch.setattr(packing, "_best_fit", seen)
    sequences = sum(times for times, _ in packing.plan(counts, 2048))
    assert residuals[0] < 0.1 * counts.sum()
    assert sequences <= 1.005 * (counts @ np.arange(2049)) / 2048 + 1


def test_other_rules_take_no_text_apart(tmp_path):
    joins = bpe.Codec(CODEC.ranks, r"[a-z]+ ?|.|\n")
    assert CODEC.splits_at_blanks and not joins.splits_at_blanks
    want = b"".join(bpe.little_endian(joins.encode_match(m.encode())) for m in ["two ", "words"])
    assert joins.encode("two words") == want
    rules = json.loads(TOKENIZER.to_str())
    rules["normalizer"] = None
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules))
    by = packing.WordTokens(str(path))
    assert not by.by_word
    text = "Words of Two"
    got = np.frombuffer(b"".join(by.encode([text])), "<u4").tolist()
    assert got == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


TOKENIZER = Tokenizer.from_file(WORD_TOKENIZER)
TOKENIZER.encode_special_tokens = True


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB \n\t'sÉ1., \x1c世ΣςİéÀ́\U0001f600t"), max_size=30))
def test_word_tokens_as_the_library(text):
    got = np.frombuffer(b"".join(packing.word_tokens(WORD_TOKENIZER).encode([text])), "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def pieces_of(text, capacity=2048):
    whole = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    for piece, at in enumerate(range(0, len(whole), capacity)):
        part = whole[at : at + capacity]
        yield piece, at, len(part), zlib.crc32(part.tobytes())


def test_pack_odd_rows(docs, empty):
    cut = packing.cut_documents(docs, WORD_TOKENIZER, 64, with_ids=True)
    rows = packing.pack(cut, 64).collect()
    want = [(r[0], *p) for r in docs.collect() for p in pieces_of(r[1], 64)]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    check_packed(rows, 64)
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.assemble(packing.pack(cut, 64)).collect()}
    assert sum(whole.values()) == sum(r["length"] for r in rows) and max(whole.values()) <= 64
    assert packing.pack(packing.cut_documents(empty, WORD_TOKENIZER)).collect() == []


def test_op10(llm, sf):
    rows = QUERIES["op10_pattern_packing"](llm, sf).collect()
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    want = sorted((d["doc_id"], *p) for d in docs for p in pieces_of(d["text"]))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check_packed(rows, 2048) <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1


def test_word_tokens_of_mixed_texts_as_the_library(monkeypatch):
    """Random texts of Latin and other characters, blanks of all kinds, in runs of a few."""
    monkeypatch.setattr(packing, "CHARS_AT_ONCE", 100)
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 50)
    rng = random.Random(8)
    some = [chr(i) for i in range(0x300)] + list("\u0301\u0307\u1e9e\u2c65\u3000\u200b\u2028Σς東京\U0001f600ﬁ")
    words = ["don't", "I'LL", "x2", "</w>", "<|endoftext|>", "Öl-Preis", "naïve,", "E\u0301", "a]b^c\\d"]
    texts = [
        "".join(rng.choice([*words, " ", " ", "\n", "\t", *rng.sample(some, 6)]) for _ in range(rng.randint(0, 60)))
        for _ in range(400)
    ]
    texts += [c + "a " + c + " b" + c for c in some]
    by = packing.WordTokens(WORD_TOKENIZER)
    for text, got in zip(texts, by.encode(texts), strict=True):
        want = by.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text


def test_parts_are_remembered_not_words():
    by = packing.WordTokens(WORD_TOKENIZER)
    list(by.encode(["Alpha, alpha. (ALPHA) Alpha"]))
    assert "alpha" in by.words and len(by.words) <= 5
