"""Near duplicates, fingerprints and repeated passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from lokora.llm import fingerprints, neardup, substrings
from lokora.llm.common import stage
from lokora.llm.components import components
from lokora.llm.queries import QUERIES


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def set_of(text, width):
    w = words_of(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def brute_components(texts, width, percent):
    """Smallest id reachable, from an inverted index of shingles."""
    sets, holders, parent = {i: set_of(t, width) for i, t in texts.items()}, defaultdict(list), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        shared = defaultdict(int)
        for s in own:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}, sets


def near_copies(n_base=3, copies=40, seed=5):
    """Chains and stars of near copies, exact copies, and unrelated texts that share a line."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts, i = {}, 0
    for _ in range(n_base):
        base = [r.choice(vocabulary) for _ in range(120)]
        chain = list(base)
        for c in range(copies):
            own = list(base) if c % 2 else chain
            for _ in range(r.choice([0, 1, 2, 3])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts[i] = " ".join(own)
            i += 1
    line = " ".join(vocabulary[:12])
    for _ in range(80):
        texts[i] = line + " " + " ".join(r.choice(vocabulary) for _ in range(15))
        i += 1
    return texts


def frame(llm, texts):
    return llm.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.mark.parametrize(("width", "percent", "leaf"), [(3, 85, 24), (5, 80, 4)])
def test_components_as_brute_force(llm, monkeypatch, width, percent, leaf):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    if leaf == 4:  # nodes branch, and cells have several blocks
        monkeypatch.setattr(neardup, "SKETCH_BLOCK", 16)
        monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
        monkeypatch.setattr(neardup, "SINGLE_PAIRS", 3)
    texts = near_copies()
    want, sets = brute_components(texts, width, percent)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(frame(llm, texts), width, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in texts)


def edited_star(copies, edits, seed=7):
    """Copies of one text, each with words of its own; the text itself has the last id."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(150)]
    texts = {}
    for i in range(copies):
        own = list(base)
        for at in r.sample(range(len(own) // 10), edits):
            own[at * 10 + r.randrange(10)] = f"x{i}_{at}"
        texts[i] = " ".join(own)
    return texts | {copies: " ".join(base)}


def test_star_of_edited_copies(llm):
    copies, edits = 1500, 3
    texts = edited_star(copies, edits)
    base = set_of(texts[copies], 5)
    assert all(100 * len(base & s) >= 80 * len(base | s) for s in (set_of(t, 5) for t in texts.values()))
    far = {copies + 1 + k: " ".join(f"y{k}_{j}" for j in range(50)) for k in range(30)}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(llm, texts | far), 5, 80).collect()}
    assert {got[i] for i in texts} == {0} and all(got[i] == i for i in far)


def test_drift_of_edited_copies(llm):
    """Each text is a copy of the one before it with one word changed, in turn."""
    own = [f"b{k}" for k in range(60)]
    texts = {}
    for i in range(1500):
        own[i * 7 % 60] = f"d{i}"
        texts[i] = " ".join(own)
    got = {r["component_id"] for r in neardup.near_duplicates(frame(llm, texts), 5, 80).collect()}
    assert got == {0}


def test_texts_that_share_an_id(llm):
    r = random.Random(9)
    clean = [" ".join(f"c{r.randrange(5000)}" for _ in range(60)) for _ in range(4)]
    near = clean[3].rsplit(" ", 1)[0] + " other"
    given = [(5, clean[0]), (5, clean[1]), (5, clean[2]), (5, clean[0]), (7, clean[3]), (5, near), (9, clean[1]), (6, None), (6, "")]
    df = llm.createDataFrame(given, "doc_id long, text string")
    rows = neardup.near_duplicates(df, 5, 80).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in rows) == [(5, 5)] * 5 + [(6, 6)] * 2 + [(7, 5), (9, 5)]
    kept = sorted(map(repr, map(tuple, neardup.drop_near_duplicates(df, 5, 80).collect())))
    want = [(5, clean[0]), (5, clean[1]), (5, clean[2]), (5, near), (6, None), (6, "")]
    assert kept == sorted(map(repr, want))


def test_near_duplicates_odd_rows(docs, empty):
    rows = neardup.near_duplicates(docs, 3, 85).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert got[2] == 1 and got[12] == 8 and got[10] == 9
    assert all(got[i] == i for i in (4, 5, 6, 7, 11, 13))
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = neardup.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 11, 13]
    assert sum(r[0] is None for r in kept.collect()) == 2
    assert neardup.near_duplicates(empty).collect() == [] and neardup.drop_near_duplicates(empty).collect() == []


def test_components(llm):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = components(llm.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(parent) and {x["node"]: x["label"] for x in found} == {x: root(x) for x in parent}


# --- Fingerprints --------------------------------------------------------------


def jaccard(a, b):
    a, b = set_of(a, 5), set_of(b, 5)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(rows, ordered):
    """``ordered``: (doc_id, text) in order."""
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    by_text = {}
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        r = next(x for x in got[doc_id] if x["edited_sha256"] == digest and x["n_chars"] == len(text))
        assert abs(r["near_edited"] - jaccard(text, edited)) < 0.2
        assert abs(r["near_next"] - jaccard(text, following)) < 0.2
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(rows) == len(ordered)


def test_op9(llm, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{sf}/documents.parquet").to_pylist())
    check_fingerprints(QUERIES["op9_minhash_fingerprints"](llm, sf).collect(), docs)


def test_fingerprints_odd_rows(llm, docs, empty):
    rows = [(r[0], r[1] or "") for r in docs.collect() if r[0] is not None]
    own = llm.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, Text string")
    check_fingerprints(fingerprints.fingerprint_with_next(own).collect(), sorted(rows))
    assert fingerprints.fingerprint_with_next(docs).count() == docs.count()
    assert fingerprints.fingerprint_with_next(empty).collect() == []
    one = fingerprints.fingerprint_with_next(own.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_similar_documents(llm, docs, empty):
    texts = near_copies(2, 20)
    rows = {r["doc_id"]: r for r in fingerprints.similar_documents(frame(llm, texts)).collect()}
    assert all(r["near_id"] < i and r["jaccard"] >= 0.8 for i, r in rows.items())
    assert all(abs(jaccard(texts[i], texts[r["near_id"]]) - r["jaccard"]) < 1e-9 for i, r in rows.items())
    copies = [(i, j) for i in texts for j in texts if j < i and texts[i] == texts[j]]
    assert copies and all(i in rows for i, _ in copies)
    assert {r["doc_id"] for r in fingerprints.similar_documents(docs).collect()} >= {12}
    assert fingerprints.similar_documents(empty).collect() == []


# --- Repeated passages -----------------------------------------------------------


def gear_ends(data):
    """Chunk ends by the rolling hash, one byte at a time."""
    h, last, ends = 0, 0, []
    for i in range(len(data)):
        h = ((h << 1) + int(substrings.GEAR[data[i]])) & 0xFFFFFFFF
        end = i + 1
        whole = end == len(data) or data[end] & 0xC0 != 0x80
        hit = h & int(substrings.MASK) == 0 and whole and end - last >= substrings.MIN_CHUNK
        if end - last > substrings.MAX_CHUNK:
            last += substrings.MAX_CHUNK
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
            hit = h & int(substrings.MASK) == 0 and whole and end - last >= substrings.MIN_CHUNK
        if hit:
            ends.append(end)
            last = end
    return ends if not data or ends and ends[-1] == len(data) else [*ends, len(data)]


@pytest.mark.parametrize("text", ["x", "é" * 700, "abc " * 500, "".join(chr(c) for c in range(32, 3000)), "y" * 161])
def test_chunks_as_a_rolling_hash(text):
    data = text.encode()
    ends = substrings.chunk_ends(np.frombuffer(data, np.uint8))
    assert ends == gear_ends(data)
    for a, b in zip([0, *ends], ends, strict=False):
        assert 0 < b - a <= substrings.MAX_CHUNK
        data[a:b].decode()


def test_boundaries_resist_insertions():
    r = random.Random(1)
    text = " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(3000)).encode()

    def parts(data):
        ends = substrings.chunk_ends(np.frombuffer(data, np.uint8))
        return {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    assert len(parts(text) - parts(b"something new " + text)) <= 6


def brute_dedup(texts, min_bytes=substrings.MIN_RUN_BYTES):
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        ends = gear_ends(data)
        spans, own = [], set()
        for a, b in zip([0, *ends], ends, strict=False):
            d = xxhash.xxh3_128_digest(data[a:b])
            if d in seen or d in own:
                if spans and spans[-1][1] == a:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
            own.add(d)
        seen |= own
        out[i] = substrings.cut_spans(data, [s for s in spans if s[1] - s[0] >= min_bytes])[0].decode()
    return out


def planted(seed=2):
    r = random.Random(seed)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))

    passage = prose(60)
    texts = {i: prose(150) for i in range(20)}
    for i in (3, 8, 15):
        texts[i] = prose(r.randrange(30, 90)) + " " + passage + " " + prose(50)
    texts[18] = texts[4]
    return texts, passage


def test_planted_passages_are_cut(llm):
    texts, passage = planted()
    rows = {r["doc_id"]: r for r in substrings.deduplicate(frame(llm, texts)).collect()}
    assert {i: r["text"] for i, r in rows.items()} == brute_dedup(texts)
    assert {i for i, r in rows.items() if r["changed"]} == {8, 15, 18}
    assert rows[3]["text"] == texts[3] and rows[8]["removed_bytes"] > 0.5 * len(passage)
    for i, r in rows.items():
        data = texts[i].encode()
        kept, at = b"", 0
        for s in r["removed_spans"] or []:
            kept += data[at : s["from"]]
            at = s["to"]
        assert (kept + data[at:]).decode() == r["text"]
        assert set(r["text"].split()) <= set(texts[i].split())


def test_texts_that_share_an_id_keep_their_own_cuts(llm):
    r = random.Random(4)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))

    passage, clean, short = prose(120), prose(400), prose(8)
    late = prose(200) + " " + passage
    given = [(1, passage), (2, late), (2, short), (2, clean), (None, prose(150) + " " + passage), (None, prose(300)), (None, "x y")]
    rows = substrings.deduplicate(llm.createDataFrame(given, "doc_id long, text string")).collect()
    assert len(rows) == len(given)
    kept = {(x["doc_id"], x["text"]) for x in rows if not x["changed"]}
    assert kept == {given[k] for k in (0, 2, 3, 5, 6)}
    cut = [x for x in rows if x["changed"]]
    assert sorted(str(x["doc_id"]) for x in cut) == ["2", "None"]
    assert all(x["removed_bytes"] > 0.5 * len(passage) for x in cut)


def test_substrings_odd_rows(docs, empty):
    rows = substrings.deduplicate(docs)
    assert rows.columns == [*docs.columns, "removed_bytes", "removed_spans", "changed"]
    got = rows.collect()
    assert len(got) == docs.count()
    texts = defaultdict(list)
    for r in got:
        texts[r[0]].append(r[1])
    assert texts[3] == [r[1] for r in docs.collect() if r[0] == 3]
    assert texts[4] == [None] and texts[5] == [""] and texts[6] == [" \n\t "]
    assert len(texts[12][0]) < 400 and len(texts[8][0]) > 5000
    assert substrings.deduplicate(empty).collect() == []


def test_op1(llm, sf):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    want = brute_dedup(texts)
    assert {r["doc_id"]: r["text"] for r in QUERIES["op1_substring_dedup"](llm, sf).collect()} == want


def test_signatures_for_bands_are_computed_once(docs, monkeypatch):
    plans = {}

    def recorded(df, name, *by):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, name, *by)

    monkeypatch.setattr(fingerprints, "stage", recorded)
    rows = fingerprints.similar_documents(docs).collect()
    assert plans["bands"].count("MapInPandas") == 1 and "MapInPandas" not in plans["band-pairs"]
    assert {(r.doc_id, r.near_id) for r in rows} >= {(12, 8)}
