"""The token-group join against brute force."""

import random

import numpy as np
import pytest

from lokora.llm import groupjoin, shingles
from .test_duplicates import brute_components, edited_star, frame, near_copies, set_of


def found(df, width, percent):
    return {r["doc_id"]: r for r in groupjoin.similar_groups(df, width, percent).collect()}


@pytest.mark.parametrize(("width", "percent", "opened", "keys"), [(3, 90, 1, 4), (3, 90, 1, 9), (5, 80, 2, 4)])
def test_components_as_brute_force(llm, monkeypatch, width, percent, opened, keys):
    """``keys`` above all there are: there are no groups, the matrix finds every link."""
    monkeypatch.setattr(groupjoin, "OPENED", opened)
    monkeypatch.setattr(groupjoin, "BLOCK_ROWS", 10)
    monkeypatch.setattr(shingles, "COLUMNS", 7)
    monkeypatch.setattr(groupjoin, "LEAST_KEYS", keys)
    texts = near_copies()
    want, sets = brute_components(texts, width, percent)
    got = found(frame(llm, texts), width, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) for i in texts)


def test_star_and_far_texts(llm, monkeypatch):
    """Copies that are similar to their base alone, which has the largest id."""
    monkeypatch.setattr(groupjoin, "BLOCK_ROWS", 100)
    texts = edited_star(400, 3)
    far = {401 + k: " ".join(f"y{k}_{j}" for j in range(50)) for k in range(30)}
    want, _ = brute_components(texts | far, 5, 80)
    assert {i: r["component_id"] for i, r in found(frame(llm, texts | far), 5, 80).items()} == want


def test_prefix_shares_tokens():
    """The bound itself: similar sets share ``DEPTH`` prefix tokens in any order of the tokens."""
    r = random.Random(2)
    counts = np.array([r.randrange(5) for _ in range(groupjoin.BUCKETS)])
    for percent in (70, 80, 90):
        for _ in range(300):
            base = [r.randrange(1 << 60) for _ in range(r.randrange(1, 60))]
            a = {x for x in base if r.random() > 0.05} or set(base)
            b = {x for x in base if r.random() > 0.05} | {r.randrange(1 << 60) for _ in range(r.randrange(3))}
            if 100 * len(a & b) >= percent * len(a | b):
                cut = [set(groupjoin.prefix(np.array(sorted(s), np.uint64), counts, percent).tolist()) for s in (a, b)]
                need = min(groupjoin.DEPTH, groupjoin.least(len(a), percent))
                assert len(cut[0] & cut[1]) >= need


def test_odd_rows(llm, docs, empty):
    got = groupjoin.similar_groups(docs, 3, 90).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_shingles"] for i in (4, 5, 6, 9, 10)] == [0, 0, 0, 1, 1]
    assert by[10]["component_id"] == 9 and by[12]["component_id"] == 8 and by[3]["component_id"] == 3
    assert by[None]["component_id"] is None and by[4]["component_id"] == 4
    assert groupjoin.similar_groups(empty, 3, 90).collect() == []


def test_texts_that_share_an_id(llm):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "A B C d e f"), (None, "a b c d e f")]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in groupjoin.similar_groups(df, 3, 90).collect())))
    assert got == sorted(map(str, [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1), (None, 4, None)]))
    assert set_of("A b", 3) == {("a", "b")}
