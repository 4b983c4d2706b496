"""Spelling variants against comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from lokora.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("block", [5, 1000])
def test_searches_as_brute_force(monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", block)
    r = random.Random(block)
    for turn in range(20):
        letters = "ab" if turn % 2 else "abcé"
        held = sorted({"".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(60)})
        asked = sorted({"".join(r.choice(letters + "z") for _ in range(r.randrange(2, 8))) for _ in range(40)})
        index = spelling.Index(held)
        for left in (True, False):
            want = set()
            for i, a in enumerate(asked):
                h = len(a) // 2
                for j, b in enumerate(held):
                    kept = b.startswith(a[:h]) if left else b.endswith(a[h:])
                    if kept and one_edit(a[h:] if left else a[:h], b[h:] if left else b[: len(b) - len(a) + h]):
                        want.add((i, j))
            query, word = index.near(asked, left)
            assert set(zip(query.tolist(), word.tolist(), strict=True)) == want and len(query) == len(want)


def brute(rows, least_length, least_count, ratio):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    held = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    out, form = {}, {}
    for w, n in held.items():
        near = [x for x in held if one_edit(w, x)]
        best = min(near, key=lambda x: (-held[x], x), default=None)
        if best is not None and held[best] >= ratio * n:
            form[w] = best
        out[w] = (n, len(near), form.get(w), held.get(form.get(w)))

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (*v, root(w)) for w, v in out.items()}


@pytest.mark.parametrize("chars", [1 << 20, 60])
def test_variants_as_brute_force(llm, monkeypatch, chars):
    """Also with shards so small that words of one half fill several."""
    monkeypatch.setattr(spelling, "SHARD_CHARS", chars)
    r = random.Random(8)
    stems = ["".join(r.choice("abÉ") for _ in range(r.randrange(3, 7))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa"]
    rows = []
    for i in range(150):
        text = [r.choice(stems[: r.randrange(1, len(stems))]) for _ in range(60)]
        rows.append((i if i % 9 else None, " ".join(w.upper() if r.random() < 0.1 else w for w in text)))
    rows += [(200, None), (201, ""), (202, "12 34"), (203, "a-b\0c" + "x" * 3000 + " " + "x" * 3000 + "y"), (203, "x" * 3000), (204, "x" * 3000 + "y")]
    df = llm.createDataFrame([(*x, "t") for x in rows], "doc_id long, text string, TEXT string")
    got = spelling.variants(df, least_length=3, ratio=3).collect()
    assert {g["word"]: (g["n"], g["n_near"], g["form"], g["form_n"], g["root"]) for g in got} == brute(rows, 3, 2, 3)
    assert len(got) == len({g["word"] for g in got})


def test_chain_of_forms(llm):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("v", "w3")]
    got = dict(map(tuple, spelling.roots(llm.createDataFrame(rows, "word string, form string")).collect()))
    assert got == {**{f"w{i}": "w9" for i in range(9)}, "v": "w9"}


def test_no_words(llm, empty):
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(llm.createDataFrame([(1, "1 2"), (2, None)], "doc_id long, text string")).collect() == []
