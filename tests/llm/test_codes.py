"""Vector codes against plain integer arithmetic."""

import hashlib
import random

import numpy as np
import pytest

from lokora.llm import codes


@pytest.mark.parametrize(("width", "largest"), [(1, 5), (16, 2**30), (100, 2**27), (3, 2**61)])
def test_products_are_exact(width, largest):
    r = random.Random(width)
    a = [[r.randrange(-largest, largest + 1) for _ in range(width)] for _ in range(9)]
    b = [[r.randrange(-largest, largest + 1) for _ in range(width)] for _ in range(7)]
    a[0], b[0] = [-largest] * width, [largest] * width
    want = [[sum(x * y for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    kind = np.int64 if width * largest**2 < 2**62 else object
    assert codes.exact_products(np.array(a), np.array(b), kind).tolist() == want


def brute(rows, parts, entries, rounds, scale):
    """Codes, errors, label errors and digest, from ``(id, vector, label)``."""
    finite = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    held = [(i, [min(max(int(np.floor(scale * c)), -(2**63)), 2**63 - 1) if abs(scale * c) < 2**63
                 else (2**63 - 1 if c > 0 else -(2**63)) for c in v], x) for i, v, x in finite]
    first = sorted(held, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    length = len(first[0][1])
    step = -(-length // parts)
    cut = [slice(k * step, (k + 1) * step) for k in range(parts)]
    books = [[list(v[c]) for _, v, _ in first if len(v) == length] for c in cut]
    vectors = [v for _, v, _ in held if len(v) == length]

    def near(part, book):
        d = [sum((x - y) ** 2 for x, y in zip(part, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for k, c in enumerate(cut):
            groups = {}
            for v in vectors:
                groups.setdefault(near(v[c], books[k])[0], []).append(v[c])
            for e, own in groups.items():
                books[k][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out, sums = [], {}
    for i, v, x in held:
        code = error = None
        if len(v) == length:
            found = [near(v[c], books[k]) for k, c in enumerate(cut)]
            code, error = "".join(f"{e:02x}" for e, _ in found), min(sum(d for _, d in found), 2**63 - 1)
            sums[x] = sums.get(x, 0) + error
        out.append((i, x, code, error))
    text = ",".join(str(c) for book in books for e in book for c in e)
    out = [(*r, None if r[1] not in sums else min(sums[r[1]], 2**63 - 1)) for r in out]
    return sorted(map(repr, out)), hashlib.sha256(text.encode()).hexdigest()


def odd_vectors(length=6):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=length)], i % 3 if i % 5 else None) for i in range(120)]
    rows += [(i, [0.5, -0.25] * (length // 2), 1) for i in range(120, 140)]  # ties
    rows += [(7, rows[7][1], 2), (7, rows[7][1], 2), (None, [1.0] * length, 9), (200, None, 1)]
    rows += [(201, [float("nan")] * length, 1), (202, [None] * length, 1), (203, [float("inf")] * length, 1)]
    return [*rows, (204, [1.0], 4), (205, [], None)]


@pytest.mark.parametrize("parts", [1, 3, 4])
@pytest.mark.parametrize("large", [1.0, 1e13, 1e300])
def test_codes_as_brute_force(llm, parts, large):
    rows = [(i, None if v is None else [None if c is None else c * large for c in v], x) for i, v, x in odd_vectors()]
    df = llm.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, Label string")
    got, books = codes.compress(df.repartition(3), parts=parts, entries=10, rounds=3)
    want, digest = brute(rows, parts, 10, 3, 1024)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert codes.books_digest(books) == digest


def test_no_vectors(llm):
    df = llm.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    got, books = codes.compress(df)
    assert got.collect() == [] and codes.books_digest(books) == hashlib.sha256(b"").hexdigest()
