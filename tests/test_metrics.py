import math
import random
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lokora.catalog import vocab_queries
from lokora.functions import distance
from lokora.functions.moves import move_blocks
from lokora.functions.tokens import words
from lokora.operators import metrics as M
from lokora.sources.lines import hypothesis_lines

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "g string, row_id int, hyp string, ref string"


def brute_bleu(pairs, smooth):
    match, total, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for h, r in pairs:
        h, r = h.split(), r.split()
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))  # noqa: E731,B023
            a, b = grams(h), grams(r)
            match[n - 1] += sum((a & b).values())
            total[n - 1] += sum(a.values())
    if min(total) == 0 or match[0] == 0 or (smooth == "none" and min(match) == 0):
        return 0.0
    log, half = 0.0, 1.0
    for m, t in zip(match, total):
        if m == 0:
            half *= 2
            log += math.log(1 / (half * t))
        else:
            log += math.log(m / t)
    bp = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return round(100 * bp * math.exp(log / 4), 4)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute_align(a, b):
    """Distance, equal partners on either side, and words of ``a`` before each place of ``b``."""
    d = [[i + j if i == 0 or j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    held, wanted, before = set(), set(), {}
    i, j = len(a), len(b)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            before[j] = i
            if a[i] == b[j]:
                held.add(i), wanted.add(j)
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
            before[j] = i
    return d[-1][-1], held, wanted, before


def brute_moves(a, b):
    a, moved = list(a), []
    while True:
        d, held, wanted, before = brute_align(a, b)
        free = {(i, j) for i in range(len(a)) for j in range(len(b)) if i not in held and j not in wanted and a[i] == b[j]}
        runs = []
        for i, j in free:
            if abs(i - j) <= 50 and (i - 1, j - 1) not in free:
                n = 1
                while n < 10 and (i + n, j + n) in free:
                    n += 1
                runs.append((-n, i, j))
        for n, i, j in sorted(runs):
            run, rest = a[i : i - n], a[:i] + a[i - n :]
            to = before[j] + n if before[j] >= i - n else min(before[j], i)
            if brute_align(rest[:to] + run + rest[to:], b)[0] < d:
                a = rest[:to] + run + rest[to:]
                moved.append(run)
                break
        else:
            return a, moved


def brute_cost(hyp, ref):
    """Character edits, moves and their cost."""
    plain = brute_edits(hyp, ref)
    words, moved = brute_moves(hyp.split(" "), ref.split(" "))
    cost = sum(len("".join(r)) / len(r) for r in moved)
    after = brute_edits(" ".join(words), ref)
    return (after, len(moved), cost) if moved and after + cost < plain else (plain, 0, 0.0)


def test_moves_as_brute_force():
    rng = random.Random(11)
    for turn in range(400):
        ref = [rng.choice("abcdefgh"[: rng.randint(2, 8)]) for _ in range(rng.randint(0, 14))]
        hyp = list(ref)
        for _ in range(rng.randint(0, 3)):
            i, n, to = rng.randint(0, 14), rng.randint(1, 4), rng.randint(0, 14)
            run, hyp = hyp[i : i + n], hyp[:i] + hyp[i + n :]
            hyp[to:to] = run
        hyp = [w if rng.random() < 0.9 else "z" for w in hyp]
        assert move_blocks(hyp, ref) == brute_moves(hyp, ref), (hyp, ref)


def test_a_moved_block_costs_one_word(spark):
    one, other = "the quick brown fox jumps", "while seven wizards brew potions"
    rows = [("g", 0, f"{one} {other} ümlaut", f"{other} {one} ümlaut"), ("g", 1, "Äh", "Ah"), ("h", 2, None, "x")]
    got = {r.row_id: r for r in M.with_edits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].moves == 1 and got[0].edits == 0 and 4 <= got[0].move_cost <= 6
    assert (got[1].edits, got[1].moves, got[2].edits) == (1, 0, None)


def test_far_apart_texts():
    """The band grows with the distance, on texts of some thousand words."""
    rng = random.Random(3)
    ref = [rng.choice("abcdefghijklmnop") + rng.choice("abcdefghij") for _ in range(3000)]
    hyp = ref[:1000] + ref[1200:] + ref[1000:1005]
    words, moved = move_blocks(hyp, ref)
    assert sorted(words) == sorted(hyp) and words != [] and len(moved) < 40


def sample():
    rng = random.Random(9)
    text = lambda k: " ".join(rng.choice("abcdefg") for _ in range(k))
    rows = []
    for g in "pqrs":
        for i in range(12):
            ref = text(rng.randint(0, 12))
            hyp = ref if rng.random() < 0.3 else " ".join(
                w if rng.random() < (0.9 if g != "s" else 0.4) else "z" for w in ref.split()[: rng.randint(1, 12)]
            )
            rows.append((g, i, hyp, ref))
    rows += [("same", 0, "a b c d e", "a b c d e"), ("empty", 0, "", "a b"), ("short", 0, "a b", "a b")]
    return rows


@pytest.mark.parametrize("smooth", ["exp", "none"])
def test_bleu(spark, smooth):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.g: r.bleu for r in M.corpus_bleu(df, ["g"], ["row_id"], words, smooth).collect()}
    for g in {r[0] for r in rows}:
        want = brute_bleu([(h, r) for k, _, h, r in rows if k == g], smooth)
        assert got[g] == pytest.approx(want, abs=2e-4), g
    assert got["same"] == 100.0


def test_ngrams_are_counted_where_rows_are(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    plan = M.ngram_matches(df, ["g"], ["row_id"])._jdf.queryExecution().executedPlan().toString()
    # One exchange for the text, one for the sums; none for the n-grams.
    assert plan.count("Exchange hashpartitioning") == 2


def test_ngrams_stay_where_a_group_column_is_fixed(spark):
    """A constant among the group columns brings no exchange of the n-grams back."""
    df = spark.createDataFrame(sample(), SCHEMA).withColumn("seed", F.lit(2))
    counts = M.ngram_matches(df, ["g", "seed"], ["row_id"])
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    plain = M.ngram_matches(df, ["g"], ["row_id"])
    assert sorted(map(tuple, counts.drop("seed").collect())) == sorted(map(tuple, plain.collect()))


def test_ngrams_of_missing_and_empty_texts(spark):
    rows = [("a", 0, None, "x y"), ("a", 1, "x", ""), ("b", 2, "", None), ("c", 3, "x x y", "x y y")]
    got = {(r.g, r.n): tuple(r)[2:] for r in M.ngram_matches(spark.createDataFrame(rows, SCHEMA), ["g"], ["row_id"]).collect()}
    want = {("a", 1): (0, 1, 2), ("a", 2): (0, 0, 1), ("c", 1): (2, 3, 3), ("c", 2): (1, 2, 2), ("c", 3): (0, 1, 1)}
    assert got == want


def test_edit_rate(spark):
    rows = sample()
    got = {r.g: r for r in M.character_edit_rate(spark.createDataFrame(rows, SCHEMA), ["g"]).collect()}
    for g in {r[0] for r in rows}:
        mine = [(h, r) for k, _, h, r in rows if k == g]
        each = [brute_cost(h, r) for h, r in mine]
        edits, moves, cost, chars = sum(e[0] for e in each), sum(e[1] for e in each), sum(e[2] for e in each), sum(len(h) for h, _ in mine)
        assert (got[g].edits, got[g].moves, got[g].hyp_chars) == (edits, moves, chars)
        assert got[g].edit_rate == (None if chars == 0 else pytest.approx(round((edits + cost) / chars, 4), abs=1e-4))
    assert got["empty"].mean_rate == 1.0


def test_registered_rates_as_brute_force(spark):
    """The query's rows on the smallest tables, real text, one system."""
    if not DATA.exists():
        pytest.skip("no test tables here")
    pairs = vocab_queries._pairs(spark, str(DATA)).filter("cxt_type = 'filename'").toPandas()
    want = {}
    for _, r in pairs.iterrows():
        edits, moves, cost = brute_cost(r["hyp"], r["ref"])
        total = want.setdefault(r["eval_set"], [0, 0, 0.0, 0])
        for k, v in enumerate((edits, moves, cost, len(r["hyp"]))):
            total[k] += v
    report = vocab_queries.full_score_report(spark, str(DATA)).filter("cxt_type = 'filename'").collect()
    assert len(report) == len(want)
    for r in report:
        edits, moves, cost, chars = want[r.eval_set]
        assert (r.edits, r.moves, r.hyp_chars) == (edits, moves, chars)
        assert r.edit_rate == pytest.approx((edits + cost) / chars, abs=1e-4)


def test_edit_distance_beyond_the_bands(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdü") for _ in range(n))
    rows = [(text(n), text(m)) for n, m in ((0, 0), (0, 9), (30, 31), (80, 70), (400, 330), (700, 20))]
    rows.append((rows[4][0], rows[4][0][:200] + "x" + rows[4][0][205:]))
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.d for r in df.select("*", M.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [brute_edits(a, b) for a, b in rows]


def test_edit_distance_both_ways_as_brute_force():
    """Diagonals and columns of bits give the same distance, also over long equal runs."""
    rng = random.Random(6)
    for turn in range(300):
        letters = "abcdü\U0001f600"[: rng.randint(1, 6)]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        b = list(a) if turn % 3 else [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 6)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 2)] = rng.choice(["", "a", "bü"])
        b = "".join(b)
        want = brute_edits(a, b)
        assert distance.edit_distance(a, b) == want, (a, b)
        assert not a or distance._by_columns(a, b) == want, (a, b)
        assert distance._by_diagonals(a, b, want) == want, (a, b)
        assert distance._by_diagonals(a, b, want - 1) is None, (a, b)


def test_distance_of_long_texts_is_no_table():
    """Some ten thousand characters that have little in common: no cell for each pair of them."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = text(30_000), text(29_000)
    start = time.process_time()
    far = distance.edit_distance(a, b)
    assert 1_000 < far < 30_000 and distance.edit_distance(b, a) == far
    assert time.process_time() - start < 30


def test_hypothesis_lines(spark):
    df = spark.createDataFrame([("S-0\tx",), ("H-0\t-0.3\tein Tag",), ("P-0\t-1",)], "value string")
    assert [tuple(r) for r in hypothesis_lines(df).collect()] == [(0, -0.3, "ein Tag")]


def test_align(spark):
    h = spark.createDataFrame([("d", "rnd", 1, "none", "x"), ("d", "rnd", 1, "domain", "y"), ("d", "rnd", 2, "none", "z")],
                              "direction string, eval_set string, row_id int, cxt_type string, hyp string")
    r = spark.createDataFrame([("d", "rnd", 1, "ref")], "direction string, eval_set string, row_id int, ref string")
    want = [("domain", "y", "ref"), ("none", "x", "ref")]
    assert sorted((x.cxt_type, x.hyp, x.ref) for x in M.align_hypotheses(h, r, strict=False).collect()) == want
    whole = M.align_hypotheses(h.filter("row_id = 1"), r, system=["cxt_type"])
    assert sorted((x.cxt_type, x.hyp, x.ref) for x in whole.collect()) == want
    for hyp in (h, h.filter("cxt_type = 'none' and row_id = 2")):
        with pytest.raises(Exception, match="differ at row"):
            M.align_hypotheses(hyp, r, system=["cxt_type"]).collect()
    assert [tuple(x) for x in M.unmatched_rows(h, r).collect()] == [("d", "rnd", 1, 0)]
