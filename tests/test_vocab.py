import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lokora.functions import text as T
from lokora.functions import tokens as K
from lokora.operators import vocab as V
from lokora.session import stage_table


def brute_merges(words, n):
    """The published algorithm, merge by merge."""
    state = {tuple(w[:-1]) + (w[-1] + "</w>",): c for w, c in words.items()}
    out = []
    for _ in range(n):
        pairs = Counter()
        for symbols, c in state.items():
            for p in zip(symbols, symbols[1:]):
                pairs[p] += c
        pairs = {p: c for p, c in pairs.items() if c >= 2}
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        out.append(best)
        new = {}
        for symbols, c in state.items():
            s, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == best:
                    s.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    s.append(symbols[i])
                    i += 1
            new[tuple(s)] = new.get(tuple(s), 0) + c
        state = new
    return out


def random_words(seed, letters="aabcé", words=150, most=60):
    rng, out = random.Random(seed), Counter()
    for _ in range(words):
        out["".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))] += rng.randint(1, most)
    return out


@pytest.mark.parametrize(("batch", "local"), [(1, 0), (40, 0), (40, 120), (40, 400), (40, 10**6)])
def test_learn_matches_published_algorithm(spark, batch, local):
    """Rounds over all words, rounds over the words of the leading pairs, and all at once."""
    words = random_words(4)
    df = spark.createDataFrame(list(words.items()), "token string, cnt bigint")
    n = 8 if batch == 1 else 40
    got = [(r.left, r.right) for r in V.learn_subwords(df, n, batch, local_symbols=local).orderBy("rank").collect()]
    assert got == brute_merges(words, n)


def test_learn_until_no_pair_is_left(spark):
    words = random_words(6, "abcdefgh", 300, 9)
    df = spark.createDataFrame(list(words.items()), "token string, cnt bigint")
    got = [(r.left, r.right) for r in V.learn_subwords(df).orderBy("rank").collect()]
    assert got == brute_merges(words, 10**6) and len(got) > 300


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_rounds_with_part_of_the_words(share):
    """A round on the words of the leading pairs makes merges of the whole, and at least one."""
    for seed in range(60):
        words = random_words(seed, "aab" if seed % 2 else "abcde", 60, 12)
        state = {w: " ".join([*w[:-1], w[-1] + V.WORD_END]) for w in words}
        want, made, done = brute_merges(words, 10**6), set(), 0
        while done < len(want):
            totals = Counter()
            for w, s in state.items():
                symbols = s.split(" ")
                for p in zip(symbols, symbols[1:]):
                    totals[p] += words[w]
            ranked = sorted(totals.values(), reverse=True)
            floor = min(ranked[int(len(ranked) * share * 0.5)], ranked[0] - 1)
            held = [w for w, s in state.items() if any(totals[p] > floor for p in zip(s.split(" "), s.split(" ")[1:]))]
            merger = V._Merger([state[w] for w in held], [words[w] for w in held], floor, made)
            new = []
            while pair := merger.next(2):
                merger.merge(pair)
                new.append(pair)
            assert new and new == want[done : done + len(new)], (seed, done)
            done += len(new)
            made |= {a + b for a, b in new}
            state.update(zip(held, [" ".join(s) for s in merger.words], strict=True))


def test_apply_and_join_back(spark):
    merges = spark.createDataFrame(
        [(0, "l", "o"), (1, "lo", "w</w>"), (2, "a", "a")], "rank int, left string, right string"
    )
    df = spark.createDataFrame([("low lower aaa x",), ("",)], "line string")
    rows = V.apply_subwords(df, ["line"], merges).withColumn("back", T.remove_subwords(F.col("line"))).collect()
    assert [r.line for r in rows] == ["low lo@@ w@@ e@@ r aa@@ a x", ""]
    assert [r.back for r in rows] == ["low lower aaa x", ""]


def test_join_back_literal(spark):
    row = spark.sql("select 'Ver@@ knü@@ pfen' as t").select(T.remove_subwords(F.col("t")).alias("t")).first()
    assert row.t == "Verknüpfen"


def test_dictionary_and_encoding(spark):
    df = spark.createDataFrame([(0, "b a a"), (1, "c a <tag>"), (2, ""), (3, "zz b")], "id int, line string")
    counts = V.token_counts(df.filter("id < 3"))
    d = V.build_dictionary(counts, ["<tag>", "<d>"])
    got = [(r.token, r.cnt, r.id) for r in d.orderBy("id").collect()]
    assert got == [("a", 3, 4), ("<tag>", 1, 5), ("b", 1, 6), ("c", 1, 7), ("<d>", 0, 8)]
    for limit in (10**6, 0):  # broadcast and shuffled token join
        e = V.encode_corpus(df, "line", d, ["id"], max_broadcast=limit).orderBy("id").collect()
        assert [list(r.ids) for r in e] == [[6, 4, 4], [7, 4, 5], [], [3, 6]]
    rep = V.oov_report(V.encode_corpus(df, "line", d, ["id"]).withColumn("g", F.lit(1)), ["g"]).first()
    assert (rep.tokens, rep.unknown) == (8, 1)


@pytest.mark.parametrize(
    "lang,text,expected",
    [
        ("en", "Don't open 3,5 files, please.", "Don &apos;t open 3,5 files , please ."),
        ("de", 'Datei "a" (neu)...', "Datei &quot; a &quot; ( neu ) ..."),
        ("fr", "l'eau & co", "l&apos; eau &amp; co"),
        ("en", "  a\t b  ", "a b"),
    ],
)
def test_tokenise(spark, lang, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(K.tokenise(F.col("t"), lang)).first()[0] == expected


def test_detokenise(spark):
    df = spark.createDataFrame([("Don &apos;t open ( 3 , 5 ) files , please .",)], "t string")
    assert df.select(K.detokenise(F.col("t"), "en")).first()[0] == "Don't open (3, 5) files, please."


@pytest.mark.parametrize("share", [0.1, 0.3, 0.6, 0.9])
def test_rounds_with_parts_of_words(share):
    """A round on the runs of the leading pairs makes merges of the whole, and at least one."""
    for seed in range(80):
        words = random_words(seed, ["aab", "abcde", "ab", "aabc"][seed % 4], 60, [12, 200][seed % 2])
        state = {w: [*w[:-1], w[-1] + V.WORD_END] for w in words}
        want, made, done = brute_merges(words, 10**6), set(), 0
        while done < len(want):
            totals = Counter()
            for w, s in state.items():
                for p in zip(s, s[1:]):
                    totals[p] += words[w]
            ranked = sorted(totals.values(), reverse=True)
            floor = min(ranked[int(len(ranked) * share * 0.5)], ranked[0] - 1)
            runs = Counter()
            for w, s in state.items():
                start = 0
                for i in range(1, len(s) + 1):
                    if i == len(s) or totals[s[i - 1], s[i]] <= floor:
                        if i - start > 1:
                            runs[" ".join(s[start:i])] += words[w]
                        start = i
            merger = V._Merger(list(runs), list(runs.values()), floor, made)
            new = []
            while pair := merger.next(2):
                merger.merge(pair)
                new.append(pair)
            assert new and new == want[done : done + len(new)], (seed, done)
            done += len(new)
            made |= {a + b for a, b in new}
            ranks = {pair: r for r, pair in enumerate(new)}
            state = {w: V._merge_in_order(s, ranks) for w, s in state.items()}


def test_parts_join_equal_runs_of_many_words(spark):
    """What one task merges is counted by run, not by word: it is small where words are many."""
    rows = [(f"{a}{b}xy", 1, f"{a} {b} x y</w>") for a in "abcdefgh" for b in "abcdefgh"]
    df = spark.createDataFrame(rows, "token string, cnt bigint, symbols string")
    assert [tuple(r) for r in V._parts(df, [("x", "y</w>")]).collect()] == [("x y</w>", 64)]


def test_only_rare_tokens_move_to_be_looked_up(spark):
    """A dictionary too large to broadcast: frequent tokens are found where they are."""
    df = spark.range(50).select(
        F.expr("nullif(id, 49)").alias("id"), F.expr("concat('a a b c w', id, ' zz')").alias("line")
    )
    d = V.build_dictionary(V.token_counts(df.filter("id < 40")))
    size = d.agg(F.sum(F.octet_length("token") + 16)).first()[0]
    got = V.encode_corpus(df, "line", d, ["id"], max_broadcast=size // 2)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [token" in text and "isnull(_id" in text
    ids = {r.token: r.id for r in d.collect()}
    for r in got.collect():
        assert r.ids == [ids.get(w, 3) for w in f"a a b c w{49 if r.id is None else r.id} zz".split()]


@pytest.mark.parametrize("limit", [0, 40, 1 << 20])
def test_equal_lines_are_encoded_once(spark, limit):
    """The same ids as row by row, whatever part of the dictionary is broadcast."""
    lines = ["a b  a", " c a ", None, "", " ", "zz a zz b", "a b  a", "\u00e9 c"]
    rows = [(f, p, k, lines[((f or 0) + p + k // 3) % 8]) for f in (1, 2, None) for p in range(5) for k in range(9)]
    df = spark.createDataFrame(rows, "f int, p int, k int, line string")
    d = spark.createDataFrame([("a", 9, 4), ("b", 5, 5), ("c", 2, 6), ("\u00e9", 1, 7)], "token string, cnt bigint, id bigint")
    known = {"a": 4, "b": 5, "c": 6, "\u00e9": 7}
    want = sorted((repr((f, p, k)), [known.get(t, 3) for t in (line or "").split(" ") if t]) for f, p, k, line in rows)
    for near in ((), ["f", "p"]):
        got = V.encode_corpus(df, "line", d, ["k", "f", "p"], max_broadcast=limit, near=near)
        assert got.columns == ["k", "f", "p", "ids"]
        assert sorted((repr((r.f, r.p, r.k)), r.ids) for r in got.collect()) == want


def test_tokens_do_not_carry_the_key(spark):
    df = spark.createDataFrame([("file", 1, "a b")], "filepath string, pos int, line string")
    d = spark.createDataFrame([("a", 9, 4)], "token string, cnt bigint, id bigint")
    plan = V.encode_corpus(df, "line", d, ["filepath", "pos"])._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"ObjectHashAggregate\(keys=\[(.*?)\]", plan)
    assert keys and all(re.fullmatch(r"_no#\d+L, _hash#\d+L", k) for k in keys)


@pytest.mark.parametrize("near", [(), ["f"]])
def test_rare_tokens_return_without_moving_rows(spark, near):
    """Rows are placed once (as read by both branches), rare tokens move to the dictionary and back."""
    df = stage_table(spark.range(60).selectExpr("concat('f', id % 7) as f", "id as p", "'a b c' as line"), "rows")
    d = spark.createDataFrame([("a", 9, 4), ("b", 5, 5)], "token string, cnt bigint, id bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        encoded = V.encode_corpus(df, "line", d, ["f", "p"], max_broadcast=20, near=near)
        plan = encoded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(_hash#\d+L, \d+\)", plan)) == 3
    assert len(re.findall(r"Exchange hashpartitioning\(token#\d+, \d+\)", plan)) == plan.count("Exchange hashpartitioning") - 3 == 2
