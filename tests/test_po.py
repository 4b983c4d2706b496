import random

from lokora.plans.corpus import po_corpus_rows
from lokora.sources import po

PO = '''msgid ""
msgstr "Content-Type: text/plain; charset=UTF-8\\n"

#: src/a.c:10 src/b.c:20
msgid "Open"
msgstr "Öffnen"

#, fuzzy
msgid "Save"
msgstr "Sichern"

msgid ""
"Two "
"lines\\n"
msgstr "Zwei "
"Zeilen\\n"

#: src/c.c:3
msgid "one file"
msgid_plural "%d files"
msgstr[0] "eine Datei"
msgstr[1] "%d Dateien"

#~ msgid "Gone"
#~ msgstr "Weg"
'''
EXPECTED = [("Open", "Öffnen", "src/a.c<cxt>"), ("Two lines", "Zwei Zeilen", "")]


def files(spark, *contents):
    return spark.createDataFrame(
        [(f"f{i}.po", c) for i, c in enumerate(contents)], "filepath string, content string"
    )


def pairs(entries, **kw):
    rows = po.po_pairs(entries, **kw).orderBy("filepath", "pos").collect()
    return [(r.src, r.tgt, r.cxt) for r in rows]


def both_ways(spark, content, block_lines=3, **kw):
    """The row form and the line form must agree, with tiny blocks too."""
    df = files(spark, content)
    by_row = pairs(po.parse_po_entries(df), **kw)
    by_line = pairs(po.po_lines_to_entries(po.po_lines(df, block_lines)), **kw)
    assert by_row == by_line
    return by_row


def test_literal(spark):
    assert both_ways(spark, PO) == EXPECTED


def test_no_blank_lines_and_crlf(spark):
    dense = PO.replace("\n\n", "\n")
    assert both_ways(spark, dense, 1) == EXPECTED
    assert both_ways(spark, PO.replace("\n", "\r\n"), 2) == EXPECTED


def test_keep_empty_keeps_plurals(spark):
    assert both_ways(spark, PO, keep_empty=True) == [
        EXPECTED[0], EXPECTED[1], ("one file", "", "src/c.c<cxt>")
    ]


def test_escapes_and_context(spark):
    text = r'''
msgctxt "menu"
"more"
msgid "a \"b\" \\n c\td"
msgstr "x\\\\\ny"
# note
msgid "k"
msgstr "v  \n"
'''
    df = files(spark, text)
    rows = po.parse_po_entries(df).orderBy("entry_no").collect()
    assert rows[0].msgctxt == "menumore"
    assert rows[0].msgid == 'a "b" \\n c\td'
    assert rows[0].msgstr == "x\\\\\ny"
    assert rows[1].msgctxt is None and rows[1].msgstr == "v  \n"
    assert both_ways(spark, text)[1] == ("k", "v", "")


def test_occurrences_and_flags(spark):
    text = '#: a.c:1 b.c\n#: c:x\n#, c-format, fuzzy\nmsgid "m"\nmsgstr "n"\n'
    row = po.parse_po_entries(files(spark, text)).first()
    assert [(o.path, o.line) for o in row.occurrences] == [("a.c", "1"), ("b.c", ""), ("c:x", "")]
    assert row.flags == ["c-format", "fuzzy"]


def test_quarantine(spark):
    bad = files(
        spark, 'msgid "a\nmsgstr "b"\n', "", 'msgid "a"\nmsgstr "b"\nnoise\n', PO, 'msgid "a\\"\nmsgstr ""\n'
    )
    got = {r.filepath: r.reason for r in po.po_problems(bad).collect()}
    assert got == {
        "f0.po": "unterminated string",
        "f1.po": "no entries",
        "f2.po": "unexpected line",
        "f4.po": "unterminated string",
    }
    by_row = po.parse_po_entries(bad).select("filepath").distinct().collect()
    assert [r.filepath for r in by_row] == ["f3.po"]
    lines = po.po_lines(bad, 2)
    assert {r.filepath: r.reason for r in po.po_line_problems(lines).collect()} == got
    by_line = po.po_lines_to_entries(po.po_lines(bad, 2)).select("filepath").distinct().collect()
    assert [r.filepath for r in by_line] == ["f3.po"]


def test_files_on_disk(spark, tmp_path):
    sub = tmp_path / "o" / "r"
    sub.mkdir(parents=True)
    (sub / "de.po").write_bytes(PO.encode("utf-8"))
    (sub / "old.po").write_bytes(PO.encode("latin-1"))
    (sub / "skip.txt").write_text(PO)
    got = po.read_po_files(spark, str(tmp_path))
    assert got.count() == 2
    assert pairs(po.parse_po_entries(got)) == EXPECTED * 2
    lines = po.read_large_po_lines(spark, str(tmp_path), 10)
    assert pairs(po.po_lines_to_entries(lines)) == EXPECTED * 2
    assert po.read_po_files(spark, str(tmp_path), 10).count() == 0
    assert po.read_large_po_lines(spark, str(tmp_path), 10**6).count() == 0


def test_split_large_file(spark, tmp_path):
    body = PO + "".join(f'\n#: s{i}.c:1\nmsgid "m{i}"\nmsgstr "n{i}"\n' for i in range(400))
    (tmp_path / "big.po").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = po.read_large_po_lines(spark, str(tmp_path), 10)
        assert lines.select("blk").distinct().count() > 3
        got = pairs(po.po_lines_to_entries(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == EXPECTED + [(f"m{i}", f"n{i}", f"s{i}.c<cxt>") for i in range(400)]


def test_old_blocks(spark):
    rows = po.parse_po_blocks(files(spark, PO)).orderBy("block_no").collect()
    assert [(r.cxt, r.src, r.tgt) for r in rows] == [
        ("src/a.c:10 src/b.c:20", " Open", " Öffnen"),
        ("src/c.c:3", " one filemsgidplural %d files", "[0] eine Dateimsgstr[1] %d Dateien"),
    ]


def test_old_blocks_carry(spark):
    text = '#: a.c:1\n#: b.c:2\nmsgid "x"\nmsgstr "y"\n\n#: c.c:3\nmsgid "p"\nmsgstr "q"\n'
    rows = po.parse_po_blocks(files(spark, text)).orderBy("block_no").collect()
    assert [(r.cxt, r.src, r.tgt) for r in rows] == [("a.c:1 b.c:2", " x", " y"), ("c.c:3", " p", " q")]


# --- Both forms agree ------------------------------------------------------------

ODD_PIECES = [
    'msgid "a"\n', 'msgid "b"\r\n', 'msgstr "x"\r', 'msgstr "y"\n', 'msgstr[0] "p"\n', '#: f.c:1\n', '#, fuzzy\n', "\n", "\r\n",
    '#~ msgid "old"\n', '#~ msgstr "gone"\n', "#~ msgfoo bar\n", 'msgid_plural "s"\n', 'msgctxt "c"\n', '"more"\n', '#~ "more"\n',
    'msgstr "form feed"\f\n', '  msgid "in"\t\x0b\n', "# comment\n", 'msgid "tab\\t\\101\\x42\\a"\n', 'msgstr "open\n', "stray\n",
    "﻿", 'msgid "ü"\n',
]


def test_forms_agree_on_odd_files(spark, tmp_path):
    rng = random.Random(11)
    root = tmp_path / "my dir" / "100%+done"
    root.mkdir(parents=True)
    good = [p for p in ODD_PIECES if "open" not in p and "stray" not in p]
    for k in range(160):
        text = "".join(rng.choice(good if k % 4 else ODD_PIECES) for _ in range(rng.randrange(1, 14)))
        data = text.encode("iso-8859-1", "ignore") if k % 9 == 8 else text.encode()
        if k % 5 == 0:
            data = b"\xef\xbb\xbf" + data
        (root / f"f {k}%41+.po").write_bytes(data + b"\n")
    results = []
    for limit in (10**9, 0):
        pairs, problems = po_corpus_rows(spark, str(tmp_path), limit)
        entries = (
            po.parse_po_entries(po.read_po_files(spark, str(tmp_path), limit))
            if limit
            else po.po_lines_to_entries(po.read_large_po_lines(spark, str(tmp_path), limit))
        )
        results.append(
            [sorted(map(repr, x.drop("blk").collect())) for x in (entries, pairs, problems)]
        )
    assert results[0] == results[1] and all(results[0])
    named = {r.filepath for r in problems.collect()} | {r.filepath for r in entries.collect()}
    # Every file is in the entries or in the quarantine, under its real name.
    assert {n.partition("/my dir/")[2] for n in named} == {f"100%+done/{f.name}" for f in root.iterdir()}


def test_lines_are_moved_once(spark):
    """Classified lines are read back as parts of entries; only parts at the edge of a block are
    grouped again."""
    df = files(spark, *[PO * 3 + f'\n#: x{i}\nmsgid "n{i}"\nmsgstr "m{i}"\n' for i in range(6)])
    entries = po.po_lines_to_entries(po.po_lines(df, 5))
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("collect_list") <= 1
    assert pairs(entries) == pairs(po.parse_po_entries(df))


def test_an_entry_over_many_blocks(spark):
    """Comments, then strings over several blocks, without a keyword in some of them."""
    more = "".join(f'"part {i} "\n' for i in range(9))
    content = f'# one\n#: a.c:1\n# two\nmsgid ""\n{more}msgstr ""\n{more}# next\nmsgid "b"\nmsgstr "c"\n'
    for block_lines in (1, 2, 3, 4, 7, 50):
        assert len(both_ways(spark, content, block_lines)) == 2
