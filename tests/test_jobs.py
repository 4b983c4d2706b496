"""The steps one after another, from PO files on disk to scores."""

import random

import pytest
from pyspark.sql import functions as F

from lokora import jobs
from lokora.functions import text as T
from lokora.sources.lines import numbered_lines


def test_end_to_end(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    root = tmp_path / "po"
    for repo in range(8):
        folder = root / "owner" / f"app{repo}" / "c1" / ("po" if repo % 2 else "de/LC_MESSAGES")
        folder.mkdir(parents=True)
        body = 'msgid ""\nmsgstr "x: y\\n"\n'
        for i in range(40):
            body += f'\n#: src/f{i % 4}.c:{i}\nmsgid "{word()} {word()} {repo}-{i}"\nmsgstr "{word()}, {word()}."\n'
        (folder / "de.po").write_text(body)
    (root / "owner" / "app0" / "c1" / "bad.po").write_text('msgid "open\n')
    out = tmp_path / "out"

    # A byte limit below the file size sends every file through the line form.
    for limit, name in (("100000000", "a"), ("10", "b")):
        jobs.main(["extract", "--root", str(root), "--out", str(out / name), "--max_bytes", limit])
    a = spark.read.parquet(str(out / "a" / "entries"))
    b = spark.read.parquet(str(out / "b" / "entries"))
    assert a.count() == 320 and a.exceptAll(b.select(a.columns)).count() == 0
    assert a.select("repo").distinct().count() == 8 and a.first().repo.startswith("owner/app")
    assert {r.repo for r in a.select("repo").distinct().collect()} == {f"owner/app{k}" for k in range(8)}
    assert spark.read.option("header", True).csv(str(out / "a" / "csv")).count() == 320
    columns = ("src", "tgt", "cxt", "name", "filepath")
    parts = {c: sorted((out / "a" / f"full.{c}").glob("part-*")) for c in columns}
    full = {c: "".join(p.read_text() for p in parts[c]).splitlines() for c in columns}
    rows = a.orderBy("filepath", "pos").collect()
    assert full["name"] == full["filepath"] and len(rows) == 320
    assert all(full[c] == [r[c] or "" for r in rows] for c in ("src", "tgt", "cxt", "filepath"))
    assert spark.read.text(str(out / "a" / "directories")).count() == 8
    for name in "ab":
        listed = spark.read.parquet(str(out / name / "quarantine")).collect()
        assert [r.reason for r in listed] == ["unterminated string"]

    entries = str(out / "a" / "entries")
    jobs.main(["subwords", "--entries", entries, "--out", str(out / "merges"), "--num_merges", "20"])
    jobs.main(["splits", "--entries", entries, "--merges", str(out / "merges"), "--out", str(out / "matrix"),
               "--train_split", "0.4", "--min_rows", "10", "--max_rows", "100"])
    matrix = spark.read.parquet(str(out / "matrix"))
    assert {r.cxt_type for r in matrix.select("cxt_type").distinct().collect()} == {"none", "domain", "filename", "neighbour"}
    none = matrix.filter("cxt_type = 'none' and direction = 'de-en'")
    assert none.filter(~F.col("output_raw").rlike(r"\d-\d")).count() == 0
    assert matrix.filter("cxt_type = 'domain' and input_raw is not null").count() == 0
    assert none.filter(F.col("input").contains("@@ ")).count() > 0

    jobs.main(["dictionary", "--matrix", str(out / "matrix"), "--out", str(out / "ids")])
    encoded = spark.read.parquet(str(out / "ids" / "output"))
    assert encoded.count() == matrix.filter("split = 'train' or eval_set = 'rnd'").count()
    assert encoded.filter(F.get("ids", F.size("ids") - 1) != 2).count() == 0

    jobs.main(["export", "--matrix", str(out / "matrix"), "--out", str(out / "sets")])
    folder = "cxt_type=none/direction=en-de/eval_set=rnd/split=test"
    lines = numbered_lines(spark, str(out / "sets" / "output" / folder), "output")
    log = lines.select(F.concat(F.lit("H-"), "row_id", F.lit("\t-0.1\t"), T.remove_subwords(F.col("output"))).alias("value"))
    log.write.text(str(out / "log"))
    log.filter("value not like 'H-0\t%'").write.text(str(out / "short_log"))
    jobs.main(["score", "--log", f"none:en-de:2={out / 'log'}", "--references", str(out / "sets" / "references"), "--out", str(out / "scores")])
    row = spark.read.parquet(str(out / "scores")).first()
    assert (row.cxt_type, row.seed, row.edits, row.bleu) == ("none", "2", 0, 100.0)
    with pytest.raises(Exception, match="differ at row 0"):
        jobs.main(["score", "--log", f"none:en-de:2={out / 'short_log'}", "--references", str(out / "sets" / "references"),
                   "--out", str(out / "none")])


def test_url_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "h.json").write_text('{"repository":"github.com/o/r","commit":"c","path":"po/de.po"}\n')
    hits = str(tmp_path / "in")
    jobs.main(["urls", "--hits", hits, "--out", str(tmp_path / "u"), "--lang", "de"])
    jobs.main(["urls", "--hits", hits, "--out", str(tmp_path / "v"), "--checkpoint", str(tmp_path / "state")])
    for name in "uv":
        assert [r.url for r in spark.read.parquet(str(tmp_path / name)).collect()] == [
            "https://raw.githubusercontent.com/o/r/c/po/de.po"]
