import pytest
from pyspark.sql import functions as F

from lokora.functions import text as T
from lokora.functions import urls as U
from lokora.operators.corpus import drop_empty_or_long
from lokora.sources.lines import parse_disambiguation
from lokora.sinks.writers import parent_directory
from lokora.streaming.hits import hits_to_urls


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "fn,value,expected",
    [
        (T.normalise_text, "a\nb \n", "a b"),
        (T.normalise_text, "a  \x1c\t", "a"),
        (T.normalise_text, None, ""),
        (T.normalise_text, " a\r\nb", " a\r b"),
        (T.replace_punct, "src/main.c:12", "src main c 12"),
        (T.replace_punct, "a--b, c", "a b c"),
        (T.clean_text, ' "Hello\n  world_x"', " Hello worldx"),
        (T.dirname, "a/b/c.po", "a/b/"),
        (T.dirname, "c.po", ""),
        (T.basename, "a/b/c.po ", "c.po"),
        (parent_directory, "a/b/c.po", "a/b"),
        (parent_directory, "c.po", "."),
        (parent_directory, "/c.po", "/"),
        (lambda c: T.path_component(c, 2), "./po_data/owner/x.po", "owner"),
        (lambda c: T.path_component(c, 9), "a/b", None),
    ],
)
def test_text(spark, fn, value, expected):
    assert one(spark, value, fn) == expected


def test_first_occurrence(spark):
    df = spark.sql("select array('src/a.c','src/b.c') as p union all select array()")
    got = [r[0] for r in df.select(T.first_occurrence_context(F.col("p"))).collect()]
    assert got == ["src/a.c<cxt>", ""]


def test_drop_rules(spark):
    rows = [("",), ("  ",), ("x" * 201,), ("x" * 200,), ("translator-credits",), (" y ",)]
    df = spark.createDataFrame(rows, "src string")
    assert sorted(r.src for r in drop_empty_or_long(df, ["src"]).collect()) == [" y ", "x" * 200]


def test_length_filter(spark):
    rows = [("a" * 199, "b" * 500), ("a" * 200, "b" * 199), ("a" * 200, "b" * 200)]
    df = spark.createDataFrame(rows, "s string, t string")
    assert df.filter(T.within_length(F.col("s"), F.col("t"))).count() == 2
    assert df.filter(T.within_length(F.col("s"), F.col("t"), mode="and")).count() == 0
    with pytest.raises(ValueError):
        T.within_length(F.col("s"), F.col("t"), mode="xor")


def test_word_limit(spark):
    df = spark.createDataFrame([("a b", "c d")], "c string, s string")
    keep = lambda n: df.filter(T.within_tokens(F.col("c"), F.col("s"), F.col("c"), F.col("s"), n)).count()
    assert (keep(5), keep(4)) == (1, 0)


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("Öl".encode("utf-8")),), (bytearray("Öl".encode("latin-1")),)], "b binary")
    assert [r[0] for r in df.select(T.decode_text(F.col("b"))).collect()] == ["Öl", "Öl"]


def test_hits_to_urls(spark):
    rows = [
        ("github.com/o/r", "c1", "po/de.po"),
        ("gitlab.com/o/r", "c1", "po/de.po"),
        (None, "c1", "po/de.po"),
        ("example.org/o/r", "c1", "po/de.po"),
        ("github.com/o/r", "c1", "po/dexpo"),
        ("gitlab.com/g/sub/r", "c2", "HEAD/de_DE.po"),
    ]
    df = spark.createDataFrame(rows, "repository string, commit string, path string")
    assert [r.url for r in hits_to_urls(df).collect()] == [
        "https://raw.githubusercontent.com/o/r/c1/po/de.po",
        "https://gitlab.com/o/r/-/raw/c1/po/de.po",
        "https://gitlab.com/g/sub/r/-/raw/c2/HEAD/de_DE.po",
    ]
    assert hits_to_urls(df, "de").count() == 3 and hits_to_urls(df, "fr").count() == 0


@pytest.mark.parametrize(
    "path,expected",
    [("a/de.po", True), ("a/de_DE.po", True), ("a/DE.PO", True), ("a/fr.po", False), ("a/xde.po", False), ("de.po", False)],
)
def test_locale(spark, path, expected):
    assert one(spark, path, lambda c: U.matches_locale(c, "de")) is expected


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://raw.githubusercontent.com/o/r/c1/po/de.po", "o/r/c1/po/de.po"),
        ("https://gitlab.com/o/r/-/raw/c1/de.po", "o/r/-/raw/c1/de.po"),
        ("https://x.org/a", None),
    ],
)
def test_url_to_path(spark, url, expected):
    assert one(spark, url, U.url_to_path) == expected


def test_provenance(spark):
    rows = [
        ("https://raw.githubusercontent.com/o/r/c1/po/de.po",),
        ("https://raw.githubusercontent.com/o/r/-/raw/c1/po/de.po",),
        ("https://gitlab.com/g/sub/r/-/raw/c1/de.po",),
        ("https://x.org/o/r/c/p.po",),
    ]
    df = U.with_provenance(spark.createDataFrame(rows, "url string"))
    got = [(r.host, r.owner, r.repo, r.commit, r.path) for r in df.collect()]
    assert got == [
        ("raw.githubusercontent.com", "o", "r", "c1", "po/de.po"),
        ("raw.githubusercontent.com", "o", "r", "c1", "po/de.po"),
        ("gitlab.com", "g", "sub/r", "c1", "de.po"),
        (None, None, None, None, None),
    ]


def test_disambiguation(spark):
    rows = [("'Read', 'Gelesen', 'https://x/de.po'",), ("noise",), ("'it's', 'ist', 'u'",)]
    got = [tuple(r) for r in parse_disambiguation(spark.createDataFrame(rows, "value string")).collect()]
    assert got == [("Read", "Gelesen", "https://x/de.po"), ("it's", "ist", "u")]
