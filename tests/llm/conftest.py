import os
from pathlib import Path

import pytest

from lokora.llm.common import prepare

DATA = Path("/root/testdata/sf0.001")
LONG = "".join(f"word{i % 977} " for i in range(40_000))

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, TEXT string, shard int, Doc_ID string, changed string"
)
_BASE = "The quick brown fox jumps over the lazy dog while seven wizards brew potions near the old stone bridge at dawn "
ROWS = [
    (1, _BASE + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "en"),
    (2, _BASE + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu xi", "en"),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund und schläft dann ein", "de"),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund und schläft dann ein", "de"),
    (4, None, "en"),
    (5, "", None),
    (6, " \n\t ", "fr"),
    (7, "12345 !!! 678", None),
    (8, LONG, "en"),
    (9, "ok", "de"),
    (10, "OK", "xx"),
    (None, "a text without any id at all", "en"),
    (None, None, None),
    (11, "é ü  \r\n x　y\U0001f600 z</s>", "fr"),
    (12, LONG, None),
    (13, "́ combining first, then <|endoftext|> and 'll", None),
]


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def docs(llm):
    """Nulls anywhere, empty and very long texts, repeated rows, clashing column names."""
    rows = [(i, t, lang, "s", None, "other", 7, "x", None) for i, t, lang in ROWS]
    return llm.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
