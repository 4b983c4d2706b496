"""Language identification in two steps: the family, then the language within it.

A text is a normalised vector of hashed byte n-grams of its letters.  A softmax
regression tells the language family; linear support vector machines, one for
each pair of languages of that family, vote on the language.

Training reads a bounded sample of labelled rows (``per_language`` rows of each
language, fewer where there are more than ``MAX_SAMPLE`` in all), chosen by a
hash of doc_id; counts cover all rows.  Prediction reads the text alone, whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and
so is every text when no row could be learnt from.  Rows without doc_id or
without a label are not learnt from, but predicted.  Languages the family table
does not know are families of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokora.functions.once import with_columns_once
from lokora.llm.common import pick

# Languages by family (ISO 639-1).
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

UNDETERMINED = "und"
BITS = 12  # 4096 features
MAX_N = 4
BLOCK = 1 << 20  # bytes hashed at once: long texts need no more memory
PER_LANGUAGE, MAX_SAMPLE = 400, 20_000
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts (1 to 4 bytes) of the whole text, at length 1."""
    data = b" " + b" ".join(text.lower().encode("utf-8").translate(LETTERS).split()) + b" "
    counts = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(data), BLOCK):
        part = np.frombuffer(data[at : at + BLOCK + MAX_N - 1], np.uint8).astype(np.uint32)
        gram = np.zeros(len(part), np.uint32)
        for n in range(1, MAX_N + 1):
            # gram[i]: the n bytes from i on.
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            slot = ((gram[:BLOCK] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            counts += np.bincount(slot, minlength=1 << BITS)
    vector = np.sqrt(counts.astype(np.float32))
    return vector / np.float32(max(np.sqrt(vector @ vector), 1e-9))


def with_bias(vectors: Sequence[bytes]) -> np.ndarray:
    """Half-precision vectors as rows of one float32 matrix, with a last column of ones."""
    x = np.ones((len(vectors), (1 << BITS) + 1), np.float32)
    for row, vector in zip(x, vectors, strict=True):
        row[:-1] = np.frombuffer(vector, np.float16)
    return x


def softmax_regression(x: np.ndarray, label: np.ndarray, classes: int, steps: int = 300) -> np.ndarray:
    """Weights (features + 1, classes) of rows ``with_bias`` by accelerated gradient descent."""
    goal = np.eye(classes, dtype=np.float32)[label]
    share = np.maximum(goal.sum(0), 1.0)
    weight = (1.0 / (classes * share))[label][:, None].astype(np.float32)  # classes count alike
    w = ahead = np.zeros((x.shape[1], classes), np.float32)
    for t in range(steps):
        p = _softmax(x @ ahead)
        new = ahead - 2.0 * (x.T @ (weight * (p - goal)) + 1e-5 * ahead)
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights and bias of a linear support vector machine (y in -1, 1) on rows ``with_bias``
    by dual coordinate descent."""
    square = np.einsum("ij,ij->i", x, x)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    order = np.random.default_rng(7)
    limit = cost * len(y) / (2 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum())))
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / square[i], 0.0), limit[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


@dataclass
class Model:
    """Languages by family, the family weights, and the weights of each pair."""

    families: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.families else []
        if not known:
            return langs, scores
        x = np.stack([features(texts[i]) for i in known])
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        names = sorted(self.families)
        share = np.ones((len(x), 1)) if self.family_weights is None else _softmax(x @ self.family_weights)
        best = share.argmax(1)
        for f in np.unique(best):
            rows = np.flatnonzero(best == f)
            members = self.families[names[f]]
            votes, belief = (np.zeros((len(rows), len(members))) for _ in range(2))
            for a, b in combinations(range(len(members)), 2):
                margin = x[rows] @ self.pairs[members[a], members[b]]
                first = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
                votes[:, a] += margin > 0
                votes[:, b] += margin <= 0
                belief[:, a] += first
                belief[:, b] += 1 - first
            belief /= max(1, len(members) - 1)
            if len(members) == 1:
                belief[:] = 1.0
            chosen = (votes + belief / 2).argmax(1)
            for at, (r, c) in enumerate(zip(rows, chosen, strict=True)):
                langs[known[r]] = members[c]
                scores[known[r]] = float(min(1.0, share[r, f] * belief[at, c]))
        return langs, scores


def vectors(rows: DataFrame) -> DataFrame:
    """``rows`` whose text has a letter, with its ``vector``.

    Each is computed once: a filter on it below a second computation takes a second Python
    worker for each task, and an executor keeps its workers, with what they remember, for
    whatever runs next.
    """

    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype(np.float16).tobytes() if has_letter(t) else None for t in text], dtype=object)

    return with_columns_once(rows, {"vector": vector("text")}).filter("vector is not null")


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from ``(doc_id, text, lang)`` rows.

    Each problem, the families and every pair, is trained in a task of its own on
    its bounded part of the sample; only weights come to the driver.
    """
    labelled = rows.filter("lang is not null and doc_id is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    wanted = min(per_language, max(1, MAX_SAMPLE // len(counts)))
    families: dict[str, list[str]] = {}
    for lang in sorted(counts):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    names = sorted(families)
    problems = {lang: [] for lang in counts}
    if len(names) > 1:
        for lang in counts:
            problems[lang].append("")
    pairs = [p for members in families.values() for p in combinations(members, 2)]
    for k, (a, b) in enumerate(pairs):
        problems[a].append(str(k))
        problems[b].append(str(k))

    spark = rows.sparkSession
    million = 1_000_000
    langs = sorted(counts)
    share = [min(million, -(-wanted * million // counts[lang])) for lang in langs]
    # As an Arrow table: rows of Python would go through Python workers of their own.
    chance = spark.createDataFrame(
        pa.table({"lang": langs, "chance": share, "problems": pa.array([problems[x] for x in langs], pa.list_(pa.string()))})
    )
    sample = (
        labelled.join(F.broadcast(chance), "lang")  # one row per language
        .filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < F.col("chance"))
        .select("doc_id", "lang", "text", "problems")
    )

    family_index = {lang: names.index(FAMILY_OF.get(lang, lang)) for lang in counts}

    def train(key: tuple[str], group: pd.DataFrame) -> pd.DataFrame:
        # One matrix beside the vectors as they came: nothing of their size is copied again.
        order = group[["lang", "doc_id"]].reset_index(drop=True).sort_values(["lang", "doc_id"])
        vectors = group["vector"].to_numpy()
        x, group = with_bias([vectors[i] for i in order.index]), order
        del vectors
        if key[0] == "":
            w = softmax_regression(x, group["lang"].map(family_index).to_numpy(), len(names))
        else:
            w = linear_svm(x, np.where(group["lang"] == pairs[int(key[0])][0], 1.0, -1.0))
        return pd.DataFrame({"problem": [key[0]], "weights": [w.astype(np.float32).tobytes()]})

    trained = (
        vectors(sample)
        .select("doc_id", "lang", "vector", F.explode("problems").alias("problem"))
        .groupBy("problem")
        .applyInPandas(train, "problem string, weights binary")
    )
    weights = {r["problem"]: np.frombuffer(r["weights"], np.float32) for r in trained.collect()}
    zero = np.zeros((1 << BITS) + 1, np.float32)
    family = weights.get("")
    return Model(
        families,
        None if family is None else family.reshape(-1, len(names)),
        {pair: weights.get(str(k), zero) for k, pair in enumerate(pairs)},
    )


def predicted(model: Model, text: Column, spark) -> Column:
    """``struct<lang, score>`` for each text; the model is a few vectors, sent once."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = shared.value.predict(list(batch))
            yield pd.DataFrame({"lang": pd.Series(lang, dtype=object), "score": score})

    return predict(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id modulo 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs``."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.filter("not held_out"), per_language)
    out = rows.withColumn("_p", predicted(model, F.col("text"), docs.sparkSession))
    return out.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
