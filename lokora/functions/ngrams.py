"""Clipped n-gram counts of two token lists, for a batch of rows at a time."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Ship the helpers below with their UDFs, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tokens counted at once, but for a longer row: bounds memory when texts are long.
TOKENS_AT_ONCE = 1 << 18


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of about ``TOKENS_AT_ONCE`` tokens."""
    turn = np.cumsum(sizes) // TOKENS_AT_ONCE
    cuts = np.flatnonzero(np.diff(turn)) + 1
    return list(zip([0, *cuts], [*cuts, len(sizes)], strict=True)) if len(sizes) else []


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _counted(left: pa.ListArray, right: pa.ListArray, order: int) -> np.ndarray:
    rows = len(left)
    sizes = np.concatenate([_lengths(left), _lengths(right)])
    tokens = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode("encode")
    token, kinds = tokens.indices.to_numpy().astype(np.int64), len(tokens.dictionary) + 1
    # List 2 * rows long: the left ones, then the right ones.
    which = np.repeat(np.arange(2 * rows), sizes)
    place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rest = sizes[which] - place
    out = np.zeros((rows, 3, order), np.int64)
    at = np.arange(len(token))
    gram = which % max(rows, 1)  # so that equal n-grams of two rows differ
    for n in range(order):
        # at: where an n-gram begins; gram: a number for the tokens before its last one.
        longer = rest[at] > n
        at, gram = at[longer], gram[longer]
        if not len(at):
            break
        gram = _dense(gram * kinds + token[at + n])
        is_left = which[at] < rows
        most = int(gram.max()) + 1
        mine, other = np.bincount(gram[is_left], minlength=most), np.bincount(gram[~is_left], minlength=most)
        row = np.zeros(most, np.int64)
        row[gram] = which[at] % rows
        for k, many in enumerate((np.minimum(mine, other), mine, other)):
            out[:, k, n] = np.bincount(row, many, rows)
    return out


def clipped_counts(left: pa.ListArray, right: pa.ListArray, order: int) -> np.ndarray:
    """Of each row, for n from 1 to ``order``: n-grams common to both lists (each as often as in
    the list that has it less often), n-grams of ``left``, and of ``right``.

    Shape (rows, 3, order).  N-grams are numbered, exactly, by the number of the
    n-gram one shorter and the last token.  A row without one of the lists has none.
    """
    missing = np.zeros(len(left), bool)
    for lists in (left, right):
        missing |= lists.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(left), 3, order), np.int64)
    for start, end in _parts(_lengths(left) + _lengths(right)):
        out[start:end] = _counted(left.slice(start, end - start), right.slice(start, end - start), order)
    out[missing] = 0
    return out
