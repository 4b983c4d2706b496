"""Exact edit distance of two texts, in characters."""

from __future__ import annotations

import sys
from math import isqrt

from pyspark import cloudpickle

# Ship the helpers below with their UDFs, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters compared at once at first, where two texts run together.
FIRST_STEP = 16


def _together(left: str, right: str, i: int, j: int) -> int:
    """How many characters are equal from ``left[i]`` and ``right[j]`` on."""
    start, step, end = i, FIRST_STEP, min(len(left) - i, len(right) - j) + i
    if i >= end or left[i] != right[j]:
        return 0
    # Doubling steps while all is equal, then halving ones to the place that differs.
    while i + step <= end and left[i : i + step] == right[j : j + step]:
        i, j, step = i + step, j + step, 2 * step
    while step := step // 2:
        if i + step <= end and left[i : i + step] == right[j : j + step]:
            i, j = i + step, j + step
    return i - start


def _by_diagonals(left: str, right: str, most: int) -> int | None:
    """The distance if it is at most ``most``: the farthest row reached on each diagonal
    with 0, 1, 2, … edits (Ukkonen 1985).  Time is the square of the distance."""
    target = len(right) - len(left)
    if abs(target) > most:
        return None
    reached = {0: _together(left, right, 0, 0)}
    if target == 0 and reached[0] == len(left):
        return 0
    for edits in range(1, most + 1):
        farther = {}
        for k in range(-min(edits, len(left)), min(edits, len(right)) + 1):
            i = max(reached.get(k, -2) + 1, reached.get(k + 1, -2) + 1, reached.get(k - 1, -2))
            i = min(i, len(left), len(right) - k)
            farther[k] = i + _together(left, right, i, i + k)
        reached = farther
        if reached.get(target) == len(left):
            return edits
    return None


def _by_columns(left: str, right: str) -> int:
    """The distance by columns of the table of all prefixes, kept as two numbers: a bit for each
    place where the column rises, and where it falls (Myers 1999, Hyyrö 2003)."""
    places: dict[str, bytearray] = {}
    for i, char in enumerate(left):
        if (bits := places.get(char)) is None:
            bits = places[char] = bytearray(len(left) // 8 + 1)
        bits[i >> 3] |= 1 << (i & 7)
    equal = {char: int.from_bytes(bits, "little") for char, bits in places.items()}
    every = (1 << len(left)) - 1
    rises, falls = every, 0
    for char in right:
        same = equal.get(char, 0)
        diagonal = (((same & rises) + rises) ^ rises) | same | falls
        right_rises = (falls | ~(diagonal | rises)) << 1 | 1
        right_falls = (rises & diagonal) << 1
        rises = (right_falls | ~(diagonal | right_rises)) & every
        falls = right_rises & diagonal & every
    return len(right) + rises.bit_count() - falls.bit_count()


def edit_distance(left: str, right: str) -> int:
    """Insertions, deletions and replacements of characters that make ``right`` of ``left``.

    What the texts begin and end with together is left out; close texts are
    settled by diagonals, others by columns of bits.
    """
    if left == right:
        return 0
    start = _together(left, right, 0, 0)
    left, right = left[start:], right[start:]
    end = _together(left[::-1], right[::-1], 0, 0)
    left, right = left[: len(left) - end], right[: len(right) - end]
    if len(left) > len(right):
        left, right = right, left
    if not left:
        return len(right)
    # Up to here diagonals take less time than columns, whose bits are a machine word or more.
    most = isqrt(len(right) * (len(left) // 1000 + 1)) // 2
    close = _by_diagonals(left, right, most)
    return _by_columns(left, right) if close is None else close
