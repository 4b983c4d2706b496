"""Block moves between two lists of words, for edit rates that count a move once."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

# Ship the helpers below with their UDFs, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of a move, and places that it may bridge, at most (as translation edit rates have it).
MOVE_WORDS, MOVE_PLACES = 10, 50
FIRST_BAND = 16
DIAGONAL, DROPPED, ADDED = 0, 1, 2


def _numbers(left: Sequence[str], right: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    known: dict[str, int] = {}
    both = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in (left, right)]
    return both[0], both[1]


def _banded(left: np.ndarray, right: np.ndarray, band: int, steps: np.ndarray | None) -> int:
    """Edit distance if it is at most ``band``, else something larger.

    ``steps`` takes the step that leads to each cell, diagonals before dropped
    before added words.
    """
    far = len(left) + len(right) + 1
    diagonal = np.arange(-band, band + 1)
    row = np.where((diagonal >= 0) & (diagonal <= len(right)), diagonal, far)
    for i in range(1, len(left) + 1):
        at = i + diagonal
        inside = (at >= 0) & (at <= len(right))
        with_word = inside & (at >= 1)
        differs = np.ones(len(diagonal), np.int64)
        differs[with_word] = right[at[with_word] - 1] != left[i - 1]
        straight = np.where(with_word, row + differs, far)
        dropped = np.append(row[1:] + 1, far)
        best = np.where(inside, np.minimum(straight, dropped), far)
        row = np.where(inside, np.minimum.accumulate(best - diagonal) + diagonal, far)
        if steps is not None:
            steps[i] = np.where(straight == row, DIAGONAL, np.where(dropped == row, DROPPED, ADDED))
    end = len(right) - len(left)
    return int(row[end + band]) if abs(end) <= band else far


def distance_within(left: np.ndarray, right: np.ndarray, most: int) -> int:
    """Edit distance of number lists if it is at most ``most``, else something larger."""
    return _banded(left, right, most, None) if most >= 0 else len(left) + len(right) + 1


def align(left: np.ndarray, right: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Distance; which words of either side have an equal partner; and for each place of
    ``right`` how many words of ``left`` come before it.

    The band doubles until it holds the distance: time is length times distance.
    """
    band = FIRST_BAND
    while True:
        band = min(band, max(len(left), len(right), 1))
        steps = np.zeros((len(left) + 1, 2 * band + 1), np.uint8)
        distance = _banded(left, right, band, steps)
        if distance <= band:
            break
        band *= 2
    held, wanted = np.zeros(len(left), bool), np.zeros(len(right), bool)
    before = np.zeros(len(right), np.int64)
    i, j = len(left), len(right)
    while i or j:
        step = steps[i, j - i + band] if i else ADDED
        if step == DIAGONAL:
            i, j = i - 1, j - 1
            held[i] = wanted[j] = left[i] == right[j]
            before[j] = i
        elif step == DROPPED:
            i -= 1
        else:
            j -= 1
            before[j] = i
    return distance, held, wanted, before


def _runs(left: np.ndarray, right: np.ndarray, held: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, int]]:
    """``(words, from, to)``: equal runs of words without partner on either side, longest first."""
    places = defaultdict(list)
    for j in np.flatnonzero(~wanted).tolist():
        places[int(right[j])].append(j)
    out = []
    for i in np.flatnonzero(~held).tolist():
        for j in places.get(int(left[i]), ()):
            if abs(i - j) > MOVE_PLACES:
                continue
            if i and j and not held[i - 1] and not wanted[j - 1] and left[i - 1] == right[j - 1]:
                continue  # the run begins earlier
            n = 1
            while (
                n < MOVE_WORDS and i + n < len(left) and j + n < len(right)
                and not held[i + n] and not wanted[j + n] and left[i + n] == right[j + n]
            ):
                n += 1
            out.append((n, i, j))
    return sorted(out, key=lambda run: (-run[0], run[1], run[2]))


def _word_by_word(left: Sequence[str], right: Sequence[str]) -> bool:
    """Whether replacing words in place is the alignment with fewest edits, and leaves no
    equal words without partner: so if those that differ have no word in common."""
    if len(left) != len(right):
        return False
    differ = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return {a for a, _ in differ}.isdisjoint(b for _, b in differ)


def move_blocks(hypothesis: Sequence[str], reference: Sequence[str]) -> tuple[list[str], list[list[str]]]:
    """The hypothesis after its block moves, and the words of each move.

    Words without an equal partner in the alignment with fewest edits, that occur
    in the same order without partner in the reference, are moved to where the
    reference has them: the longest run first, then the first one, if that lowers
    the word edit distance; again until no move does.
    """
    words, moved = list(hypothesis), []
    while not _word_by_word(words, reference):
        left, right = _numbers(words, reference)
        distance, held, wanted, before = align(left, right)
        for n, i, j in _runs(left, right, held, wanted):
            to = int(before[j])
            to = to - n if to >= i + n else min(to, i)
            rest = np.delete(left, np.s_[i : i + n])
            if distance_within(np.insert(rest, to, left[i : i + n]), right, distance - 1) < distance:
                run = words[i : i + n]
                words = words[:i] + words[i + n :]
                words[to:to] = run
                moved.append(run)
                break
        else:
            break
    return words, moved
