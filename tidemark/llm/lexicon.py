"""Normal form of words for matching: letters, digits and bytes above ASCII are word bytes, all else separates."""

from __future__ import annotations

import numpy as np

from .common import span_hashes

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def normal_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word at or after each of the sorted byte positions `cuts`."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, cuts)


def normal_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every normal word, and the index of the first word at each cut."""
    starts, ends, first = normal_words(data, cuts)
    return span_hashes(data, starts, ends), first


def edit_distance(pattern: list, text: list, anywhere: bool = False) -> tuple[int, int]:
    """Levenshtein distance by Myers' bit vectors, and the end in `text` where it is reached first.

    With `anywhere` the pattern may match any part of the text; else the whole text. Symbols are any hashable values.
    """
    m = len(pattern)
    if not m:
        return (0 if anywhere else len(text)), 0
    masks: dict = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) | (not anywhere), minus << 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical & full
        if score < best:
            best, at = score, j
    return (best, at) if anywhere else (score, len(text))
