"""Two-stage suffix sorting in numpy: sort the suffixes that are smaller than their successors, induce the rest."""

from __future__ import annotations

import numpy as np

#: Value of a separator. Separators compare by position, so no common prefix runs across one.
SEPARATOR = 0


def suffix_array(text: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The suffix array of text: uint16 with bytes as 1 to 256 and 0 as separator, the last value a separator.

    reach: for each position, the distance to its separator (0 there)."""
    n = len(text)
    # Small: smaller than the successor. In a run of one value, what follows the run decides.
    change = np.flatnonzero(np.diff(text) != 0)
    after = np.full(n, n - 1)
    where = np.searchsorted(change, np.arange(n - 1))
    after[: n - 1] = np.where(where < len(change), change[np.minimum(where, len(change) - 1)] + 1, n - 1) if len(change) else n - 1
    small = text[after] > text
    small |= text == SEPARATOR
    direct = _sort_direct(text, reach, np.flatnonzero(small))

    values = np.flatnonzero(np.bincount(text, minlength=257))
    heads = text[direct]
    bound = np.searchsorted(heads, np.arange(258))
    induced: dict[int, list[np.ndarray]] = {int(c): [] for c in values}
    parts = []
    for c in values.tolist():
        large = _join(induced.pop(c))
        front = large
        while len(front):
            p = front[front > 0] - 1
            front = p[(text[p] == c) & ~small[p]]
            if len(front):
                large = np.concatenate([large, front])
        bucket = np.concatenate([large, direct[bound[c] : bound[c + 1]]])
        parts.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[~small[p] & (text[p] > c)]
        if len(p):
            p = p[np.argsort(text[p], kind="stable")]
            cuts = np.flatnonzero(np.diff(text[p])) + 1
            for piece in np.split(p, cuts):
                induced[int(text[piece[0]])].append(piece)
    return np.concatenate(parts)


def _join(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int64)


def _sort_direct(text: np.ndarray, reach: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorts the suffixes at, five values a step; only those still tied go on. Ties at a separator go by position."""
    padded = np.concatenate([text.astype(np.uint64), np.zeros(5, np.uint64)])
    n = len(text)
    word = np.zeros(n, np.uint64)
    stop = np.zeros(n, bool)
    for k in range(5):
        value = padded[k : n + k].copy()
        value[stop] = 0
        word = word * np.uint64(257) + value
        stop |= padded[k : n + k] == 0
    order = at[np.argsort(word[at], kind="stable")]
    first = np.concatenate([[True], np.diff(word[order]) != 0]) if len(order) else np.zeros(0, bool)
    step = 0
    while len(order):
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        step += 5
        tied = np.flatnonzero((size[group] > 1) & (reach[order] >= step))
        if not len(tied):
            break
        # A tie holds suffixes that go on or, all alike, ones that have met their separators.
        p, g = order[tied], group[tied]
        key = word[np.minimum(p + step, n - 1)]
        by = np.lexsort((p, key, g))
        order[tied] = p[by]
        key, g = key[by], g[by]
        first[tied[1:]] |= (key[1:] != key[:-1]) | (g[1:] != g[:-1])
    return order


def equal_windows(text: np.ndarray, array: np.ndarray, reach: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of whole windows in suffix order, and the number of each one's class: adjacent suffixes whose common prefix is at least length."""
    starts = array[reach[array] >= length]
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    same = np.ones(len(starts) - 1, bool)
    live = np.arange(len(starts) - 1)
    for k in range(length):
        keep = text[starts[live] + k] == text[starts[live + 1] + k]
        same[live[~keep]] = False
        live = live[keep]
        if not len(live):
            break
    return starts, np.concatenate([[0], np.cumsum(~same)])
