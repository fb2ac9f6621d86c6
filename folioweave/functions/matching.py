"""What difflib's SequenceMatcher finds, faster: equal runs of two texts come from an index of one text's parts, not from all pairs
of equal characters. Results are difflib's, ties included."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np

#: Lengths of indexed parts, each twice the one before; equal pairs of parts that are held at once (more: difflib itself).
PARTS, MOST = (1, 2, 4, 8), 4_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Index:
    """The places of every part of a text; a part is numbered by its two halves, so equal numbers are equal parts."""

    def __init__(self, text: str):
        self.text, self.levels = text, []
        flat = _codes(text)
        for size in PARTS:
            if size > 1:
                flat = self._paired(flat, size)
            keys, number, count = np.unique(flat, return_inverse=True, return_counts=True)
            self.levels.append((keys, np.argsort(number, kind="stable"), np.cumsum(count) - count, count))
            flat = number.astype(np.int64)

    def _paired(self, flat: np.ndarray, size: int) -> np.ndarray:
        half = size // 2
        a, b = flat[: max(len(flat) - half, 0)], flat[half:]
        return np.where((a >= 0) & (b >= 0), a * (len(self.text) + 1) + b, -1)

    def runs(self, said: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """start and end in said and shift to the text of all maximal equal runs of ``least`` (one of PARTS) characters or more."""
        flat = _codes(said)
        for size, (keys, places, begin, count) in zip(PARTS, self.levels, strict=True):
            if size > 1:
                flat = self._paired(flat, size)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            flat = np.where(keys[at] == flat, at, -1) if len(keys) else np.full(len(flat), -1)
            if size == least:
                break
        i = np.flatnonzero(flat >= 0)
        many = count[flat[i]]
        if many.sum() > MOST:
            return None
        j = places[np.arange(many.sum()) + np.repeat(begin[flat[i]] - (np.cumsum(many) - many), many)]
        i = np.repeat(i, many)
        order = np.lexsort((i, j - i))
        i, shift = i[order], (j - i)[order]
        new = np.ones(len(i), bool)
        new[1:] = (shift[1:] != shift[:-1]) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(i)][: len(first)] - 1
        return i[first], i[last] + least, shift[first]

    def longest(self, said: str) -> tuple[int, int, int]:
        """Start in said, start in the text and size of the longest common block; the first in said, then in the text."""
        if said and (at := self.text.find(said)) >= 0:
            return 0, at, len(said)
        for least in reversed(PARTS):
            found = self.runs(said, least)
            if found is None:
                return tuple(difflib.SequenceMatcher(None, said, self.text, autojunk=False).find_longest_match())
            if len(found[0]):
                start, end, shift = found
                best = np.lexsort((start + shift, start, start - end))[0]
                return int(start[best]), int(start[best] + shift[best]), int(end[best] - start[best])
        return 0, 0, 0

    def blocks(self, said: str, least: int) -> list[tuple[int, int]]:
        """Start in the text and size of those matching blocks of said and the text (autojunk off) that have ``least`` characters."""
        if said and (at := self.text.find(said)) >= 0:
            return [(at, len(said))] if len(said) >= least else []
        found = self.runs(said, max(p for p in PARTS if p <= max(least, 1)))
        if found is None:
            return [(m.b, m.size) for m in difflib.SequenceMatcher(None, said, self.text, autojunk=False).get_matching_blocks() if m.size and m.size >= least]
        out, todo = [], [(0, len(said), 0, len(self.text), *found)]
        while todo:  # a block shorter than least has no longer one beside it in its range
            low, high, b_low, b_high, start, end, shift = todo.pop()
            first, last = np.maximum(np.maximum(start, low), b_low - shift), np.minimum(np.minimum(end, high), b_high - shift)
            kept = last - first >= max(least, 1)
            start, end, shift, first, size = start[kept], end[kept], shift[kept], first[kept], (last - first)[kept]
            if not len(size):
                continue
            top = np.flatnonzero(size == size.max())
            best = top[np.lexsort((first[top] + shift[top], first[top]))[0]]
            i, k = int(first[best]), int(size[best])
            j = i + int(shift[best])
            out.append((j, k))
            todo += [(low, i, b_low, j, start, end, shift), (i + k, high, j + k, b_high, start, end, shift)]
        return sorted(out)


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(): in texts of 200 characters and more, frequent characters only widen blocks, so the runs
    of the others are few."""
    n = len(b)
    if n < 200:
        return difflib.SequenceMatcher(None, a, b).ratio()
    places: dict[str, list[int]] = {c: [] for c, times in Counter(b).items() if times <= n // 100 + 1}
    for j, c in enumerate(b):
        if c in places:
            places[c].append(j)
    runs, open_runs = [], {}
    for i, c in enumerate(a):
        for j in places.get(c, ()):
            run = open_runs.get(j - i)
            if run is not None and run[1] == i:
                run[1] = i + 1
            else:
                open_runs[j - i] = run = [i, i + 1, j - i]
                runs.append(run)
    total, todo = 0, [(0, len(a), 0, n, runs)]
    while todo:
        low, high, b_low, b_high, near = todo.pop()
        size, i, j, kept = 0, low, b_low, []
        for run in near:
            start, end, shift = run
            start = max(start, low, b_low - shift)
            k = min(end, high, b_high - shift) - start
            if k > 0:
                kept.append(run)
                if k > size or k == size and (start, start + shift) < (i, j):
                    size, i, j = k, start, start + shift
        while i > low and j > b_low and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < high and j + size < b_high and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if low < i and b_low < j:
                todo.append((low, i, b_low, j, kept))
            if i + size < high and j + size < b_high:
                todo.append((i + size, high, j + size, b_high, kept))
    return 2.0 * total / (len(a) + n)
