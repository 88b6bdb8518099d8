"""Which of many names occur in texts, and where first: numpy over the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 19
CELLS = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_size(length: int) -> int:
    return 8 if length >= 8 else 4 if length >= 4 else length


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each position on, as one number."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if size in (4, 8):
        out = np.empty(n, f"<u{size}")
        for at in range(min(size, n)):
            some = out[at::size]
            some[:] = data[at : at + len(some) * size].view(out.dtype)
        return out.astype(np.uint64, copy=False)
    out = np.zeros(n, np.uint64)
    for at in range(size):
        out |= data[at : at + n].astype(np.uint64) << np.uint64(8 * at)
    return out


class _Class:
    """Needles that are looked up by grams of one size: each by the one of its grams that the fewest needles hold."""

    def __init__(self, size: int, needles: dict[int, bytes]) -> None:
        self.size = size
        cut = {i: _grams(np.frombuffer(n, np.uint8), size) for i, n in needles.items()}
        values, counts = np.unique(np.concatenate([np.unique(g) for g in cut.values()]), return_counts=True)
        held: dict[int, list[tuple[int, int]]] = {}
        for i, g in cut.items():
            at = int(np.argmin(counts[np.searchsorted(values, g)]))
            held.setdefault(int(g[at]), []).append((i, at))
        self.anchors = np.array(sorted(held), np.uint64)
        self.held = [held[int(a)] for a in self.anchors]
        self.shift = np.uint64(64 - min(22, max(12, int(64 * len(held)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self._slots(self.anchors)] = True

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return (grams * _MIX) >> self.shift

    def met(self, data: np.ndarray):
        """(needle, where it would start) for each gram of a needle, by windows of the bytes."""
        for first in range(0, len(data), WINDOW):
            grams = _grams(data[first : first + WINDOW + self.size - 1], self.size)
            at = np.flatnonzero(self.table[self._slots(grams)])
            which = np.searchsorted(self.anchors, grams[at])
            same = self.anchors[np.minimum(which, len(self.anchors) - 1)] == grams[at]
            at, which = at[same] + first, which[same]
            order = np.argsort(which, kind="stable")
            at, which = at[order], which[order]
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(which)) + 1) if len(at) else ():
                for needle, offset in self.held[which[some[0]]]:
                    yield needle, at[some] - offset


class Needles:
    """Built once from the needles, none of them empty; ``first_in`` then costs the same for few needles and many."""

    def __init__(self, needles: list[bytes]) -> None:
        self.needles = needles
        sizes: dict[int, dict[int, bytes]] = {}
        for i, n in enumerate(needles):
            sizes.setdefault(_gram_size(len(n)), {})[i] = n
        self.classes = [_Class(size, some) for size, some in sorted(sizes.items())]

    def first_in(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, needle, start in ``data``) of the first occurrence of every needle in every text, by text.

        Text ``i`` is ``data[ends[i]:ends[i + 1]]``.
        """
        found = [(np.empty(0, np.int64),) * 3]
        for group in self.classes:
            for i, start in group.met(data):
                needle = np.frombuffer(self.needles[i], np.uint8)
                start = start[(start >= ends[0]) & (start + len(needle) <= ends[-1])]
                text = np.searchsorted(ends, start, side="right") - 1
                inside = start + len(needle) <= ends[text + 1]
                start, text = start[inside], text[inside]
                if len(needle) > group.size:
                    near = (data[start] == needle[0]) & (data[start + len(needle) - 1] == needle[-1])
                    start, text = start[near], text[near]
                    step, places = max(1, CELLS // len(needle)), np.arange(len(needle))
                    parts = [(data[start[k : k + step, None] + places] == needle).all(axis=1) for k in range(0, len(start), step)]
                    same = np.concatenate([np.empty(0, bool), *parts])
                    start, text = start[same], text[same]
                text, where = np.unique(text, return_index=True)
                found.append((text, np.full(len(text), i), start[where]))
        text, needle, start = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((start, needle, text))
        text, needle, start = text[order], needle[order], start[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (needle[1:] != needle[:-1])
        return text[new], needle[new], start[new]
