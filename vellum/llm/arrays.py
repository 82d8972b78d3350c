"""Texts of a batch as one numpy array of code points, and array steps used by the window operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from vellum.llm.text import fold_char

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal values stay equal, others look random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as code points, and where each begins (one more entry than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), starts


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    inverse = U(pow(int(_ODD), -1, 1 << 64))
    out = []
    for base in (_ODD, inverse):
        p = np.full(max(n, 1), base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(values: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q values; shorter by q - 1 than values."""
    n = len(values)
    if n < q:
        return np.zeros(0, U)
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(mix(values.astype(U) + U(1)) * up, out=total[1:])
    return mix((total[q:] - total[: n - q + 1]) * down[: n - q + 1])


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of width values; shorter by width - 1."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = best(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        out = best(out[: len(out) - (width - reach)], out[width - reach :])
    return out


class WordArrays:
    """Folded words of texts as arrays: case, accents, punctuation and odd forms don't count.

    Characters are folded through a table that is filled as characters turn up.
    """

    def __init__(self) -> None:
        self.kind = np.full(0x110000, -1, np.int8)  # -1 unknown, 0 vanishes, 1 parts words, 2 counts
        self.code = np.zeros(0x110000, U)

    def _learn(self, points: np.ndarray) -> None:
        for cp in np.unique(points[self.kind[points] < 0]):
            c = fold_char(chr(cp)) if not 0xD800 <= cp < 0xE000 else " "
            self.kind[cp] = 0 if c == "" else 1 if c.strip() == "" else 2
            self.code[cp] = hash_text(c)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each word of all texts in order, and at which word each text begins."""
        points, starts = code_points(texts)
        if not len(points):
            return np.zeros(0, U), np.zeros(len(starts), np.int64)
        self._learn(points)
        kind = self.kind[points]
        keep = kind > 0
        points, kind = points[keep], kind[keep]
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        letter = kind == 2
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        inner = starts[(starts > 0) & (starts < len(letter))]
        first[inner] = letter[inner]
        begins = np.flatnonzero(first)
        if not len(begins):
            return np.zeros(0, U), np.zeros(len(starts), np.int64)
        # position of a letter in its word, so that a word has one hash wherever it stands
        owner = np.cumsum(first) - 1
        at = np.flatnonzero(letter)
        inside = at - begins[owner[at]]
        up, _ = powers(int(inside.max()) + 2)
        hashes = mix(np.add.reduceat(mix(self.code[points[at]]) * up[inside], np.searchsorted(at, begins)))
        return hashes, np.searchsorted(begins, starts)


def hash_text(text: str) -> np.uint64:
    """Hash of a short folded piece."""
    out = 0
    for c in text:
        out = (out * 1_000_003 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return U(out)


def groups(lengths: list[int], most: int) -> Iterator[slice]:
    """Consecutive items with at most that total length together (a longer item is alone)."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def char_table(pattern: str) -> np.ndarray:
    """For every code point whether it matches a one-character pattern."""
    every = "".join(chr(cp) for cp in range(0x20000) if not 0xD800 <= cp < 0xE000)
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in re.findall(pattern, every)]] = True
    return table


class TextScan:
    """Texts that hold one of the characters, or one of the neighbouring pairs, given as one-character patterns."""

    def __init__(self, single: str, pairs: list[tuple[str, str]] = ()) -> None:
        self.patterns = single, list(pairs)
        assert len(self.patterns[1]) <= 32
        self._tables = None

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns, "_tables": None}

    def __call__(self, texts: list[str]) -> list[int]:
        """Which texts (numbers); nulls are none of them."""
        if self._tables is None:
            single, pairs = self.patterns
            # a bit for each pair, so that all are looked up at once
            first, second = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32)
            for k, (a, b) in enumerate(pairs):
                first |= char_table(a).astype(np.uint32) << np.uint32(k)
                second |= char_table(b).astype(np.uint32) << np.uint32(k)
            self._tables = char_table(single), first, second
        single, first, second = self._tables
        out = []
        held = [i for i, x in enumerate(texts) if x and not x.isascii()]
        for part in groups([len(texts[i]) for i in held], 400_000):
            points, starts = code_points([texts[i] for i in held[part]])
            flag = single[points]
            if self.patterns[1]:
                flag[:-1] |= (first[points[:-1]] & second[points[1:]]) != 0
            many = np.add.reduceat(flag, starts[:-1], dtype=np.int64)
            out += [held[part.start + i] for i in np.flatnonzero(many)]
        return out
