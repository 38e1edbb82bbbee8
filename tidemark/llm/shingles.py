"""Hashes of word shingles, vectorised over many texts.

Words are what lies between ASCII white space (space, tab to carriage return) after lower-casing
A-Z. A text of fewer words than a shingle holds has its whole word sequence as its one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes that are hashed at once, and powers kept for later.
SPAN = 1 << 18


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 * SPAN:  # rare, and too long to keep
            return _steps(BASE, n), _steps(pow(BASE, -1, 1 << 64), n)
        if len(self.up) < n:
            size = max(n, SPAN + (SPAN >> 2))
            self.up, self.down = _steps(BASE, size), _steps(pow(BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


def _steps(step: int, n: int) -> np.ndarray:
    steps = np.full(n, step, _U)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_powers = _Powers()


def word_hashes(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each the place of its text. Texts are lower-cased.

    At most about ``span`` bytes, or one longer word, are hashed at once."""
    whole = b"\n".join(texts) + b"\n"
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    hashes, places, at = [], [], 0
    while at < len(whole):
        stop = min(at + span, len(whole))
        if stop < len(whole):  # cut after white space
            cut = max(whole.rfind(c, at, stop) for c in (b" ", b"\n"))
            stop = cut + 1 if cut >= 0 else min(x for x in (whole.find(c, stop) + 1 for c in (b" ", b"\n")) if x)
        found, starts = _hashed(np.frombuffer(whole, np.uint8, stop - at, at))
        hashes.append(found)
        places.append(starts + at)
        at = stop
    return np.concatenate(hashes), np.searchsorted(bounds, np.concatenate(places), side="right")


def _hashed(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of ``buffer``, which ends with white space."""
    edges = np.flatnonzero(np.diff(SPACE[buffer], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers.of(len(buffer))
    sums = np.zeros(len(buffer) + 1, _U)
    np.cumsum((buffer.astype(_U) + _U(1)) * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U)), starts


def shingle_sets(texts: list[str | None], words: int, span: int = SPAN) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a null text or one without words."""
    start = size = 0
    plain = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    for i, t in enumerate(plain):
        if size and size + len(t) > span:
            yield from _sets(plain[start:i], words)
            start, size = i, 0
        size += len(t)
    if start < len(plain):
        yield from _sets(plain[start:], words)


def _sets(plain: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, owner = word_hashes(plain)
    firsts = np.searchsorted(owner, np.arange(len(plain) + 1))
    n = len(hashes) - words + 1
    rolled = np.zeros(max(n, 0), _U)
    for j in range(words):
        if n > 0:
            rolled = mix(rolled * _U(3) + hashes[j : j + n] + _U(j + 1))
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            whole = np.zeros(1, _U)
            for h in hashes[a:b]:
                whole = mix(whole * _U(5) + h + _U(977 * (b - a)))
            yield whole
        else:
            yield np.zeros(0, _U)
