"""Word shingles as 64-bit hashes, computed on whole buffers of text with numpy.

Upper-case A-Z is lowered; words are parted by space and tab to carriage return. Hashes of 64 bits
stand for shingles, so two different ones of the same set coincide about once in 2 ** 64 / n ** 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
# Bytes hashed at a time; a longer word widens its window.
WINDOW = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
# An odd base has an inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the usual window."""
    if size not in _powers:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > WINDOW:
            return out[0], out[1]
        _powers[size] = out[0], out[1]
    return _powers[size]


def _windows(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a buffer that end at blanks, with their offsets and blanks."""
    at = 0
    while at < len(data):
        piece = _BLANK[data[at : at + WINDOW]]
        if at + WINDOW < len(data):
            blanks = np.flatnonzero(piece)
            if len(blanks):
                piece = piece[: blanks[-1] + 1]
            else:
                rest = np.flatnonzero(_BLANK[data[at + WINDOW :]])
                end = at + WINDOW + (rest[0] + 1 if len(rest) else len(data))
                piece = _BLANK[data[at:end]]
        yield at, data[at : at + len(piece)], piece
        at += len(piece)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, piece, blank in _windows(np.frombuffer(data, np.uint8)):
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _tables(max(WINDOW, len(piece)))
        # Sums of byte times base ** place; a word's own is a difference, moved to place 0.
        upto = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=upto[1:])
        own = (upto[ends] - upto[starts]) * inverse[starts]
        hashes.append(mix(own + (ends - starts).astype(np.uint64) * _WEIGHTS[0]))
        places.append(starts + at)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    words, places = word_hashes(b"\n".join(data))
    ends = np.cumsum([len(d) + 1 for d in data])
    upto = np.concatenate([[0], np.searchsorted(places, ends)])
    rolled = np.zeros(max(0, len(words) - SIZE + 1), np.uint64)
    for i, weight in enumerate(_WEIGHTS):
        rolled += words[i : i + len(rolled)] * weight
    rolled = mix(rolled)
    out = []
    for a, b in zip(upto[:-1], upto[1:]):
        n = b - a
        if n >= SIZE:
            s = np.sort(rolled[a : b - SIZE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            # Fewer words are one shingle of their own, apart from all longer ones.
            whole = (words[a:b] * _WEIGHTS[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(mix(np.array([whole], np.uint64)) ^ np.uint64(_BASE)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
