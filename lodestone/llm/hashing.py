"""Hashes of the words of many texts at a time, by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at a time; arrays take about 50 times that.
RUN = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_LETTERS = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int) -> np.ndarray:
    out = np.full(2 * RUN + 2, np.uint64(base % 2**64))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: list[np.ndarray] = []


def _hash_run(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of at most 2 * RUN bytes that end with a blank.

    A word is a polynomial in an odd multiplier modulo 2**64; sums over all bytes give it at any place, and
    the inverse power takes the place out.
    """
    if not _UP:
        _UP.extend((_powers(_MULTIPLIER), _powers(pow(_MULTIPLIER, -1, 2**64))))
    codes = np.frombuffer(data, np.uint8)
    blank = _BLANK[codes]
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[codes] * _UP[0][: len(codes)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * _UP[1][starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _hash_long(data: bytes) -> np.ndarray:
    """The word hashes of a text of any length; a word over RUN bytes is cut, and its parts are folded."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + RUN)
        if end < len(data):
            cut = max(data.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut >= at else end
        out.append(_hash_run(data[at:end] + b" ")[0])
        at = end
    return np.concatenate(out)


def hashed_words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, A-Z in lower case, in order."""
    run: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if run:
            h, starts = _hash_run(b" ".join(run) + b" ")
            edges = np.cumsum([0] + [len(r) + 1 for r in run])
            yield from np.split(h, np.searchsorted(starts, edges[1:-1]))

    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if size + len(data) + 1 > RUN:
            yield from flush()
            run, size = [], 0
        if len(data) >= RUN:
            yield _hash_long(data)
        else:
            run.append(data)
            size += len(data) + 1
    yield from flush()


def shingles_of(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes, in place order."""
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = mixed(out * np.uint64(_MULTIPLIER) + h[j : j + n])
    return out


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; all words as one if there are
    fewer, nothing without words."""
    for h in hashed_words(texts):
        yield np.unique(shingles_of(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)
