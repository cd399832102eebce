"""Word hashes of many texts at once (numpy over UTF-8 bytes), for operators that need them by the hundred million."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at once: the arrays of one go take about 40 times as much.
CHUNK = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) <= n:
        m = max(n, CHUNK) + 1
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def words(buffer: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a byte buffer, A-Z in lower case.

    ``edges``: ascending places, the first 0 and the last the length, that words don't cross."""
    if not len(buffer):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    solid = ~_BLANK[buffer]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = edges[(edges > 0) & (edges < len(buffer))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(buffer))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[_LOWER[buffer]] * power[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return starts, ends, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(texts: list[bytes], cut: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts packed into buffers of about ``CHUNK`` bytes: buffer, edges, and the text number of each stretch between edges.

    A longer text is cut into stretches just after a ``cut`` byte; texts come in order, empty ones have no stretch."""
    held, numbers, size = [], [], 0

    def packed():
        edges = np.zeros(len(held) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in held], out=edges[1:])
        return np.frombuffer(b"".join(held), dtype=np.uint8), edges, np.array(numbers, dtype=np.int64)

    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK:
                end = text.rfind(cut, at, at + CHUNK) + 1 or text.find(cut, at + CHUNK) + 1 or len(text)
            if held and size + end - at > CHUNK:
                yield packed()
                held, numbers, size = [], [], 0
            held.append(text[at:end])
            numbers.append(k)
            size += end - at
            at = end
    if held:
        yield packed()
