"""Words and their 64-bit hashes, for many texts at once, as NumPy arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=_U)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=_U) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n + 1 of each."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size + 1, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, joined by line ends: each word's hash, its start and end there, and of each text the number of its
    first word (one more at the end)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.cumsum([0, *(len(x) + 1 for x in texts)])
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    bounds = np.concatenate([[0], change]) if len(raw) and not space[0] else change
    start, end = bounds[0::2], bounds[1::2]
    up, inverses = powers(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverses[start] + (end - start).astype(_U))
    return hashes, start, end, np.searchsorted(start, edge)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` consecutive words, by the first one's place; shorter by size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(size):
        out += hashes[k : k + n] * _STEP[k]
    return mix(out)


def text_batches(texts, most: int = 1 << 19):
    """The texts (Arrow strings, null: empty) as lists of bytes of about `most` bytes in all, with the place of the
    first."""
    part, size, first = [], 0, 0
    for i in range(len(texts)):
        x = texts[i].as_py()
        raw = x.encode("utf-8", "surrogatepass") if x else b""
        if part and size + len(raw) > most:
            yield first, part
            part, size, first = [], 0, i
        part.append(raw)
        size += len(raw)
    if part:
        yield first, part


def spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for the words of each span."""
    up, inverses = powers(len(hashes))
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[end] - total[start]) * inverses[start] + (end - start).astype(_U))
