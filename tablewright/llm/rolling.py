"""Fingerprints of all windows of a sequence, with numpy.

A window's fingerprint is the polynomial of its values in a fixed odd multiplier modulo 2**64, taken from running sums
and mixed afterwards. The values are random 64-bit numbers (of bytes) or mixed fingerprints (of words) themselves.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Positions whose powers are kept; longer sequences are cut into such shares.
SHARE = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(SHARE, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end], ``starts`` ascending; spans may be long."""
    up, down = _powers()
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        base = int(starts[low])
        high = int(np.searchsorted(starts, base + SHARE // 2))
        while high - low > 1 and int(ends[low:high].max()) - base > SHARE:
            high = low + (high - low) // 2
        top = int(ends[low:high].max())
        if top - base > SHARE:  # one long span: by Horner's rule over shares
            total = np.uint64(0)
            for at in range(base, int(ends[low]), SHARE):
                share = values[at : min(at + SHARE, int(ends[low]))]
                total = np.bitwise_xor(mix(np.array([total], dtype=np.uint64))[0], np.sum(share * up[: len(share)], dtype=np.uint64))
            out[low] = total
            low += 1
            continue
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values[base:top] * up[: top - base], dtype=np.uint64)])
        a = starts[low:high] - base
        out[low:high] = (sums[ends[low:high] - base] - sums[a]) * down[np.minimum(a, SHARE - 1)]
        low = high
    return mix(out)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of ``width`` values, by start."""
    starts = np.arange(max(0, len(values) - width + 1))
    return spans(values, starts, starts + width)


def byte_array(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 bytes one after the other, and the border of each."""
    raw = [t.encode() if t else b"" for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def words(buffer: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (between white space and borders of texts), and the first word of each text."""
    inside = ~SPACES[buffer]
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    edges = borders[:-1][borders[:-1] < len(buffer)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    stops = inside & ~np.concatenate([inside[1:], [False]])
    last = borders[1:][borders[1:] > 0] - 1
    stops[last] = inside[last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, borders)
