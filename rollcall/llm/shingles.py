"""Vectorised word n-gram hashing shared by the shingle operators.

All kernels work on whole texts as UTF-8 bytes and on a batch of documents at
once, so the cost per byte is a handful of numpy operations.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_TABLE = _BYTE.copy()
for _upper in range(0x41, 0x5B):
    _TABLE[_upper] = _TABLE[_upper + 32]
_IS_WORD = np.ones(256, dtype=bool)
for _space in _SPACES:
    _TABLE[_space] = 0
    _IS_WORD[_space] = False

_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(length: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < length:
        steps = np.full(max(64, 2 * length), _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash every white-space separated word of ``data``; return (hashes, start offsets)."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = _IS_WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    spans = np.diff(np.append(starts, len(raw)))
    offset = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    values = _TABLE[raw[starts[0] :]]
    # A long run of white space would need long powers; its values are zero anyway.
    longest = 1 + int((offset * word[starts[0] :]).max())
    values *= _powers(longest)[np.minimum(offset, longest - 1)]
    return mix(np.add.reduceat(values, starts - starts[0])), starts


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct ``width``-word shingle hashes of each text.

    Fewer words than ``width`` make one shingle of the whole sequence; no words
    make an empty set.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    hashes, starts = word_hashes(b"\n".join(parts))
    cuts = np.searchsorted(starts, np.append(0, ends))
    grams = np.empty(0, np.uint64)
    if len(hashes) >= width:
        total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
        for k in range(width):
            total += hashes[k : k + len(total)] * _SLOT[k]
        grams = mix(total)
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif hi > lo:
            whole = (hashes[lo:hi] * _SLOT[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + _SLOT[32 + hi - lo]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
