"""Vectorised hashes of all stretches of a symbol sequence, and least hashes of windows.

Hashes of long stretches are built from those of shorter ones (`joined`), as a tree of nonlinear steps: there is no
polynomial whose algebra unlike sequences could share. Words enter by xxh3, eight bytes enter exactly.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Low bits of a hash that hold a position while least hashes are sought.
PLACE_BITS = 24


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the stretch whose two halves (they may overlap) have hashes a and b."""
    x = a ^ (a >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    y = b ^ (b >> np.uint64(29))
    y *= np.uint64(0xD6E8FEB86659FD93)
    x += y
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def longer(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of all stretches of `want` symbols from those of `have` symbols, have <= want <= 2 * have."""
    n = len(h) - (want - have)
    return joined(h[:n], h[want - have :]) if n > 0 else h[:0]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """Every eight bytes as one number, the first byte highest."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        if len(x) <= width:
            return x[:0]
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    out, h = v, 1
    while 2 * h <= w:
        out = np.minimum(out[:-h], out[h:])
        h *= 2
    return np.minimum(out[: len(out) - (w - h)], out[w - h :]) if w > h else out


def first_least(grams: np.ndarray, w: int, bits: int = PLACE_BITS) -> np.ndarray:
    """Of every w neighbours the place of the least by its high bits, the first on a tie.

    Places count from the start of a stretch that `bits` bits can number; stretches overlap by w - 1.
    """
    place = np.uint64((1 << bits) - 1)
    step = (1 << bits) - w + 1
    out = np.empty(max(0, len(grams) - w + 1), np.int64)
    for at in range(0, len(out), step):
        part = grams[at : at + step + w - 1]
        least = sliding_min((part & ~place) | np.arange(len(part), dtype=np.uint64), w)
        out[at : at + step] = (least & place).astype(np.int64) + at
    return out
