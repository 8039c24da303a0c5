"""Hashes of all words of a column of texts at once, from its bytes.

Words are what ASCII white space leaves between it, with A-Z lower-cased. A word's hash is a polynomial of its bytes,
each replaced by a 64-bit number of its own: a difference of two prefix sums, shifted back to the word's first byte and
mixed with the length. No word becomes an object of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0xC2B2AE3D27D4EB4F  # odd, and not one more than a multiple of four, so that its powers differ early
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, by element."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(256, dtype=U) + U(0x9E3779B97F4A7C15))
BYTES[65:91] = BYTES[97:123]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... mod 2 ** 64; at least n of them."""
    if len(_POWERS.get(base, ())) < n:
        x = np.full(max(n, 1 << 16), U(base))
        x[0] = 1
        _POWERS[base] = np.cumprod(x)
    return _POWERS[base]


def slices(texts: pa.Array, size: int = 1 << 16):
    """`texts` in slices of about `size` bytes, or of a single text."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
        yield k, texts.slice(k, end - k)
        k = end


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of `texts` (strings) in order, and the number of words of each text; null: none."""
    texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
    if not len(texts) or texts.buffers()[2] is None:
        return np.empty(0, U), np.zeros(len(texts), np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    x = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at -= at[0]
    word = ~SPACE[x]
    cut = np.zeros(len(x) + 1, bool)  # before a byte: the text changes
    cut[at] = True
    start = word & cut[:-1]
    start[1:] |= word[1:] & ~word[:-1]
    end = word & cut[1:]
    end[:-1] |= word[:-1] & ~word[1:]
    start, end = np.nonzero(start)[0], np.nonzero(end)[0] + 1
    sums = np.zeros(len(x) + 1, U)
    np.cumsum(BYTES[x] * powers(BASE, len(x))[: len(x)], out=sums[1:])
    back = powers(pow(BASE, -1, 2**64), len(x))
    out = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U))
    return out, np.diff(np.searchsorted(start, at))
