"""Words of a text and hashes of its word shingles, for the near-duplicate operators.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. The hash of a shingle is a
polynomial in 64-bit hashes of its words, then mixed; a text of fewer words is one shingle.
"""

from __future__ import annotations

import numpy as np
import xxhash

from assetloom.llm.common import Recent, release

CACHE_WORDS, CACHE_BYTES = 200_000, 64


HASHES = Recent(xxhash.xxh3_64_intdigest, CACHE_WORDS, CACHE_BYTES, __name__)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Hashes of all word shingles of a text in turn, repeated ones too; none without words."""
    release(__name__)
    words = text.encode().lower().split()
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n < 1:
        if not len(h):
            return h
        width, n = len(h), 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
    out += np.uint64(width)
    return mix(out)
