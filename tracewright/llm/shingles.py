"""Sets of word shingles as hashes."""

from __future__ import annotations

import numpy as np

from tracewright.llm.common import U64, mix64, prefix_sums, span_hashes

WORDS = 5
#: Bytes with A-Z lower-cased and the separators [\x20\x09-\x0D] made spaces.
FOLD = bytes(32 if 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PLACES = mix64(np.arange(1, 65, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each lower-cased word [^\\x20\\x09-\\x0D]+, in order."""
    data = np.frombuffer(text.encode().translate(FOLD), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=U64)
    gap = np.empty(len(data) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    np.equal(data, 32, out=gap[1:-1])
    starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    return span_hashes(prefix_sums(data), starts, ends)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes.

    With fewer words than a shingle has, all of them are one; without words, or for null, there is none.
    """
    hashes = word_hashes(text) if text else np.zeros(0, dtype=U64)
    n = len(hashes)
    if not n:
        return hashes
    size = min(n, words)
    sums = np.full(n - size + 1, U64(size), dtype=U64)
    for i in range(size):
        sums += hashes[i : n - size + 1 + i] * PLACES[i]
    return np.unique(mix64(sums))
