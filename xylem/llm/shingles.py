"""Sets of word shingles of whole texts, as 64-bit hashes.

Words are the runs of bytes other than space and \\x09-\\x0D, after A-Z become
a-z. A text's set is its distinct shingles of five words in a row; a text of
one to four words has one shingle, the whole; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from xylem.llm.common import U64, mix64, prefix_hash, span_hash, text_bytes

WIDTH = 5
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word among the bytes of many texts, and the number of words of each text."""
    n = len(offsets) - 1
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n, np.int64)
    white = _WHITE[flat]
    first, last = np.empty_like(white), np.empty_like(white)
    first[0] = last[-1] = True
    first[1:], last[:-1] = white[:-1], white[1:]
    filled = np.diff(offsets) > 0
    first[offsets[:-1][filled]] = True
    last[offsets[1:][filled] - 1] = True
    start, end = np.flatnonzero(first & ~white), np.flatnonzero(last & ~white) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text end to end, and where each text's begin (one more for the end)."""
    flat, offsets = text_bytes(texts)
    flat = _LOWER[flat]
    start, end, words = word_spans(flat, offsets)
    word = span_hash(prefix_hash(flat), start, end)
    weights = [U64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(width)]
    sums = np.zeros(max(0, len(word) - width + 1), U64)
    for k in range(width if len(sums) else 0):
        sums += word[k : k + len(sums)] * weights[k]
    sums = mix64(sums)
    at = np.concatenate([[0], np.cumsum(words)])
    out, sizes = [], np.zeros(len(words), np.int64)
    for i, n in enumerate(words.tolist()):
        if n >= width:
            one = np.sort(sums[at[i] : at[i] + n - width + 1])
            one = one[np.append(True, one[1:] != one[:-1])]
        elif n:
            part = word[at[i] : at[i + 1]]
            total = sum((int(h) * int(w) for h, w in zip(part, weights, strict=False)), n * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
            one = mix64(np.array([total], U64))
        else:
            continue
        out.append(one)
        sizes[i] = len(one)
    return np.concatenate(out) if out else np.empty(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each set, from its members and their number. Empty sets get 0."""
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mix64(hashes ^ U64(0x27D4EB2F165667C5)), out=sums[1:])
    sizes = np.diff(bounds)
    out = mix64((sums[bounds[1:]] - sums[bounds[:-1]]) + sizes.astype(U64) * U64(0x9FB21C651E98DF25))
    return np.where(sizes > 0, out, U64(0))
