"""Hashes of word shingles, shared by the fingerprint operators.

A function of one text: a null, empty or blank text has none; repeated shingles stay; a text of any length is read whole.
"""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, lower-cased in A-Z and joined by one space; the whole if it has fewer; none if it has none.

    Words are runs of anything but the six ASCII white spaces, which is how bytes are split.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, seed)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1].tolist()
    return np.fromiter([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8", n - width + 1)
