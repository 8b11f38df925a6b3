"""Hashes of word shingles and fingerprints of them, in steps that bound memory for texts of any length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np

#: Bytes of text that are cut into words at a time.
STEP = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles in order, repeats included: `width` words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, joined by a space; fewer words are one shingle, none are nothing."""
    import xxhash

    data, held, at, any_yet = (text or "").encode("utf-8", "surrogatepass"), [], 0, False
    while at < len(data):
        gap = _GAP.search(data, at + STEP) if len(data) - at > STEP else None
        end = gap.start() if gap else len(data)
        words = held + data[at:end].lower().split()  # of bytes: both know ASCII only
        at = end
        if len(words) >= width:
            joined = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, len(words) - width + 1)
            any_yet = True
        held = words[max(0, len(words) - width + 1) :] if len(words) >= width else words
    if held and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprint(steps: Iterator[np.ndarray]) -> int:
    """The 64 bits that are set in over half of all hashes; zero for none."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in steps:
        for first in range(0, len(hashes), 1 << 16):
            part = np.ascontiguousarray(hashes[first : first + (1 << 16)], "<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0
