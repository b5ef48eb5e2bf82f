"""Hashes of the words of many texts at once, by arrays.

A word is a run of bytes other than space and the controls 09 to 0D, with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are hashed at a time, and the longest token hashed by the tables.
_PIECE, _SHORT = 1 << 22, 64
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
_PLACES = np.array([xxhash.xxh64_intdigest(b"place %d" % k) | 1 for k in range(_SHORT)], np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
END_OF_TEXT = np.uint64(xxhash.xxh64_intdigest(b"end"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of ``texts``, the end of each included, in order, and the number of tokens of each."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    found, owners = [], []
    lo, top = int(offsets[0]), int(offsets[-1])
    while lo < top:
        hi = min(lo + _PIECE, top)
        if hi < top:  # on to the end of the token there
            limit = int(offsets[np.searchsorted(offsets, hi)])
            while hi < limit:
                gap = np.flatnonzero(_SPACE[data[hi : min(hi + 4096, limit)]])
                if len(gap):
                    hi += int(gap[0])
                    break
                hi = min(hi + 4096, limit)
        part = data[lo:hi]
        inside = ~_SPACE[part]
        fresh = np.zeros(len(part) + 1, bool)  # where a text begins
        fresh[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
        fresh[0] = fresh[-1] = True
        begins = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate([[False], inside[:-1]])))
        if len(begins):
            ends = np.flatnonzero(inside & (fresh[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
            lengths = ends - begins
            at = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
            values = _BYTES[part[inside]] * _PLACES[np.minimum(place, _SHORT - 1)]
            hashes = np.add.reduceat(values, at) + lengths.astype(np.uint64)
            for k in np.flatnonzero(lengths > _SHORT):
                hashes[k] = xxhash.xxh64_intdigest(part[begins[k] : ends[k]].tobytes().lower())
            found.append(mix(hashes))
            owners.append(np.searchsorted(offsets, begins + lo, "right") - 1)
        lo = hi
    words = np.concatenate([*found, np.zeros(0, np.uint64)])
    owner = np.concatenate([*owners, np.zeros(0, np.int64)])
    sizes = np.bincount(owner, minlength=len(raw)) + 1
    out = np.full(len(words) + len(raw), END_OF_TEXT, np.uint64)
    out[np.arange(len(words)) + owner] = words
    return out, sizes
