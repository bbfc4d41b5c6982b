"""Vectorised 64-bit hashes of many byte runs inside one buffer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_S = np.uint64(32)
PAD = 16


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M3
    h = h ^ (h >> np.uint64(29))
    h = h * _M2
    return h ^ (h >> _S)


def buffer(parts: Sequence[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Parts with a gap after each, zero-padded; and each part's start (one more at the end)."""
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + len(gap)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    joined = gap.join([*parts, b"\0" * PAD]) if parts else b"\0" * PAD
    return np.frombuffer(joined, dtype=np.uint8), starts


def hash_runs(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of buf[s:s+n] for each run; eight bytes a step, so short runs take one or two."""
    words = np.ndarray((max(len(buf) - 7, 0),), dtype="<u8", buffer=buf.data, strides=(1,))
    h = lengths.astype(np.uint64) * _M1 + np.uint64(seed)
    alive, at, left = None, starts, lengths
    while True:
        w = words[at] & _MASK[np.minimum(left, 8)]
        if alive is None:
            h = (h ^ mix(w + _M1)) * _M2
            h ^= h >> _S
        else:
            g = (h[alive] ^ mix(w + _M1)) * _M2
            h[alive] = g ^ (g >> _S)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mix(h)
        alive = more if alive is None else alive[more]
        at, left = at[more] + 8, left[more] - 8


#: Bytes that end a word in the shingle contracts: space and 09-0D. Fixed value.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: Sequence[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words start (one more at the end).

    A-Z are lower-cased; words are runs of anything but space and 09-0D.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf, text_at = buffer(parts, b" ")
    if lower:
        buf = _LOWER[buf]
    inside = ~_IS_SPACE[buf]
    inside[text_at[-1] :] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[0::2], edge[1::2]
    return hash_runs(buf, starts, stops - starts), np.searchsorted(starts, text_at)
