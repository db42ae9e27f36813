"""Words and word shingles of whole Arrow columns as 64-bit hashes, without a Python object for each word.

A word is a run of bytes other than ASCII white space, with A-Z in lower case. A word of at most SHORT bytes is hashed as a
polynomial over a random number for each byte value; longer ones are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHORT, PART = 512, 1 << 17

_U = np.uint64
#: Odd factors, one for each word of a shingle.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], _U)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, _U)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_POWER = np.cumprod(np.full(SHORT, 0xD6E8FEB86659FD93, _U))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _part(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in `raw`, and where they start; no word reaches over one of `cuts`."""
    word = ~_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inside = cuts[(cuts > 0) & (cuts < len(raw))]
    first[inside] = word[inside]
    last[inside - 1] = word[inside - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return np.zeros(0, _U), starts
    letters = ends + 1 - starts
    place = np.arange(starts[0], len(raw), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(raw))))
    value = _BYTE.take(raw[starts[0] :])
    value *= _POWER.take(np.minimum(place, SHORT - 1, out=place))
    total = np.cumsum(value)
    h = mixed(total[ends - starts[0]] - total[starts - starts[0]] + value[starts - starts[0]] + letters.astype(_U) * MIX[0])
    for k in np.flatnonzero(letters > SHORT):
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k] + 1].tobytes().lower())
    return h, starts


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts end to end, and where each text begins in them (one number more than texts)."""
    column = column.cast(pa.large_binary())
    _, ends, values = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if column.null_count:  # a null may stand over bytes
        return word_hashes(column.fill_null(b""))
    raw = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    hashes, starts, at = [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + PART)
        if stop < len(raw):  # at a white space or where a text begins, if there is one
            back = np.flatnonzero(_SPACE[raw[at:stop]])
            text = ends[np.searchsorted(ends, stop, "right") - 1]
            cut = max(at + int(back[-1]) + 1 if len(back) else at, int(text))
            if cut <= at:
                ahead = stop
                while ahead < len(raw) and not len(found := np.flatnonzero(_SPACE[raw[ahead : ahead + PART]])):
                    ahead += PART
                cut = min(len(raw) if ahead >= len(raw) else ahead + int(found[0]) + 1, int(ends[np.searchsorted(ends, at, "right")]))
            stop = cut
        lo, hi = np.searchsorted(ends, at), np.searchsorted(ends, stop)
        h, s = _part(raw[at:stop], ends[lo:hi] - at)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for i in range(k):
        out += (hashes[i : n + i] ^ _U(i)) * MIX[i]
    return mixed(out + _U(k))


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted set of its runs of k words; with fewer words the whole sequence as one; without words none."""
    h, ends = word_hashes(column)
    full = runs_of(h, k)
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        own = full[a : b - k + 1] if b - a >= k else runs_of(h[a:b], b - a) if b > a else h[:0]
        own = np.sort(own)
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own
