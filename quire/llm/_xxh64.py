"""XXH64 of many byte spans at once: spans of one length share a sequence of numpy operations."""

from __future__ import annotations

import numpy as np

# Fixed values of the published XXH64 algorithm.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def _one_length(eight, four, one, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    seed = np.uint64(seed)
    done = 0
    if n >= 32:
        v = [np.full(len(at), x) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while done + 32 <= n:
            v = [_round(x, eight[at + (done + 8 * i)]) for i, x in enumerate(v)]
            done += 32
        h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * P1 + P4
    else:
        h = np.full(len(at), seed + P5)
    h = h + np.uint64(n)
    while done + 8 <= n:
        h = _rot(h ^ _round(np.uint64(0), eight[at + done]), 27) * P1 + P4
        done += 8
    if done + 4 <= n:
        h = _rot(h ^ (four[at + done].astype(np.uint64) * P1), 23) * P2 + P3
        done += 4
    while done < n:
        h = _rot(h ^ (one[at + done].astype(np.uint64) * P5), 11) * P1
        done += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:end] for each span."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(pad) - 7,), "<u8", pad, strides=(1,))
    four = np.ndarray((len(pad) - 3,), "<u4", pad, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    with np.errstate(over="ignore"):
        for n, at in zip(sizes, np.split(order, first[1:]), strict=True):
            out[at] = _one_length(eight, four, pad, starts[at], int(n), seed)
    return out
