"""XXH64 of many short byte runs at a time, in numpy (algorithm: public xxHash specification)."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of the xxHash specification.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

#: Longer runs are few; the library takes them one by one.
LONGEST = 160


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _same_length(lanes8: np.ndarray, lanes4: np.ndarray, data: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    s = np.uint64(seed)
    k = 0
    with np.errstate(over="ignore"):
        if n >= 32:
            v = [np.full(len(at), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            while k + 32 <= n:
                for i in range(4):
                    v[i] = _round(v[i], lanes8[at + (k + 8 * i)])
                k += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros_like(x), x)) * P1 + P4
        else:
            h = np.full(len(at), s + P5, np.uint64)
        h = h + np.uint64(n)
        while k + 8 <= n:
            h = _rotl(h ^ _round(np.zeros_like(h), lanes8[at + k]), 27) * P1 + P4
            k += 8
        if k + 4 <= n:
            h = _rotl(h ^ (lanes4[at + k].astype(np.uint64) * P1), 23) * P2 + P3
            k += 4
        while k < n:
            h = _rotl(h ^ (data[at + k].astype(np.uint64) * P5), 11) * P1
            k += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def hash_runs(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[starts[i] : starts[i] + lengths[i]] for every i, unsigned."""
    out = np.empty(len(starts), np.uint64)
    padded = data + bytes(8)
    bytes_ = np.frombuffer(padded, np.uint8)
    lanes8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lanes4 = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    order = np.argsort(np.minimum(lengths, LONGEST + 1).astype(np.uint8), kind="stable")
    found, first = np.unique(np.minimum(lengths, LONGEST + 1)[order], return_index=True)
    for n, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        at = order[a:b]
        if n > LONGEST:
            for i in at.tolist():
                out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]], seed)
        else:
            out[at] = _same_length(lanes8, lanes4, bytes_, starts[at], n, seed)
    return out
