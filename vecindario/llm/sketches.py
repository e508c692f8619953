"""ProbMinHash sketches of weighted word shingles, and their exact probability Jaccard similarity.

A shingle's weight is how often the text has it. Each shingle sends arrivals of a Poisson process whose rate is its
weight, to random registers; a register keeps the shingle of its first arrival. Two texts' registers agree
with the probability Jaccard similarity of their shingles. Arrivals stop once they come later than every
register's, so the work is about the number of shingles plus m log m.
"""

from __future__ import annotations

import numpy as np

from .textarrays import mixed, shingles, word_hashes

REGISTERS = 120
WIDTH = 5
ID_BITS = 52
_ID = np.uint64((1 << ID_BITS) - 1)
_TURN = np.uint64(0xA0761D6478BD642F)


def bags(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, identity and weight of each distinct shingle of each text, sorted by owner and identity; 4,096 texts at most."""
    hashes, at = shingles(*word_hashes(data, offsets), width)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    keys = np.sort(owner << np.uint64(ID_BITS) | hashes >> np.uint64(64 - ID_BITS))
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    weights = np.diff(np.concatenate((starts, [len(keys)])))
    return (keys[starts] >> np.uint64(ID_BITS)).astype(np.int64), keys[starts] & _ID, weights.astype(float)


def sketches(owner: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers; rows of texts without a shingle stay 0."""
    earliest, registers = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    time, seed, turn = np.zeros(len(ids)), mixed(ids), np.uint64(0)
    while len(ids):
        turn += np.uint64(1)
        random = mixed(seed + np.multiply(turn, _TURN))
        time = time - np.log1p(-(random >> np.uint64(24)).astype(float) * 2.0 ** -40) / weights
        at = owner * m + ((random & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        registers[at[won]] = ids[won]
        last = earliest.reshape(n, m).max(axis=1)
        going = np.flatnonzero(time < last[owner])
        owner, ids, weights, time, seed = owner[going], ids[going], weights[going], time[going], seed[going]
    return registers.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of consecutive registers."""
    n, m = registers.shape
    total = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], n, axis=0)
    for column in range(m // bands):
        total = mixed(total * np.uint64(31) + registers[:, column::m // bands])
    return total.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two bags (sorted identities, weights): the sum over shared d of 1 / sum of max(a/a_d, b/b_d)."""
    ids = np.union1d(a[0], b[0])
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    x[np.searchsorted(ids, a[0])] = a[1]
    y[np.searchsorted(ids, b[0])] = b[1]
    shared = (x > 0) & (y > 0)
    if not shared.any():
        return 0.0
    ratio = x[shared] / y[shared]
    kinds, inverse = np.unique(ratio, return_inverse=True)
    totals = np.array([np.maximum(x, k * y).sum() for k in kinds])
    return float((x[shared] / totals[inverse]).sum())
