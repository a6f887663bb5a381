"""Static binary-fuse filters: about nine bits a key, no false negatives, 1 in 256 strangers let through.

Each key owns three slots in neighbouring segments of a byte array whose exclusive or is the key's fingerprint.
Building peels off keys that own a slot alone, whole fronts at a time, and fills the slots in reverse order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tidemark.llm.words import mix

TRIES = 64


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    length: int
    segments: int
    slots: bytes

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Which 64-bit ``keys`` may be in the filter; every key it was built from is."""
        if not self.slots or not len(keys):
            return np.zeros(len(keys), bool)
        at, mark = _places(keys.astype(np.uint64), self.seed, self.length, self.segments)
        held = np.frombuffer(self.slots, np.uint8)
        return (held[at[0]] ^ held[at[1]] ^ held[at[2]]) == mark


def _layout(n: int) -> tuple[int, int]:
    """Segment length and number of segments for ``n`` keys, by the published sizing rule for three slots."""
    if n < 2:
        return 4, 1
    length = min(1 << math.floor(math.log(n) / math.log(3.33) + 2.25), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(1, math.ceil(n * factor / length) - 2)


def _places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key (3 x n) and its fingerprint byte."""
    h = mix(keys ^ np.uint64(seed))
    g = mix(h ^ np.uint64(0x9E3779B97F4A7C15))
    first = (((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)).astype(np.int64)
    inner = np.uint64(length - 1)
    second = (first + length) ^ (g & inner).astype(np.int64)
    third = (first + 2 * length) ^ ((g >> np.uint64(20)) & inner).astype(np.int64)
    return np.stack([first, second, third]), (h & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> FuseFilter:
    """A filter of 64-bit ``keys``; repeated keys count once, no keys give a filter that holds nothing."""
    keys = np.unique(keys.astype(np.uint64))
    if not len(keys):
        return FuseFilter(0, 0, 0, b"")
    length, segments = _layout(len(keys))
    for seed in range(1, TRIES):
        at, mark = _places(keys, seed, length, segments)
        order = _peel(at, (segments + 2) * length)
        if order is not None:
            slots = np.zeros((segments + 2) * length, np.uint8)
            for owner, slot in reversed(order):
                slots[slot] = mark[owner] ^ slots[at[0, owner]] ^ slots[at[1, owner]] ^ slots[at[2, owner]]
            return FuseFilter(seed, length, segments, slots.tobytes())
    raise RuntimeError(f"no filter of {len(keys)} keys in {TRIES} tries")


def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Fronts of (keys, the slot each owns alone), or None if some keys cannot be peeled off."""
    n = at.shape[1]
    count = np.bincount(at.ravel(), minlength=size)
    # The sum of the keys on a slot names the key once it is alone there.
    names = np.bincount(at.ravel(), weights=np.tile(np.arange(n, dtype=float), 3), minlength=size).astype(np.int64)
    alone, order, done = np.flatnonzero(count == 1), [], 0
    while len(alone):
        owner, first = np.unique(names[alone], return_index=True)
        order.append((owner, alone[first]))
        done += len(owner)
        touched = at[:, owner].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(names, touched, np.tile(owner, 3))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return order if done == n else None
