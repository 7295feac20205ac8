"""Static 16-bit binary-fuse filters (Graf and Lemire, 2022), built and probed with numpy.

A filter answers "surely absent" or "maybe present" for 64-bit keys at about 18 bits a key and
a false-positive rate of 2^-16; it is built once from distinct keys and never changed.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QIIII")
_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + _U(seed)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """Three slots for each hash, in three consecutive segments."""
    first = ((h >> _U(32)) * _U(count * segment)) >> _U(32)
    mask = _U(segment - 1)
    second = (first + _U(segment)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(0xFFFF)).astype(np.uint16)


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (key numbers, the slot that only this key used then); None if some keys are left."""
    n = slots.shape[1]
    every = np.arange(n, dtype=np.int64)
    count, xored = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for s in slots:
        np.add.at(count, s, 1)
        np.bitwise_xor.at(xored, s, every)
    rounds, left = [], n
    alone = np.flatnonzero(count == 1)
    while left and len(alone):
        keys, at = np.unique(xored[alone], return_index=True)
        rounds.append((keys, alone[at]))
        left -= len(keys)
        touched = slots[:, keys]
        for s in touched:
            np.add.at(count, s, -1)
            np.bitwise_xor.at(xored, s, keys)
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> bytes:
    """A filter over ``keys`` (uint64, repeats allowed)."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return _HEAD.pack(0, 0, 0, 0, 0)
    segment = 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for attempt in range(200):
        count = max(1, -(-int(n * factor * (1 + 0.01 * attempt)) // segment) - 2)
        size = (count + 2) * segment
        seed = (attempt + 1) * 0x9E3779B97F4A7C15 % 2**64
        h = _mix(keys, seed)
        slots = _slots(h, segment, count)
        rounds = _peel(slots, size)
        if rounds is None:
            continue
        table, prints = np.zeros(size, np.uint16), _print(h)
        for k, slot in reversed(rounds):
            others = table[slots[0, k]] ^ table[slots[1, k]] ^ table[slots[2, k]] ^ table[slot]
            table[slot] = prints[k] ^ others
        return _HEAD.pack(seed, segment, count, size, n) + table.tobytes()
    raise RuntimeError("no seed peels these keys")


def maybe_contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True where the key may be among those the filter was built from."""
    seed, segment, count, _, n = _HEAD.unpack_from(blob)
    keys = np.asarray(keys, np.uint64)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint16, offset=_HEAD.size)
    h = _mix(keys, seed)
    s = _slots(h, segment, count)
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == _print(h)
