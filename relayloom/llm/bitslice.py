"""Hamming neighbours among groups of fingerprints, on vertical bit planes.

Lane i of plane b holds bit b of fingerprint i, 64 lanes to a word. One query bit XOR one
plane word gives 64 differences at once; eight such words run through carry-save adders
into bitwise counters, so 64 distances grow together. After every eight planes a bitwise
comparison with the radius abandons the blocks in which all lanes are beyond it.
"""

from __future__ import annotations

import numpy as np

#: (query, block) pairs compared at once.
TILE = 1 << 17
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three one-bit words."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (low bit first) exceeds radius."""
    over, equal = np.zeros_like(counter[0]), np.full_like(counter[0], FULL)
    if radius >> len(counter):
        return over
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            over |= equal & counter[k]
            equal &= ~counter[k]
    return over


def _mask(words: np.ndarray, b: int) -> np.ndarray:
    """All ones where bit b is set."""
    return np.uint64(0) - (words[:, b // 64] >> np.uint64(b % 64) & np.uint64(1))


def _near(planes: np.ndarray, words: np.ndarray, q: np.ndarray, block: np.ndarray, valid: np.ndarray, radius: int):
    """The (query, block, mask of lanes within radius) that remain."""
    low = [np.zeros(len(q), np.uint64) for _ in range(3)]
    high: list[np.ndarray] = []
    for first in range(0, len(planes), 8):
        d = [planes[b][block] ^ _mask(words, b)[q] for b in range(first, first + 8)]
        ones, twos_a = _add(low[0], d[0], d[1])
        ones, twos_b = _add(ones, d[2], d[3])
        twos, fours_a = _add(low[1], twos_a, twos_b)
        ones, twos_a = _add(ones, d[4], d[5])
        ones, twos_b = _add(ones, d[6], d[7])
        twos, fours_b = _add(twos, twos_a, twos_b)
        fours, carry = _add(low[2], fours_a, fours_b)
        low = [ones, twos, fours]
        for k in range(len(high)):
            high[k], carry = high[k] ^ carry, high[k] & carry
        if (first // 8 + 1).bit_length() > len(high):
            high.append(carry)
        valid = valid & ~_beyond(low + high, radius)
        keep = valid != 0
        left = int(np.count_nonzero(keep))
        if left < 0.8 * len(keep):
            q, block, valid = q[keep], block[keep], valid[keep]
            low, high = [x[keep] for x in low], [x[keep] for x in high]
            if not left:
                break
    return q, block, valid


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each link the same, smallest, label."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (jump := label[label]).tobytes() != label.tobytes():
            label[:] = jump


def forest(words: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that connect, within each group, just what pairs within `radius` connect.

    words: fingerprints, (n, 64-bit words); group: their groups' numbers, ascending. Groups
    stand side by side in the lanes, and a mask keeps a query to its own. A block whose lanes
    all have the query's label already is skipped, so a dense group of n costs little more than n,
    and at most n - 1 links come out of it.
    """
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(words):
        return nothing
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    rows = np.flatnonzero(np.repeat(size > 1, size))  # a row alone has no link
    if not len(rows):
        return nothing
    size = size[size > 1]
    words, n = words[rows], len(rows)
    group_end = np.repeat(np.cumsum(size), size)
    total = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    lanes = np.zeros((bits.shape[1], total * 64), np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)
    del lanes
    del bits

    label, own = np.arange(n), np.arange(n) // 64
    count = (group_end - 1) // 64 - own + 1
    ends = np.cumsum(count)
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + TILE, "right")))
        for q, block in _tiles(at, to, count, own):
            valid = np.where(own[q] == block, _above(q % 64), FULL) & _below(group_end[q] - block * 64)
            alike = _uniform(label, total)
            keep = (valid != 0) & (alike[block] != label[q])
            q, block, mask = _near(planes, words, q[keep], block[keep], valid[keep], radius)
            for k in range(0, len(q), 1 << 14):
                hit, bit = np.nonzero(np.unpackbits(mask[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                if len(hit):
                    _join(label, q[k + hit], block[k + hit] * 64 + bit)
        at = to
    linked = np.flatnonzero(label != np.arange(n))
    return rows[label[linked]], rows[linked]


def _above(lane: np.ndarray) -> np.ndarray:
    """Masks of the lanes after each lane."""
    return (FULL << lane.astype(np.uint64)) & ~(np.uint64(1) << lane.astype(np.uint64))


def _below(count: np.ndarray) -> np.ndarray:
    """Masks of the first count lanes, all from 64 on."""
    return np.where(count >= 64, FULL, (np.uint64(1) << np.clip(count, 0, 63).astype(np.uint64)) - np.uint64(1))


def _tiles(at: int, to: int, count: np.ndarray, own: np.ndarray):
    """(query, block) pairs of the queries at..to, each with the blocks from its own on."""
    c = count[at:to]
    for first in range(0, int(c.sum()) if to - at == 1 else 1, TILE):
        if to - at == 1:  # one query against more blocks than a tile holds
            block = np.arange(first, min(first + TILE, int(c[0]))) + own[at]
            yield np.full(len(block), at), block
        else:
            q = np.repeat(np.arange(at, to), c)
            yield q, own[q] + np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)


def _uniform(label: np.ndarray, total: int) -> np.ndarray:
    """The label that all rows of a block have; -1 where they differ."""
    padded = np.full(total * 64, label[-1])
    padded[: len(label)] = label
    lanes = padded.reshape(total, 64)
    return np.where((lanes == lanes[:, :1]).all(1), lanes[:, 0], -1)
