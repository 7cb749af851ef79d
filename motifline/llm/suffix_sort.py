"""Deep-shallow suffix sorting of many small groups at once.

Shallow: a multikey sort on eight-byte symbols; every group of every level is partitioned in the same array pass, and
only members that still tie go on, down to ``shallow`` symbols. Deep: what still ties shares a long prefix and is
ordered by blind tries. A trie's node holds a leader; the other members branch off at their common-prefix length with
it, on one byte. Only that length and byte are compared; members that branch off at the same place form the child.
Suffixes that follow each other in the data and have leaders at one distance inherit the length (less one for each byte
on), so a stretch of them is compared with its leaders' bytes once, not once for each suffix.
"""

from __future__ import annotations

import numpy as np


class Symbols:
    """Eight bytes from any position as one big-endian word; past ``limit`` bytes of a suffix, zero bits."""

    def __init__(self, data: np.ndarray, limit: int):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(data) + 8, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.limit, self.count = limit, -(-limit // 8)
        rest = limit - 8 * (self.count - 1)
        self.last = np.uint64((1 << 64) - (1 << (64 - 8 * rest)))

    def at(self, position: np.ndarray, k: int) -> np.ndarray:
        out = self.words[position + 8 * k]
        return out & self.last if k == self.count - 1 else out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys changes."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def deep_shallow(data: np.ndarray, position: np.ndarray, group: np.ndarray, limit: int, shallow: int = 4):
    """Order the suffixes at ``position`` by group and their first ``limit`` bytes (each must have as many).

    Returns (order, same): a permutation, and whether each suffix in that order has the same group and first
    ``limit`` bytes as the one before it.
    """
    if not len(position):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    symbols = Symbols(data, limit)
    order = np.argsort(group, kind="stable")
    new = _starts(group[order])  # a part begins
    for k in range(min(shallow, symbols.count)):
        part, tied = _tied(new)
        if not len(tied):
            return order, ~new
        own = order[tied]
        word = symbols.at(position[own], k)
        first = np.flatnonzero(_starts(part))
        size = np.diff(np.r_[first, len(part)])
        two = first[size == 2]  # most parts: a comparison sorts them
        a, b = word[two], word[two + 1]
        out = np.arange(len(part))
        out[two] += b < a
        out[two + 1] -= b < a
        more = np.flatnonzero(np.repeat(size > 2, size))
        out[more] = more[np.lexsort((word[more], part[more]))]
        order[tied] = own[out]
        new[tied] = _starts(part, word[out])
    if symbols.count > shallow:
        _blind_tries(data, symbols, position, order, new, shallow)
    return order, ~new


def _tied(new: np.ndarray):
    """Part numbers and places of members of parts of two or more."""
    part = np.cumsum(new) - 1
    many = np.bincount(part)[part] > 1
    tied = np.flatnonzero(many)
    return part[tied], tied


def _inherited(data: np.ndarray, p: np.ndarray, q: np.ndarray, limit: int, most: int = 8):
    """Common-prefix lengths of the suffixes at ``p`` and ``q``, and for which they are known.

    Suffixes of one stretch have their leaders at one distance; stretches of more than ``most`` bytes a suffix are left out.
    ``data`` has less than 2 GB.
    """
    by = np.argsort(p, kind="stable")
    at, far = p[by], (q - p)[by]
    first = np.flatnonzero(np.r_[True, (far[1:] != far[:-1]) | (at[1:] - at[:-1] > limit)])
    size = np.diff(np.r_[first, len(at)])
    span = at[first + size - 1] - at[first] + limit
    dense = span <= most * size
    common, known = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
    if not dense.any():
        return common, known
    base = np.cumsum(span[dense]) - span[dense]  # a stretch's place among all the bytes compared
    place = np.arange(span[dense].sum(), dtype=np.int32)
    place += np.repeat((at[first[dense]] - base).astype(np.int32), span[dense])
    mine = data[place]
    place += np.repeat(far[first[dense]].astype(np.int32), span[dense])
    differ = np.flatnonzero(mine != data[place])
    member = np.flatnonzero(np.repeat(dense, size))
    own = at[member] + np.repeat(base - at[first[dense]], size[dense])
    after = np.r_[differ, len(mine)][np.searchsorted(differ, own)]
    common[by[member]] = np.minimum(after - own, limit)
    known[by[member]] = True
    return common, known


def _blind_tries(data: np.ndarray, symbols: Symbols, position: np.ndarray, order: np.ndarray, new: np.ndarray, shallow: int) -> None:
    """Order parts that share their first ``shallow`` symbols; changes ``order`` and ``new``."""
    part, place = _tied(new)
    known = np.full(len(place), shallow * 8)  # bytes that a part's members share
    while len(place):
        own = order[place]
        lead_at = np.flatnonzero(_starts(part))
        leader = own[np.repeat(lead_at, np.diff(np.r_[lead_at, len(part)]))]
        common, done = _inherited(data, position[own], position[leader], symbols.limit)
        left = np.flatnonzero(~done)
        common[left] = symbols.limit
        for k in range(int(known[left].min(initial=symbols.limit)) // 8, symbols.count):
            if not len(left):
                break
            a, b = symbols.at(position[own[left]], k), symbols.at(position[leader[left]], k)
            off = np.flatnonzero(a != b)
            if len(off):
                x = a[off] ^ b[off]
                zeros = np.zeros(len(x), np.int64)
                for width in (32, 16, 8):  # leading zero bytes
                    high = x < (np.uint64(1) << np.uint64(64 - width))
                    zeros += high * (width // 8)
                    x = np.where(high, x << np.uint64(width), x)
                common[left[off]] = 8 * k + zeros
                left = np.delete(left, off)
        same = common >= symbols.limit
        branch = np.zeros(len(own), np.int64)
        out = np.flatnonzero(~same)
        at, shift = common[out] // 8, (56 - 8 * (common[out] % 8)).astype(np.uint64)
        mine = symbols.words[position[own[out]] + 8 * at] >> shift & np.uint64(255)
        lead = symbols.words[position[leader[out]] + 8 * at] >> shift & np.uint64(255)
        branch[out] = mine.astype(np.int64)
        # in order: lesser branches, the earliest first; the leader's own string; greater branches, the latest first
        turn = np.zeros(len(own), np.int64)
        turn[out] = np.where(mine < lead, common[out] - symbols.limit, symbols.limit - common[out])
        by = np.lexsort((branch, turn, part))
        order[place] = own[by]
        part, turn, branch, common = part[by], turn[by], branch[by], common[by]
        fresh = _starts(part, turn, branch)
        new[place] = fresh | new[place]
        # children of two or more that are not the leader's own string
        child = np.cumsum(fresh) - 1
        go = (np.bincount(child)[child] > 1) & (turn != 0)
        place, part, known = place[go], child[go], common[go] + 1
