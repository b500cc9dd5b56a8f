"""Repeated strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Intervals of equal prefixes are extended backwards, one symbol a level and all of a level at once (after
Beller et al. 2013): the prefixes common to neighbours come out by increasing length, and the expansion
stops at the wanted one, so suffixes need to be sorted by that many symbols only. Intervals that hold one
owner alone can never give a string shared by two and are not extended. The sort doubles its symbols, so the
expansion begins at the longest intervals that come out of it on the way, and only these are sorted further.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def eights(text: np.ndarray) -> np.ndarray:
    """The first eight symbols of each suffix as one number."""
    key = np.concatenate([text, np.zeros(8, dtype=text.dtype)]).astype(U64)
    for i in (1, 2, 4):
        key = (key[:-i] << U64(8 * i)) | key[i:]
    return key[: len(text)]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, and where each range's begin among them."""
    size = hi - lo
    first = np.cumsum(size) - size
    return np.arange(first[-1] + size[-1]) + np.repeat(lo - first, size), first


class Suffixes:
    """Suffixes in the order of their first ``have`` symbols, 8 at first; rank is where the group of equal ones begins."""

    def __init__(self, text: np.ndarray):
        self.text, self.have = text, 8
        key = eights(text)
        self.order = np.argsort(key)
        own = key[self.order]
        self.lo = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        self.hi = np.append(self.lo[1:], len(text))
        self.rank = np.empty(len(text), dtype=np.int64)
        self.rank[self.order] = np.repeat(self.lo, self.hi - self.lo)

    def keep(self, good: np.ndarray) -> None:
        """Only these groups are sorted further."""
        self.lo, self.hi = self.lo[good], self.hi[good]

    def grow(self, step: int) -> None:
        """Sorts the groups by ``step`` more symbols, as many as they have at most."""
        at, _ = _spread(self.lo, self.hi)
        place = self.order[at]
        after = place + step
        # What a text lacks counts less than any symbol.
        if after.max() < len(self.rank):
            then = self.rank[after] + 1
        else:
            then = np.where(after < len(self.rank), self.rank[np.minimum(after, len(self.rank) - 1)] + 1, 0)
        bits, own = len(self.rank).bit_length(), len(place).bit_length()
        key = (self.rank[place] << bits) | then
        if 2 * bits + own < 64:  # numbers are sorted faster than their order is found
            key = np.sort((key << own) | np.arange(len(place)))
            by, key = key & ((1 << own) - 1), key >> own
        else:
            by = np.argsort(key)
            key = key[by]
        place = place[by]
        self.order[at] = place
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        size = np.diff(np.append(cut, len(key)))
        self.lo = at[cut]
        self.hi = self.lo + size
        self.rank[place] = np.repeat(self.lo, size)
        self.have += step


def bounded_suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of a text of small unsigned symbols in the order of their first ``length`` symbols (8 or more), by prefix doubling."""
    s = Suffixes(text)
    while s.have < length:
        s.keep(s.hi - s.lo > 1)
        if not len(s.lo):
            break
        s.grow(min(s.have, length - s.have))
    return s.order


def shared_intervals(text: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes, starts, ends) of the intervals whose suffixes share their first ``length`` symbols and have two owners or more.

    Symbol 0 separates texts, ends the last and is part of no string. Outside these intervals suffixes need not be sorted.
    """
    none = np.empty(0, dtype=np.int64)
    s = Suffixes(text)
    s.keep(s.hi - s.lo > 1)
    while 2 * s.have <= length and len(s.lo):
        s.grow(s.have)
        s.keep(s.hi - s.lo > 1)
    if len(s.lo):
        separators = np.concatenate([[0], np.cumsum(text == 0), np.full(s.have, len(text) + 1)])
        place = s.order[s.lo]
        s.keep(separators[place + s.have] == separators[place])
    if len(s.lo):
        # A suffix that is sorted no more stands beside others of its owner.
        at, first = _spread(s.lo, s.hi)
        held = owner[s.order[at]]
        s.keep(np.minimum.reduceat(held, first) < np.maximum.reduceat(held, first))
    if not len(s.lo):
        return s.order, none, none
    lo, hi, have = s.lo, s.hi, s.have
    if have < length:
        s.grow(length - have)
    order = s.order
    # The transform: what stands before each suffix; the backward step goes to the suffix that begins there.
    place = np.empty(len(text), dtype=np.int32)
    place[order] = np.arange(len(text), dtype=np.int32)
    before = text[order - 1]
    lf = np.where((before != 0) & (order > 0), place[order - 1], -1)
    symbol, held = text[order], owner[order]
    begins = np.concatenate([[True], symbol[1:] != symbol[:-1]])
    # The first place after i whose owner is another: an interval from i up to there has one owner.
    change = np.append(np.flatnonzero(held[1:] != held[:-1]) + 1, len(text))
    other = np.repeat(change, np.diff(np.concatenate([[0], change])))
    at, _ = _spread(lo, hi)
    own = np.repeat(np.arange(len(lo), dtype=np.int32), hi - lo)
    label = np.full(len(text), -1, dtype=np.int32)
    for _ in range(length - have):
        # Members of all intervals in the order of suffixes, and which interval they are of.
        to = lf[at]
        real = to >= 0
        label[to[real]] = own[real]
        at = np.flatnonzero(label >= 0)
        if not len(at):
            return order, none, none
        own = label[at]
        label[at] = -1
        new = begins[at]
        new[1:] |= (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
        new[0] = True
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        lo = at[first]
        hi = lo + size
        several = other[lo] < hi
        at = at[np.repeat(several, size)]
        lo, hi = lo[several], hi[several]
        if not len(lo):
            return order, none, none
        own = np.repeat(np.arange(len(lo), dtype=np.int32), hi - lo)
    return order, lo, hi
