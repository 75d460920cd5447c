"""Burrows-Wheeler transforms of string collections: shards' own, and their merge by iterative interleave refinement.

A collection holds strings with a terminator each, smaller than every byte and ordered by string. The merge knows of each
shard only its transform, here over blocks of Q symbols, so that one step goes Q symbols deep. It starts with the shards'
places one after the other and refines this interleave: walking the places in order, each one's preceding symbols are
read from its shard's transform, and the place that they lead to (by the transform alone: the k-th occurrence of a block
leads to its k-th place) goes to the end of that block's bucket. After h steps the interleave orders the rotations by
their first Q h symbols, and places that no step has told apart have a common prefix of that length: they are the
repeated intervals of that depth. A place that stands alone stays alone, and so do those it leads to: they leave the walk.
No suffix of one shard is compared with another's, and none is sorted again.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a step.
Q = 5


class Collection:
    """Strings one after another, each followed by its terminator."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) + 1 for s in strings], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8) if strings else np.zeros(0, np.uint8)
        self.symbols = raw.astype(np.int64) + 1
        self.symbols[self.begin[1:] - 1] = 0
        self.string = np.repeat(np.arange(len(strings)), self.sizes)

    def shifted(self, by: int) -> np.ndarray:
        """Places of the symbols `by` further on, around the end of their own strings."""
        at = np.arange(len(self.symbols)) - self.begin[self.string] + by
        return self.begin[self.string] + at % self.sizes[self.string]


def suffix_order(c: Collection) -> np.ndarray:
    """Places of all suffixes in order, by prefix doubling on ranks; equal suffixes go by string."""
    n = len(c.symbols)
    at = np.arange(n)
    ends = c.begin[1:][c.string]
    key = np.zeros(n, np.uint64)
    depth = 7  # symbols of nine bits in a word
    for j in range(depth):
        ok = at + j < ends
        key = (key << np.uint64(9)) | np.where(ok, c.symbols[np.minimum(at + j, n - 1)], 0).astype(np.uint64)
    longest = int(c.sizes.max())
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        if depth >= longest or int(rank.max()) == n:
            break
        further = np.where(at + depth < ends, rank[np.minimum(at + depth, n - 1)], np.uint64(0))
        key = (rank << np.uint64(32)) | further
        depth *= 2
    return np.argsort((rank << np.uint64(32)) | at.astype(np.uint64))


def codes_of(shards: list[Collection]) -> list[np.ndarray]:
    """For every place the number of the Q symbols that start there, in their order over all shards; those with a terminator
    are told apart by string. 16-bit numbers, for which numpy's stable sort is a counting sort, if they suffice."""
    keys, base = [], 1
    for c in shards:
        key, own = np.zeros(len(c.symbols), np.int64), np.zeros(len(c.symbols), np.int64)
        for j in range(Q):
            symbol = np.where(own > 0, 0, c.symbols[c.shifted(j)])
            key = (key << 9) | symbol
            own = np.where((symbol == 0) & (own == 0), base + c.string, own)
        keys.append((key << 18) | own)
        base += len(c.sizes)
    if base >= 1 << 18:
        raise ValueError("too many strings for one merge")
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    codes = inverse.astype(np.uint16 if len(unique) <= 1 << 16 else np.int64)
    return np.split(codes, np.cumsum([len(k) for k in keys])[:-1])


def transform(c: Collection, order: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The shard's transform: for each place of its order, the code of the Q symbols before the suffix."""
    return codes[c.shifted(-Q)][order]


def merge(transforms: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, block) of the merged order after `steps` refinements, for places that aren't alone; blocks have Q * steps
    symbols in common. Places count through the shards' orders, one after the other."""
    leads = []
    for t in transforms:
        lead = np.empty(len(t), np.int64)
        lead[np.argsort(t, kind="stable")] = np.arange(len(t))
        leads.append(lead + sum(map(len, leads)))
    before, lead = np.concatenate(transforms), np.concatenate(leads)
    place, block = np.arange(len(before)), np.zeros(len(before), np.int32)
    for _ in range(steps):
        symbols = before[place]
        order = np.argsort(symbols, kind="stable")
        symbols, block, place = symbols[order], block[order], lead[place[order]]
        edge = np.empty(len(place) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(symbols[1:], symbols[:-1], out=edge[1:-1])
        edge[1:-1] |= block[1:] != block[:-1]
        kept = ~(edge[:-1] & edge[1:])
        block, place = np.cumsum(edge[:-1], dtype=np.int32)[kept], place[kept]
        if not len(place):
            break
    return place, block


def repeated_starts(strings: list[bytes], weights: np.ndarray, length: int, shards: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every start of a `length`-byte substring that occurs at least twice, a string of weight w
    counting w times. Sorted by string and offset. length must be a multiple of Q."""
    if length % Q:
        raise ValueError(f"length must be a multiple of {Q}")
    shards = max(1, min(shards, len(strings)))
    cut = [len(strings) * k // shards for k in range(shards + 1)]
    parts = [Collection(strings[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    orders = [suffix_order(c) for c in parts]
    codes = codes_of(parts)
    place, block = merge([transform(c, o, k) for c, o, k in zip(parts, orders, codes, strict=True)], length // Q)
    of_string = np.concatenate([first + c.string[o] for first, c, o in zip(cut, parts, orders, strict=False)])
    of_offset = np.concatenate([o - c.begin[c.string[o]] for c, o in zip(parts, orders, strict=True)])
    string, offset = of_string[place], of_offset[place]
    sizes = np.array([len(x) for x in strings], np.int64)
    whole = offset + length <= sizes[string]
    total = np.bincount(block[whole], weights[string[whole]], int(block.max(initial=0)) + 1)
    alone = np.flatnonzero(weights >= 2)  # a string that occurs twice is repeated everywhere, also where it is alone
    count = np.maximum(sizes[alone] - length + 1, 0)
    more = np.repeat(alone, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = whole & (total[block] >= 2)
    string, offset = np.concatenate([string[found], more[0]]), np.concatenate([offset[found], more[1]])
    both = np.unique(string << 32 | offset)
    return both >> 32, both & ((1 << 32) - 1)
