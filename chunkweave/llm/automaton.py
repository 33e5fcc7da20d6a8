"""Minimal acyclic transducer over byte strings, in one flat file that readers map into memory.

Words are added in sorted order; equal suffixes share their states. An arc carries the number of words
that sort before the ones behind it in its state, so the sum along a path is the word's rank, which
indexes its output. Outputs are integer sequences.
"""

from __future__ import annotations

import mmap

import numpy as np

_HEAD = 6


def build(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """The file's content. ``words`` are sorted and distinct; ``outputs`` belong to them."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...))
    counts: list[int] = []  # words accepted from a state on

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
            counts.append(int(node[0]) + sum(counts[target] for _, target in node[1]))
        return known[key]

    path = [[False, []]]  # open states along the last word
    previous = b""
    for word in words:
        if word <= previous and (previous or len(path) > 1):
            raise ValueError("words must be sorted and distinct")
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        for depth in range(len(previous), shared, -1):
            target = frozen(path.pop())
            path[-1][1].append((previous[depth - 1], target))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        previous = word
    for depth in range(len(previous), 0, -1):
        target = frozen(path.pop())
        path[-1][1].append((previous[depth - 1], target))
    root = frozen(path.pop())

    keys, targets, before = [], [], []
    for number, (final, arcs) in enumerate(states):
        passed = int(final)
        for label, target in arcs:
            keys.append(number << 8 | label)
            targets.append(target)
            before.append(passed)
            passed += counts[target]
    offsets = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(o) for o in outputs], out=offsets[1:])
    flat = np.array([x for o in outputs for x in o], dtype=np.int64)
    final = np.array([state[0] for state in states], dtype=np.int64)
    head = np.array([root, len(keys), len(states), len(words), len(flat), 0], dtype=np.int64)
    body = [head, np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int64), np.array(before, dtype=np.int64), final, offsets, flat]
    return b"".join(part.tobytes() for part in body)


class Transducer:
    """Reads a built file through a memory map, so processes of one machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), dtype=np.int64)
        self.root, arcs, states, words, flat, _ = (int(x) for x in data[:_HEAD])
        sizes = [arcs, arcs, arcs, states, words + 1, flat]
        parts = np.split(data[_HEAD:], np.cumsum(sizes)[:-1])
        self.keys, self.targets, self.before, self.final, self.offsets, self.flat = parts
        self.states = states

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word in the lexicon, -1 for words outside; all words take a step at once."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        state, rank = np.full(len(words), self.root), np.zeros(len(words), dtype=np.int64)
        alive = np.ones(len(words), dtype=bool)
        for depth in range(int(lengths.max(initial=0))):
            at = np.flatnonzero(alive & (lengths > depth))
            if not len(at) or not len(self.keys):
                break
            wanted = state[at] << 8 | data[starts[at] + depth]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[arc] == wanted
            alive[at[~hit]] = False
            state[at[hit]] = self.targets[arc[hit]]
            rank[at[hit]] += self.before[arc[hit]]
        if not len(self.keys):
            alive &= lengths == 0
        found = alive & (self.final[state] == 1)
        return np.where(found, rank, -1)

    def output(self, rank: int) -> np.ndarray:
        return self.flat[self.offsets[rank] : self.offsets[rank + 1]]
