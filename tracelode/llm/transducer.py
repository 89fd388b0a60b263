"""A minimal acyclic transducer that maps words to id sequences, as flat arrays in one memory-mapped file.

Words enter in byte order; each finished suffix is replaced by an equal state already known, so that the
automaton stays minimal while it grows. Every arc carries the number of words that precede its branch; the sum
along a word's path is the word's place in the lexicon, and that indexes the output ids. Equal suffixes are thus
shared although their outputs differ.
"""

from __future__ import annotations

import os

import numpy as np

_MAGIC = 0x5452414C4F4445
_PARTS = (("arcs", np.int64), ("target", np.int32), ("weight", np.int32), ("final", np.int8), ("offset", np.int32), ("ids", np.int32))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file image of a transducer for the entries (non-empty words)."""
    words = sorted(w for w in entries if w)
    known: dict[tuple, int] = {}
    arcs_of: list[tuple] = []  # of each finished state: (final, ((byte, state), ...))
    path: list[list] = [[False, []]]  # open states of the last word: [final, [(byte, state), ...]]

    def close(down_to: int, last: bytes) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            state = known.get(key)
            if state is None:
                known[key] = state = len(arcs_of)
                arcs_of.append(key)
            path[-1][1].append((last[depth - 1], state))

    last = b""
    for w in words:
        shared = 0
        while shared < min(len(w), len(last)) and w[shared] == last[shared]:
            shared += 1
        close(shared, last)
        path.extend([False, []] for _ in range(len(w) - shared))
        path[-1][0] = True
        last = w
    close(0, last)
    arcs_of.append((path[0][0], tuple(path[0][1])))
    below = np.zeros(len(arcs_of), np.int64)  # words that end in or below a state; targets come before sources
    keys, target, weight = [], [], []
    for s, (final, arcs) in enumerate(arcs_of):
        n = int(final)
        for byte, to in arcs:
            keys.append(s << 8 | byte)
            target.append(to)
            weight.append(n)
            n += int(below[to])
        below[s] = n
    out = [entries[w] for w in words]
    parts = {
        "arcs": keys, "target": target, "weight": weight, "final": [f for f, _ in arcs_of],
        "offset": np.concatenate(([0], np.cumsum([len(x) for x in out], dtype=np.int64))), "ids": [i for x in out for i in x],
    }
    arrays = [np.asarray(parts[name], kind) for name, kind in _PARTS]
    head = np.array([_MAGIC, *(len(x) for x in arrays)], np.int64)
    pad = lambda x: x + b"\0" * (-len(x) % 8)
    return head.tobytes() + b"".join(pad(x.tobytes()) for x in arrays)


class Lexicon:
    """Reads a compiled transducer from a file without loading it."""

    def __init__(self, path: str | os.PathLike) -> None:
        raw = np.memmap(path, np.uint8, "r")
        head = raw[: 8 * (len(_PARTS) + 1)].view(np.int64)
        if head[0] != _MAGIC:
            raise ValueError(f"{path} is no transducer")
        at = 8 * len(head)
        for (name, kind), n in zip(_PARTS, head[1:]):
            size = int(n) * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8
        self.start = len(self.final) - 1

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, or -1. All words walk the automaton in step, one byte at a time."""
        place = np.zeros(len(words), np.int64)
        if not words or not len(self.arcs):
            return place - 1
        lens = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lens) - lens
        state = np.full(len(words), self.start, np.int64)
        state[lens == 0] = -1
        live, step = np.flatnonzero(lens > 0), 0
        while len(live):
            key = state[live] << 8 | data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[arc] == key
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            place[live] += self.weight[arc]
            state[live] = self.target[arc]
            step += 1
            live = live[lens[live] > step]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] > 0
        return np.where(ok, place, -1)

    def output(self, place: int) -> np.ndarray:
        return self.ids[self.offset[place] : self.offset[place + 1]]
