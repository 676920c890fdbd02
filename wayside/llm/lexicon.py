"""A minimal acyclic transducer from words to numbers, in flat arrays that can be memory-mapped."""

from __future__ import annotations

import io

import numpy as np


class Builder:
    """Builds the smallest automaton of sorted words; suffixes that agree share their states."""

    def __init__(self):
        self.arcs: list[tuple[tuple[int, int], ...]] = []  # of finished states: (label, target)
        self.final: list[bool] = []
        self.register: dict = {}
        self.path: list[list] = [[]]  # open states of the last word: arcs so far
        self.path_final = [False]
        self.last = b""

    def add(self, word: bytes) -> None:
        shared = 0
        while shared < min(len(word), len(self.last)) and word[shared] == self.last[shared]:
            shared += 1
        self._close(shared)
        for _ in word[shared:]:
            self.path.append([])
            self.path_final.append(False)
        self.path_final[-1] = True
        self.last = word

    def _close(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            state = (self.path_final.pop(), tuple(self.path.pop()))
            number = self.register.get(state)
            if number is None:
                number = self.register[state] = len(self.arcs)
                self.arcs.append(state[1])
                self.final.append(state[0])
            self.path[-1].append((self.last[len(self.path) - 1], number))

    def finish(self) -> int:
        self._close(0)
        self.arcs.append(tuple(self.path[0]))
        self.final.append(self.path_final[0])
        return len(self.arcs) - 1


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """A lexicon of words and the ids that each puts out, as one block of bytes.

    Each arc carries how many words precede those behind it in order; summed along a word they are
    its rank, which finds its ids. Arcs lie sorted by state and label.
    """
    entries = sorted((w, ids) for w, ids in dict(entries).items() if w)
    builder = Builder()
    for word, _ in entries:
        builder.add(word)
    root = builder.finish()
    below = []  # words that end at or behind a state; targets come before the states that reach them
    keys, targets, outputs = [], [], []
    for state, arcs in enumerate(builder.arcs):
        n = int(builder.final[state])
        for label, target in arcs:
            keys.append(state * 256 + label)
            targets.append(target)
            outputs.append(n)
            n += below[target]
        below.append(n)
    ids = [i for _, out in entries for i in out]
    ends = np.cumsum([0] + [len(out) for _, out in entries])
    file = io.BytesIO()
    for array in (
        np.array([root], np.int64), np.array(builder.final, np.int8), np.array(keys, np.int64),
        np.array(targets, np.int64), np.array(outputs, np.int64), ends.astype(np.int64), np.array(ids, np.int64),
    ):
        file.write(np.int64(len(array)).tobytes() + array.tobytes() + b"\0" * (-array.nbytes % 8))
    return file.getvalue()


class Lexicon:
    """Looks words up in a compiled lexicon, many at a time."""

    def __init__(self, buffer):
        at, arrays = 0, []
        for kind in (np.int64, np.int8, *[np.int64] * 5):
            n = int(np.frombuffer(buffer, np.int64, 1, at)[0])
            arrays.append(np.frombuffer(buffer, kind, n, at + 8))
            at += 8 + arrays[-1].nbytes + (-arrays[-1].nbytes % 8)
        (self.root,), self.final, self.keys, self.targets, self.outputs, self.ends, self.ids = arrays

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word among the lexicon's, -1 if it isn't there. All words step together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(lengths > 0)
        state, rank = np.full(n, self.root), np.zeros(n, np.int64)
        step = 0
        while len(live):
            key = state[live] * 256 + data[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            live, arc = live[there], arc[there]
            rank[live] += self.outputs[arc]
            state[live] = self.targets[arc]
            step += 1
            done = lengths[live] == step
            ended = live[done]
            out[ended] = np.where(self.final[state[ended]] == 1, rank[ended], -1)
            live = live[~done]
        return out

    def output(self, rank: int) -> list[int]:
        """The ids of the word of this rank."""
        return self.ids[self.ends[rank] : self.ends[rank + 1]].tolist()

    def lookup(self, words: list[bytes]) -> list:
        """The ids of each word, None for words that aren't in the lexicon."""
        return [None if r < 0 else self.output(r) for r in self.ranks(words).tolist()]
