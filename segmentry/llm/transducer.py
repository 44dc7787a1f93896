"""A minimal acyclic transducer from sorted terms to their ordinals, and its walk over many words at once."""

from __future__ import annotations

import io
import os
from dataclasses import astuple, dataclass

import numpy as np

SPACE = 0x20


@dataclass(frozen=True)
class Transducer:
    """States of a minimal automaton of byte strings. The edges of a state are the slots base[s] + label - low[s]
    for the labels from low[s] on, width[s] of them; `to` is the state behind a slot or -1, and `add` the number of
    terms that come before those behind it. So the sum of `add` along a term is its ordinal."""

    low: np.ndarray
    width: np.ndarray
    base: np.ndarray
    final: np.ndarray
    to: np.ndarray
    add: np.ndarray
    root: int

    @classmethod
    def of(cls, terms: list[bytes]) -> Transducer:
        """From distinct terms in ascending order: states are closed, and merged with equal ones, as soon as no later term can change them."""
        known: dict[tuple, int] = {}
        closed: list[tuple] = []
        behind: list[int] = []
        path: list[list] = [[False]]

        def close() -> int:
            state = tuple(path.pop())
            if (found := known.get(state)) is None:
                found = known[state] = len(closed)
                closed.append(state)
                behind.append(int(state[0]) + sum(behind[t] for t in state[2::2]))
            return found

        last = b""
        for term in terms:
            same = len(os.path.commonprefix([last, term]))
            for at in range(len(last) - 1, same - 1, -1):
                found = close()
                path[-1] += (last[at], found)
            path += ([False] for _ in range(len(term) - same))
            path[-1][0] = True
            last = term
        for at in range(len(last) - 1, -1, -1):
            found = close()
            path[-1] += (last[at], found)
        root = close()

        n = len(closed)
        low, width = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint16)
        for s, state in enumerate(closed):
            if len(state) > 1:
                low[s], width[s] = state[1], state[-2] - state[1] + 1
        base = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        to, add = np.full(base[-1], -1, dtype=np.int32), np.zeros(base[-1], dtype=np.int64)
        for s, state in enumerate(closed):
            before = int(state[0])
            for label, target in zip(state[1::2], state[2::2]):
                slot = base[s] + label - int(low[s])
                to[slot], add[slot] = target, before
                before += behind[target]
        return cls(low, width, base[:-1], np.array([s[0] for s in closed], dtype=bool), to, add, root)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *astuple(self))
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Transducer:
        held = np.load(io.BytesIO(raw), allow_pickle=False)
        *arrays, root = (held[f"arr_{i}"] for i in range(7))
        return cls(*arrays, int(root))

    def ordinals(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words of `data` (bytes, each word followed by a space) that begin at `at`: which are terms, and their ordinals."""
        which, state, out = np.arange(len(at)), np.full(len(at), self.root), np.zeros(len(at), dtype=np.int64)
        found = [(which[:0], out[:0])]
        while len(at):
            label = data[at]
            done = np.flatnonzero((label == SPACE) & self.final[state])
            found.append((which[done], out[done]))
            # Labels below `low` wrap around and are beyond the width, as is a space.
            step = label - self.low[state]
            on = np.flatnonzero(step < self.width[state])
            slot = self.base[state[on]] + step[on]
            to = self.to[slot]
            alive = np.flatnonzero(to >= 0)
            on, state = on[alive], to[alive]
            which, out, at = which[on], out[on] + self.add[slot[alive]], at[on] + 1
        return np.concatenate([w for w, _ in found]), np.concatenate([o for _, o in found])
