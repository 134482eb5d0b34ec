"""Aho–Corasick automata over the UTF-8 bytes of many small groups of patterns at once, as numpy arrays.

Each group has a root of its own, so one table of transitions serves all groups of a batch, and all texts of a batch go through it side by side, a byte a step.
Nothing is reported by occurrence: what is asked for are minima, which are kept by state and carried along the failure links once.
"""

from __future__ import annotations

import numpy as np

#: Bytes of patterns in one automaton; a state has at most 257 transitions of 4 bytes.
PATTERN_BYTES = 1 << 15
#: Texts are cut into pieces of so many bytes, with as much overlap as the longest pattern needs.
PIECE = 256
NONE = np.iinfo(np.int64).max


def aranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Automaton:
    """data[starts : ends] are the patterns, none of them empty; group: the root of each, from 0 to groups - 1."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, groups: int):
        size = ends - starts
        used = np.zeros(256, bool)
        used[data[aranges(starts, size)]] = True
        self.symbol = np.where(used, np.cumsum(used), 0).astype(np.int32)
        self.width = int(used.sum()) + 1
        self.longest = int(size.max()) if len(size) else 1
        #: per depth: first state, parents and symbols of its states
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.end = group.astype(np.int64)  # the state of each pattern, in the end that of the whole
        states, live = groups, np.arange(len(size))
        for depth in range(self.longest if len(size) else 0):
            live = live[size[live] > depth]
            edge, at = np.unique(self.end[live] * self.width + self.symbol[data[starts[live] + depth]], return_inverse=True)
            self.levels.append((states, edge // self.width, edge % self.width))
            self.end[live] = states + at
            states += len(edge)
        self.fail = np.zeros(states, np.int64)
        self.next = np.zeros((states, self.width), np.int32)
        roots = np.arange(groups)
        self.fail[:groups], self.next[:groups] = roots, roots[:, None]
        for depth, (first, parent, symbol) in enumerate(self.levels):
            here = np.arange(first, first + len(parent))
            self.fail[here] = self.next[self.fail[parent], symbol] if depth else parent
            self.next[parent, symbol] = here
            self.next[here] = self.next[self.fail[here]]
        self.ends_here = np.zeros(states, bool)
        self.ends_here[self.end] = True
        for first, parent, _ in self.levels:
            here = slice(first, first + len(parent))
            self.ends_here[here] |= self.ends_here[self.fail[here]]

    def _steps(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray):
        """(text, state) of every place of the texts at which some pattern ends, a step of all texts at once."""
        pieces = np.maximum(-(-(ends - starts) // PIECE), 1)
        text = np.repeat(np.arange(len(starts)), pieces)
        at = aranges(np.zeros(len(starts), np.int64), pieces) * PIECE + starts[text]
        size = np.minimum(at + PIECE + self.longest - 1, ends[text]) - at
        order = np.argsort(-size, kind="stable")
        text, at, size = text[order], at[order], size[order]
        state = group[text].astype(np.int64)
        flat = self.next.ravel()
        symbol = self.symbol[data]
        for step in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -step))
            state = flat[state[:n] * self.width + symbol[at[:n] + step]].astype(np.int64)
            hit = np.flatnonzero(self.ends_here[state])
            if len(hit):
                yield text[hit], state[hit]

    def first(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each pattern the least value of the texts of its group that contain it, or NONE."""
        least = np.full(len(self.fail), NONE)
        for text, state in self._steps(data, starts, ends, group):
            np.minimum.at(least, state, value[text])
        for first, parent, _ in reversed(self.levels):
            here = slice(first, first + len(parent))
            np.minimum.at(least, self.fail[here], least[here])
        return least[self.end]

    def least(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each text the least value of the patterns of its group that it contains, or NONE."""
        low = np.full(len(self.fail), NONE)
        np.minimum.at(low, self.end, value)
        for first, parent, _ in self.levels:
            here = slice(first, first + len(parent))
            low[here] = np.minimum(low[here], low[self.fail[here]])
        out = np.full(len(starts), NONE)
        for text, state in self._steps(data, starts, ends, group):
            np.minimum.at(out, text, low[state])
        return out


def packs(size: np.ndarray, most: int = PATTERN_BYTES):
    """Ranges [i, j) of patterns of at most `most` bytes together, or one longer pattern."""
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def first_containing(data: np.ndarray, pattern: tuple, text: tuple, value: np.ndarray, *, of_text: bool) -> np.ndarray:
    """pattern, text: (starts, ends, group), ordered by group; empty patterns and texts are allowed and match nothing here.

    of_text false: for each pattern the least value (one for each text) of the texts of its group that contain it. of_text true: for each text the least value (one for
    each pattern) of the patterns of its group in it. NONE where there is none. A pattern that fills an automaton alone is looked for by itself.
    """
    starts, ends, group = pattern
    t_starts, t_ends, t_group = text
    out = np.full(len(t_starts) if of_text else len(starts), NONE)
    some = np.flatnonzero(ends > starts)
    for i, j in packs((ends - starts)[some]):
        mine = some[i:j]
        names, at = np.unique(group[mine], return_inverse=True)
        low, high = np.searchsorted(t_group, names), np.searchsorted(t_group, names, "right")
        texts = aranges(low, high - low)
        if not len(texts):
            continue
        roots = np.repeat(np.arange(len(names)), high - low)
        if j == i + 1 and ends[mine[0]] - starts[mine[0]] > PATTERN_BYTES:
            whole = data[starts[mine[0]] : ends[mine[0]]].tobytes()
            holds = np.array([whole in data[t_starts[k] : t_ends[k]].tobytes() for k in texts.tolist()], bool)
            if of_text:
                out[texts[holds]] = np.minimum(out[texts[holds]], value[mine[0]])
            elif holds.any():
                out[mine[0]] = value[texts[holds]].min()
            continue
        machine = Automaton(data, starts[mine], ends[mine], at, len(names))
        if of_text:
            out[texts] = np.minimum(out[texts], machine.least(data, t_starts[texts], t_ends[texts], roots, value[mine]))
        else:
            out[mine] = machine.first(data, t_starts[texts], t_ends[texts], roots, value[texts])
    return out
