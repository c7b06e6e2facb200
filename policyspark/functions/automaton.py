"""Aho-Corasick automata over bytes, as numpy arrays, for packs of terms of bounded size.

States are the prefixes of the terms. ``step`` holds the complete transition
table (goto and failure links in one), over the classes of bytes that occur in
terms; ``link`` leads from a state to the longest shorter term that ends there.
UTF-8 is self-synchronising, so containment of bytes is containment of text.

A buffer is scanned in many lanes at once: it is cut into segments, each lane
starts early enough to know every term that ends in its segment, and all lanes
take a step together.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a lane; longer terms make longer lanes.
SEGMENT = 512
#: Stands between texts: no byte of UTF-8.
BREAK = b"\xff"


def begins_as_it_ends(term: bytes) -> bool:
    """Whether a shorter beginning of the term is also its end; takes time in proportion to the term."""
    border = [0]  # of each beginning, the longest shorter beginning that ends it
    for b in term[1:]:
        size = border[-1]
        while size and term[size] != b:
            size = border[size - 1]
        border.append(size + (term[size] == b))
    return border[-1] > 0


class Automaton:
    """All occurrences of some terms (distinct, not empty, as bytes)."""

    def __init__(self, terms: list[bytes]):
        self.terms, self.overlaps = terms, None
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.longest = int(self.lengths.max())
        used = np.unique(np.frombuffer(b"".join(terms), np.uint8))
        self.class_of = np.zeros(256, np.int32)  # class 0: bytes of no term
        self.class_of[used] = np.arange(1, len(used) + 1)
        self.shift = int(len(used)).bit_length()
        parent, byte, depth, end = [0], [0], [0], [-1]
        children: list[dict[int, int]] = [{}]
        for number, term in enumerate(terms):
            at = 0
            for b in term:
                if (to := children[at].get(b)) is None:
                    to = children[at][b] = len(parent)
                    parent.append(at)
                    byte.append(b)
                    depth.append(depth[at] + 1)
                    end.append(-1)
                    children.append({})
                at = to
            end[at] = number
        self.term = np.array(end)
        self._connect(np.array(parent), self.class_of[np.array(byte)], np.array(depth))

    def _connect(self, parent: np.ndarray, kind: np.ndarray, depth: np.ndarray) -> None:
        """Transitions, failure links and term links, one level of prefixes at a time."""
        states = len(parent)
        step = np.zeros((states, 1 << self.shift), np.int32)
        self.fail, self.link = np.zeros(states, np.int64), np.full(states, -1)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for d, level in enumerate(levels):
            if d > 1:
                self.fail[level] = step[self.fail[parent[level]], kind[level]]
            if d:
                fail = self.fail[level]
                step[level] = step[fail]
                self.link[level] = np.where(self.term[fail] >= 0, fail, self.link[fail])
            if d + 1 < len(levels):
                below = levels[d + 1]
                step[parent[below], kind[below]] = below
        self.step = (step << self.shift).ravel()
        self.found = (self.term >= 0) | (self.link >= 0)

    def overlapping(self) -> np.ndarray:
        """Of each term, whether two of its occurrences can overlap: it begins as it ends."""
        if self.overlaps is None:
            self.overlaps = np.array([begins_as_it_ends(t) for t in self.terms], bool)
        return self.overlaps

    def scan(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last byte, state) wherever at least one term ends."""
        early = self.longest - 1
        size = max(SEGMENT, 4 * early)
        lanes = -(-len(buffer) // size)
        kinds = np.zeros(lanes * size + early, np.int32)
        kinds[early:early + len(buffer)] = self.class_of[buffer]
        state = np.zeros(lanes, np.int32)
        positions, states = [], []
        for t in range(size + early):
            state = self.step[state + kinds[t:t + (lanes - 1) * size + 1:size]]
            if t >= early:
                at = state >> self.shift
                hit = np.flatnonzero(self.found[at])
                if len(hit):
                    positions.append(hit * size + (t - early))
                    states.append(at[hit])
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(positions), np.concatenate(states)

    def _text_of(self, texts: list[bytes], positions: np.ndarray) -> np.ndarray:
        starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        return np.searchsorted(starts, positions, "right") - 1

    def _ended(self, owner: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``owner``, term) of all terms that end at the states."""
        places, terms, place = [], [], np.arange(len(owner))
        while len(place):
            own = self.term[state] >= 0
            places.append(place[own])
            terms.append(self.term[state[own]])
            state = self.link[state]
            place, state = place[state >= 0], state[state >= 0]
        return (np.concatenate(places), np.concatenate(terms)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def contained(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) numbers: the distinct terms of each text."""
        position, state = self.scan(np.frombuffer(BREAK.join(texts), np.uint8))
        pairs = np.unique(self._text_of(texts, position) * len(self.term) + state)
        place, term = self._ended(pairs, pairs % len(self.term))
        both = np.unique(pairs[place] // len(self.term) * len(self.lengths) + term)
        return both // len(self.lengths), both % len(self.lengths)

    def counted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of non-overlapping occurrences, taken from the left.

        Hits of one state in one text are counted together; only terms that can
        overlap themselves need the places of their hits.
        """
        position, state = self.scan(np.frombuffer(BREAK.join(texts), np.uint8))
        apart, pairs = self.overlapping(), self._text_of(texts, position) * len(self.term) + state
        placed = self._ends_one_of(apart)[state]
        end, at = position[placed], pairs[placed]
        pairs, seen = np.unique(pairs, return_counts=True)
        place, term = self._ended(pairs, pairs % len(self.term))
        once = ~apart[term]
        one, of = np.unique(pairs[place[once]] // len(self.term) * len(self.lengths) + term[once], return_inverse=True)
        count = np.bincount(of, seen[place[once]], len(one)).astype(np.int64)
        place, term = self._ended(at, at % len(self.term))
        again = apart[term]
        place, term = place[again], term[again]
        two, fewer = self._apart(at[place] // len(self.term) * len(self.lengths) + term, end[place], self.lengths[term])
        group, count = np.concatenate([one, two]), np.concatenate([count, fewer])
        return group // len(self.lengths), group % len(self.lengths), count

    def _ends_one_of(self, wanted: np.ndarray) -> np.ndarray:
        """Of each state, whether one of the wanted terms ends there."""
        states = np.arange(len(self.term))
        place, term = self._ended(states, states)
        return np.bincount(place[wanted[term]], minlength=len(states)) > 0

    @staticmethod
    def _apart(group: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per group, how many occurrences are met going from the first to the next one that begins after it."""
        if not len(group):
            return group, group
        order = np.lexsort((end, group))
        names, of = np.unique(group[order], return_inverse=True)
        end, width = end[order], int(end.max()) + int(length.max()) + 1
        key = of * width + end
        following = np.searchsorted(key, key + length[order])
        following = np.append(np.where(np.append(of, -1)[following] == of, following, len(key)), len(key))
        at = np.searchsorted(of, np.arange(len(names)))
        count = np.zeros(len(names), np.int64)
        while (here := at < len(key)).any():
            count += here
            at = following[at]
        return names, count
