"""Weighted acyclic automata over words: every path spells an n-gram, every arc holds its count.

Built incrementally from sorted n-grams, states shared when their arcs are equal; united by summing
the weights of equal paths; looked up by composing them with a sorted list of phrases.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np

Arc = tuple[bytes, int, int]  # word, count of the n-gram that ends here, next state
_HEAD = struct.Struct("<IIII")  # bytes of the words, words, states, arcs


class Automaton:
    """States as tuples of arcs in word order; state 0 has none, the last one is the start."""

    def __init__(self, states: list[tuple[Arc, ...]]):
        self.states = states

    @property
    def start(self) -> int:
        return len(self.states) - 1

    def to_bytes(self) -> bytes:
        words = sorted({arc[0] for arcs in self.states for arc in arcs})
        number = {w: i for i, w in enumerate(words)}
        flat = [(number[w], n, to) for arcs in self.states for w, n, to in arcs]
        table = b"\n".join(words)
        sizes = np.fromiter(map(len, self.states), "<u4", len(self.states))
        head = _HEAD.pack(len(table), len(words), len(sizes), len(flat))
        return head + table + sizes.tobytes() + np.array(flat, "<i8").reshape(-1, 3).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        length, count, n_states, n_arcs = _HEAD.unpack_from(data)
        at = _HEAD.size
        words = data[at : at + length].split(b"\n") if count else []
        sizes = np.frombuffer(data, "<u4", n_states, at + length).tolist()
        flat = np.frombuffer(data, "<i8", n_arcs * 3, at + length + 4 * n_states).reshape(-1, 3).tolist()
        arcs = iter([(words[w], n, to) for w, n, to in flat])
        return cls([tuple([next(arcs) for _ in range(n)]) for n in sizes])

    def paths(self, state: int | None = None, lead: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """Every (n-gram, count) in word order."""
        for word, n, to in self.states[self.start if state is None else state]:
            yield (*lead, word), n
            yield from self.paths(to, (*lead, word))

    def compose(self, phrases: Iterable[tuple[bytes, ...]]) -> Iterator[int]:
        """Counts of phrases, 0 for unknown ones; sorted phrases share the walk along their common start."""
        walked: list[tuple[bytes, int, dict]] = []  # word, count, arcs of the state reached
        first = {w: (n, to) for w, n, to in self.states[self.start]}
        for phrase in phrases:
            same = 0
            while same < min(len(walked), len(phrase)) and walked[same][0] == phrase[same]:
                same += 1
            del walked[same:]
            for word in phrase[same:]:
                n, to = (walked[-1][2] if walked else first).get(word, (0, 0))
                walked.append((word, n, {w: (m, t) for w, m, t in self.states[to]}))
            yield walked[-1][1] if walked else 0


class Builder:
    """Registers states bottom-up, equal ones once."""

    def __init__(self):
        self.states: list[tuple[Arc, ...]] = [()]
        self.known: dict[tuple[Arc, ...], int] = {(): 0}

    def state(self, arcs: tuple[Arc, ...]) -> int:
        number = self.known.get(arcs)
        if number is None:
            number = self.known[arcs] = len(self.states)
            self.states.append(arcs)
        return number

    def finish(self, arcs: tuple[Arc, ...]) -> Automaton:
        if self.states[-1] != arcs or len(self.states) == 1:
            self.states.append(arcs)  # the start is the last state
        return Automaton(self.states)


def build(ngrams: Iterable[tuple[tuple[bytes, ...], int]], counted_from: int = 2) -> Automaton:
    """Automaton of sorted distinct n-grams whose counts go to all their starts of ``counted_from`` words or more.

    Only the path of the latest n-gram is open; what its successor does not share is closed at once.
    """
    made = Builder()
    words: list[bytes] = []
    counts: list[int] = []
    open_arcs: list[list[Arc]] = [[]]  # of the states along the path

    def close(depth: int) -> None:
        while len(words) > depth:
            to = made.state(tuple(open_arcs.pop()))
            open_arcs[-1].append((words.pop(), counts.pop(), to))

    for ngram, n in ngrams:
        same = 0
        while same < min(len(words), len(ngram)) and words[same] == ngram[same]:
            same += 1
        close(same)
        for word in ngram[same:]:
            words.append(word)
            counts.append(0)
            open_arcs.append([])
        for depth in range(counted_from - 1, len(ngram)):
            counts[depth] += n
    close(0)
    return made.finish(tuple(open_arcs[0]))


def unite(parts: list[Automaton], least: int = 0) -> Automaton:
    """Sum of automata. Arcs below the first word that end up under ``least`` go, with all that follows them.

    No n-gram is more frequent than its start, so nothing of ``least`` or more is lost.
    """
    made = Builder()

    def merge(states: list[tuple[list, int]], depth: int) -> tuple[Arc, ...]:
        total: dict[bytes, int] = {}
        follow: dict[bytes, list] = {}
        for own, state in states:
            for word, n, to in own[state]:
                if word in total:
                    total[word] += n
                else:
                    total[word] = n
                    follow[word] = []
                if to:
                    follow[word].append((own, to))
        kept = sorted(total) if depth == 0 else sorted(w for w, n in total.items() if n >= least)
        return tuple([(w, total[w], made.state(merge(follow[w], depth + 1)) if follow[w] else 0) for w in kept])

    return made.finish(merge([(p.states, p.start) for p in parts], 0))
