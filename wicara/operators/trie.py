"""A trie over words with failure links: all expressions of a lexicon in one pass over a text.

Every step is one word. Where no expression goes on, the failure link leads to the longest ending of
the words read so far that starts an expression; each node knows the expressions that end there, its
own and those of its links. A column function sends the trie to the workers, so no word leaves its row and
the same code serves a table and a stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Expressions = Sequence[tuple[str, Sequence[str]]]


class WordTrie:
    """Edges by node and word, failure links, and the numbers of the expressions that end at each node."""

    def __init__(self, expressions: Sequence[str]):
        self.words: dict[str, int] = {}
        self.edges: dict[tuple[int, int], int] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        count, children = 1, [[]]
        for number, expression in enumerate(expressions):
            node = 0
            for word in expression.split(" "):
                step = (node, self.words.setdefault(word, len(self.words)))
                if step not in self.edges:
                    self.edges[step] = count
                    children[node].append((step[1], count))
                    children.append([])
                    count += 1
                node = self.edges[step]
            self.ends[node] = (*self.ends.get(node, ()), number)
        self.links = [0] * count
        waiting = deque(node for _, node in children[0])
        while waiting:  # nearer nodes first, so that the links of shorter paths are known
            node = waiting.popleft()
            for word, child in children[node]:
                self.links[child] = self.follow(self.links[node], word)
                if inherited := self.ends.get(self.links[child]):
                    self.ends[child] = (*self.ends.get(child, ()), *inherited)
                waiting.append(child)

    def follow(self, node: int, word: int) -> int:
        while True:
            found = self.edges.get((node, word))
            if found is not None:
                return found
            if not node:
                return 0
            node = self.links[node]

    def matches(self, text: str) -> list[int]:
        """Numbers of the expressions in a text whose words are set apart by single blanks, ascending."""
        node, found = 0, set()
        known, ends = self.words.get, self.ends
        for word in text.split(" "):
            number = known(word)
            node = 0 if number is None else self.follow(node, number)
            if node in ends:
                found.update(ends[node])
        return sorted(found)


def trie_matcher(spark: SparkSession, expressions: Expressions):
    """Column function: matches of a cleaned text as (expression, regions), in the order of the lexicon."""
    sent = spark.sparkContext.broadcast((WordTrie([e for e, _ in expressions]), list(expressions)))

    @F.arrow_udf("array<struct<expression:string,regions:array<string>>>")
    def match(texts):
        import pyarrow as pa

        trie, entries = sent.value
        found = [trie.matches(t) if t else [] for t in texts.to_pylist()]
        sizes, flat = [0], []
        for numbers in found:
            flat += numbers
            sizes.append(len(flat))
        names = pa.array([entries[n][0] for n in flat], pa.string())
        regions = pa.array([list(entries[n][1]) for n in flat], pa.list_(pa.string()))
        items = pa.StructArray.from_arrays([names, regions], names=["expression", "regions"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)

    def of(text: Column) -> Column:
        return match(text)

    return of
