"""Token counts by a linear longest-match automaton.

Greedy word-piece cuts a word into the longest vocabulary pieces from its left. The trie of the vocabulary has a failure link
and a popped-token count at each node: where a node has no child for the next byte, the pieces that the match so far is certain
to be cut into are popped, only their number being kept, and the link leads to the node of what remains. Each byte moves a node
down once and each link pops at least a piece, so a word takes linear time and no piece is ever built.

A word is a run of characters that aren't white space, with a blank before it as in the vocabulary's marking of word starts. A word
of which some part is in no piece counts as one unknown token. Counts of words are kept in a bounded cache a worker.

Nulls and empties: a null or empty text has no words or tokens; a null doc_id stays null; repeated rows are counted each; extra
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import slices, table, texts

CACHE = 700_000
UNKNOWN = -1


class Automaton:
    """first: pieces that may start a word; later: pieces that may follow (the same if not given)."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes] | None = None):
        self.child: list[dict[int, int]] = [{}, {}]  # node 0 starts a word, node 1 stands after a piece
        self.end = bytearray(2)
        first = list(first)
        for root, pieces in ((0, first), (1, first if later is None else later)):
            for piece in pieces:
                node = root
                for b in piece:
                    step = self.child[node]
                    if b not in step:
                        step[b] = len(self.child)
                        self.child.append({})
                        self.end.append(0)
                    node = step[b]
                if piece:
                    self.end[node] = 1
        self.link, self.popped = [-1] * len(self.child), [0] * len(self.child)
        level = [0, 1]
        while level:
            level = [self._link(node, b, kid) for node in level for b, kid in self.child[node].items()]

    def _link(self, parent: int, b: int, node: int) -> int:
        if self.end[node]:
            self.link[node], self.popped[node] = 1, 1
            return node
        at, count = self.link[parent], self.popped[parent]
        while at >= 0 and b not in self.child[at]:
            at, count = self.link[at], count + self.popped[at]
        if at >= 0:
            self.link[node], self.popped[node] = self.child[at][b], count
        return node

    def count(self, word: bytes) -> int:
        """Pieces of the greedy cut, or UNKNOWN."""
        child, link, popped = self.child, self.link, self.popped
        node = n = 0
        for b in word:
            while b not in child[node]:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return UNKNOWN
            node = child[node][b]
        while node > 1:
            n += popped[node]
            node = link[node]
            if node < 0:
                return UNKNOWN
        return n


def byte_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file, its printable stand-ins turned back into bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [bytes(stand[c] for c in piece) for piece in json.load(open(path))["model"]["vocab"] if all(c in stand for c in piece)]


@lru_cache(1)
def automaton(path: str) -> Automaton:
    return Automaton(byte_vocabulary(path))


class _Counts(dict):
    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = self.machine.count(b" " + word.encode("utf-8", "surrogatepass"))
        return n


@lru_cache(1)
def _counts(path: str) -> _Counts:
    return _Counts(automaton(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(path)
        for batch in slices(batches):
            found = [list(map(known.__getitem__, t.split())) for t in texts(batch)]
            unknown = [x.count(UNKNOWN) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([sum(x) + 2 * u for x, u in zip(found, unknown, strict=True)], pa.int64()), pa.array(unknown, pa.int64()), pa.array([max(x, default=0) for x in found], pa.int64())],
                ["doc_id", "n_words", "n_tokens", "n_unknown", "longest"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown and longest (most tokens in a word) for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(vocabulary), "doc_id long, n_words long, n_tokens long, n_unknown long, longest long")


def op6_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op6_wordpiece_counts": op6_wordpiece_counts}
SQL: dict[str, str] = {}
