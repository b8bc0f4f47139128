"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Where a word leaves the trie at node v, greedy
longest-match has settled some pieces of v's text; the failure link leads to the
node of what is left, and the number of pieces so popped is known beforehand.
So a word is read once, byte by byte, and its number of pieces comes out without
building any.  Every (node, byte) step is worked out once and kept.

A word is a run of bytes other than \\x20 and \\x09-\\x0d; `mark` stands before it
as the sign of a word's start (one space in byte-level vocabularies).  Pieces are
those of `vocabulary`; greedy pieces are what "longest piece first" takes.

Cases: text null or without words has 0 pieces; a word that the vocabulary can't
spell counts as one piece (unknown), as word-piece has it; repeated rows are each
counted; further columns are left; an empty vocabulary makes every word unknown.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, table, text_slices
from .op3_bpe import _schema, load_ranks
from .pretok import Cache

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_WORDS = 400_000
_NONE = -1


class Automaton:
    def __init__(self, pieces):
        self.kids: list[dict[int, int]] = [{}]
        self.is_piece = [False]
        self.depth = [0]
        for p in sorted(set(pieces) - {b""}):
            v = 0
            for c in p:
                v = self._kid(v, c)
            self.is_piece[v] = True
        self._link()
        self.steps: dict[int, tuple[int, int] | None] = {}

    def _kid(self, v: int, c: int) -> int:
        u = self.kids[v].get(c)
        if u is None:
            u = self.kids[v][c] = len(self.kids)
            self.kids.append({})
            self.is_piece.append(False)
            self.depth.append(self.depth[v] + 1)
        return u

    def _link(self) -> None:
        """link[v], popped[v]: where failing at v leads, and how many pieces that settles.

        A piece node pops itself and leads to the root.  Another node pops what its
        parent pops and goes on from the parent's link by its own last byte,
        popping on until that byte fits; _NONE where nothing fits.
        """
        n = len(self.kids)
        self.link, self.popped = [_NONE] * n, [0] * n
        queue = [0]
        for v in queue:
            for c, u in self.kids[v].items():
                queue.append(u)
                if self.is_piece[u]:
                    self.link[u], self.popped[u] = 0, 1
                    continue
                z, k = self.link[v], self.popped[v]
                while z != _NONE and c not in self.kids[z]:
                    k += self.popped[z]
                    z = self.link[z]
                if z != _NONE:
                    self.link[u], self.popped[u] = self.kids[z][c], k

    def _step(self, v: int, c: int) -> tuple[int, int] | None:
        """(next node, pieces popped) for byte c at node v; None: no way on."""
        k = 0
        while c not in self.kids[v]:
            k += self.popped[v]
            v = self.link[v]
            if v == _NONE:
                return None
        return self.kids[v][c], k

    def count(self, data: bytes) -> int:
        """Pieces of greedy longest match; 0 for nothing; -1 where it can't be spelt."""
        v = total = 0
        steps = self.steps
        for c in data:
            key = v << 8 | c
            try:
                at = steps[key]
            except KeyError:
                at = steps[key] = self._step(v, c)
            if at is None:
                return -1
            v = at[0]
            total += at[1]
        while v > 0:  # the end: whatever is left settles
            total += self.popped[v]
            v = self.link[v]
        return total if v == 0 else -1


@functools.cache
def _automaton(name: str, mark: bytes) -> Cache:
    import public_tokenizers

    a = Automaton(load_ranks(public_tokenizers.path(name)))
    count = a.count
    return Cache(lambda words: ((w, abs(count(mark + w))) for w in words), CACHE_WORDS)


def counts(docs: DataFrame, vocabulary: str = VOCABULARY, mark: bytes = b" ") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _automaton(vocabulary, mark)
        for b in text_slices(batches, "text"):
            words = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in b.column(1).cast(pa.binary())]
            n = []
            for w in words:
                cache.ready(w)
                n.append(sum(map(cache.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, words), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return pick(docs, "doc_id", "text").mapInArrow(run, _schema(docs, "n_words bigint, n_tokens bigint"))


def query(spark, sf_dir) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": query}
