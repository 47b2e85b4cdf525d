"""Token counts (operator 8): a linear longest-match automaton.

Greedy word-piece segmentation takes the longest piece of the vocabulary at each place of
a word. The automaton walks a word once: a trie of word-initial and of continuing pieces,
where each node has a failure link (where matching goes on after the pieces that must be
cut off there) and the number of pieces cut off on the way. Only counts are kept, so no
piece is ever built.

The vocabulary comes from a public byte-level file: entries that begin with a space are
word-initial pieces, the others continue a word; all single bytes are both, so that every
word can be segmented. It works on UTF-8 bytes; words are what stands between ASCII white
space.

Scale: a map over rows with whole texts, no shuffle. Each Python worker builds the
automaton once; counts of recent words are kept in a cache of bounded size."""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only
from .vocab import Cache, _byte_letters, vocabulary_path

VOCAB = "byte_bpe_50k.json"


def pieces(name: str = VOCAB) -> tuple[set[bytes], set[bytes]]:
    """Word-initial and continuing pieces of a byte-level vocabulary file."""
    byte = {c: b for b, c in _byte_letters().items()}
    with open(vocabulary_path(name), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    first, later = ({bytes([b]) for b in range(256)} for _ in range(2))
    for token in vocab:
        if not all(c in byte for c in token):
            continue
        raw = bytes(byte[c] for c in token)
        if raw[:1] == b" ":
            first.add(raw[1:])
        else:
            later.add(raw)
    first.discard(b"")
    return first, later


class Automaton:
    def __init__(self, first: set[bytes], later: set[bytes]):
        # Node 0 begins words, node 1 goes on within them. All nodes share one dict of
        # edges keyed by node * 256 + byte.
        self.edges: dict[int, int] = {}
        is_piece, parent = [False, False], [(0, 0), (0, 0)]
        for root, words in ((0, first), (1, later)):
            for w in words:
                node = root
                for c in w:
                    key = node << 8 | c
                    child = self.edges.get(key)
                    if child is None:
                        child = self.edges[key] = len(is_piece)
                        is_piece.append(False)
                        parent.append((node, c))
                    node = child
                is_piece[node] = True
        n = len(is_piece)
        self.fail, self.popped = [-1] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for node in range(2, n):
            children[parent[node][0]].append(node)
        # Breadth first: a link depends on links of shorter strings. A node that is a
        # piece cuts itself off; any other cuts what its parent does, then follows links
        # until its own byte fits.
        for node in self._by_depth(children):
            if is_piece[node]:
                self.fail[node], self.popped[node] = 1, 1
                continue
            above, c = parent[node]
            z, count = self.fail[above], self.popped[above]
            while z != -1 and (z << 8 | c) not in self.edges:
                count += self.popped[z]
                z = self.fail[z]
            if z != -1:
                self.fail[node], self.popped[node] = self.edges[z << 8 | c], count

    @staticmethod
    def _by_depth(children: list[list[int]]) -> Iterator[int]:
        queue = deque([*children[0], *children[1]])
        while queue:
            node = queue.popleft()
            yield node
            queue.extend(children[node])

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of ``word``; 0 for the empty word."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for c in word:
            while (after := edges.get(node << 8 | c)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    raise ValueError("a byte is not in the vocabulary")
            node = after
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total


@functools.cache
def automaton(name: str = VOCAB) -> Automaton:
    return Automaton(*pieces(name))


@functools.cache
def _counts(name: str) -> Cache:
    return Cache(automaton(name).count)


def count_tokens(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """doc_id, n_words, n_tokens and n_bytes for every row of ``docs``.

    Null text counts as empty and has no token; words of any length are segmented whole;
    repeated rows come back as often as they are there. An empty table gives an empty
    table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(vocab)
        for b in batches:
            n_words, n_tokens, n_bytes = [], [], []
            for t in b.column("text").to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                n_words.append(len(words))
                n_tokens.append(sum([known[w] for w in words]))
                n_bytes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_bytes))],
                ["doc_id", "n_words", "n_tokens", "n_bytes"],
            )

    thin = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return thin.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")
