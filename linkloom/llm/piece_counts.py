"""Token counts by a linear longest-match automaton.

A word is a run of characters other than ASCII white space. Its word pieces are taken greedily
from the left: the first begins with the word mark, each is the longest piece of the vocabulary
that matches, and a character that no piece has is spelt in single bytes. The automaton is the
trie of the pieces with failure links. A node without a move on the next byte pops the pieces that
greedy matching would have taken of its path, a number known beforehand, and fails to the node of
what is left. So a word costs time in its length, and no piece is built.

Null and empty texts have 0 words and 0 pieces; repeated rows and null ids pass through; other
columns are ignored; an empty table gives an empty result; texts are whole whatever their length. Counts of words met before are kept,
up to ``WORDS`` of them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import worker

MARK, WORDS = "▁".encode(), 400_000


def load_pieces(path: str) -> set[bytes]:
    """The pieces of a vocabulary file as bytes; all single bytes are among them."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i).encode() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))} | {bytes([b]) for b in range(256)}


class Automaton(dict):
    """Word to its number of pieces."""

    def __init__(self, pieces: set[bytes]):
        super().__init__()
        self.child: dict[int, int] = {}
        path, ends = [(0, 0)], set()
        for piece in pieces:
            node = 0
            for byte in piece:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(path)
                    path.append((node, byte))
                node = nxt
            ends.add(node)
        below: list[list[int]] = [[] for _ in path]
        for node in range(1, len(path)):
            below[path[node][0]].append(node)
        self.pops, self.fail = [0] * len(path), [0] * len(path)
        queue = deque(below[0])
        while queue:
            node = queue.popleft()
            queue.extend(below[node])
            if node in ends:
                self.pops[node] = 1
                continue
            parent, byte = path[node]
            popped, at = self.pops[parent], self.fail[parent]
            while at << 8 | byte not in self.child:
                popped += self.pops[at]
                at = self.fail[at]
            self.pops[node], self.fail[node] = popped, self.child[at << 8 | byte]

    def __missing__(self, word: bytes) -> int:
        child, pops, fail = self.child, self.pops, self.fail
        node, n = 0, 0
        for byte in MARK + word:
            while node << 8 | byte not in child:
                n += pops[node]
                node = fail[node]
            node = child[node << 8 | byte]
        while node:
            n += pops[node]
            node = fail[node]
        if len(self) >= WORDS:
            self.clear()
        self[word] = n
        return n


def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, one per worker process."""
    return worker.keep(("pieces", path), lambda: Automaton(load_pieces(path)))


def piece_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_pieces) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = automaton(path)
        for batch in batches:
            words, pieces = [], []
            for x in batch.column(1).cast(pa.binary()):
                own = x.as_buffer().to_pybytes().split() if x.is_valid else []
                words.append(len(own))
                pieces.append(sum(map(count.__getitem__, own)))
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["id", "n_words", "n_pieces"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_pieces long")
