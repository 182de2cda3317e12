"""Token counts without tokens: a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that start a word and one for pieces that go on
inside it.  Every node has a failure link to the node where matching goes on after the longest pieces
have been taken off, and the *number* of pieces taken off on the way.  A word is then counted in one
pass over its characters; pieces are never cut out.

Semantics: white space separates chunks; within a chunk, runs of letters and digits and every other
single character are words.  A word is cut greedily, longest piece first; a word that can't be cut
wholly counts as one unknown token.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import kept, map_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = -1
#: Counts of this many distinct chunks are kept by a worker, then it starts afresh; longer ones aren't kept.
CACHE, KEPT = 400_000, 64
_WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")


def load_pieces(path: str) -> tuple[list[str], list[str]]:
    """(pieces that start a word, pieces inside a word) of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    starts = [p[1:] for p in pieces if p.startswith(MARK)]
    return [p for p in starts if p and MARK not in p], [p for p in pieces if MARK not in p]


class LongestMatch:
    """Counts the pieces of greedy longest-match segmentation, in time linear in the word."""

    START, INSIDE, NONE = 0, 1, -1

    def __init__(self, starting: Iterable[str], inside: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((self.START, starting), (self.INSIDE, inside)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.child[node].setdefault(c, len(self.child))
                    if node == len(self.child):
                        self.child.append({})
                        final.append(False)
                final[node] = node > 1
        self.fail, self.popped = [self.NONE] * len(self.child), [0] * len(self.child)
        level = [self.START, self.INSIDE]
        while level:
            below = []
            for parent in level:
                for c, node in self.child[parent].items():
                    below.append(node)
                    if final[node]:
                        self.fail[node], self.popped[node] = self.INSIDE, 1
                        continue
                    z, popped = self.fail[parent], self.popped[parent]
                    while z != self.NONE and c not in self.child[z]:
                        popped += self.popped[z]
                        z = self.fail[z]
                    if z != self.NONE:
                        self.fail[node], self.popped[node] = self.child[z][c], popped
            level = below

    def count(self, word: str) -> int:
        """Number of pieces, or UNKNOWN."""
        child, fail, popped = self.child, self.fail, self.popped
        node, n = self.START, 0
        for c in word:
            while (to := child[node].get(c)) is None:
                n += popped[node]
                if (node := fail[node]) == self.NONE:
                    return UNKNOWN
            node = to
        while node != self.INSIDE:
            n += popped[node]
            if (node := fail[node]) == self.NONE:
                return UNKNOWN
        return n

    def chunk(self, chunk: str) -> tuple[int, int, int]:
        """(tokens, words, unknown words) of a chunk without white space."""
        tokens = words = unknown = 0
        for word in _WORDS.findall(chunk):
            n = self.count(word)
            words += 1
            unknown += n == UNKNOWN
            tokens += 1 if n == UNKNOWN else n
        return tokens, words, unknown


def count_tokens(docs: DataFrame, pieces: tuple[list[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_words, n_unknown of every whole text.

    Null and empty texts have 0 of each; repeated rows are counted each for itself.  The vocabulary has
    the fixed size of its file and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    contents = xxhash.xxh64_intdigest("\n".join("\0".join(p) for p in pieces))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher, known = kept("longest match", contents, lambda: (LongestMatch(*shared.value), {}))
        rows = []
        for text in batch.column(1).to_pylist():
            chunks = text.split() if text else ()
            for c in set(chunks).difference(known):
                if len(known) >= CACHE:
                    known.clear()
                if len(c) <= KEPT:
                    known[c] = matcher.chunk(c)
            got = [known.get(c) or matcher.chunk(c) for c in chunks]
            rows.append(tuple(map(sum, zip(*got))) if got else (0, 0, 0))
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_tokens", "n_words", "n_unknown"])

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), run, f"id {kind}, n_tokens long, n_words long, n_unknown long").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_words, n_unknown for every row of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents"), load_pieces(vocabulary))
