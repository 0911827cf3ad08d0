"""Counts of word pieces without building the pieces: a linear longest-match automaton.

A trie holds the vocabulary, pieces that begin words under one root and pieces that continue them under another.  When
no edge goes on from a node, greedy longest matching would now cut off the longest pieces matched so far; the failure
link says where matching stands after that, and a precomputed number says how many pieces were cut off.  So each
character is read once, whatever its piece lengths (Song et al., "Fast WordPiece Tokenization", 2021).
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, load
from .tokens import public_path

#: Chunks that a worker remembers.
REMEMBERED = 400_000
START, NEXT = 0, 1  # roots: of pieces that begin a word, of pieces that continue one
NOWHERE = -1


def piece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Beginning and continuing pieces of a sentencepiece file: those with its space mark, and those without."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    mark = "▁"
    return [x[1:] for x in pieces if x[0] == mark and mark not in x[1:] and len(x) > 1], [x for x in pieces if mark not in x]


class LongestMatch:
    """Trie with failure links; edges are keyed by node and character in one table."""

    def __init__(self, beginning: list[str], continuing: list[str]):
        self.edges: dict[tuple[int, str], int] = {}
        self.fail, self.popped, whole = [NOWHERE, NOWHERE], [0, 0], [False, False]
        children: list[list[tuple[str, int]]] = [[], []]
        for root, pieces in ((START, beginning), (NEXT, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (node, c) not in self.edges:
                        self.edges[node, c] = len(whole)
                        children[node].append((c, len(whole)))
                        whole.append(False)
                        children.append([])
                    node = self.edges[node, c]
                whole[node] |= node > NEXT
        self.fail += [NOWHERE] * (len(whole) - 2)
        self.popped += [0] * (len(whole) - 2)
        queue = deque([START, NEXT])
        while queue:
            node = queue.popleft()
            for c, child in children[node]:
                queue.append(child)
                if whole[child]:
                    self.fail[child], self.popped[child] = NEXT, 1
                    continue
                at, n = self.fail[node], self.popped[node]
                while at != NOWHERE and (at, c) not in self.edges:
                    n += self.popped[at]
                    at = self.fail[at]
                if at != NOWHERE:
                    self.fail[child], self.popped[child] = self.edges[at, c], n

    def count(self, word: str) -> int:
        """Pieces of a word by greedy longest match; 0 if it can't be cut up so."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, n = START, 0
        for c in word:
            to = edges.get((node, c))
            while to is None:
                n += popped[node]
                node = fail[node]
                if node == NOWHERE:
                    return 0
                to = edges.get((node, c))
            node = to
        while node != NEXT:
            n += popped[node]
            node = fail[node]
            if node == NOWHERE:
                return 0
        return n


class Counter(dict):
    """Remembers the count of each word."""

    def __init__(self, path: str):
        super().__init__()
        self.automaton = LongestMatch(*piece_vocabulary(path))

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = n
        return n

    def text(self, text: str | None, block: int = 1 << 16) -> tuple[int, int, int]:
        """Tokens, words and unknown words of a text; an unknown word is one token."""
        words, tokens, unknown = (text or "").split(), 0, 0
        for i in range(0, len(words), block):
            found = list(map(self.__getitem__, words[i : i + block]))
            tokens += sum(found)
            unknown += found.count(0)
        return tokens + unknown, len(words), unknown


@lru_cache
def counter(path: str) -> Counter:
    return Counter(path)


def _counts(path: str):
    def run(batches):
        c = counter(path)
        for b in batches:
            rows = [c.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=["id", "n_tokens", "n_words", "n_unknown"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_tokens, n_words, n_unknown.

    Words are what white space separates.  A word that greedy longest match can't cut up wholly is unknown and counts
    as one token.  Null and empty texts have no words; repeated rows and null ids are counted like any other; texts and
    words of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_counts(path or public_path("piece_bpe_32k.model")), "id long, n_tokens long, n_words long, n_unknown long")
    return counted.withColumnRenamed("id", id_col)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"))
