"""Byte-pair encoding by backtracking, and decoding by an offset table.

The encoder looks up, for every place of a piece of text, the longest token that starts there (one Aho-Corasick pass
over the reversed piece), and takes tokens from left to right.  A token may follow another only if the merges would
not have joined them otherwise, which a pair-compatibility table answers; if none of the token's prefixes may follow,
the last token is taken back and that place is ruled out.  Each place is ruled out once, so the work is linear in the
piece, and the result is exactly that of the merges.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, load
from .tokens import Vocabulary, public_path

#: Entries of a worker's memory of pieces and of token pairs; beyond it, pieces are encoded anew each time.
REMEMBERED = 400_000


class BacktrackingEncoder:
    """Merges of one piece of bytes.  Tokens are numbered by rank: bytes first, then the merges in their order."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        made = {c for _, _, c in vocabulary.merges}
        base = sorted(i for i in vocabulary.tokens if i not in made)
        order = base + [c for _, _, c in vocabulary.merges]
        rank = {t: r for r, t in enumerate(order)}
        self.to_id = np.array(order, np.uint32)
        self.bytes_of = [vocabulary.tokens[t][0] for t in order]
        self.rank_of = {b: r for r, b in enumerate(self.bytes_of)}
        self.length = list(map(len, self.bytes_of))
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.joined = {}
        for a, b, c in vocabulary.merges:
            a, b, c = rank[a], rank[b], rank[c]
            self.left[c], self.right[c], self.joined[a, b] = a, b, c
        self.shorter = [next((self.rank_of[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.rank_of), -1) for b in self.bytes_of]
        self.longest = ahocorasick.Automaton()
        for r, b in enumerate(self.bytes_of):
            self.longest.add_word(b.decode("latin-1")[::-1], r)
        self.longest.make_automaton()
        self.fits: dict[int, bool] = {}

    def learn(self, a: int, b: int) -> bool:
        """Enters a pair in the table."""
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        found = self.fits[a << 20 | b] = self.compatible(a, b)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as neighbours: undoing them on either side of the boundary, in falling
        order of rank, no pair may come up that would have been joined before what was undone."""
        joined, left, right = self.joined, self.left, self.right
        bound = len(left)
        while True:
            if joined.get((a, b), bound) < bound:
                return False
            a_whole, b_whole = right[a] == a, left[b] == b
            if a_whole and b_whole:
                return True
            if b_whole or (not a_whole and a > b):
                a, bound = right[a], a
            else:  # of equal ranks the left one was merged first, so a pair of b's rank comes before b
                b, bound = left[b], b + 1

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        whole = self.rank_of.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter = len(piece), self.length, self.shorter
        start = [-1] * n
        for end, token in self.longest.iter(piece.decode("latin-1")[::-1]):
            at = n - 1 - end
            if start[at] < 0 or length[token] > length[start[at]]:
                start[at] = token
        out: list[int] = []
        ruled_out, pos, token = bytearray(n + 1), 0, start[0]
        last, known, learn = -1, self.fits.get, self.learn
        while True:
            while token >= 0:
                end = pos + length[token]
                if not ruled_out[end]:
                    if last < 0:
                        break
                    fits = known(last << 20 | token)
                    if fits or fits is None and learn(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                last, pos, token = token, end, start[end]
            else:
                ruled_out[pos] = 1
                token = out.pop()
                pos -= length[token]
                last = out[-1] if out else -1


#: White space as Unicode has it, for the pattern below.
SPACE = r"\t-\r \x85\xa0  -     　"


class Codec(dict):
    """Text to ids and back.  As a dict it remembers pieces: a piece's key to its ids, packed as 32-bit integers.

    Texts are split at spaces and line ends, where no token crosses; a key is a word that a space precedes, or a
    string after NUL as it is.  Texts whose white space isn't single are split by the full pattern instead.
    """

    IRREGULAR = re.compile(r"\s\s|^\s|\s$|\x00")

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        super().__init__()
        v = Vocabulary(path)
        if v.suffix:
            raise ValueError(f"{path}: a byte-level vocabulary without word ends is needed")
        self.encoder = BacktrackingEncoder(v)
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.special = v.special
        self.at_special = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None
        of = {i: b for i, (b, _) in v.tokens.items()} | {i: s.encode() for s, i in v.special.items()}
        self.size = np.array([len(of.get(i, b"")) for i in range(v.size)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.blob = np.frombuffer(b"".join(of.get(i, b"") for i in range(v.size)), np.uint8)
        digits = [b"%d," % i for i in range(v.size)]
        self.digit_size = np.array(list(map(len, digits)), np.int64)
        self.digit_start = np.concatenate([[0], np.cumsum(self.digit_size)[:-1]])
        self.digit_blob = np.frombuffer(b"".join(digits), np.uint8)

    def __missing__(self, key: str) -> bytes:
        encode, out = self.encoder.encode, []
        for piece in self.pattern.findall(key[1:] if key[:1] == "\0" else key if key == "\n" else " " + key):
            out += encode(piece.encode())
        packed = self.encoder.to_id[out].tobytes() if out else b""
        if len(self) < REMEMBERED and len(key) < 64:
            self[key] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        if self.at_special and self.at_special.search(text):
            parts = [np.array([self.special[x]], np.uint32) if x in self.special else self._plain(x) for x in self.at_special.split(text) if x]
            return np.concatenate(parts)
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.IRREGULAR.search(text):
            keys = ["\0" + x for x in self.pattern.findall(text)]
        else:
            keys = ("\0" + text.replace("\n", " \n \0")).split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, keys)), np.uint32)

    @staticmethod
    def _gather(blob: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
        """The stretches of the blob that the ids stand for, one after another."""
        n = size[ids]
        ends = np.cumsum(n)
        return blob[np.repeat(start[ids] - ends + n, n) + np.arange(ends[-1])].tobytes() if len(ids) else b""

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> str:
        """The text of the ids, special ones included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self._gather(self.blob, self.start, self.size, ids[i : i + block]) for i in range(0, len(ids), block)).decode("utf-8", "replace")

    def digits(self, ids: np.ndarray, block: int = 1 << 16) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(self._gather(self.digit_blob, self.digit_start, self.digit_size, ids[i : i + block]) for i in range(0, len(ids), block))[:-1]


@lru_cache
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(path: str):
    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], names=["id", "ids"])

    return run


def _decoded(path: str):
    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.frombuffer(x or b"", np.uint32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def _digests(path: str):
    def run(batches):
        c = codec(path)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                rows.append((len(ids), hashlib.sha256(c.digits(ids)).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _rows(docs: DataFrame, id_col: str, col: str) -> DataFrame:
    in_small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(col))


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's ids as little-endian 32-bit integers.  Null is the empty text; every row gives a row."""
    return _rows(docs, id_col, text_col).mapInArrow(_encoded(path or public_path("byte_bpe_50k.json")), "id long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from what encode_texts returns."""
    return _rows(encoded, id_col, ids_col).mapInArrow(_decoded(path or public_path("byte_bpe_50k.json")), "id long, text string").withColumnRenamed("id", id_col)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests, in one pass.

    One row per row, null ids and repeated ones too; null is the empty text, which has no ids; texts of any length are
    read whole; an empty table gives no rows; other columns are ignored.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = _rows(load(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.mapInArrow(_digests(public_path("byte_bpe_50k.json")), schema).withColumnRenamed("id", "doc_id")
