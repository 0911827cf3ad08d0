"""Toxicity by noisy-channel deobfuscation.

Texts are restored first: a run of single characters is one chunk with optional word breaks, and a chunk with such
breaks, digits or symbols among its letters, or a letter repeated, becomes a lattice of what each character may stand
for.  Viterbi finds the likeliest reading under a character trigram model counted over the whole corpus; a chunk with
one reading only is that.  The restored words are then scored:
words and word beginnings whose share of toxic documents is high in a bounded sample of labelled rows, by more than
chance among so many candidates and in documents that aren't each other's copies, form the lexicon; a text's score
combines the distinct entries that it holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, fold, in_small_batches, load

#: Labelled rows of each class that the lexicon is learned from, which also bounds its size.
SAMPLE_PER_CLASS = 15_000
#: Prefix lengths of words that are entries beside whole words, least toxic documents and least share of an entry, and
#: the score from which a text is called toxic.
PREFIXES, LEAST, SHARE, THRESHOLD = range(3, 9), 4, 0.95, 0.7
#: Score of a text without any entry; independent toxic documents that an entry must occur in.
REST, SUPPORT = 0.02, 2.5
REMEMBERED = 300_000
#: Odd multipliers that make eight orders of words out of one hash.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(8)], np.uint64)
#: The letters that digits and symbols are used for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs, in nats, of reading a symbol as a letter, as a break between words, as nothing, and of dropping a repeat where
#: a letter stands three times or more, or twice, as it does in many words.
AS_LETTER, AS_BREAK, AS_NOTHING, DROP_REPEAT, DROP_DOUBLE = 1.0, 4.0, 2.5, 1.0, 5.0
#: Letters of the model: 0 is a word's edge, a to z, U+00DF to U+00FF, and one for all others.
LETTERS = 61
#: What stands for white space between single characters within a chunk: a break or nothing.
GAP = "\ue000"
SPACED = re.compile(r"(?<!\S)[\"'(«“„¿¡]?\S(?:\s+\S)+[.,;:?!)\"'»”…]*(?!\S)")
PLAIN = re.compile(r"[^\W\d_]+")
DOUBLE = re.compile(r"([^\W\d_])\1")
LONG_RUN = re.compile(rf"([^{GAP}])(?:{GAP}?\1){{3,}}")
WORD_ENDS = ".,;:?\"'()[]{}<>«»“”„…–—-_*#%&/\\~^=`"


def letter_codes() -> np.ndarray:
    """Code of each character below U+0250, lower-cased; others are told apart by isalpha."""
    out = np.zeros(0x250, np.int64)
    for c in range(0x250):
        low = chr(c).lower()[0]
        if "a" <= low <= "z":
            out[c] = ord(low) - 96
        elif 0xDF <= ord(low) <= 0xFF and low.isalpha():
            out[c] = 27 + ord(low) - 0xDF
        elif low.isalpha():
            out[c] = LETTERS - 1
    return out


CODES = letter_codes()


def code(c: str) -> int:
    return int(CODES[ord(c)]) if ord(c) < 0x250 else (LETTERS - 1) * c.isalpha()


def _trigrams(batches):
    total = np.zeros(LETTERS**3, np.int64)
    for b in batches:
        for text in b.column(0).to_pylist():
            chars = np.frombuffer((" " + (text or "") + " ").encode("utf-32-le"), np.uint32)
            for at in range(0, len(chars), 1 << 20):
                part = chars[at : at + (1 << 20) + 2]
                codes = np.where(part < 0x250, CODES[np.minimum(part, 0x24F)], LETTERS - 1)
                total += np.bincount((codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:], minlength=LETTERS**3)
    found = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a, b) over all texts, smoothed by lower orders; the counts that come back are bounded by the alphabet."""
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LETTERS**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    counts = counts.reshape((LETTERS,) * 3)
    one = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + LETTERS)
    pairs = counts.sum(axis=0)
    two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
    return np.log((counts + 5 * two) / (counts.sum(axis=2, keepdims=True) + 5))


class Restorer:
    """Reads chunks of text; `model` is what character_model returns."""

    def __init__(self, model: np.ndarray):
        self.logs = model.tolist()

    def chunk(self, chunk: str) -> str:
        """The words of a chunk between white space, in lower case and restored."""
        core = self._undecorated(chunk.lower().strip(WORD_ENDS))
        if not PLAIN.search(core) and not any(c in LEET for c in core):
            return ""
        if core.rstrip("!").isalpha():
            core = core.rstrip("!")
            if not DOUBLE.search(core):  # its only reading
                return core
        return self.viterbi(core)

    @staticmethod
    def _undecorated(core: str) -> str:
        """Without a run of three or more equal symbols at the end or the start."""
        while len(core) > 3 and not core[-1].isalnum() and core[-1] == core[-2] == core[-3]:
            core = core.rstrip(core[-1]).rstrip(WORD_ENDS)
        while len(core) > 3 and not core[0].isalnum() and core[0] == core[1] == core[2]:
            core = core.lstrip(core[0]).lstrip(WORD_ENDS)
        return core

    def viterbi(self, chunk: str) -> str:
        """The likeliest reading.  Texts are chains (rest, last character), so that time is linear in the chunk; of a
        character over three times in a row three are read."""
        chunk = LONG_RUN.sub(r"\1\1\1", chunk)
        logs, states = self.logs, {(0, 0): (0.0, (None, ""))}
        for c, drop in zip(chunk, drop_costs(chunk)):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}

            def reach(state: tuple[int, int], score: float, text: tuple) -> None:
                if state not in step or score > step[state][0]:
                    step[state] = (score, text)

            k = code(c)
            for (a, b), (score, text) in states.items():
                if k:
                    reach((b, k), score + logs[a][b][k], (text, c))
                    if text[1] == c:
                        reach((a, b), score - drop, text)
                    continue
                if c == GAP:
                    reach((a, b), score, text)
                    if b:
                        reach((b, 0), score + logs[a][b][0], (text, " "))
                    continue
                for x in LEET.get(c, ""):
                    reach((b, code(x)), score + logs[a][b][code(x)] - AS_LETTER, (text, x))
                    if text[1] == x:
                        reach((a, b), score - DROP_REPEAT - AS_LETTER, text)
                reach((a, b), score - AS_NOTHING, text)
                if b:
                    reach((b, 0), score + logs[a][b][0] - AS_BREAK, (text, " "))
            states = step
        text = max(((score + (logs[a][b][0] if b else 0.0), text) for (a, b), (score, text) in states.items()), key=lambda x: x[0])[1]
        out = []
        while text[0] is not None:
            out.append(text[1])
            text = text[0]
        return "".join(reversed(out)).strip()

    def text(self, text: str) -> str:
        """A whole text restored, words separated by single spaces."""
        return " ".join(filter(None, map(self.chunk, draw_together(text).split())))


def drop_costs(chunk: str) -> list[float]:
    """Of each character the cost of dropping it as a repeat, by how often it stands in a row, gaps aside."""
    out, at = [DROP_DOUBLE] * len(chunk), 0
    while at < len(chunk):
        end, same = at + 1, 1
        while end < len(chunk) and chunk[end] in (chunk[at], GAP):
            same += chunk[end] == chunk[at]
            end += 1
        if same > 2:
            out[at:end] = [DROP_REPEAT] * (end - at)
        at = end
    return out


def draw_together(text: str) -> str:
    """Runs of single characters between any white space become one chunk each, with gaps between them."""
    return SPACED.sub(lambda m: GAP.join(m[0].split()), text)


def entries(word: str) -> list[str]:
    """The lexicon entries that a word can match: itself, and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]


def _restored_chunks(text: str | None, restore: Restorer, known: dict) -> set[str]:
    out: set[str] = set()
    for chunk in set(draw_together(text or "").split()):
        found = known.get(chunk)
        if found is None:
            if len(known) > REMEMBERED:
                known.clear()
            found = known[chunk] = tuple(restore.chunk(chunk).split())
        out.update(found)
    return out


def _documents_with(model: np.ndarray, wanted: frozenset | None):
    def run(batches):
        restore, known, counts = Restorer(model), {}, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                found = {e for w in _restored_chunks(text, restore, known) for e in entries(w)}
                counts.update(found if wanted is None else found & wanted)
            if len(counts) > 4 * REMEMBERED:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])

    return run


def _entries_of(model: np.ndarray, wanted: frozenset):
    def run(batches):
        restore, known = Restorer(model), {}
        for b in batches:
            found, signatures = [], []
            for t in b.column(0).to_pylist():
                words = _restored_chunks(t, restore, known)
                found.append(sorted({e for w in words for e in entries(w)} & wanted))
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words] or [0], np.uint64)
                signatures.append([int((hashes * k).min() >> np.uint64(1)) for k in MULTIPLIERS])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array(signatures, pa.list_(pa.int64()))], names=["entries", "signature"])

    return run


class Lexicon:
    """Entries with the estimated share of toxic documents, and the share without any entry."""

    def __init__(self, shares: dict[str, float], rest: float):
        self.shares, self.rest = shares, rest

    @classmethod
    def learn(cls, docs: DataFrame, labels: DataFrame, model: np.ndarray, bound: int = SAMPLE_PER_CLASS) -> Lexicon:
        """From the texts of docs and labels (doc_id, toxic 0 or 1).  Labels are sampled before anything is joined, so
        what is broadcast is bounded and no text moves; the sample's texts are written once."""
        of, rates = bounded_sample(labels.where("toxic in (0, 1)"), "toxic", bound)
        texts = docs.select(F.col("doc_id").alias("id"), "text")
        sample = Scratch(docs.sparkSession, "toxic").keep(texts.join(F.broadcast(of.select(F.col("doc_id").alias("id"), "toxic")), "id").select("text", "toxic"), "sample")
        size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not size.get(1) or not size.get(0):
            return cls({}, 0.5 if not size else float(0 not in size))

        def counted(kind: int, wanted: frozenset | None) -> DataFrame:
            texts = sample.where(F.col("toxic") == kind).select("text")
            return texts.mapInArrow(_documents_with(model, wanted), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

        toxic = {r["entry"]: r["n"] for r in counted(1, None).where(F.col("n") >= LEAST).collect()}
        clean = {r["entry"]: r["n"] for r in counted(0, frozenset(toxic)).collect()}
        weight = rates[1][0] / rates[0][0]  # clean rows that a sampled clean row stands for, against toxic ones
        base = size[1] / (size[1] + size[0] * weight)
        shares, chance = {}, math.log(len(toxic) + 1) + 1
        for e, t in toxic.items():
            n = t + clean.get(e, 0) * weight
            p = (t + 0.5) / (n + 1)
            surprise = t * math.log(t / n / base) + (n - t) * math.log(max((1 - t / n) / (1 - base), 1e-300))
            if t / n >= SHARE and t / n > base and surprise >= chance:
                shares[e] = p
        shares = longest({e: toxic[e] for e in shares}, shares)
        held = sample.where("toxic = 1").select("text").mapInArrow(_entries_of(model, frozenset(shares)), "entries array<string>, signature array<long>").collect()  # bounded by the sample
        of: dict[str, list[list[int]]] = {}
        for r in held:
            for e in r["entries"]:
                of.setdefault(e, []).append(r["signature"])
        return cls({e: p for e, p in sorted(shares.items()) if independent(of.get(e, [])) >= SUPPORT}, REST)


def longest(counts: dict[str, int], shares: dict[str, float]) -> dict[str, float]:
    """Entries but for beginnings that hardly occur other than in one longer entry."""
    covered: dict[str, int] = {}
    for e, n in counts.items():
        word = e[1:] if e[0] == "=" else e
        for k in range(1, len(word) + (e[0] == "=")):
            covered[word[:k]] = max(covered.get(word[:k], 0), n)
    return {e: p for e, p in shares.items() if e[0] == "=" or covered.get(e, 0) < 0.95 * counts[e]}


def independent(signatures: list[list[int]]) -> float:
    """How many independent documents these are worth: copies and near copies, whose words agree, count as one."""
    n = len(signatures)
    if n < 2:
        return float(n)
    pairs = sum(k * (k - 1) for column in zip(*signatures) for k in Counter(column).values())  # that agree in a place
    return n / (1 + pairs / (len(signatures[0]) * n))


class Scorer:
    def __init__(self, model: np.ndarray, lexicon: Lexicon):
        self.restore, self.lexicon, self.seen, self.hits = Restorer(model), lexicon, set(), {}

    def _hit(self, chunk: str) -> tuple[str, ...]:
        """The best entry of each of the chunk's words."""
        shares, out = self.lexicon.shares, []
        for word in self.restore.chunk(chunk).split():
            found = [e for e in entries(word) if e in shares]
            if found:
                out.append(max(found, key=lambda e: (shares[e], len(e), e)))
        return tuple(out)

    def score(self, text: str | None) -> float:
        chunks = set(draw_together(text or "").lower().split())
        if len(self.seen) > REMEMBERED:
            self.seen, self.hits = set(), {}
        new = chunks - self.seen
        for chunk in new:
            if found := self._hit(chunk):
                self.hits[chunk] = found
        self.seen |= new
        clean = 1 - self.lexicon.rest
        for e in {e for chunk in self.hits.keys() & chunks for e in self.hits[chunk]}:
            clean *= 1 - min(self.lexicon.shares[e], 0.995)
        return 1 - clean


def _scored(model: np.ndarray, lexicon: Lexicon):
    def run(batches):
        scorer = Scorer(model, lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([scorer.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["id", "held_out", "score"])

    return run


def _restored(model: np.ndarray):
    def run(batches):
        restore = Restorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else restore.text(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "restored"])

    return run


def restore_texts(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored): every text as the scorer reads it."""
    in_small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(_restored(model), "id long, restored string").withColumnRenamed("id", id_col)


def learnable_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, toxic) outside the fold that is held out; of several labels of a document the highest counts."""
    return labels.where((fold(id_col, 3) != 1) & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def _passed(model: np.ndarray, lexicon: Lexicon, text_col: str, below: float):
    def run(batches):
        scorer = Scorer(model, lexicon)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([scorer.score(t) < below for t in texts], pa.bool_()))

    return run


def kept(docs: DataFrame, model: np.ndarray, lexicon: Lexicon, text_col: str = "text", below: float = THRESHOLD) -> DataFrame:
    """Rows of docs that aren't predicted toxic, all columns as they are."""
    in_small_batches(docs.sparkSession)
    return docs.mapInArrow(_passed(model, lexicon, text_col, below), docs.schema)


def score_toxicity(docs: DataFrame, model: np.ndarray, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, score, predicted.

    Null and empty texts get the score of a text without any entry; without usable labels every text gets one score.
    Texts of any length are read whole.  Repeated rows are returned each, a null id isn't held out, an empty table gives
    no rows; other columns are ignored.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(fold(id_col, 3) == 1, F.lit(False)).alias("held_out"))
    scored = rows.mapInArrow(_scored(model, lexicon), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Lexicon]:
    model = character_model(docs)
    return model, Lexicon.learn(docs, learnable_labels(labels), model)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_toxicity(docs, *fit(docs, load(spark, sf_dir, "labels")))
