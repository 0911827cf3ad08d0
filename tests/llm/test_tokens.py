"""Encoders against the tokenizers library, files against what was written, piece counts against greedy cutting."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import bpe, huffman_ids, token_counts
from foliomill.llm.tokens import by_library, byte_level, library, public_path, word_level

BYTES, WORDS = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
ODD = ["", " ", "\n\n a  b", "don't 'tis I'S !'s 12³ a_b __x ½ ª º µ ß İ ŉ ǅ x", "<|endoftext|> x <|startoftext|>", "naïve CAFÉ's 3.14", "Ǆ ΑΣ Σ", "a\xa0b\x85c\x1cd", "é é 漢字 😀 　x", "a" * 5000, " " * 300 + "x", "er" * 2000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert bpe.codec(BYTES).encode(text).tolist() == by_library(BYTES, text)
    assert byte_level(BYTES).encode(text).tolist() == by_library(BYTES, text)
    assert word_level(WORDS).encode(text).tolist() == by_library(WORDS, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("aeinrst  \n\t'.1é")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    c = bpe.codec(BYTES)
    ids = c.encode(text)
    assert ids.tolist() == by_library(BYTES, text)
    assert c.decode(ids) == library(BYTES).decode(ids.tolist(), skip_special_tokens=False)
    assert word_level(WORDS).encode(text).tolist() == by_library(WORDS, text)


def test_any_ids_decode_alike():
    c, rng = bpe.codec(BYTES), np.random.default_rng(0)
    for _ in range(50):
        ids = rng.integers(0, 50257, 20)
        assert c.decode(ids) == library(BYTES).decode(ids.tolist(), skip_special_tokens=False)
        assert c.digits(ids) == ",".join(map(str, ids.tolist())).encode()


def test_codec_round_trip(docs, empty):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    back = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert {r["doc_id"]: r["text"] for r in back} == texts and len(back) == docs.count()
    assert bpe.encode_texts(empty).count() == 0


def test_codec_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in bpe.op7_bpe_codec(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, r = by_library(BYTES, d["text"] or ""), rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=60))
def test_code_lengths_are_a_full_code_within_the_limit(counts):
    bits = huffman_ids.code_lengths(np.array(counts), 7)
    assert bits.max() <= 7 and (len(counts) == 1 or sum(2.0 ** -b for b in bits.tolist()) == 1.0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=40), max_size=12), st.integers(1, 9))
def test_codes_round_trip(lists, block):
    ids = np.array([x for xs in lists for x in xs], np.int64)
    sizes = np.array(list(map(len, lists)), np.int64)
    book = huffman_ids.CodeBook(huffman_ids.code_lengths(np.bincount(ids, minlength=1)))
    stream, starts, marks = book.encode(ids, sizes, block)
    points = np.concatenate([*(m + np.uint64(8 * a) for m, a in zip(marks, starts.tolist())), np.empty(0, np.uint64)])
    assert book.decode(stream, points, huffman_ids.block_counts(sizes, block)).tolist() == ids.tolist()


def test_files_round_trip(spark, docs, empty, tmp_path):
    for frame, name, block, segment in ((docs, "a", 64, 500), (docs, "b", 256, 1 << 20), (empty, "c", 256, 1 << 20)):
        folder = f"file://{tmp_path}/{name}"
        huffman_ids.write_token_files(frame, folder, block=block, segment_ids=segment)
        found = huffman_ids.read_token_files(spark, folder, block=block).orderBy("start").collect()
        rows = frame.collect()
        assert len(found) == len(rows)
        assert [r["doc_id"] for r in found] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i))
        at = 0
        for r in found:
            assert r["start"] == at
            at += r["n_tokens"]
        texts = {r["doc_id"]: r["text"] for r in rows}
        for r in found:
            ids = [*by_library(WORDS, texts[r["doc_id"]] or ""), 2]
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids


def test_files_query(spark, sf_dir):
    found, at = {r["doc_id"]: r for r in huffman_ids.op10_huffman_ids(spark, sf_dir).collect()}, 0
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids, r = np.array([*by_library(WORDS, d["text"] or ""), 2], "<u4"), found[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def greedy(beginning, continuing, word):
    at = n = 0
    while at < len(word):
        pieces = continuing if at else beginning
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_piece_counts_are_greedy_ones():
    rng = random.Random(1)
    for _ in range(500):
        make = lambda: ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))]
        b, c = make(), make()
        m = token_counts.LongestMatch(b, c)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert m.count(word) == greedy(set(b), set(c), word)


def test_counts_of_a_table(docs, empty):
    found = token_counts.count_tokens(docs)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_words"]) for r in found.collect()) == plain_counts(docs)
    assert token_counts.count_tokens(empty).count() == 0


def plain_counts(docs):
    b, c = map(set, token_counts.piece_vocabulary(public_path("piece_bpe_32k.model")))
    known = {}
    count = lambda w: known.setdefault(w, max(1, greedy(b, c, w)))
    return sorted((str(r["doc_id"]), sum(map(count, (r["text"] or "").split())), len((r["text"] or "").split())) for r in docs.collect())


def test_counts_query(spark, sf_dir):
    found = token_counts.op4_token_counts(spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_words"]) for r in found) == plain_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
