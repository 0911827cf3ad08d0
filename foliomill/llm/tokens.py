"""Token ids as the tokenizers library gives them, from public vocabulary files.

`ByteLevel` and `WordLevel` return the ids of `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`,
truncation and padding unused.  They let tiktoken do the merges, which is several times faster, and hand any text
outside what the two agree on (special tokens' strings, unusual characters) to the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np


def public_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def byte_alphabet() -> dict[str, int]:
    """Character to byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What a byte-pair file holds: bytes of each id, merges as id pairs, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take in their neighbourhood aren't supported")
        self.ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        self.size = max([*model["vocab"].values(), *self.special.values()]) + 1

        def plain(token: str) -> tuple[bytes, bool]:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            return bytes(alphabet[c] for c in (token[: -len(self.suffix)] if ends else token)), ends

        self.tokens = {i: plain(t) for t, i in self.ids.items()}


@lru_cache
def library(path: str):
    """The tokenizers library's own tokenizer, as read from the file but for truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def by_library(path: str, text: str) -> list[int]:
    return library(path).encode(text, add_special_tokens=False).ids


class ByteLevel:
    """Ids under a byte-level vocabulary without word ends."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        v = Vocabulary(path)
        self.path, self.special = path, re.compile("|".join(map(re.escape, v.special)) or r"(?!)")
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, (b, _) in v.tokens.items()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not self.special.search(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
            except BaseException as e:  # the pattern engine gives up on some endless runs, with a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(by_library(self.path, text), np.uint32)


def _latin() -> tuple[np.ndarray, re.Pattern]:
    """Which characters below U+0250 the libraries may treat differently when lower-casing, normalising or classing
    them; and the pattern of what stands apart from letters: contractions, single digits, runs of other signs."""
    chars = list(map(chr, range(0x250)))
    kind = list(map(unicodedata.category, chars))
    unusual = [k in ("Cc", "Lt", "Cn") and c not in "\n\r\t" or c in "\xa0\xadİŉǰ" or len(c.lower()) > 1 or k[0] == "M" for c, k in zip(chars, kind)]
    digits = "".join(c for c, k in zip(chars, kind) if k[0] == "N")
    signs = "".join(c for c, k in zip(chars, kind) if k[0] in "PS")
    return np.array(unusual), re.compile(f"('(?:s|t|re|ve|m|ll|d)|[{digits}]|[{re.escape(signs)}]+)")


UNUSUAL, BREAKS = _latin()


class WordLevel:
    """Ids under a lower-cased vocabulary whose words end in a suffix; white space is dropped.

    A word's end is written as a space, which no token holds, so one merge table serves both kinds of token.
    """

    def __init__(self, path: str):
        import tiktoken

        v = Vocabulary(path)
        self.path = path
        ranks = {b + b" " * ends: i for i, (b, ends) in v.tokens.items()}
        self.fast = tiktoken.Encoding("own", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        if len(codes) and (codes.max() >= len(UNUSUAL) or UNUSUAL[codes].any()) or "<|" in text:
            return np.array(by_library(self.path, text), np.uint32)
        words = " ".join(BREAKS.split(text.lower())).replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return self.fast.encode_to_numpy(words + " ", allowed_special=set(), disallowed_special=())


@lru_cache
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache
def word_level(path: str) -> WordLevel:
    return WordLevel(path)
