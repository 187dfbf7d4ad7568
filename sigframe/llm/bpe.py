"""Byte-level BPE with the whole-token shortcut.

A vocabulary string is *whole* when the tokenizer, given that string alone,
returns exactly that one id.  ``Encoder`` proves this once for every vocabulary
string that is text: words of any script, with and without a space before them,
numbers, punctuation and runs of white space.  A count cuts the text into its
pre-tokens, counts those that are whole, and merges only the others, which encode
on their own because merges never cross a pre-token.

Where every character is Latin or general punctuation, the libraries' character
classes agree, and pre-tokens are cut by the pattern and merged by tiktoken over
the same vocabulary as ranks; any other text is cut and merged by the parts of
``tokenizers`` that do so.  Special strings are cut out first, as ``tokenizers``
does by default.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

#: The byte-level pre-token pattern, and the same for texts
#: without two white-space characters in a row (no look-ahead is needed there).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

_ADJACENT = re.compile(r"\s\s")
_OTHER = re.compile("[^\x00-ɏ‐-‧€]")


class Encoder:
    """``ids`` and ``count`` equal to ``tokenizers`` with
    ``add_special_tokens=False``, no truncation and no padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, special = spec["pre_tokenizer"], spec["added_tokens"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE without normalizer and prefix space is expected")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special):
            raise ValueError("added tokens that strip or match whole words are not supported")
        self.special = {t["content"]: t["id"] for t in special}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.vocab = {n: i for n, i in spec["model"]["vocab"].items() if n not in self.special}
        self.bytes_of = self._bytes()
        self._rankers()
        self.words = regex.compile(PATTERN).findall
        self._whole: tuple[frozenset[str], frozenset[str]] | None = None
        self._known: dict[str, int] = {}

    def _bytes(self) -> dict[str, bytes]:
        """Vocabulary string -> the bytes that its letters stand for."""
        from tokenizers import pre_tokenizers

        letters = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
        own = [x for x in letters if ord(x) < 256]
        moved = [b for b in range(256) if chr(b) not in set(own)]
        byte = {x: ord(x) for x in own} | dict(zip([x for x in letters if ord(x) > 255], moved, strict=True))
        return {n: bytes(byte[x] for x in n) for n in self.vocab}

    def _rankers(self) -> None:
        from tiktoken import Encoding

        ranks = {self.bytes_of[n]: i for n, i in self.vocab.items()}
        self.full, self.single = (
            Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            for name, p in (("full", PATTERN), ("single", SINGLE)))

    @property
    def whole(self) -> tuple[frozenset[str], frozenset[str]]:
        """The vocabulary strings that encode alone as one token: as text, and in the
        vocabulary's byte letters."""
        if self._whole is None:
            texts = {}
            for n, b in self.bytes_of.items():
                try:
                    texts[n] = b.decode()
                except UnicodeDecodeError:  # a part of a character is never a pre-token
                    continue
            got = self.tok.encode_batch(list(texts.values()), add_special_tokens=False)
            names = [n for n, e in zip(texts, got, strict=True) if e.ids == [self.vocab[n]]]
            self._whole = frozenset(texts[n] for n in names), frozenset(names)
        return self._whole

    def _merge(self, text: str) -> list[int]:
        if not text.isascii() and _OTHER.search(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.full(text) if _ADJACENT.search(text) else self.single(text)

    def _parts(self, text: str) -> list[str]:
        """Alternating plain texts and special strings."""
        if self.cut is None or not any(n in text for n in self.special):
            return [text]
        return self.cut.split(text)

    def ids(self, text: str | None) -> np.ndarray:
        out: list[int] = []
        for k, part in enumerate(self._parts(text or "")):
            out += [self.special[part]] if k % 2 else self._merge(part)
        return np.array(out, dtype=np.uint32)

    def counts(self, text: str | None) -> tuple[int, int]:
        """Tokens that are whole pre-tokens, or special, and tokens merged from the other pre-tokens."""
        as_text, as_names = self.whole
        direct = merged = 0
        for k, part in enumerate(self._parts(text or "")):
            if k % 2:
                direct += 1
                continue
            if part.isascii() or not _OTHER.search(part):
                pre = self.words(part)
                rest = [w for w in pre if w not in as_text]
                merged += sum(map(self._merged, rest))
            else:
                pre = [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]
                rest = [w for w in pre if w not in as_names]
                merged += sum(len(self.tok.model.tokenize(w)) for w in rest)
            direct += len(pre) - len(rest)
        return direct, merged

    def count(self, text: str | None) -> int:
        return sum(self.counts(text))

    def _merged(self, word: str) -> int:
        n = self._known.get(word)
        if n is None:
            n = len(self.full(word))
            if len(word) <= 64:  # a cache of bounded size, for speed alone
                if len(self._known) >= 200_000:
                    self._known.clear()
                self._known[word] = n
        return n


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
