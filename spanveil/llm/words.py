"""Token ids of whole texts, one lookup for each word.

A tokenizer whose pre-tokens never hold white space gives the same ids for a text as for its
words in turn.  So each distinct word is encoded once and looked up after that.  Words of common
letters, digits and signs are cut into pre-tokens here, and each distinct pre-token goes to the
library's byte-pair model; all other words, and texts with characters on which Python and the library disagree about
white space, go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Characters at which str.split() cuts but the tokenizer's \s may not.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")
#: Words longer than this aren't kept.
LONG_WORD = 64
#: Longer texts are looked up in parts, cut at white space.
PART = 1 << 20
#: Words that are cut here, and how the tokenizer's file says they are cut.
COMMON = re.compile(r"[!-~À-ÖØ-öø-įĴ-ň]+")
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ň]+|[0-9]|[!-/:-@\[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes. keep: the most words of either generation remembered at a time."""

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_bytes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.keep = keep
        self.words, self.older = {}, {}
        self.tokens: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drops the words remembered so far."""
        self.words, self.older, self.tokens = {}, {}, {}

    def _library(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _token(self, token: str) -> bytes:
        written = token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
        as_bytes = self.as_bytes
        found = b"".join([as_bytes[t.id] for t in self.model.tokenize(written)])
        if len(self.tokens) > self.keep:
            self.tokens.clear()
        if len(token) <= LONG_WORD:
            self.tokens[token] = found
        return found

    def _new(self, word: str) -> bytes:
        found, tokens = self.older.get(word), self.tokens
        if found is None and word.isascii():
            # the usual forms: letters, or letters and a mark
            if word.isalpha():
                token = word.lower()
                found = tokens.get(token) or self._token(token)
            elif word[-1] in ".,;:!?" and word[:-1].isalpha():
                token = word[:-1].lower()
                found = (tokens.get(token) or self._token(token)) + (tokens.get(word[-1]) or self._token(word[-1]))
        if found is None:
            if COMMON.fullmatch(word) and not ("<|" in word and any(s in word for s in self.specials)):
                found = b"".join([tokens.get(t) or self._token(t) for t in PRETOKEN.findall(word.lower())])
            else:
                found = self._library(word)
        if len(word) <= LONG_WORD:
            if len(self.words) > self.keep:
                self.words, self.older = {}, self.words
            self.words[word] = found
        return found

    def _part(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACES):
            return self._library(text)
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            for k, b in enumerate(found):
                if b is None:
                    found[k] = self.words.get(words[k]) or self._new(words[k])
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if len(text) <= PART:
            return self._part(text)
        out, at = [], 0
        while at < len(text):
            end = at + PART
            if end < len(text):
                cuts = [text.rfind(c, at, end) for c in " \n"]
                # without white space in reach the part grows to the next one
                ends = [i for c in " \n" if (i := text.find(c, end)) >= 0]
                end = max(cuts) if max(cuts) > at else min(ends, default=len(text))
            out.append(self._part(text[at:end]))
            at = end
        return b"".join(out)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)
