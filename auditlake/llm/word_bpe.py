"""Token ids of a lower-casing word BPE, each different word encoded once per worker.

The tokenizer's file sets the ids; nothing is trained here.  Texts of plain
characters are cut at white space, and new words into runs of letters, digits and signs as the
tokenizer cuts them; looked up word by word this gives the same ids as the tokenizer itself
because it never joins characters across pieces.  All other texts go through the tokenizer as they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from functools import lru_cache

#: Words, and pieces of words, kept per worker; beyond it a store starts anew, which changes speed only.
STORE_WORDS = 300_000

_LETTERS = "".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L")
_DIGITS = "".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "N")
#: Fixed value: how the vocabulary's file cuts text, for characters below U+0300.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
#: Characters whose case, form or class needs the tokenizer's own rules, and spelled-out special tokens.
_SPECIAL = re.compile("[\x1c-\x1f\x85\xa0İ̀-\U0010ffff]|<\\|")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write byte b as a printable character: itself, or the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _is_special(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_SPECIAL.search(text))
    return any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "<|"))


class WordBpe:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.store: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= STORE_WORDS:
                self.pieces = {}
            found = self.pieces[piece] = self._packed([x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        return found

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        if word[:-1].isalpha():  # a word and one sign or digit
            return self._piece(word[:-1]) + self._piece(word[-1])
        return b"".join(map(self._piece, _PIECES.findall(word)))

    def encode(self, text: str) -> bytes:
        if _is_special(text):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words, store = text.lower().split(), self.store
        new = set(words).difference(store)
        if new:
            if len(store) + len(new) > STORE_WORDS:
                store = self.store = {}
                new = set(words)
            for w in new:
                store[w] = self._word(w)
        return b"".join(map(store.__getitem__, words))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
