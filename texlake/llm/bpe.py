"""Token ids of whole texts by the tokenizers library, with a memory of the pieces between single blanks."""

from __future__ import annotations

import codecs
import gc
import os
import re
from array import array

import numpy as np

from .common import fresh_worker, worker_cache

#: Pre-tokens of a piece without white space but a leading blank, where it has only these letters and ASCII.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(f"[\x21-\x7e{_LETTERS}]+")
#: A comma or full stop that doesn't follow a letter or number. It is looked for before what it follows, which is faster.
_LOOSE = re.compile(r"[,.](?<![^\W_].)")
#: What a text that is cut at blanks and line feeds must not have: runs of them, or the separator.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\x1f")
#: Pre-tokens of such pieces, also of many at once between unit separators, which no such piece has.
_PARTS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ 0-9{_LETTERS}\x1f]+|\x1f")
_ALL_PLAIN = re.compile(f" ?[\x21-\x7e{_LETTERS}]+(?:\x1f ?[\x21-\x7e{_LETTERS}]+)*+")


def _byte_chars() -> str:
    """The printable character by which a byte-level vocabulary writes each byte, but the two separators as themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)} | {0x1E: "\x1e", 0x1F: "\x1f"}
    return "".join(chars[b] for b in range(256))


class PieceEncoder:
    """Ids of texts as ``encode(text, add_special_tokens=False)`` gives them.

    A byte-level BPE never merges over the borders of its pre-tokens, and a single blank or line feed between
    other characters always begins one. So a text is cut there, each different piece is encoded once by the
    library, and its ids are looked up for every later place. Texts with runs of white space, or other white space, go to the library whole. ``most``
    bounds the memory: when half of it is full, what has not been asked for since the half before it goes.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.chars, self.model, self.code = _byte_chars(), self.tokenizer.model, "H" if self.kind.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> bool:
        """Take the ids of pieces into ``known``, unless one has other white space: then the text can't be cut.

        Those that are plain need the model alone, and are cut and written together.
        """
        text = "\x1f".join(new)
        if not _ALL_PLAIN.fullmatch(text) or any(s in text for s in self.special):
            plain, others = [], []
            for piece in new:
                (plain if _PLAIN.fullmatch(piece, piece[:1] == " ") and not any(s in piece for s in self.special) else others).append(piece)
            if any(p != "\n" and p.removeprefix(" ").split() != [p.removeprefix(" ")] for p in others):
                return False
            for piece in others:
                self.known[piece] = self._library(piece)
            new, text = plain, "\x1f".join(plain)
        if new:
            written = codecs.charmap_decode("\x1e".join(_PARTS.findall(text)).encode(), "strict", self.chars)[0]
            known, tokenize, code = self.known, self.model.tokenize, self.code
            for piece, parts in zip(new, written.split("\x1e\x1f\x1e")):
                known[piece] = array(code, [t.id for part in parts.split("\x1e") for t in tokenize(part)]).tobytes()
        return True

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        if text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS):
            return np.frombuffer(self._library(text), self.kind)
        cut = text if _LOOSE.search(text) else text.replace(",", "\x1f,").replace(".", "\x1f.")
        pieces = cut.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")
        ids = list(map(self.known.get, pieces))
        if None in ids:
            if 2 * len(self.known) >= self.most:
                self.older, self.known = self.known, {}
            gc.disable()  # many small objects, no cycles
            try:
                older, known, new, asked = self.older, self.known, {}, []
                for k, x in enumerate(ids):
                    if x is None:
                        asked.append(k)
                        piece = pieces[k]
                        x = older.get(piece)
                        if x is None:
                            new[piece] = None
                        else:
                            known[piece] = x
                if new and not self._learn(list(new)):
                    return np.frombuffer(self._library(text), self.kind)
                for k in asked:
                    ids[k] = known[pieces[k]]
            finally:
                gc.enable()
        return np.frombuffer(b"".join(ids), self.kind)


_encoders: dict[tuple[str, int], PieceEncoder] = worker_cache()

#: Pieces that an encoder remembers: some 130 bytes each.
MOST = 600_000


def encoder(path: str, most: int = MOST) -> PieceEncoder:
    """This worker's encoder for a vocabulary file, kept between tasks."""
    if (path, most) not in _encoders:
        fresh_worker()
        _encoders[path, most] = PieceEncoder(path, most)
    return _encoders[path, most]
