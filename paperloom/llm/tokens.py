"""Token ids of whole texts by the ``tokenizers`` library, with a cache of pieces that can be encoded apart."""

from __future__ import annotations

import gc
import re
import sys
from array import array

from paperloom.llm.common import worker_cache

#: Pieces that a worker remembers, some 200 bytes each; then it forgets all and goes on.
REMEMBERED = 800_000
_FITS = sys.byteorder == "little" and array("I").itemsize == 4
#: Letters that are one pre-token: composed, and lower-cased one by one.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153]+"
_letters = re.compile(_LETTERS).fullmatch
#: Such letters and the marks behind them, without an apostrophe, are two.
_marked = re.compile(f"(\0?{_LETTERS})([!-&(-/:-@[-`{{-~]+)").fullmatch
#: Byte-level BPE's characters of the bytes that aren't their own.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str, remember: int = REMEMBERED) -> PieceEncoder:
    """One for each worker process; its cache outlives a task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = {"byte": ByteEncoder, "word": WordEncoder}[kind](path)
    _encoders[path, kind].remember = remember
    return _encoders[path, kind]


def _little(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _FITS else b"".join(i.to_bytes(4, "little") for i in ids)


class _Known(dict[str, bytes | None]):
    """What an encoder remembers; a piece that isn't here is found as it is asked for."""

    def __init__(self, owner: PieceEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes | None:
        return self.keep(piece, self.owner.find(piece))

    def keep(self, piece: str, ids: bytes | None) -> bytes | None:
        if len(self) >= self.owner.remember:
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """Ids as little-endian 32-bit bytes, the same as the library gives for the whole text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.remember = REMEMBERED
        self.tokenize = self.tokenizer.model.tokenize
        self.known = worker_cache(_Known(self))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [_little(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, piece: str) -> tuple[str, ...] | None:
        """Smaller pieces that give the same ids one after the other; itself if there are none; None if it can't stand alone."""
        raise NotImplementedError

    def as_text(self, piece: str) -> str:
        return piece

    def as_word(self, piece: str) -> str | None:
        """The one pre-token of a piece of letters, before its bytes become characters; None for other pieces."""
        raise NotImplementedError

    def find(self, piece: str) -> bytes | None:
        if (cut := self.parts(piece)) is None:
            return None
        return self._alone(piece) if cut == (piece,) else b"".join(map(self._part, cut))

    def _part(self, piece: str) -> bytes:
        if (found := self.known.get(piece)) is None:
            found = self.known.keep(piece, self._alone(piece))
        return found

    def _alone(self, piece: str) -> bytes:
        """By the library's model alone where nothing is left to do for the steps before it."""
        if (word := self.as_word(piece)) is None:
            return self.encode_batch([self.as_text(piece)])[0]
        return _little([x.id for x in self.tokenize(word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(_BYTES))])

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, texts: list[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # many short-lived tuples, no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        get, out = self.known.__getitem__, []
        for text in texts:
            try:
                out.append(b"".join(map(get, self.pieces(text or ""))))
            except TypeError:  # a piece that can't stand alone
                out.append(self.encode_batch([text or ""])[0])
        return out


class ByteEncoder(PieceEncoder):
    """Byte-level BPE whose pre-tokens are a run of white space, or a word with the one space before it.

    A space after a character that isn't white space starts a pre-token, so the text may be cut there. A piece is kept
    without its space; the first, which has none, is marked by a NUL. A piece that is empty or ends in white space
    may be one pre-token with what follows: such texts, and those that hold a NUL or U+0001, go to the library whole.
    """

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if "\0" in text or "\1" in text:
            return [""]
        out = text.split(" ")
        out[0] = "\0" + out[0]
        return out

    def as_text(self, piece: str) -> str:
        return piece[1:] if piece[0] in "\0\1" else " " + piece

    def as_word(self, piece: str) -> str | None:
        if piece[0] in "\0\1":
            return piece[1:] if _letters(piece, 1) else None
        return " " + piece if _letters(piece) else None

    def parts(self, piece: str) -> tuple[str, ...] | None:
        if not piece or not piece[-1].isprintable() or piece[-1].isspace():
            return None
        left, feed, right = piece.partition("\n")
        if feed and len(left) > 1 and right and left[-1] in ".," and right[0].isalpha():
            after = self.parts("\0" + right)
            return None if after is None else (*self.parts(left), "\1\n", *after)
        if both := _marked(piece):
            return both[1], "\0" + both[2]
        # a letter and the one mark behind it are pre-tokens of their own
        return (piece[:-1], "\0" + piece[-1]) if piece[-1] in ".," and len(piece) > 1 and piece[-2].isalpha() else (piece,)


class WordEncoder(PieceEncoder):
    """BPE with word ends that drops white space: pieces between spaces and line ends stand alone."""

    def pieces(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def as_word(self, piece: str) -> str | None:
        return piece.lower() if _letters(piece) else None

    def parts(self, piece: str) -> tuple[str, ...] | None:
        if piece.isascii():  # of other texts a letter's lower case may hang on its neighbours
            piece = piece.lower()
        if both := _marked(piece):
            return both.groups()
        # a letter and the one mark behind it are pre-tokens of their own; the lower case of \u0130 doesn't end in a letter
        return (piece[:-1], piece[-1]) if piece[-1:] in {".", ","} and piece[-2:-1].lower().isalpha() else (piece,)
