"""Tokenizing whole texts with public tokenizer files, exactly and with a bounded piece cache.

A text is cut into pieces at places where the tokenizer's own pre-tokenizer always
cuts and where the ids on either side do not depend on the other side; pieces are
encoded by the tokenizers library and kept, as little-endian 32-bit ids, in a bounded
cache.  Texts for which that is not certain are encoded whole.  `tests/llm` holds the
result against the library on whole texts.
"""

from __future__ import annotations

import functools
import gc
import itertools
import os
import re

import numpy as np

#: White space other than blank and line feed, and U+180E, on which libraries differ: such texts are encoded whole.
_ODD = [chr(c) for c in (0x00, 0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: White space beside white space: the byte pre-tokenizer may keep both together.
_BESIDE = ("  ", " \n", "\n ", "\n\n")
#: A stop after anything but a letter or digit: the pre-tokenizer may keep both together.
_STOP_AFTER_SIGN = re.compile(r"[.,](?<![^\W_].)")


def _plain(text: str) -> bool:
    return not any(c in text for c in _ODD) and "<|" not in text


def _cut_stops(cut: str, text: str) -> str:
    """Also cut before a stop that ends a piece."""
    if _STOP_AFTER_SIGN.search(text):
        return cut
    return cut.replace(",\0", "\0,\0").replace(".\0", "\0.\0")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of whole texts as bytes; `kind` is "word" (lower case, white space dropped) or "byte" (GPT-2 splitting)."""

    def __init__(self, path: str, kind: str, room: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.room = kind, room
        self.known: dict[str, bytes] = {"": b""}

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _byte_pieces(self, text: str) -> list[str] | None:
        """Pieces that keep their leading blank; None where white space stands beside white space."""
        if not _plain(text) or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _BESIDE):
            return None
        return _cut_stops(text.replace(" ", "\0 ").replace("\n", "\0\n\0") + "\0", text).split("\0")

    def _word_pieces(self, text: str) -> list[str] | None:
        if not _plain(text):
            return None
        try:
            text.encode("latin-1")  # in this range Python and the tokenizer lower-case alike
        except UnicodeEncodeError:
            pass
        else:
            text = text.lower()
        return _cut_stops(text.replace(" ", "\0").replace("\n", "\0") + "\0", text).split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text (null: empty) its ids as little-endian unsigned 32-bit integers."""
        collects = gc.isenabled()
        gc.disable()  # the cache is all small live objects; walking them again and again frees nothing
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut = self._word_pieces if self.kind == "word" else self._byte_pieces
        size, held = 0, []
        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = cut(text)
            if pieces is None:
                out[i] = self._direct([text])[0]
                continue
            held.append((i, pieces))
            size += len(pieces)
            if size > 200_000:
                self._flush(held, out)
                size, held = 0, []
        self._flush(held, out)
        return out

    def _flush(self, held: list, out: list) -> None:
        if len(self.known) > self.room:  # the older half goes
            self.known = {"": b""} | dict(itertools.islice(self.known.items(), self.room // 2, None))
        seen: set[str] = set()
        for _, pieces in held:
            seen.update(pieces)
        new = list(seen.difference(self.known))
        if new:
            self.known.update(zip(new, self._direct(new), strict=True))
        get = self.known.__getitem__
        for i, pieces in held:
            out[i] = b"".join(map(get, pieces))


@functools.lru_cache(maxsize=4)
def encoder(path: str | None, name: str, kind: str, room: int = 1_200_000) -> Encoder:
    """One encoder per Python worker, kept between tasks: each of up to `room` pieces takes about 200 bytes of its memory."""
    return Encoder(path or default_path(name), kind, room)
