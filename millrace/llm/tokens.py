"""Token ids of whole texts, equal to what the tokenizers library gives for the text as one.

Texts are cut into pieces at places no token crosses, and the ids of a piece are kept in a table of
bounded size, so the library sees each frequent piece once per worker.

* Plain texts (Latin letters whose lower case and composed form do not depend on their neighbours) are
  lower-cased and cut by the pre-tokenizer's own pattern.
* Other texts are cut at white space, which that pre-tokenizer drops.
* Texts with control characters that only one side counts as white space go to the library as they are.

This holds for tokenizer files whose pre-tokenizer drops white space and splits by ``PATTERN``;
``word_bpe_49k.json`` is one. ``Encoder(path, exact=True)`` makes no assumption and encodes texts whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

# fixed values: letters and digits up to U+017F after lower-casing, and the tokenizer's splitting pattern over them
LETTERS = "a-zªµºß-öø-ÿĀ-ſ"
NUMBERS = "0-9²³¹¼-¾"
PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\u012f\\u0131-\\u017f]*")
ODD = re.compile("[\\x1c-\\x1f]")
SPECIAL = "<|"


class Table(dict):
    """Text to its ids as bytes, worked out when first asked for.

    Two generations bound a worker's memory: a full table becomes the older one, and what is still asked
    for moves over, so frequent texts are never worked out anew.
    """

    def __init__(self, work_out, limit: int = 300_000, longest: int = 64):
        self.work_out, self.limit, self.longest, self.older = work_out, limit, longest, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.work_out(text)
        if len(text) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned ids, of two bytes where the vocabulary allows it."""

    def __init__(self, path: str, exact: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.exact = Tokenizer.from_file(path), exact
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letter = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces = Table(self.whole)

    def whole(self, text: str) -> bytes:
        ids = array(self.letter, self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a whole text."""
        if self.exact or ODD.search(text):
            return self.whole(text)
        if SPECIAL not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, PATTERN.findall(text.lower())))
        return b"".join(map(self.pieces.__getitem__, text.split()))


    def many(self, texts: Iterable[str], at_once: int = 1 << 22) -> Iterator[bytes]:
        """The ids of each text, in order. New pieces of about ``at_once`` characters are worked out together, which is quicker."""
        held, size = [], 0
        for text in texts:
            plain = not (self.exact or ODD.search(text)) and SPECIAL not in text and PLAIN.fullmatch(text)
            held.append((plain, PATTERN.findall(text.lower()) if plain else text))
            size += len(text)
            if size >= at_once:
                yield from self.held(held)
                held, size = [], 0
        yield from self.held(held)

    def held(self, texts: list) -> Iterator[bytes]:
        ids = self.pieces.__getitem__
        new = set().union(*(found for plain, found in texts if plain)).difference(self.pieces)
        for piece in sorted(new):
            ids(piece)
        for plain, found in texts:
            yield b"".join(map(ids, found)) if plain else self(found)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)
