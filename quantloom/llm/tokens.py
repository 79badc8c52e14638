"""Whole texts to ids of a public tokenizer, with a bounded cache of words in each Python worker.

A byte-pair tokenizer never joins across the start of a word, so a text's ids are the joined ids of its
words. Both encoders cut texts only at spaces where that is certain, look each distinct word of a batch up in a cache
and give what is new to the tokenizers library; anything unusual (other white space runs, other scripts, special-token
strings) goes to the library whole.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import hashing

#: Bytes of text whose words are looked up at once.
PART = 8 << 20
#: Cached words and pieces of a worker; what comes later is encoded each time. Of words that only put cached pieces together fewer stay.
CACHE, JOINED = 600_000, 300_000
#: Text that lower-cases letter by letter and has no white space, apostrophe or "<" (special-token strings).
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~]+")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LOWER = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SPACED = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
#: Marks that often end a word and are a piece of their own after letters.
_ENDS = frozenset(".,;:!?")
#: Texts (for Arrow) that go to the library whole: with "\0", which stands in keys; where only spaces are cut, with special-token strings or with
#: three white-space characters, or two at the end, where a cut could part what belongs together.
_WHOLE = {True: r"\x00", False: r"\x00|<\||[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}(?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"}
#: Texts that can't be lower-cased as a whole: special-token strings, and what isn't Latin-1, where each letter has one lower-case letter.
_AS_IS = r"<\||[^\x{0}-\x{ff}]"
#: The key of the end of a text, which no word can be.
_END = "\n\n"


def path(name: str) -> str:
    """Where a public tokenizer's file lies; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _bytes_table() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in keep}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(keep)))
    return table


class _Words(dict):
    """Ids of words, asked of `new` where they aren't known yet."""

    def __init__(self, new):
        self.new = new

    def __missing__(self, word: str) -> bytes:
        return self.new(word)


def _one_piece(word: str) -> bool:
    return word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word) is not None)


class Encoder:
    """encode(texts): their ids as little-endian unsigned 32-bit integers, in bytes.

    Without lower, words keep the space before them, and line ends are words.
    """

    def __init__(self, file: str, lower: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path(file))
        self.model, self.lower = self.tokenizer.model, lower
        self.words = _Words(self._word)  # words, and the pieces that they are cut into
        self.words[""] = b""

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(_bytes_table())
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def _word(self, word: str) -> bytes:
        known, most = self.words, JOINED
        bare = word if self.lower or word[0] != " " else word[1:]
        if _one_piece(bare):
            got, most = self._piece(word.lower() if self.lower else word), CACHE
        elif word[-1] in _ENDS and _one_piece(bare[:-1]):
            got = known[word[:-1]] + known[word[-1]]
        elif _PLAIN.fullmatch(bare):
            got = b""
            for p in _LOWER.findall(word.lower()) if self.lower else _SPACED.findall(word):
                ids = known.get(p)
                if ids is None:
                    ids = self._piece(p)
                    if len(known) < CACHE:
                        known[p] = ids
                got += ids
        else:
            got = self.whole(word)
        if len(known) < most:
            known[word] = got
        return got

    def encode(self, texts: pa.Array, end: bytes = b"") -> Iterator[pa.Array]:
        """Binary arrays, in all a row for each text, a null one included: its ids and then those of `end`."""
        for part in hashing.parts(pa.record_batch([texts], ["text"]), 0, PART):
            with without_gc():
                yield self._encode(part.column(0).fill_null(""), end)

    def ids(self, text: str) -> bytes:
        return next(self.encode(pa.array([text])))[0].as_py()

    def _encode(self, texts: pa.Array, end: bytes) -> pa.Array:
        odd = pc.match_substring_regex(texts, _WHOLE[self.lower])
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        own = {f"{_END}{k}": self.whole(texts[k].as_py()) for k in at} | {_END: end}
        cut = " " if self.lower else "\0"
        if self.lower:
            text = pc.if_else(pc.match_substring_regex(texts, _AS_IS), texts, pc.utf8_lower(texts))
            text = pc.replace_substring(text, "\n", " ")
        else:
            text = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        if at:
            text = pc.replace_with_mask(text, odd, pa.array([f"{_END}{k}" for k in at], text.type))
        words = pc.split_pattern(pc.binary_join_element_wise(text, _END, cut), cut)
        coded = words.values.dictionary_encode()
        known = self.words
        ids = pa.array([own[w] if w[:2] == _END else known[w] for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.binary()).take(coded.indices)
        begin = np.frombuffer(ids.buffers()[1], np.int32)[np.asarray(words.offsets)]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(begin), ids.buffers()[2]])


@contextlib.contextmanager
def without_gc():
    """For loops that make many small objects and no cycles, beside a large cache that each collection would go through."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@functools.cache
def encoder(file: str) -> Encoder:
    """One per worker and file. Vocabularies with word ends drop white space and case."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(file, "word" in file.rsplit("/", 1)[-1])
