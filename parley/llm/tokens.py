"""Token ids of a public tokenizer file, computed by distinct word inside tasks.

The tokenizer drops white space and never joins characters across it, so a text's ids are the
ids of its words in a row, and each distinct word needs the library only once per worker. Words of
characters below U+0250 are in normal form already; for them the library's model is asked
directly. All other words go through the library's whole pipeline.
"""

from __future__ import annotations

from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Bounds of the caches of one Python worker: entries, and characters of a word that is kept.
CACHE_WORDS = 500_000
CACHE_WORD_CHARS = 40
LETTERS = chr(0x250)
DOTTED_I = "İ"

# --- fixed values: the pre-tokenizer pattern of the tokenizer file ------------------------------
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# ------------------------------------------------------------------------------------------------


def byte_letters() -> dict[int, int]:
    """The usual byte-level alphabet: printable Latin-1 as itself, other bytes from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts as unsigned 32-bit integers, equal to those of the tokenizer's own encode."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode_piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.alphabet)
        ids = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
        if len(piece) <= CACHE_WORD_CHARS:
            self.pieces[piece] = ids
        return ids

    def encode_word(self, word: str) -> bytes:
        if not word:
            return b""
        if max(word) < LETTERS and DOTTED_I not in word and "<|" not in word:
            lower = word.lower()
            pieces = [lower] if lower.isalpha() else PIECES.findall(lower)
            return b"".join(self.pieces.get(p) or self.encode_piece(p) for p in pieces)
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]], the last of them the end id.

        Null counts as empty.
        """
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        known, coded = self.words, []
        for word in words.dictionary.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= CACHE_WORD_CHARS:
                    known[word] = ids
            coded.append(ids)
        for full in (self.words, self.pieces):
            if len(full) > CACHE_WORDS:
                full.clear()
        starts = np.zeros(len(coded) + 1, "i8")
        np.cumsum([len(ids) // 4 for ids in coded], out=starts[1:])
        flat = np.frombuffer(b"".join(coded), "u4")
        lists = pa.LargeListArray.from_arrays(starts, flat).take(words.indices)
        by_word = lists.offsets.to_numpy()
        ends = (by_word - by_word[0])[split.offsets.to_numpy()]
        ids = np.insert(lists.flatten().to_numpy(), ends[1:], end).astype("u4", copy=False)
        return ends + np.arange(len(ends)), ids


@cache
def encoder(path: str) -> WordEncoder:
    """The encoder of this worker; tasks that run one after another share its caches."""
    return WordEncoder(path)
