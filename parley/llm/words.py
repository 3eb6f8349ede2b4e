"""Words of a batch of texts as integer codes, for NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """codes of all words in a row; text i has codes[bounds[i]:bounds[i + 1]]."""

    codes: np.ndarray
    bounds: np.ndarray
    distinct: pa.Array

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def by_text(self, value_of_word: np.ndarray) -> np.ndarray:
        """Sum over a text's words of a value given for each distinct word."""
        sums = np.concatenate([[0], np.cumsum(value_of_word[self.codes])])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def split_words(texts: pa.Array) -> Words:
    """Words between ASCII white space; null has none."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = split.flatten().dictionary_encode()
    codes, bounds = flat.indices.to_numpy(), split.offsets.to_numpy().astype("i8")
    blank = pc.index(flat.dictionary, "").as_py()
    if blank >= 0:
        real = codes != blank
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return Words(codes, bounds, flat.dictionary)
