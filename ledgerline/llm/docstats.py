"""Whole-text statistics of documents, counted with numpy on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import _TABLES, U64, Words, _ranges, blocks, covered, mix, release, text_buffer

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digit", "n_shout", "n_bar", "n_wide"]
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:192], _CLASS[192:] = 1, 2, 3, 5, 4
_CLASS[[ord(c) for c in SYMBOLS]] = 6
_CLASS[ord("!")], _CLASS[ord("|")] = 7, 8
_SPACES = [0x20, *range(0x09, 0x0E)]
_CLASS[_SPACES] = 9


def first_equal(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, key): whether an equal pair comes before it, and how often it occurs."""
    both = mix(doc.astype(U64) + U64(0x51ED2701)) ^ key
    _, first, inverse, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    return np.arange(len(key)) != first[inverse], count[inverse]


def block_stats(offsets: np.ndarray, data: np.ndarray, k: int = 5) -> dict[str, np.ndarray]:
    """COUNTS of each document of a block.

    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in k-word
    windows found twice or more in the text. word_chars: code points in words.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10)
    words = Words(offsets, data)
    wdoc = words.doc_of()
    hashes = words.hashes()

    def per_doc(mask, of):
        return np.bincount(of[mask], minlength=n)

    at, win = words.windows(hashes, k)
    twice = first_equal(wdoc[at], win)[1] > 1
    repeat = covered(at[twice], k, len(wdoc))
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1])) if n else np.zeros(0, np.int64)
    ldoc = np.searchsorted(offsets, starts, side="right") - 1
    ok = (ldoc < n) & (starts < len(data)) if len(starts) else np.zeros(0, bool)
    starts, ldoc = starts[ok], ldoc[ok]
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[ldoc + 1])
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    trim = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10))
    line = mix(_ranges(data, 0x9E3779B97F4A7C15, starts, trim, _TABLES[0]) + (trim - starts).astype(U64))
    again = first_equal(ldoc[has], line[has])[0]
    return {
        "n_bytes": np.diff(offsets),
        "n_words": words.per_doc,
        "word_chars": kinds.sum(1) - kinds[:, 9] - kinds[:, 5],
        "n_symbols": kinds[:, 6] + kinds[:, 8],
        "n_dup_lines": per_doc(again, ldoc[has]),
        "n_repeat_words": per_doc(repeat, wdoc),
        "n_lines": np.bincount(ldoc[has], minlength=n),
        "n_distinct": per_doc(~first_equal(wdoc, hashes)[0], wdoc),
        "n_upper": kinds[:, 1],
        "n_lower": kinds[:, 2],
        "n_digit": kinds[:, 3],
        "n_shout": kinds[:, 7],
        "n_bar": kinds[:, 8],
        "n_wide": kinds[:, 4],
    }


def stats_column(text):
    """A struct column of COUNTS (long) of a text column; null counts as empty."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def stats(col: pa.Array) -> pa.Array:
        offsets, data = text_buffer(col)
        parts = [block_stats(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]) for i, j in blocks(offsets)]
        release()
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in COUNTS], names=COUNTS)

    return stats(text)
