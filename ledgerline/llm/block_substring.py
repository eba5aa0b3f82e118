"""Exact repeats of word sequences found by fixed-block anchors.

1. Every document is indexed by its non-overlapping blocks of (window + 1) // 2 words; any window
   contains one. All rolling blocks of all documents probe that index.
2. Hits are extended: the windows around a hit that the chunk can form are compared by 128-bit keys
   across chunks, which gives the smallest document each starts in. Runs of windows that also start
   in a smaller document are the maximal repeats to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, exchange, find, rows_of, to_chunks, told, with_answers
from .common import U64, Scratch, Words, covered, shuffle_parts

#: Block keys travel as the low 48 bits of a hash; a false hit only adds windows, which are compared by 128 bits.
KEY_BYTES = 6
KEY = U64((1 << 48) - 1)
_NONE = np.iinfo(np.int64).max


def _blocks(chunk: Chunk, window: int):
    """Words of a chunk, their hashes, and its rolling blocks: start, key, whether it is indexed, document."""
    words = Words(chunk.offsets, chunk.data)
    hashes = words.hashes()
    size = (window + 1) // 2
    at, key = words.windows(hashes, size)
    doc = np.searchsorted(words.ptr, at, side="right") - 1
    return words, hashes, at, key, (at - words.ptr[doc]) % size == 0, doc


def _probe_keys(window: int):
    def keys_of(row):
        chunk = Chunk(row)
        _, _, _, key, anchor, doc = _blocks(chunk, window)
        kinds, inverse = np.unique(key & KEY, return_inverse=True)
        flags = np.zeros(len(kinds), np.uint8)
        flags[inverse[anchor]] |= 1
        low = np.full(len(kinds), _NONE)
        np.minimum.at(low, inverse, doc)
        flags[inverse[doc != low[inverse]]] |= 2
        return kinds, [flags]

    return keys_of


def _probe_answer(keys, values, source):
    """A block matters if it is indexed somewhere and two documents or more have it."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    flags = np.zeros(len(count), np.uint8)
    np.bitwise_or.at(flags, inverse, values[0])
    good = (flags & 1 > 0) & ((count > 1) | (flags & 2 > 0))
    return good[inverse], []


def _extended(row, window: int):
    """Windows of a chunk around the blocks that hit: start word, two 64-bit keys, document."""
    chunk = Chunk(row)
    words, hashes, at, key, _, _ = _blocks(chunk, window)
    (hits,) = told(row, {}, KEY_BYTES)
    n = len(words.starts)
    hit = np.zeros(n + 1, np.int64)
    hit[at[find(hits, key & KEY) >= 0] + 1] = 1
    hit = np.cumsum(hit)
    starts, k1 = words.windows(hashes, window)
    size = (window + 1) // 2
    use = hit[starts + window - size + 1] > hit[starts] if len(starts) else np.zeros(0, bool)
    k2 = words.windows(words.hashes(1), window, 1)[1][use]
    starts, k1 = starts[use], k1[use]
    return chunk, words, starts, k1, k2, np.searchsorted(words.ptr, starts, side="right") - 1


def _window_keys(window: int):
    def keys_of(row):
        chunk, _, _, k1, k2, doc = _extended(row, window)
        both = np.rec.fromarrays([k1, k2], names="a,b")
        order = np.lexsort((k2, k1))
        both, ids = both[order], np.where(chunk.known, chunk.ids, _NONE)[doc][order]
        first = np.ones(len(both), bool)
        first[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        at = np.flatnonzero(first)
        low = np.minimum.reduceat(ids, at) if len(at) else ids
        high = np.maximum.reduceat(ids, at) if len(at) else ids
        return both.a[at], [both.b[at], low, (high > low).astype(np.uint8)]

    return keys_of


def _window_answer(keys, values, source):
    """The smallest document of every window that two documents or more have."""
    k2, low, more = values
    order = np.lexsort((k2, keys))
    a, b = keys[order], k2[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    least = np.minimum.reduceat(low[order], at)[group]
    wide = (np.diff(np.append(at, len(a))) > 1) | np.maximum.reduceat(more[order], at).astype(bool)
    mask, out = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    mask[order], out[order] = wide[group], least
    return mask, [k2, out]


def _removed(row, window: int) -> tuple[Chunk, Words, np.ndarray]:
    chunk, words, starts, k1, k2, doc = _extended(row, window)
    keys, second, low = (np.zeros(0, t) for t in (U64, U64, np.int64))
    if row["lows"]:
        keys, second, low = told({"answers": row["lows"]}, {"a0": U64, "a1": np.int64})
    mine = np.where(chunk.known, chunk.ids, _NONE)[doc]
    gone = np.zeros(len(starts), bool)
    spot = np.searchsorted(keys, k1)
    live = np.arange(len(starts))
    step = 0
    while len(live):  # keys of equal first halves stand next to each other
        s = spot[live] + step
        live = live[(s < len(keys))]
        s = s[s < len(keys)]
        same = keys[s] == k1[live]
        live, s = live[same], s[same]
        hit = second[s] == k2[live]
        gone[live[hit]] = low[s[hit]] < mine[live[hit]]
        live = live[~hit]
        step += 1
    return chunk, words, covered(starts[gone], window, len(words.starts))


def repeated_words(docs: DataFrame, window: int, finish, schema: str, extra: list[str] | None = None) -> DataFrame:
    """finish(chunk, words, mask of removed words) -> Arrow batch, over chunks of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    buckets = 2 * shuffle_parts(docs.sparkSession)
    chunks = scratch.save(to_chunks(docs, extra), "chunks")
    hits = scratch.save(exchange(chunks, _probe_keys(window), _probe_answer, [np.uint8], buckets, [], KEY_BYTES), "hits")
    hit_chunks = with_answers(chunks, hits)
    lows = scratch.save(exchange(hit_chunks.where("answers is not null"), _window_keys(window), _window_answer, [U64, np.int64, np.uint8], buckets, [U64, np.int64]), "lows")
    last = lows.groupBy("chunk_id").agg(F.collect_list(F.struct("keys", "a0", "a1")).alias("lows"))

    def run(batches):
        for row in rows_of(batches):
            yield finish(*_removed(row, window))

    return hit_chunks.join(last, "chunk_id", "left").mapInArrow(run, schema)


def _texts(chunk: Chunk, words: Words, gone: np.ndarray):
    """(document, words, removed words, kept words joined by a space) of a chunk."""
    raw = chunk.data.tobytes()
    starts, ends = words.starts.tolist(), words.ends.tolist()
    for d, (i, j) in enumerate(zip(words.ptr, words.ptr[1:], strict=False)):
        keep = np.flatnonzero(~gone[i:j]) + i
        yield d, int(j - i), int(j - i - len(keep)), b" ".join([raw[starts[k] : ends[k]] for k in keep.tolist()])


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of docs (doc_id, text).

    A word goes if it is in a window of `window` consecutive words of its document that also starts
    in a document with a smaller doc_id; windows are judged on the input. Words are
    `[^\\x20\\x09-\\x0D]+`, unchanged. Null and empty texts have no words. Rows that repeat a doc_id
    are equals: neither removes the other's words. A null doc_id counts as larger than all others.
    An empty table gives no rows; extra columns are ignored. A chunk's keys, not its documents,
    meet in a bucket, so copies and common passages of any number are whole and cheap.
    """

    def finish(chunk, words, gone):
        rows = [(n, m, hashlib.sha256(t).hexdigest(), t) for _, n, m, t in _texts(chunk, words, gone)]
        n, m, sha, text = zip(*rows, strict=True) if rows else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(chunk.ids, mask=~chunk.known), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return repeated_words(docs, window, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def drop_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs with repeated words taken out of text, under the rule of remove_repeats; all columns stay.

    A text that loses nothing stays as it is; others keep their words joined by a space, and a row
    whose words all go is dropped. A column n_chars, if there is one, is counted anew.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def finish(chunk, words, gone):
        raw, o = chunk.data.tobytes(), chunk.offsets.tolist()
        texts, stay = [], []
        for d, n, m, t in _texts(chunk, words, gone):
            texts.append(t if m else raw[o[d] : o[d + 1]])
            stay.append(m < n or not m)
        out = [pa.array(chunk.ids, mask=~chunk.known), pa.array(texts, pa.binary()).cast(pa.string()), *(chunk.columns() if others else [])]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "text", *[f"_{k}" for k in range(len(others))]]).filter(pa.array(stay))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(["doc_id long", "text string", *[f"_{k} {kinds[c]}" for k, c in enumerate(others)]])
    out = repeated_words(docs, window, finish, schema, others)
    made = {c: F.col(f"_{k}") for k, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        made["n_chars"] = F.length("text").cast(kinds["n_chars"])
    return out.select(*[made[c].alias(c) for c in docs.columns])
