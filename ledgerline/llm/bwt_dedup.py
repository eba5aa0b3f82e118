"""Exact repeats of byte strings by merging Burrows-Wheeler transforms of shards.

1. A hash pre-filter picks what can repeat: in every window the smallest hash of a short gram is its
   anchor, so equal windows have equal anchors. Chunks of documents exchange their anchors; only
   windows whose anchor occurs in two documents or more go on.
2. The windows of one anchor occurrence form a snippet. Distinct snippets of a chunk go to the
   anchor's bucket. Snippets of equal bytes are one; an anchor that has one text only needs no more.
   The others are dealt to shards by their anchor. Each shard is sorted once, which gives its
   transform. The windows of an anchor with very many snippets are snippets of their own and go by
   their whole text, so it spreads over all buckets. The transforms of a part are merged by refining
   their interleave: a stable pass by the two preceding symbols turns the order by h symbols into the
   order by h + 2, and a boundary between neighbours that appears then is a common prefix shorter than
   that. After as many symbols as the window is long the intervals without a boundary are the
   repeated windows. No suffix is compared again.
3. Each interval's smallest document goes back as bits for the windows of the snippets sent.

Hashes only group candidates: snippets are joined when their bytes are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, exchange, find, rows_of, to_chunks, told, with_answers
from .common import _ODD, _TABLES, U64, Scratch, _low, _ranges, by_bucket, covered, mix, pack, release, shuffle_parts, unpack, window_mask

KEY_BYTES = 6
KEY = U64((1 << 48) - 1)
GRAM = 20
#: Text of a shard whose transform is built at once, and of the shards that are merged at once.
SHARD_BYTES, PART_BYTES = 1 << 18, 1 << 20
#: Snippets sent of an anchor, over all chunks, above which its windows are dealt singly.
HOT = 1 << 14
_NONE = np.iinfo(np.int64).max
_STEP = 1 << 14


def anchors(chunk: Chunk, window: int):
    """Runs of windows with one anchor: first and last window start, anchor key, document."""
    n = len(chunk.data)
    gram = min(GRAM, window)
    width = window - gram + 1
    valid = window_mask(chunk.offsets, window)
    spot, keys = np.full(n, -1, np.int32), np.zeros(n, U64)
    up, down = _low(_ODD[0]), _low(pow(_ODD[0], -1, 1 << 64))
    for i in range(0, n - window + 1, _STEP):
        # grams that start in this step or in its last window, hashed from a prefix sum of their own
        part = chunk.data[i : i + _STEP + window - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_TABLES[0][part] * up[: len(part)], out=sums[1:])
        key = mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        at = np.arange(len(key), dtype=U64)
        low = (key >> U64(32) << U64(32)) | at
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        found = (low & U64(0xFFFFFFFF)).astype(np.int64)
        spot[i : i + len(found)] = found + i
        keys[i : i + len(found)] = key[found] & KEY
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (spot[1:] != spot[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    return a, b, keys[a], np.searchsorted(chunk.offsets, a, side="right") - 1


def _ids(chunk: Chunk) -> np.ndarray:
    return np.where(chunk.known, chunk.ids, _NONE)


def _hash(chunk: Chunk, a: np.ndarray, b: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Hash of the text and anchor of runs of windows."""
    return mix(_ranges(chunk.data, _ODD[1], a, b + window, _TABLES[1]) ^ key ^ mix((b - a).astype(U64)))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def same_text(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each kind of text data[start : start + size], and the kind of each.

    Texts with one hash are compared byte by byte with the first of them; those that differ are
    told apart by their bytes.
    """
    _, show, which = np.unique(hashes, return_index=True, return_inverse=True)
    first = show[which]
    odd = sizes != sizes[first]
    rest = np.flatnonzero(~odd & (first != np.arange(len(first))))
    for i in range(0, len(rest), 1 << 14):
        r = rest[i : i + (1 << 14)]
        differ = data[_spread(starts[r], sizes[r])] != data[_spread(starts[first[r]], sizes[r])]
        odd[r] = np.logical_or.reduceat(differ, np.cumsum(sizes[r]) - sizes[r])
    if odd.any():
        kinds = {}
        for i in np.flatnonzero(odd):
            k = kinds.setdefault((hashes[i], data[starts[i] : starts[i] + sizes[i]].tobytes()), len(show) + len(kinds))
            which[i] = k
        _, at = np.unique(which, return_index=True)
        show = at
    return show, which


def _anchor_keys(window: int):
    def keys_of(row):
        chunk = Chunk(row)
        a, b, key, doc = anchors(chunk, window)
        kinds, inverse = np.unique(key, return_inverse=True)
        low = np.full(len(kinds), _NONE)
        np.minimum.at(low, inverse, doc)
        more = np.zeros(len(kinds), np.uint8)
        more[inverse[doc != low[inverse]]] = 1
        # above that bit, the number of distinct snippets as quarters of its binary logarithm, rounded up
        _, show = np.unique(_hash(chunk, a, b, key, window), return_index=True)
        count = np.ceil(4 * np.log2(np.bincount(inverse[show], minlength=len(kinds)))).astype(np.uint8)
        return kinds, [more | count << np.uint8(1)]

    return keys_of


def _anchor_answer(hot: int):
    def answer(keys, values, source):
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        more = np.bincount(inverse, values[0] & 1) > 0
        busy = np.bincount(inverse, 2.0 ** ((values[0] >> 1) / 4)) > hot
        return ((count > 1) | more)[inverse], [busy[inverse]]

    return answer


def snippets(row, window: int):
    """Runs of a chunk that go on, its distinct snippets, and the distinct pieces of them that are sent.

    Returns the chunk, (a, b, document id) of each run, each run's snippet, each snippet's smallest
    document id, and (snippet, offset in it, piece) of its pieces; of the pieces, in a fixed order, the
    first and last window start, the smallest document id and the key to deal by. A snippet is one
    piece; those of hot anchors are cut into single windows.
    """
    chunk = Chunk(row)
    a, b, key, doc = anchors(chunk, window)
    hits, hot = told(row, {"a0": np.uint8}, KEY_BYTES)
    spot = find(hits, key)
    use = spot >= 0
    a, b, key, doc, busy = a[use], b[use], key[use], doc[use], hot[spot[use]] > 0
    show, which = same_text(chunk.data, a, b - a + window, _hash(chunk, a, b, key, window))
    ids = _ids(chunk)[doc]
    low = np.full(len(show), _NONE)
    np.minimum.at(low, which, ids)
    count = np.where(busy, b - a + 1, 1)[show]
    of, offset = np.repeat(np.arange(len(show)), count), _spread(np.zeros(len(show), np.int64), count)
    first = a[show][of] + offset
    last = np.where(busy[show][of], first, b[show][of])
    text = _hash(chunk, first, last, key[show][of], window)
    one, piece = same_text(chunk.data, first, last - first + window, text)
    least = np.full(len(one), _NONE)
    np.minimum.at(least, piece, low[of])
    deal = np.where(busy[show][of], text, key[show][of])[one]
    return chunk, (a, b, ids), which, low, (of, offset, piece), (first[one], last[one], least, deal)


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all rotations of a text whose strings each end with symbol 0, and its transform."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    for k in (1, 2):  # the first four symbols, then seven, at once
        rank = rank << (9 * k) | np.roll(rank, -k)
    rank = rank << 27 | np.roll(rank, -4) >> 9
    order = np.argsort(rank)
    slots, keys, place = np.arange(n), rank[order], np.empty(n, np.int64)
    h = 7
    while True:
        # a group of equal rotations is named by its first slot; only groups of several are sorted on
        step = np.ones(len(keys) + 1, bool)
        step[1:-1] = keys[1:] != keys[:-1]
        head = step[:-1]
        place[order[slots]] = slots[head][np.cumsum(head) - 1]
        slots = slots[~(head & step[1:])]
        if not len(slots) or h >= 4 * n:
            break
        open_ = order[slots]
        keys = place[open_] << 32 | place[(open_ + h) % n]
        spot = np.argsort(keys)
        order[slots], keys = open_[spot], keys[spot]
        h *= 2
    return order, symbols[order - 1]


def repeated_intervals(texts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in texts) of windows found more than once, and an interval number of each.

    texts holds strings one after the other; ends are their ends. Windows stay inside a string.
    """
    sizes = np.diff(np.concatenate([[0], ends]))
    shard_of = (ends - sizes) // SHARD_BYTES
    move, bwt, where = [], [], []
    base = 0
    for s in np.unique(shard_of):
        mine = np.flatnonzero(shard_of == s)
        lo, size = ends[mine[0]] - sizes[mine[0]], sizes[mine]
        plus = np.cumsum(size + 1)
        symbols = np.zeros(plus[-1], np.uint16)
        origin = np.full(plus[-1], -1, np.int32)
        inner = np.ones(plus[-1], bool)
        inner[plus - 1] = False
        symbols[inner] = texts[lo : ends[mine[-1]]].astype(np.uint16) + 1
        origin[inner] = np.arange(lo, ends[mine[-1]])
        origin[~inner] = ends[mine]
        order, last = transform(symbols)
        back = np.empty(len(last), np.int32)
        back[np.argsort(last, kind="stable")] = np.arange(len(last), dtype=np.int32)
        move.append(back + np.int32(base))
        bwt.append(last)
        where.append(origin[order])
        base += len(last)
    move, bwt, where = np.concatenate(move), np.concatenate(bwt), np.concatenate(where)
    rows, block = np.arange(base, dtype=np.int32), np.zeros(base, np.int32)

    def refine(rows, block, symbol, inside, move):
        """One pass: rows that have the symbols, in the order with those in front; rows alone in theirs go."""
        at = inside[rows]
        rows, block = rows[at], block[at]
        symbol = symbol[rows]
        order = np.argsort(symbol, kind="stable")
        rows, block, symbol = rows[order], block[order], symbol[order]
        edge = np.ones(len(rows) + 1, bool)
        edge[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        many = ~(edge[:-1] & edge[1:])
        return move[rows[many]], np.cumsum(edge[:-1], dtype=np.int32)[many]

    inside, letter = bwt > 0, (bwt - 1).astype(np.uint8)
    if window % 2:
        rows, block = refine(rows, block, letter, inside, move)
    inside &= inside[move]
    pair = letter[move].astype(np.uint16) << 8 | letter
    move = move[move]
    for _ in range(window // 2):
        rows, block = refine(rows, block, pair, inside, move)
        if not len(rows):
            break
    return where[rows].astype(np.int64), block


def _parts(sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Bounds of runs of texts, in order of their tags, of about PART_BYTES each; no tag is in two runs."""
    ends = np.cumsum(sizes)
    cut = np.flatnonzero(np.append(True, tags[1:] != tags[:-1]))
    part = (ends[cut] - sizes[cut]) // PART_BYTES
    return np.append(cut[np.append(True, part[1:] != part[:-1])], len(sizes))


def _bits(table: pa.Table, window: int) -> pa.Table:
    """For each snippet of a bucket, bits of the windows that a smaller document than its own has too."""
    sizes, low, tags = ([unpack(x, t) for x in table[c].to_pylist()] for c, t in (("sizes", np.uint8), ("low", np.int64), ("tags", np.uint32)))
    count = [len(x) for x in sizes]
    size, low, tags = np.concatenate(sizes).astype(np.int64) + window, np.concatenate(low), np.concatenate(tags)
    data = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint8)
    starts = np.cumsum(size) - size
    text = mix(_ranges(data, _ODD[1], starts, starts + size, _TABLES[1]) ^ size.astype(U64))
    show, which = same_text(data, starts, size, text)
    least = np.full(len(show), _NONE)
    np.minimum.at(least, which, low)
    # an anchor with one text has nothing to be merged with
    order = show[np.argsort(tags[show], kind="stable")]
    tag = tags[order]
    same = np.zeros(len(tag) + 1, bool)
    same[1:-1] = tag[1:] == tag[:-1]
    order = order[same[:-1] | same[1:]]
    windows = size[order] - window + 1
    begin = np.cumsum(windows) - windows
    best = np.repeat(least[which[order]], windows)
    bounds = _parts(size[order], tags[order]) if len(order) else np.zeros(1, np.int64)
    for i, j in zip(bounds, bounds[1:], strict=False):
        some = order[i:j]
        ends = np.cumsum(size[some])
        at, block = repeated_intervals(data[_spread(starts[some], size[some])], ends, window)
        if len(at):
            string = np.searchsorted(ends, at, side="right")
            _, group = np.unique(block, return_inverse=True)
            smallest = np.full(group.max() + 1, _NONE)
            np.minimum.at(smallest, group, least[which[some[string]]])
            best[begin[i + string] + at - (ends - size[some])[string]] = smallest[group]
    # windows of every snippet sent, against its own document
    whole = (np.int64(1) << (size - window + 1)) - 1
    mask = np.where(least[which] < low, whole, 0)
    place = np.full(len(show), -1)
    place[which[order]] = np.arange(len(order))
    merged = np.flatnonzero(place[which] >= 0)
    for k in range(0, len(merged), 1 << 14):
        m = merged[k : k + (1 << 14)]
        at, n = place[which[m]], size[m] - window + 1
        hit = best[_spread(begin[at], n)] < np.repeat(low[m], n)
        mask[m] = np.add.reduceat(hit.astype(np.int64) << _spread(np.zeros(len(m), np.int64), n), np.cumsum(n) - n)
    rows = {"chunk_id": [], "bucket": [], "index": [], "mask": []}
    stop = np.cumsum(count)
    for chunk, bucket, lo, hi in zip(table["chunk_id"].to_pylist(), table["bucket"].to_pylist(), stop - count, stop, strict=True):
        some = np.flatnonzero(mask[lo:hi])
        if len(some):
            for c, v in (("chunk_id", chunk), ("bucket", bucket), ("index", pack(some.astype(np.uint32))), ("mask", pack(mask[lo:hi][some]))):
                rows[c].append(v)
    out = pa.table({c: pa.array(v, t) for (c, v), t in zip(rows.items(), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})
    del data, text, best, mask, sizes
    release()
    return out


def _tags(key: np.ndarray) -> np.ndarray:
    """32 bits of what a piece is dealt by: pieces that share a window share them."""
    return (mix(key) >> U64(32)).astype(np.uint32)


def remove_repeated_bytes(docs: DataFrame, window: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs (doc_id, text).

    A byte of a text's UTF-8 goes if a window-long string that covers it also starts in a document
    with a smaller doc_id; strings are judged on the input and stay inside a document. n_spans counts
    maximal removed runs; kept holds the rest as binary. Null texts are empty. Rows that repeat a
    doc_id are equals: neither removes the other's bytes. A null doc_id counts as larger than all
    others. An empty table gives no rows; extra columns are ignored. window is at most 82. The windows
    of an anchor with more than about hot snippets are dealt singly; the result is the same.
    """
    if not 1 <= window <= GRAM + 62:
        raise ValueError("window must be from 1 to 82")
    scratch = Scratch(docs.sparkSession)
    buckets = 2 * shuffle_parts(docs.sparkSession)
    chunks = scratch.save(to_chunks(docs), "chunks")
    hits = scratch.save(exchange(chunks, _anchor_keys(window), _anchor_answer(hot), [np.uint8], buckets, [np.uint8], KEY_BYTES), "hits")
    marked = with_answers(chunks, hits)

    def deal(key):
        return by_bucket((mix(key ^ U64(0x77)) % U64(buckets)).astype(np.int64), buckets)

    def send(batches):
        for row in rows_of(batches):
            chunk, *_, (a, b, low, key) = snippets(row, window)
            order, cut = deal(key)
            some = [k for k in range(buckets) if cut[k + 1] > cut[k]]
            cols = ([], [], [], [])
            for k in some:
                part = order[cut[k] : cut[k + 1]]
                lo, size = a[part], b[part] - a[part]
                for c, v in zip(cols, (chunk.data[_spread(lo, size + window)], size.astype(np.uint8), low[part], _tags(key[part])), strict=True):
                    c.append(pack(v))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk.chunk_id] * len(some), pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "chunk_id", "texts", "sizes", "low", "tags"])

    sent = marked.where("answers is not null").mapInArrow(send, "bucket int, chunk_id long, texts binary, sizes binary, low binary, tags binary")
    bits = scratch.save(sent.groupBy("bucket").applyInArrow(lambda t: _bits(t, window), "chunk_id long, bucket int, index binary, mask binary"), "bits")
    last = bits.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "index", "mask")).alias("bits"))

    def finish(batches):
        for row in rows_of(batches):
            chunk, (a, b, ids), which, low, (of, offset, piece), (first, last, least, key) = snippets(row, window)
            bits_of = np.zeros(len(key), np.int64)
            order, cut = deal(key)
            for part in row["bits"] or []:
                bits_of[order[cut[part["bucket"]] : cut[part["bucket"] + 1]][unpack(part["index"], np.uint32)]] = unpack(part["mask"], np.int64)
            # a piece may have a smaller document in this chunk than its snippet
            sooner = least[piece] < low[of]
            mask = np.zeros(len(low), np.int64)
            if len(of):  # a sooner document has all windows of the piece
                whole = (np.int64(1) << (last - first + 1)[piece]) - 1
                parts = np.where(sooner, whole, bits_of[piece]) << offset
                mask = np.bitwise_or.reduceat(parts, np.flatnonzero(np.append(True, of[1:] != of[:-1])))
            windows = b - a + 1
            run = np.repeat(np.arange(len(a)), windows)
            offset = _spread(np.zeros(len(a), np.int64), windows)
            # a snippet's own smallest document needs the bits; its other documents come after that one
            gone = (ids > low[which])[run] | (mask[which[run]] >> offset & 1 > 0)
            out = covered((a[run] + offset)[gone], window, len(chunk.data))
            cs = np.concatenate([[0], np.cumsum(out)])
            begin = out.copy()
            begin[1:] &= ~out[:-1]
            heads = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
            begin[heads] = out[heads]
            spans = np.concatenate([[0], np.cumsum(begin)])
            o = chunk.offsets
            kept = [chunk.data[i:j][~out[i:j]].tobytes() for i, j in zip(o, o[1:], strict=False)]
            cols = [pa.array(chunk.ids, mask=~chunk.known), pa.array(np.diff(o)), pa.array(cs[o[1:]] - cs[o[:-1]]), pa.array(spans[o[1:]] - spans[o[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return marked.join(last, "chunk_id", "left").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
