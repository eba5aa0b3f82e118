"""Self join of documents by Jaccard similarity of word shingles: T-occurrence search with DivideSkip.

1. Chunks of documents exchange their shingles, which gives every shingle its number of occurrences
   and so a global order, rare ones first.
2. Documents with equal sets form a class. Two classes that link share a shingle of their prefixes
   (the rarest tenth) and have sizes within the ratio; star edges over the documents of a prefix shingle,
   cut where sizes are too far apart, give groups outside which nothing can link.
3. Within a group each set is a query against inverted lists: short lists are merged and counted,
   long ones are probed by binary search, and those reaching the needed overlap are kept.
   A group of more than task_shingles first meets one of its members, each document on its own; then
   what did not link to that member meets the whole group in blocks of that size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, exchange, find, rows_of, to_chunks, told, with_answers
from .common import _WIN, U64, Scratch, Words, _ranges, by_bucket, columns_of, mix, pack, shuffle_parts, text_batches, unpack
from .components import components

#: Shingle counts travel under the low 48 bits of a hash; where two shingles share them the order is as good.
KEY_BYTES = 6
KEY = U64((1 << 48) - 1)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (n + 1) and sorted distinct shingles of each document of a block, A-Z lower-cased.

    A document with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    words = Words(offsets, data, lower=True)
    hashes = words.hashes()
    at, win = words.windows(hashes, k)
    n = len(offsets) - 1
    doc = np.searchsorted(words.ptr, at, side="right") - 1
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < k))
    if len(short):
        whole = mix(_ranges(hashes, _WIN[0], words.ptr[short], words.ptr[short + 1])) ^ words.per_doc[short].astype(U64)
        doc, win = np.concatenate([doc, short]), np.concatenate([win, whole])
    order = np.argsort(win)
    order = order[np.argsort(doc[order].astype(np.uint32) if n > 65535 else doc[order].astype(np.uint16), kind="stable")]
    doc, win = doc[order], win[order]
    new = np.ones(len(win), bool)
    new[1:] = (win[1:] != win[:-1]) | (doc[1:] != doc[:-1])
    doc, win = doc[new], win[new]
    return np.searchsorted(doc, np.arange(n + 1)), win


def needed(size: int, ratio: int) -> int:
    """Least overlap of a set of this size with any set it links to."""
    return -(-ratio * size // 100)


def _shingle_keys(k: int):
    def keys_of(row):
        chunk = Chunk(row)
        keys, count = np.unique(shingle_sets(chunk.offsets, chunk.data, k)[1] & KEY, return_counts=True)
        return keys, [np.minimum(count, 255)]

    return keys_of


def _shingle_answer(keys, values, source):
    """How many documents have a shingle, up to 255, where it is more than one."""
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, values[0])[inverse]
    return total > 1, [np.minimum(total, 255)]


def _profiles(chunks: DataFrame, k: int, ratio: int) -> DataFrame:
    """(doc_id, n, s1, s2, prefix): set size, 128-bit signature of the set, its rarest shingles."""

    def run(batches):
        for row in rows_of(batches):
            chunk = Chunk(row)
            keys, counts = told(row, {"a0": np.uint8}, KEY_BYTES)
            ptr, tokens = shingle_sets(chunk.offsets, chunk.data, k)
            n = np.diff(ptr)
            sums = [np.concatenate([[U64(0)], np.cumsum(mix(tokens ^ U64(s)))]) for s in (0x1234567, 0x89ABCDEF01)]
            s1, s2 = ((s[ptr[1:]] - s[ptr[:-1]]).view(np.int64) for s in sums)
            at = find(keys, tokens & KEY)
            common = np.where(at >= 0, counts[at] if len(counts) else 1, 1)
            rank = np.lexsort((tokens, common, np.repeat(np.arange(len(n)), n)))
            tokens = tokens[rank]
            prefix = [pack(tokens[p : p + m - needed(m, ratio) + 1]) if m else None for p, m in zip(ptr, n.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, mask=~chunk.known), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(prefix, pa.binary())], names=["doc_id", "n", "s1", "s2", "prefix"])

    return chunks.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix binary")


def size_runs(token: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, ratio: int):
    """What documents with one shingle fall into by their set sizes, as two sets link only if the smaller has ratio per cent of the larger.

    Rows are (shingle, least size, greatest size, smallest document). Runs end where a size is out of
    reach of all before it. Returns (shingle, least, greatest, document) of each run, and star edges
    (run's document, document) within it.
    """
    order = np.lexsort((doc, low, token))
    token, low, high, doc = token[order], low[order], high[order], doc[order]
    if not len(token):
        return token, low, high, doc, np.zeros((0, 2), np.int64)
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    # greatest size so far of the same shingle
    reach = np.maximum.accumulate(np.cumsum(new).astype(np.int64) << 32 | high) & 0xFFFFFFFF
    new[1:] |= 100 * reach[:-1] < ratio * low[1:]
    at = np.flatnonzero(new)
    first = np.minimum.reduceat(doc, at)
    mine = first[np.cumsum(new) - 1]
    edge = np.unique(np.stack([mine, doc], 1)[mine != doc], axis=0)
    return token[at], low[at], np.maximum.reduceat(high, at), first, edge


def _prefix_edges(reps: DataFrame, buckets: int, ratio: int) -> DataFrame:
    """Star edges (a, b) between documents that share a prefix shingle and whose sizes a chain of others brings together.

    A task sends each run of a shingle once, with its sizes and the smallest id, and its own stars as
    edges, so a shingle of very many documents is a few rows for each task.
    """

    def send(batches):
        for batch in batches:
            docs, sizes = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            raw = batch.column("prefix").to_pylist()
            token = np.concatenate([unpack(x, U64) for x in raw]) if raw else np.zeros(0, U64)
            count = [len(x or b"") // 8 for x in raw]
            size = np.repeat(sizes, count)
            *run, edge = size_runs(token, size, size, np.repeat(docs, count), ratio)
            order, cut = by_bucket((mix(run[0]) % U64(buckets)).astype(np.int64), buckets)
            rows = [(int(k), *[pack(c[order[i:j]]) for c in run]) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
            for i in range(0, len(edge), 100_000):
                part = edge[i : i + 100_000]
                rows.append((-1 - int(part[0, 1]) % buckets, None, None, None, pack(part)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "tokens", "low", "high", "ids"])

    def meet(table: pa.Table) -> pa.Table:
        get = lambda c, t: np.concatenate([unpack(x, t) for x in table[c].to_pylist()])
        if table["bucket"][0].as_py() < 0:
            edge = get("ids", np.int64).reshape(-1, 2)
        else:
            edge = size_runs(get("tokens", U64), get("low", np.int64), get("high", np.int64), get("ids", np.int64), ratio)[-1]
        return pa.table({"a": pa.array(edge[:, 0]), "b": pa.array(edge[:, 1])})

    return reps.select("doc_id", "n", "prefix").mapInArrow(send, "bucket int, tokens binary, low binary, high binary, ids binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def divide_skip(sets: list[np.ndarray], ratio: int, query: np.ndarray, known: np.ndarray, mu: float = 0.0085) -> np.ndarray:
    """Group labels of sets (sorted by size) under links of at least ratio per cent.

    query: which sets take part in every pair; known: labels already joined, as indexes.
    For each set the lists of its shingles are split: the longest (about T / (mu log M + 1) of them)
    are only probed, by binary search, for what occurs T - L times or more in the merged short ones.
    """
    n = len(sets)
    root = known.copy()
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    post = np.sort(code.astype(np.int64) * n + np.repeat(np.arange(n), size))
    lists = np.searchsorted(post, np.arange(code.max() + 2, dtype=np.int64) * n)
    rank = post % n
    most = max(2, int(np.diff(lists).max()))
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(n - 1):
        a = int(size[i])
        hi = int(np.searchsorted(size, a * 100 // ratio, side="right"))
        open_ = root[i + 1 : hi] != root[i]
        if not query[i]:
            open_ &= query[i + 1 : hi]
        if not open_.any():
            continue
        need = -(-ratio * 2 * a // (100 + ratio))
        mine = code[at[i] : at[i + 1]]
        length = lists[mine + 1] - lists[mine]
        longs = min(need - 1, int(need / (mu * np.log(most) + 1)))
        order = np.argsort(length, kind="stable")
        short, long = mine[order[: a - longs]], mine[order[a - longs :]]
        merged = np.concatenate([rank[lists[t] : lists[t + 1]] for t in short])
        count = np.bincount(merged, minlength=n)[i + 1 : hi]
        cand = np.flatnonzero(open_ & (count >= need - longs)) + i + 1
        for c0 in range(0, len(cand), 4096):
            c = cand[c0 : c0 + 4096]
            c = c[root[c] != root[i]]
            if len(c):
                want = long[:, None].astype(np.int64) * n + c[None, :]
                spot = np.minimum(np.searchsorted(post, want), len(post) - 1)
                both = count[c - i - 1] + (post[spot] == want).sum(0)
                for j in c[100 * both >= ratio * (a + size[c] - both)]:
                    x, y = root[i], root[j]
                    if x != y:
                        root[root == max(x, y)] = min(x, y)
    return root


def similarity_components(docs: DataFrame, ratio: int = 90, k: int = 3, task_shingles: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Two documents link when 100 * |intersection| >= ratio * |union| of their distinct k-word
    shingles (A-Z lower-cased); component_id is the smallest doc_id reachable by links. Documents
    with null, empty or wordless texts have no shingles and are components of their own; a row
    with a null doc_id links with nothing and has a null component; rows that repeat a doc_id are
    one node. Ties need no rule: all links count. An empty table gives no rows. Extra columns are
    ignored. Every link between different sets is found, whatever the size of a group; a set is
    compared with another only while the two are not yet connected.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    buckets = 2 * shuffle_parts(spark)
    chunks = scratch.save(to_chunks(docs), "chunks")
    counts = scratch.save(exchange(chunks, _shingle_keys(k), _shingle_answer, [np.uint8], buckets, [np.uint8], KEY_BYTES), "counts")
    profiles = scratch.save(_profiles(with_answers(chunks, counts), k, ratio), "profiles")
    scratch.drop(chunks, counts)
    some = profiles.where("n > 0 and doc_id is not null")
    classes = some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = scratch.save(classes, "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    groups = components(_prefix_edges(reps, buckets, ratio), scratch)
    sizes = reps.join(groups.withColumnRenamed("id", "doc_id"), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "component", "n", "s1", "s2")
    sizes = scratch.save(sizes, "members")
    weight = scratch.save(sizes.groupBy("component").agg(F.ceil(F.sum("n") / task_shingles).cast("int").alias("blocks")), "weights")

    def to_sets(batches):
        for batch, o, b in text_batches(batches):
            ptr, tokens = shingle_sets(o, b, k)
            sets = [pack(tokens[i:j]) for i, j in zip(ptr, ptr[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("component", "blocks", "doc_id")] + [pa.array(sets, pa.binary())], names=["component", "blocks", "doc_id", "tokens"])

    text = docs.where("doc_id is not null").select("doc_id", "text")

    def sets_of(groups):
        members = sizes.select("doc_id", "component").join(groups, "component").join(text, "doc_id").select("component", "blocks", "doc_id", "text")
        return members.mapInArrow(to_sets, "component long, blocks int, doc_id long, tokens binary")

    def links(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        sets_ = [unpack(x, U64) for x in table["tokens"].to_pylist()]
        order = np.lexsort((ids, [len(s) for s in sets_]))
        ids, sets_ = ids[order], [sets_[i] for i in order]
        query = table["query"].to_numpy(zero_copy_only=False)[order] if "query" in table.column_names else np.ones(len(ids), bool)
        label = table["label"].to_numpy()[order] if "label" in table.column_names else np.arange(len(ids))
        _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
        root = divide_skip(sets_, ratio, query, first[inverse].astype(np.int64))
        apart = root != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[root[apart]], pa.int64()), "b": pa.array(ids[apart], pa.int64())})

    edges = scratch.save(sets_of(weight.where("blocks <= 1")).groupBy("component").applyInArrow(links, "a long, b long"), "links")
    large = None
    if not weight.where("blocks > 1").isEmpty():
        large = scratch.save(sets_of(weight.where("blocks > 1")), "large")
        edges = edges.unionByName(_large_groups(large, scratch, ratio, task_shingles, links))
    found = components(edges.unionByName(_shared_ids(some, classes)), scratch)
    scratch.drop(sizes, weight, *([large] if large is not None else []))
    classes = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("n", "s1", "s2", "component")
    out = profiles.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges that join an id to the classes of all its texts, for ids that repeat with different ones."""
    kind = F.struct("n", "s1", "s2")
    several = rows.groupBy("doc_id").agg(F.min(kind).alias("low"), F.max(kind).alias("high")).where("low <> high").select("doc_id")
    held = rows.join(several, "doc_id", "left_semi").join(classes, ["n", "s1", "s2"])
    return held.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))


def _large_groups(large: DataFrame, scratch: Scratch, ratio: int, task_shingles: int, links) -> DataFrame:
    """Edges within groups that no task could hold: first against one member, then by blocks."""
    centre = large.groupBy("component").agg(F.min("doc_id").alias("doc_id"))
    centre = centre.join(large, ["component", "doc_id"]).select("component", F.col("doc_id").alias("centre"), F.col("tokens").alias("centre_tokens"))

    def meet(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column("tokens").to_pylist(), batch.column("centre_tokens").to_pylist(), strict=True):
                x, y = unpack(x, U64), unpack(y, U64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                near.append(100 * both >= ratio * (len(x) + len(y) - both))
            label = [c if n else d for n, c, d in zip(near, batch.column("centre").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("component", "blocks", "doc_id", "tokens")] + [pa.array(label, pa.int64()), pa.array([not x for x in near])], names=["component", "blocks", "doc_id", "tokens", "label", "query"])

    met = scratch.save(large.join(centre, "component").mapInArrow(meet, "component long, blocks int, doc_id long, tokens binary, label long, query boolean"), "met")
    edges = met.where("label <> doc_id").select(F.col("label").alias("a"), F.col("doc_id").alias("b"))
    left = met.where("query").groupBy("component").agg(F.ceil(F.sum(F.length("tokens")) / (8 * task_shingles)).cast("int").alias("query_blocks"))
    met = met.join(left, "component")
    spot = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int")
    side = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("query_blocks").cast("long")).cast("int")
    pairs = met.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("component", "x", spot.alias("y"), "doc_id", "tokens", "label", F.lit(False).alias("query"))
    asks = met.where("query").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", side.alias("x"), "y", "doc_id", "tokens", "label", "query")
    both = pairs.unionByName(asks).groupBy("component", "x", "y").applyInArrow(lambda t: links(_once(t)), "a long, b long")
    return edges.unionByName(both)


def _once(table: pa.Table) -> pa.Table:
    """A document that stands on both sides of a block is kept as a query."""
    order = np.lexsort((~table["query"].to_numpy(zero_copy_only=False), table["doc_id"].to_numpy()))
    ids = table["doc_id"].to_numpy()[order]
    return table.take(order[np.append(True, ids[1:] != ids[:-1])])


def keep_one(docs: DataFrame, ratio: int = 80, k: int = 5) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; null doc_ids and other columns stay."""
    found = similarity_components(docs, ratio, k)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns_of(docs))
