"""Documents packed into chunks of a few MB, and the exchange of keys between chunks by bucket.

A chunk is one row (chunk_id, ids, known, offsets, data, extra): a run of whole documents that one task
read, its bytes compressed.
Chunks are written to the shared folder once, so every later pass sees the same ones. In an exchange
each chunk sends every key once, with the smallest document id that has it there, to the key's bucket;
a bucket answers each chunk that sent a key which matters. What is sent for a key is thus bounded by
the number of chunks, not of documents, and no key gathers documents in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_bucket, mix, pack, release, text_batches, unpack

CHUNK = "chunk_id long, ids binary, known binary, offsets binary, data binary, extra binary"
CHUNK_BYTES = 2 << 20


def to_chunks(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Chunks of docs (doc_id, text). known marks ids that are not null; null texts are empty.

    extra names columns that a chunk carries along, as Arrow bytes.
    """
    names = [f"_{k}" for k in range(len(extra or []))]

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = n = 0

        def flush():
            nonlocal held, size, n
            ids = np.concatenate([h[0] for h in held])
            known = np.concatenate([h[1] for h in held])
            lens = np.concatenate([np.diff(h[2]) for h in held])
            data = pa.compress(b"".join(h[3] for h in held), codec="zstd", asbytes=True)
            more = None
            if names:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0][4].schema) as out:
                    for h in held:
                        out.write_batch(h[4])
                more = sink.getvalue().to_pybytes()
            row = [base + n, pack(ids), pack(known), pack(np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)), data, more]
            held, size, n = [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), *[pa.binary()] * 5), strict=True)], names=["chunk_id", "ids", "known", "offsets", "data", "extra"])

        for batch, o, b in text_batches(batches, limit=CHUNK_BYTES):
            if size and size + len(b) > CHUNK_BYTES:
                yield flush()
            ids = batch.column("doc_id").cast(pa.int64())
            held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), o, b.tobytes(), batch.select(names)))
            size += len(b)
        if held:
            yield flush()

    return docs.select("doc_id", "text", *[docs[f"`{c}`"].alias(k) for c, k in zip(extra or [], names, strict=True)]).mapInArrow(run, CHUNK)


def rows_of(batches):
    """Rows of Arrow batches as dicts, one at a time, so that few chunks are held at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        release()


class Chunk:
    def __init__(self, row: dict):
        self.chunk_id = row["chunk_id"]
        self.ids = unpack(row["ids"], np.int64)
        self.known = unpack(row["known"], bool)
        self.offsets = unpack(row["offsets"], np.int64)
        size = int(self.offsets[-1])
        self.data = np.frombuffer(pa.decompress(row["data"], size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
        self.extra = row["extra"]

    def columns(self) -> list[pa.Array]:
        """The columns carried along."""
        table = pa.ipc.open_stream(self.extra).read_all().combine_chunks()
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each key."""
    return pack(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def unpack_keys(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def send_rows(chunk_id: int, keys: np.ndarray, values: list[np.ndarray], buckets: int, width: int):
    """Rows (bucket, chunk_id, keys, v0, v1 ...) of one chunk."""
    order, cut = by_bucket((mix(keys ^ U64(0x5BF03635)) % U64(buckets)).astype(np.int64), buckets)
    keys, values = keys[order], [v[order] for v in values]
    some = [k for k in range(buckets) if cut[k + 1] > cut[k]]
    cols = [pa.array(some, pa.int32()), pa.array([chunk_id] * len(some), pa.int64())]
    cols.append(pa.array([pack_keys(keys[cut[k] : cut[k + 1]], width) for k in some], pa.binary()))
    for v in values:
        cols.append(pa.array([pack(v[cut[k] : cut[k + 1]]) for k in some], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "chunk_id", "keys", *[f"v{i}" for i in range(len(values))]])


def exchange(chunks: DataFrame, keys_of: Callable, answer: Callable, dtypes: list, buckets: int, answers: list, width: int = 8) -> DataFrame:
    """(chunk_id, keys, a0, a1 ...): what the buckets answer to each chunk.

    keys_of(row) gives distinct keys (uint64) and value arrays of dtypes for a chunk row. answer(keys,
    values, source) sees all of a bucket and gives a mask of the sent keys to answer and arrays of
    the dtypes in answers. Keys below 256 ** width travel in width bytes.
    """
    nv = len(dtypes)
    schema = "bucket int, chunk_id long, keys binary" + "".join(f", v{i} binary" for i in range(nv))
    reply = "chunk_id long, keys binary" + "".join(f", a{i} binary" for i in range(len(answers)))

    def send(batches):
        for row in rows_of(batches):
            keys, values = keys_of(row)
            yield send_rows(row["chunk_id"], keys, [np.asarray(v, t) for v, t in zip(values, dtypes, strict=True)], buckets, width)

    def meet(table: pa.Table) -> pa.Table:
        raw = table["keys"].to_pylist()
        counts = np.array([len(x) // width for x in raw])
        keys = np.concatenate([unpack_keys(x, width) for x in raw])
        values = [np.concatenate([unpack(x, t) for x in table[f"v{i}"].to_pylist()]) for i, t in enumerate(dtypes)]
        source = np.repeat(np.arange(len(raw)), counts)
        mask, given = answer(keys, values, source)
        ends = np.cumsum(counts)
        rows = {c: [] for c in ("chunk_id", "keys", *[f"a{i}" for i in range(len(answers))])}
        for c, lo, hi in zip(table["chunk_id"].to_pylist(), ends - counts, ends, strict=True):
            m = mask[lo:hi]
            if m.any():
                rows["chunk_id"].append(c)
                rows["keys"].append(pack_keys(keys[lo:hi][m], width))
                for i, t in enumerate(answers):
                    rows[f"a{i}"].append(pack(np.asarray(given[i], t)[lo:hi][m]))
        out = pa.table({c: pa.array(v, pa.int64() if c == "chunk_id" else pa.binary()) for c, v in rows.items()})
        del raw, keys, values, mask, given
        release()
        return out

    return chunks.mapInArrow(send, schema).groupBy("bucket").applyInArrow(meet, reply)


def with_answers(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks with the list `answers` of what they were told (null if nothing)."""
    told = replies.groupBy("chunk_id").agg(F.collect_list(F.struct(*[c for c in replies.columns if c != "chunk_id"])).alias("answers"))
    return chunks.join(told, "chunk_id", "left")


def told(row: dict, dtypes: dict, width: int = 8) -> list[np.ndarray]:
    """The keys of a chunk's answers, in order, and what came with them."""
    parts = row["answers"] or []
    out = [np.concatenate([unpack_keys(p["keys"], width) for p in parts]) if parts else np.zeros(0, U64)]
    out += [np.concatenate([unpack(p[c], t) for p in parts]) if parts else np.zeros(0, t) for c, t in dtypes.items()]
    order = np.argsort(out[0])
    return [x[order] for x in out]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key among sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
