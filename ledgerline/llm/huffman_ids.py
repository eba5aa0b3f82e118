"""Token ids in a Huffman-coded table of blocks, written in id order and read back.

The format is a folder: `codes` holds each id's code length (canonical codes follow from lengths
alone), `blocks` one row for each block of whole documents: their ids, token counts, the position of
the block's first token in the corpus, the bit offset of every STRIDE-th token, and the coded bits.
A block is decoded alone, and inside it every checkpoint starts a lane; all lanes advance together
through one look-up table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import rows_of
from .common import Scratch, pack, text_batches, unpack
from .encode import ENCODE_BYTES, Encoder

STRIDE = 512
BLOCK_TOKENS = 1 << 20
LONGEST = 16
BLOCK = "part int, block int, tokens long, start long, doc_ids binary, known binary, counts binary, marks binary, bits binary"


def code_lengths(count: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code in which none exceeds longest, by package-merge; 0 where count is 0."""
    out = np.zeros(len(count), np.uint8)
    used = np.flatnonzero(count)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more ids than codes of that length")
    leaves = np.argsort(count[used], kind="stable")
    weight = count[used][leaves].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weight))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    lengths = np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used[leaves]] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id) from lengths; left-aligned within LONGEST bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    step = 1 << (LONGEST - lengths[order].astype(np.int64))
    out = np.zeros(len(lengths), np.int64)
    out[order] = np.cumsum(step) - step
    return out


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offset of every STRIDE-th id, and the coded bits."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    # codes stand in order, so those that begin in one machine word are a run; of each run only the last may reach into the next
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    code = codes[ids].astype(np.uint64)
    out = np.zeros((total >> 6) + 2, np.uint64)
    if len(at):
        runs = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[runs]] = np.bitwise_or.reduceat(code << np.uint64(64 - LONGEST) >> bit, runs)
        last = np.append(runs[1:], len(at)) - 1
        last = last[bit[last] > 64 - LONGEST]
        out[word[last] + 1] |= code[last] << (np.uint64(128 - LONGEST) - bit[last])
    return at[::STRIDE], out.astype(">u8").tobytes()[: -(-total // 8)]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """id and code length for every LONGEST-bit window."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    width = 1 << (LONGEST - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << LONGEST, np.uint32), np.ones(1 << LONGEST, np.int64)
    n = int(width.sum())
    ids[:n], size[:n] = np.repeat(order, width), np.repeat(lengths[order], width)
    return ids, size


def decode_bits(bits: bytes, marks: np.ndarray, tokens: int, table) -> np.ndarray:
    """The ids of a block: every checkpoint is a lane, and all lanes take STRIDE steps together."""
    ids, size = table
    raw = np.frombuffer(bits, np.uint8).astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(3 + STRIDE * LONGEST // 8, np.uint32)])
    window = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    at = marks.astype(np.int64)
    out = np.zeros((len(marks), STRIDE), np.uint32)
    mask = (1 << LONGEST) - 1
    for t in range(min(STRIDE, tokens)):
        w = window[at >> 3].astype(np.int64) >> (24 - LONGEST - (at & 7)) & mask
        out[:, t] = ids[w]
        at += size[w]
    return out.ravel()[:tokens]


def tokenize_blocks(docs: DataFrame, tokenizer: str, end_id: int, specials: bool = True) -> DataFrame:
    """Blocks of encoded documents in ascending doc_id order; part and block give that order.

    inside is the number of tokens of the part before the block. An added token that a text spells out is one id, or
    text like any other with specials=False.
    """

    def run(batches):
        encoder = Encoder.at(tokenizer, specials)
        part, n, inside = TaskContext.get().partitionId(), 0, 0
        for batch, _, _ in text_batches(batches, limit=ENCODE_BYTES):
            bound, ids = encoder.encode(batch.column("text"))
            count = np.diff(bound) + 1
            ends = np.cumsum(count)
            flat = np.zeros(ends[-1], np.uint32)
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner], flat[~inner] = ids, end_id
            doc = batch.column("doc_id").cast(pa.int64())
            known, doc = doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            i = 0
            while i < len(count):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - count[i] + BLOCK_TOKENS, side="right")))
                piece = flat[ends[i] - count[i] : ends[j - 1]]
                small = len(piece) and piece.max() < 65536
                row = [part, n, len(piece), inside, pack(doc[i:j]), pack(known[i:j]), pack(count[i:j]), pack(piece.astype(np.uint16) if small else piece), bool(small)]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["part", "block", "tokens", "inside", "doc_ids", "known", "counts", "ids", "small"])
                i, n, inside = j, n + 1, inside + len(piece)

    parts = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return parts.mapInArrow(run, "part int, block int, tokens long, inside long, doc_ids binary, known binary, counts binary, ids binary, small boolean")


def _ids(row) -> np.ndarray:
    return unpack(row["ids"], np.uint16 if row["small"] else np.uint32)


def id_counts(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs in all blocks; as long as the vocabulary."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for row in rows_of(batches):
            c = np.bincount(_ids(row))
            if len(c) > len(total):
                total, c = c, total
            total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = blocks.select("ids", "small").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write docs (doc_id, text) in ascending doc_id order as a folder of this format.

    Every text is encoded whole and ends with end_id; null and empty texts are the end id alone. Null
    doc_ids come first; rows that repeat a doc_id follow each other by their texts. An empty table
    gives a folder without blocks. Only code lengths and the token totals of partitions reach the driver.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.save(tokenize_blocks(docs, tokenizer, end_id), "ids")
    lengths = code_lengths(id_counts(blocks))
    codes = canonical(lengths)
    spark = docs.sparkSession
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    held = spark.sparkContext.broadcast((lengths, codes, before))

    def run(batches):
        size, code, first = held.value
        for row in rows_of(batches):
            marks, bits = encode_bits(_ids(row), size, code)
            out = [row["part"], row["block"], row["tokens"], first[row["part"]] + row["inside"], row["doc_ids"], row["known"], row["counts"], pack(marks), bits]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

    blocks.mapInArrow(run, BLOCK).write.parquet(f"{path}/blocks")
    scratch.drop(blocks)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document of a folder; ids is uint32 little-endian bytes."""
    rows = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    held = spark.sparkContext.broadcast(lengths)

    def run(batches):
        table = decode_table(held.value)
        for row in rows_of(batches):
            ids = decode_bits(row["bits"], unpack(row["marks"], np.int64), row["tokens"], table)
            count = unpack(row["counts"], np.int64)
            ends = np.cumsum(count)
            parts = [ids[a:b].tobytes() for a, b in zip(ends - count, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(unpack(row["doc_ids"], np.int64), mask=~unpack(row["known"], bool)), pa.array(row["start"] + ends - count, pa.int64()), pa.array(count, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
