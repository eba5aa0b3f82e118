"""Vector bin packing of token sequences under simultaneous limits, by the dot-product heuristic."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches
from .encode import ENCODE_BYTES, Encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Packer:
    """Places examples into sequences, keeping at most `pool` open examples.

    An example is (id, ids as bytes, number of leading tokens without loss). Limits on a sequence:
    tokens, segments and loss-bearing tokens. The next example of the open sequence is the one with
    the largest dot product of its sizes with what is left, both relative to the limits, among those
    that fit. Where none fits, the one with the largest product is cut so that it fills what is left.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, base: int, pool: int):
        self.cap = np.array([max_tokens, max_segments, max_loss], float)
        self.base, self.pool = base, pool
        self.items: list[list] = []  # [id, ids, first unplaced token, tokens, prompt]
        self.size = np.zeros((pool + 1, 3))
        self.seq = self.offset = 0
        self.left = self.cap.copy()
        self.out: list[tuple] = []

    def add(self, ident, ids: bytes, prompt: int) -> None:
        self.items.append([ident, ids, 0, len(ids) // 4, prompt])
        self._measure(len(self.items) - 1)
        while len(self.items) > self.pool:
            self.place()

    def _measure(self, k: int) -> None:
        _, _, at, n, prompt = self.items[k]
        self.size[k] = n - at, 1, max(0, n - max(at, prompt))

    def _close(self) -> None:
        self.seq, self.offset, self.left = self.seq + 1, 0, self.cap.copy()

    def place(self) -> None:
        if self.left.min() < 1:
            self._close()
        n = len(self.items)
        size = self.size[:n]
        score = size @ (self.left / self.cap / self.cap)
        fits = (size <= self.left).all(1)
        k = int(np.argmax(np.where(fits, score, -1.0))) if fits.any() else int(np.argmax(score))
        ident, ids, at, total, prompt = self.items[k]
        take = min(total - at, int(self.left[0]))
        lossless = max(0, min(take, prompt - at))
        take = min(take, lossless + int(self.left[2]))
        loss = take - min(take, lossless)
        part = ids[4 * at : 4 * (at + take)]
        self.out.append((ident, at, take, zlib.crc32(part), total, loss, self.base + self.seq, self.offset))
        self.offset += take
        self.left -= (take, 1, loss)
        if at + take == total:
            last = self.items.pop()
            if k < n - 1:
                self.items[k] = last
                self.size[k] = self.size[n - 1]
        else:
            self.items[k][2] = at + take
            self._measure(k)

    def drain(self) -> None:
        while self.items:
            self.place()


def answers(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Examples (doc_id, prompt, text) of turns (conv_id, turn, role, text): each turn of `role` is an answer, whose prompt is what was said since the one before.

    doc_id is conv_id * 1,000,000 + the example's last turn. Turns after the last answer are a prompt without a text;
    turns of one number go by role and text; null texts are empty; an empty table gives no rows. A window
    numbers a conversation's answers, so only one prompt's turns are gathered at a time.
    """
    said = F.coalesce(F.col("role") == role, F.lit(False))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    told = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"), "role", "text", said.alias("said"))
    told = told.withColumn("k", F.coalesce(F.sum(F.col("said").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.sort_array(F.collect_list(F.when(~F.col("said"), F.struct("turn", "role", "t"))))
    one = told.groupBy("conv_id", "k").agg(F.max("turn").alias("turn"), F.array_join(F.transform(before, lambda x: x["t"]), "\n").alias("prompt"), F.max(F.when(F.col("said"), F.col("t"))).alias("text"))
    return one.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"), "prompt", "text")


def pack_examples(docs: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, pool: int = 256, prompt: str | None = None, specials: bool = True) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text).

    Every text is encoded whole and ends with end_id; an added token that a text spells out is one id, or text like
    any other with specials=False. `prompt` names an optional text column whose
    tokens come before the text's and bear no loss. Tasks pack what they read, in one pass with at
    most `pool` open examples, so there is no shuffle and each task leaves one sequence unfilled.
    Null texts and empty ones give the end id alone; a null doc_id is kept; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    max_loss = max_loss or max_tokens
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = Encoder.at(tokenizer, specials)
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 32, pool)

        def rows():
            out, packer.out = packer.out, []
            types = [pa.int64()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch, _, _ in text_batches(batches, limit=ENCODE_BYTES):
            bound, ids = encoder.encode(batch.column("text"))
            before, lead = encoder.encode(batch.column("prompt")) if prompt else (np.zeros(len(bound), np.int64), ids[:0])
            for k, ident in enumerate(batch.column("doc_id").to_pylist()):
                first = lead[before[k] : before[k + 1]]
                packer.add(ident, first.tobytes() + ids[bound[k] : bound[k + 1]].tobytes() + end, len(first))
            yield rows()
        packer.drain()
        yield rows()

    cols = ["doc_id", "text"] + ([docs[prompt].alias("prompt")] if prompt else [])
    return docs.select(*cols).mapInArrow(run, SCHEMA)
