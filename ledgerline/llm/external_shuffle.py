"""Sharding by a two-pass external shuffle: a seeded hash scatters rows into buckets that fit in memory, each bucket is shuffled there.

The buckets in order, each in its shuffled order, are one permutation of the table, which is cut into shards whose
counts are at most one apart and written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, release, shuffle_files_go, shuffle_parts

#: Bytes of text that a bucket aims at, and the most buckets and tasks; buckets grow beyond 2 ** 20 of them (16 TB).
BUCKET_BYTES = 16 << 20
MOST_BUCKETS, MOST_TASKS = 1 << 20, 1 << 15
#: A bucket of more than so many times its aim holds repeated ids, whose rows are scattered again one by one.
HOT = 4


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (none for null) plus 8 for its id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def scatter(docs: DataFrame, scratch: Scratch, seed: int, id_column: str, text_column: str, bucket_bytes: int) -> tuple[DataFrame, np.ndarray]:
    """First pass: (bucket, key, row) of every row, and the number of rows in each bucket.

    A row's bucket comes from a hash of seed and id. Where that heaps up one bucket, as an id that a third of
    the rows share would, its rows are dealt one by one over all buckets and written, so that what is
    counted is what is shuffled.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    ident, text = docs[f"`{id_column}`"], docs[f"`{text_column}`"]
    sized = docs.select(ident.alias("id"), text_size(text).alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    aim = max(bucket_bytes, math.ceil(total / MOST_BUCKETS))
    n = min(MOST_BUCKETS, max(shuffle_parts(scratch.spark), math.ceil(total / aim)))
    place = lambda c: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")
    found = sized.groupBy(place(F.col("id")).alias("bucket")).agg(F.count("*").alias("rows"), F.sum("size").alias("size")).toPandas()
    hot = found[(found["size"] > HOT * aim) & (found["rows"] > 1)]
    rows = docs.select(place(ident).alias("bucket"), F.xxhash64(F.lit(seed + 1), ident, text).alias("key"), row)
    counts = np.zeros(n, np.int64)
    counts[found["bucket"]] = found["rows"]
    if len(hot):
        held = F.col("bucket").isin(hot["bucket"].tolist())
        dealt = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(n)).cast("int")
        again = scratch.save(rows.where(held).select(dealt.alias("bucket"), "key", "row"), "hot")
        rows = rows.where(~held).unionAll(again)
        more = again.groupBy("bucket").agg(F.count("*").alias("rows")).toPandas()
        counts[hot["bucket"]] = 0
        counts[more["bucket"]] += more["rows"].to_numpy()
    return rows, counts


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places, by exchanging each place from the last down with one not after it."""
    order = np.arange(n)
    np.random.default_rng([seed & 0xFFFFFFFF, bucket]).shuffle(order)
    return order


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write docs in a seeded random order to path/shard=K and return them reread: (slot, row, shard).

    Shards hold numbers of rows at most one apart, slots run from 0 without gaps; each row is in `row`, whole,
    so its columns may have any names. The order depends on seed, ids, texts and the number of buckets
    (bucket_bytes and the session's shuffle partitions), not on the input's layout; only rows of an id that fills several buckets are
    dealt by their place. Null and empty texts weigh 8 bytes and null ids are one id; rows that agree in id
    and text are equal and each has a slot; an empty table writes nothing and gives no rows.
    """
    spark = docs.sparkSession
    rows, counts = scatter(docs, Scratch(spark), seed, id_column, text_column, bucket_bytes)
    first = np.concatenate([[0], np.cumsum(counts)])
    bounds = np.array([k * int(first[-1]) // n_shards for k in range(n_shards + 1)])
    each = math.ceil(len(counts) / MOST_TASKS)
    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("row", rows.schema["row"].dataType), T.StructField("shard", T.IntegerType())])

    def shuffle(bucket: int, parts: list[pa.RecordBatch]):
        held = pa.Table.from_batches(parts).combine_chunks()
        order = fisher_yates(held.num_rows, seed, bucket)
        if held.num_rows != first[bucket + 1] - first[bucket]:
            raise ValueError(f"bucket {bucket} has {held.num_rows} rows of {first[bucket + 1] - first[bucket]}")
        at = first[bucket] + np.arange(held.num_rows)
        shard = np.searchsorted(bounds, at, side="right") - 1
        out = held.select(["row"]).take(pa.array(order))
        yield from pa.table({"slot": pa.array(at - bounds[shard], pa.int64()), "row": out["row"], "shard": pa.array(shard, pa.int32())}).to_batches(max_chunksize=4096)

    def run(batches):
        now, parts = None, []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if i < j and bucket[i] != now:
                    if parts:
                        yield from shuffle(now, parts)
                    now, parts = int(bucket[i]), []
                parts.append(batch.slice(i, j - i))
        if parts:
            yield from shuffle(now, parts)
        release()

    dealt = rows.repartitionById(math.ceil(len(counts) / each), F.expr(f"bucket div {each}").cast("int")).sortWithinPartitions("bucket", "key")
    shuffled = dealt.mapInArrow(run, schema).sortWithinPartitions("shard", "slot")
    with shuffle_files_go(spark):
        shuffled.write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)
