"""Uploads as a file stream: each file's content is merged into the master once, whatever it is called and wherever a run dies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import KINDS, LISTING
from ..plans.checkpoints import numbered
from ..plans.merge import build_plan, default_inserts, default_updates
from ..plans.table import MasterTable
from ..sources.documents import content_hash

FILE = "path string, modificationTime timestamp, length long, content binary"
ACCEPTED = "content_hash string, path string"


def read_parquet_uploads(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(LISTING).parquet(*paths)


def _first_of_content(key, frames, state):
    """Of one content's events in order: the first upload is let through, and the first after a discard."""
    seen = state.exists
    out = []
    for e in pd.concat(frames).sort_values(["at", "kind", "path"]).itertuples():
        if e.kind == "discard":
            seen = False
        elif not seen:
            seen = True
            out.append((key[0], e.path))
    if seen:
        state.update((True,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["content_hash", "path"])


def accepted_uploads(spark: SparkSession, folder: str, discards: str | None = None, pattern: str = "*.parquet", files_per_trigger: int = 1000, logic: str = "1") -> DataFrame:
    """(content_hash, path), a stream: files that come into a folder and whose content was not seen before.

    Files are hashed where they are read, with the version of the logic that will read them; what is kept of each content
    is one state under its hash. Lines
    {"content_hash": ...} in `discards` make a content new again, as when a pending batch is thrown away.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    events = files.select(content_hash(F.col("content"), logic).alias("content_hash"), F.lit("upload").alias("kind"), "path", F.col("modificationTime").alias("at"))
    if discards:
        gone = spark.readStream.schema("content_hash string, at timestamp").json(discards)
        events = events.unionByName(gone.select("content_hash", F.lit("discard").alias("kind"), F.lit(None).cast("string").alias("path"), "at"))
    return events.groupBy("content_hash").applyInPandasWithState(_first_of_content, ACCEPTED, "seen boolean", "append", "NoTimeout")


def merge_batch(table: MasterTable, rows: DataFrame, batch_id: int, checkpoint, stream: str = "uploads") -> str | None:
    """Merge one batch under the default decisions; None if it is empty or the table has this batch of the stream already.

    The id is in the same commit as the rows, so a batch that dies at any step is merged once when it is run
    again; rows are ordered by their values, so that it is then the same batch.
    """
    rows = checkpoint(rows.select(*KINDS), "rows")
    if rows.isEmpty():
        return None
    order = ["provider", "building", "floor_unit", "postcode", "source_file", "_line"]
    lines = rows.withColumn("_line", F.monotonically_increasing_id())
    batch = checkpoint(numbered(lines, order, "_pos", checkpoint).drop("_line"), "batch")

    def change(master):
        plan = build_plan(batch, master, checkpoint)
        return default_updates(plan), default_inserts(plan), None

    return table.merge(change, checkpoint, f"stream:{batch_id}", (stream, batch_id))


def run_available(spark: SparkSession, folder: str, table: MasterTable, checkpoint_dir: str, checkpoint, discards: str | None = None, read: Callable[[SparkSession, list[str]], DataFrame] = read_parquet_uploads, pattern: str = "*.parquet") -> None:
    """Merge the files that have come into a folder since the last run, and stop.

    read(spark, paths) gives the listing rows of accepted files; their paths, at most files_per_trigger of them,
    come to the driver.
    """

    def merge(files: DataFrame, k: int) -> None:
        paths = [r["path"] for r in files.select("path").collect()]
        if paths:
            merge_batch(table, read(spark, sorted(paths)), k, checkpoint, checkpoint_dir)

    stream = accepted_uploads(spark, folder, discards, pattern)
    stream.writeStream.foreachBatch(merge).outputMode("append").option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()
