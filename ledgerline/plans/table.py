"""The master as a versioned table: numbered commits over buckets of rows, a log, retention and restore."""

from __future__ import annotations

import datetime
import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.schema import KINDS, LISTING, to_listing
from ..sources.mapping import header_hash
from .checkpoints import numbered
from .merge import apply_merge, missing_ids

KEEP_VERSIONS = 30
#: Positions of one bucket, the unit that a merge writes anew.
BUCKET_ROWS = 100_000
LOG = "timestamp string, success boolean, row_count long, error string, source string, new_count long, updated_count long, version_path string, fields_changed long, removed_count long"
ROWS = StructType([*LISTING.fields]).add("_pos", LongType())


class CommitConflict(RuntimeError):
    """Another writer committed since the version that a write is based on."""


def _stamp() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d_%H-%M-%S-%f")


class MasterTable:
    """A folder with `data/<write>/bucket=K` (Parquet), `versions/<number>.json` (commits) and `log/` (JSON lines).

    A commit names the folder of each bucket of positions, so a version is a list of buckets and shares with
    the one before what a merge did not touch. A commit is one file with the next number, made only if
    there is none: of two writers with one base the second gets CommitConflict, and a reader or a crash
    at any time finds a whole version. What must hold together with the rows (ids of streamed batches, the
    log entry) is in the same file. All access goes through Spark and Hadoop's file systems, so the folder
    can be in any store they reach whose rename does not replace a file; on local disks a hard link does this.
    """

    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._over, self._new = (spark.sparkContext._gateway.new_array(rename, 1) for _ in range(2))
        self._over[0], self._new[0] = rename.OVERWRITE, rename.NONE
        self.seen: int | None = None

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _part(self, text: str):
        """text in a new hidden file, to be renamed."""
        part = self._fs.makeQualified(self._path(f"{self.root}/.{uuid.uuid4().hex}.part"))
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        return part

    def _write_text(self, name: str, text: str) -> None:
        """Write beside and rename over in one step, so that a reader sees the old or the new one."""
        to, part = self._fs.makeQualified(self._path(f"{self.root}/{name}")), self._part(text)
        self._fs.mkdirs(to.getParent())
        self._context.rename(part, to, self._over)

    def _create_text(self, name: str, text: str) -> None:
        """Make a file that does not exist yet, whole and in one step, or raise CommitConflict."""
        to, part = self._fs.makeQualified(self._path(f"{self.root}/{name}")), self._part(text)
        self._fs.mkdirs(to.getParent())
        try:
            if to.toUri().getScheme() == "file":
                os.link(part.toUri().getPath(), to.toUri().getPath())
            else:
                self._context.rename(part, to, self._new)
        except Exception as error:
            if self._fs.exists(to):
                raise CommitConflict(f"{name} is another writer's") from error
            raise
        finally:
            self._fs.delete(part, False)

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # ------------------------------------------------------------ versions

    def _names(self) -> list[str]:
        if not self._exists("versions"):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(f"{self.root}/versions")) if not (n := s.getPath().getName()).startswith("."))

    def state(self, name: str | None = None) -> dict:
        """A commit by name, the last one by default: version, buckets {bucket: {path, rows}}, top (the last position given), batches {stream: last batch}."""
        if name is None:
            names = self._names()
            if not names:
                return {"version": 0, "buckets": {}, "top": -1, "batches": {}, "row_count": 0, "bucket_rows": self.bucket_rows}
            name = names[-1]
        return json.loads(self._read_text(f"versions/{name}"))

    def current(self) -> str | None:
        """Path of the current version."""
        names = self._names()
        return f"{self.root}/versions/{names[-1]}" if names else None

    def _rows(self, buckets: dict) -> DataFrame:
        paths = [f"{self.root}/{b['path']}" for b in buckets.values()]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of a version (its path), the current one by default, with their _pos; empty before the first write."""
        state = self.state(version and version.rpartition("/")[2])
        if version is None:
            self.seen = state["version"]
        return self._rows(state["buckets"])

    def ordered(self) -> DataFrame:
        """The current rows in written order: no provider last, then by provider in lower case and position."""
        return self.read().orderBy(F.col("provider").isNull(), F.lower("provider"), "_pos")

    def versions(self, limit: int | None = None) -> DataFrame:
        """Versions, newest first, each with its log entry."""
        paths = self.spark.createDataFrame([(f"{self.root}/versions/{n}",) for n in self._names()], "version_path string")
        out = with_last_entry(paths, self.read_log()).orderBy(F.desc("version_path"))
        return out.limit(limit) if limit else out

    # ------------------------------------------------------------ writes

    def write(self, rows: DataFrame, source: str = "merge", base: int | None = None, **counts) -> str:
        """All rows (listing columns and a distinct _pos) as a new version; its path.

        base: the version the rows were made from, that which this object read last by default; CommitConflict
        if there is a newer one. Rows are counted as they are written and as they are read back.
        """
        state = self.state()
        if base is None:
            base = state["version"] if self.seen is None else self.seen
        with _Failures(self, source, counts):
            if base != state["version"]:
                raise CommitConflict(f"version {state['version']} is newer than {base}")
            return self._commit(state | {"buckets": {}, "bucket_rows": self.bucket_rows}, self._write_buckets(to_listing(rows), self.bucket_rows), source, counts)

    def merge(self, change, checkpoint, source: str = "merge", batch: tuple[str, int] | None = None, tries: int = 5, **counts) -> str | None:
        """Apply change(master) -> (updates, inserts, removed or None), see apply_merge, writing only the buckets it touches.

        New rows get the positions after the last one ever given, in order. If another writer commits first,
        change is asked again with the new rows. batch (stream, id): merged only if no batch of
        that stream with this id or a later one is in the table; None is returned if there is.
        """
        with _Failures(self, source, counts):
            for left in reversed(range(tries)):
                state = self.state()
                if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                    return None
                updates, inserts, removed = change(self._rows(state["buckets"]))
                try:
                    return self._overlay(state, updates, inserts, removed, checkpoint, source, batch, counts)
                except CommitConflict:
                    if not left:
                        raise

    def _overlay(self, state: dict, updates: DataFrame, inserts: DataFrame, removed: DataFrame | None, checkpoint, source: str, batch, counts: dict) -> str:
        size, top = state["bucket_rows"], state["top"]
        master = self._rows(state["buckets"])
        updates = checkpoint(updates.select("_pos", "field", "value").unionByName(missing_ids(master)), "updates")
        new = checkpoint(inserts.select(*KINDS, "_pos"), "new")
        inserts = checkpoint(numbered(new, ["_pos"], "_pos", checkpoint), "inserts")
        spots = updates.select("_pos")
        if removed is not None:
            removed = checkpoint(removed.select("_pos"), "removed")
            spots = spots.union(removed)
        touched = {str(r[0]) for r in spots.select(F.expr(f"_pos div {size}")).distinct().collect()} & set(state["buckets"])
        first = str((top + 1) // size)  # new rows go behind those of the last bucket
        if first in state["buckets"] and not inserts.isEmpty():
            touched.add(first)
        rows = apply_merge(self._rows({k: state["buckets"][k] for k in touched}), updates, inserts, removed, top)
        kept = {k: v for k, v in state["buckets"].items() if k not in touched}
        if touched or not inserts.isEmpty():
            return self._commit(state | {"buckets": kept}, self._write_buckets(rows, size), source, counts, batch)
        return self._commit(state, {}, source, counts, batch)

    def _write_buckets(self, rows: DataFrame, size: int) -> dict:
        """Write rows, by bucket and inside a bucket in written order; {bucket: {path, rows, top}}."""
        name, told = f"data/{_stamp()}-{uuid.uuid4().hex[:8]}", Observation()
        order = ["bucket", F.col("provider").isNull(), F.lower("provider"), "_pos"]
        out = rows.select(*ROWS.names, F.expr(f"_pos div {size}").alias("bucket")).repartition("bucket").sortWithinPartitions(*order)
        out.observe(told, F.count("*").alias("n")).write.partitionBy("bucket").parquet(f"{self.root}/{name}")
        if not told.get["n"]:
            return {}
        back = self.spark.read.parquet(f"{self.root}/{name}").groupBy("bucket").agg(F.count("*").alias("n"), F.max("_pos").alias("top")).collect()
        if sum(r["n"] for r in back) != told.get["n"]:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            raise ValueError(f"{sum(r['n'] for r in back)} rows were written of {told.get['n']}")
        return {str(r["bucket"]): {"path": f"{name}/bucket={r['bucket']}", "rows": r["n"], "top": r["top"]} for r in back}

    def _commit(self, state: dict, written: dict, source: str, counts: dict, batch: tuple[str, int] | None = None) -> str:
        """Make the version after state's, with the written buckets in place of those it names."""
        number = state["version"] + 1
        buckets = state["buckets"] | written
        path = f"{self.root}/versions/{number:020d}.json"
        entry = {"timestamp": _stamp(), "success": True, "row_count": sum(b["rows"] for b in buckets.values()), "source": source, "version_path": path, **counts}
        batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        told = {"version": number, "bucket_rows": state["bucket_rows"], "top": max([state["top"], *(b["top"] for b in written.values())]), "batches": batches, "buckets": buckets}
        try:
            self._create_text(f"versions/{number:020d}.json", json.dumps(entry | told) + "\n")
        except CommitConflict:
            for b in {b["path"].rpartition("/")[0] for b in written.values()}:
                self._fs.delete(self._path(f"{self.root}/{b}"), True)
            raise
        self.seen = number
        self._retain(number)
        return path

    def restore(self, version: str, source: str | None = None) -> str:
        """An old version as a new one: a commit that names the same files, byte for byte, after they are found whole."""
        name = version.rpartition("/")[2]
        source = source or f"restore:{version}"
        with _Failures(self, source, {}):
            state = self.state()
            if name not in self._names() or int(name.partition(".")[0]) <= state["version"] - KEEP_VERSIONS:
                raise ValueError(f"{name} is no longer kept")
            old = self.state(name)
            if (found := self._rows(old["buckets"]).count()) != old["row_count"]:
                raise ValueError(f"{name} has {found} rows of {old['row_count']}")
            return self._commit(old | {"version": state["version"], "top": max(old["top"], state["top"]), "batches": state["batches"]}, {}, source, {})

    # ------------------------------------------------------------ log and retention

    def log(self, stamp: str, success: bool, **fields) -> None:
        self._write_text(f"log/{stamp}.json", json.dumps({"timestamp": stamp, "success": success, **fields}) + "\n")

    def read_log(self) -> DataFrame:
        """Commits that are kept, and what the log has of older ones and of failures."""
        folders = [f"{self.root}/{n}" for n in ("versions", "log") if self._exists(n)]
        if not folders:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(folders).dropDuplicates(["timestamp", "version_path"])

    def _retain(self, number: int) -> None:
        """Forget versions KEEP_VERSIONS before number, and folders that none of the others names; a failure here never fails the write.

        An entry goes to the log, then the folders go, then the commit, so that a crash in between is made good
        by the next write. Folders of writers at work are in no commit and stay.
        """
        try:
            names = self._names()
            old = [n for n in names if int(n.partition(".")[0]) <= number - KEEP_VERSIONS]
            if not old:
                return
            held = {b["path"] for n in names if n not in old for b in self.state(n)["buckets"].values()}
            for n in old:
                gone = self.state(n)
                self.log(gone["timestamp"], **{k: v for k, v in gone.items() if k in LOG and k not in ("timestamp",)})
                for b in gone["buckets"].values():
                    if b["path"] not in held:
                        self._fs.delete(self._path(f"{self.root}/{b['path']}"), True)
                self._fs.delete(self._path(f"{self.root}/versions/{n}"), False)
        except Exception as error:  # noqa: BLE001
            self.log(f"{_stamp()}-retention", False, error=str(error)[:200])


class _Failures:
    """Log a write that fails, and let its error through."""

    def __init__(self, table: MasterTable, source: str, counts: dict):
        self.table, self.source, self.counts = table, source, counts

    def __enter__(self):
        return self

    def __exit__(self, kind, error, _):
        if error is not None and isinstance(error, Exception):
            self.table.log(_stamp(), False, error=str(error)[:500], source=self.source, **self.counts)


def with_last_entry(versions: DataFrame, log: DataFrame) -> DataFrame:
    """versions (version_path) with the fields of their last log entry, null where there is none."""
    fields = [c for c in ("timestamp", "row_count", "source", "new_count", "updated_count", "removed_count", "fields_changed") if c in log.columns]
    last = log.where("version_path is not null").groupBy("version_path").agg(F.max_by(F.struct(*fields), "timestamp").alias("e"))
    return versions.join(last, "version_path", "left").select("version_path", "e.*")


def latest_uploads(batches: DataFrame) -> DataFrame:
    """The latest batch of each content hash, whatever its status; null hashes have none."""
    last = batches.where("content_hash is not null").groupBy("content_hash").agg(F.max_by(F.struct(*batches.columns), F.struct("timestamp", "path")).alias("b"))
    return last.select("b.*")


def latest_upload(batches: DataFrame, content_hash: str) -> DataFrame:
    """The latest batch with this content hash; a null hash never matches."""
    return latest_uploads(batches.where(F.col("content_hash") == content_hash))


class RescueStore:
    """What reviewers said about critical fields that no header settles, one JSON for each set of headers."""

    STATE = "header_hash string, headers array<string>, assignments map<string,string>"

    def __init__(self, spark: SparkSession, root: str):
        self.table = MasterTable(spark, root)
        self.spark, self.root = spark, self.table.root

    def save(self, headers: list[str], assignments: dict[str, str | None]) -> str:
        """Keep {field: header or null} for these headers; the last one saved counts."""
        name = header_hash(headers)
        self.table._write_text(f"rescues/{name}.json", json.dumps({"header_hash": name, "headers": headers, "assignments": assignments}) + "\n")
        return name

    def read(self) -> DataFrame:
        if not self.table._exists("rescues"):
            return self.spark.createDataFrame([], self.STATE)
        return self.spark.read.schema(self.STATE).json(f"{self.root}/rescues")

    def lookup(self, hashes: list[str]) -> dict[str, dict[str, str | None]]:
        """The assignments of those of these header sets that have any; few headers, as a reviewer's."""
        rows = self.read().where(F.col("header_hash").isin(hashes)).collect() if hashes else []
        return {r["header_hash"]: dict(r["assignments"] or {}) for r in rows}


class Staging:
    """Batches that wait for approval: `rows/<batch>` and one JSON state for each."""

    STATE = "path string, filename string, timestamp string, status string, n_rows long, content_hash string, fully_occupied_buildings array<struct<provider:string,building:string>>"

    def __init__(self, spark: SparkSession, root: str):
        self.table = MasterTable(spark, root)
        self.spark, self.root = spark, self.table.root

    def save(self, rows: DataFrame, filename: str, content_hash: str | None = None, fully_occupied: list[dict] | None = None) -> str:
        stamp = _stamp()
        name = f"{stamp}_{''.join(ch if ch.isalnum() else '_' for ch in filename.rpartition('.')[0] or filename)}"
        path = f"{self.root}/rows/{name}"
        to_listing(rows).write.parquet(path)
        self._state(name, {"path": path, "filename": filename, "timestamp": stamp, "status": "pending", "n_rows": self.spark.read.parquet(path).count(), "content_hash": content_hash, "fully_occupied_buildings": fully_occupied or []})
        return name

    def _state(self, name: str, state: dict) -> None:
        self.table._write_text(f"state/{name}.json", json.dumps(state) + "\n")

    def batches(self) -> DataFrame:
        if not self.table._exists("state"):
            return self.spark.createDataFrame([], self.STATE)
        return self.spark.read.schema(self.STATE).json(f"{self.root}/state")

    def pending(self) -> DataFrame:
        """Pending batches, newest first."""
        return self.batches().where("status = 'pending'").orderBy(F.desc("timestamp"), F.desc("path"))

    def approve(self, name: str) -> None:
        row = self.batches().where(F.col("path") == f"{self.root}/rows/{name}").first().asDict(recursive=True)
        self._state(name, row | {"status": "approved"})

    def discard(self, name: str) -> None:
        """Delete a batch and forget its hash."""
        fs, path = self.table._fs, self.table._path
        fs.delete(path(f"{self.root}/rows/{name}"), True)
        fs.delete(path(f"{self.root}/state/{name}.json"), False)

    def union(self) -> DataFrame:
        """Rows of all pending batches with a building, by provider and then by batch and place."""
        paths = [r["path"] for r in self.pending().select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], LISTING).withColumn("_pos", F.lit(0).cast("long"))
        rows = self.spark.read.parquet(*paths).where("trim(building) <> ''")
        return rows.orderBy(F.col("provider").isNull(), F.lower("provider"), F.input_file_name(), "_pos") if "_pos" in rows.columns else rows.orderBy(F.col("provider").isNull(), F.lower("provider"))
