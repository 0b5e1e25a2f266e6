"""An upsert table that is read and compacted while a stream writes it.

Rows lie in files by range of the keys' hash. A *manifest* lists the live folders; the newest one
is the table. Each change writes its files first and then publishes the next manifest, a small file
that is moved to a name nobody may take twice. A reader therefore sees the table before or after a
change, never half of it, and two writers can't overwrite each other's change: the later one reads
the new manifest and tries again.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillcask.operators.dedup import latest_by_key
from rillcask.streaming.sinks import BATCH, start

RANGE = "key_range"


class UpsertTable:
    """Last row per key in ``path``, by ``order``; equal orders go to the later batch.

    ``ranges`` is the number of key ranges, each of which a reader finds in at most ``max_files``
    folders once ``compact`` has run. The files of the last ``keep`` manifests stay, so a reader has
    that many changes' time; one that takes longer fails for want of a file and reads anew.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, order: list[str],
        ranges: int = 8, max_files: int = 4, keep: int = 3,
    ) -> None:
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.ranges, self.max_files, self.keep = ranges, max_files, keep
        self.schema = schema
        self.stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        context = spark.sparkContext
        self._jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ---- manifests

    def versions(self) -> list[int]:
        """Versions whose manifest is still there, oldest first."""
        folder = self._at("manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest list of live folders, or an older one."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "batches": {}, "live": []}
            version = known[-1]
        stream = self._fs.open(self._at(f"manifest/{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> bool:
        """False if another change took this version."""
        draft = self._at(f"manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(draft, self._at(f"manifest/{manifest['version']:012d}.json"), none)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def _change(self, edit: Callable[[dict], dict | None]) -> bool:
        """Publish what ``edit`` makes of the newest manifest; None leaves it alone."""
        while True:
            old = self.manifest()
            new = edit(old)
            if new is None:
                return False
            if self._publish({**new, "version": old["version"] + 1}):
                self._forget()
                return True

    def _forget(self) -> None:
        """Drop the oldest manifests and the folders that only they list."""
        known = self.versions()
        old, kept = known[: -self.keep], known[-self.keep :]
        if not old:
            return
        live = {e["folder"] for v in kept for e in self.manifest(v)["live"]}
        for version in old:
            for entry in self.manifest(version)["live"]:
                if entry["folder"] not in live:
                    self._fs.delete(self._at(entry["folder"]), True)
            self._fs.delete(self._at(f"manifest/{version:012d}.json"), False)

    # ---- rows

    def _write(self, rows: DataFrame) -> list[dict]:
        """Write rows by range into a fresh folder; entries for the manifest."""
        folder = f"data/{uuid.uuid4().hex}"
        number = F.pmod(F.xxhash64(*self.keys), F.lit(self.ranges)).cast("int")
        rows.withColumn(RANGE, number).repartition(RANGE).write.partitionBy(RANGE).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]
        return [
            {"range": int(n.split("=")[1]), "folder": f"{folder}/{n}"}
            for n in sorted(names) if n.startswith(f"{RANGE}=")
        ]

    def _rows(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.stored)
        rows = self.spark.read.schema(self.stored).parquet(*[f"{self.path}/{e['folder']}" for e in entries])
        return latest_by_key(rows, self.keys, [*self.order, BATCH])

    def holds(self, batch_id: int, writer: str = "stream") -> bool:
        return self.manifest()["batches"].get(writer, -1) >= batch_id

    def upsert(self, rows: DataFrame, batch_id: int, writer: str = "stream") -> bool:
        """Add a batch: its last row per key. A batch that is in already changes nothing."""
        if self.holds(batch_id, writer):
            return False
        last = latest_by_key(rows.select(*self.schema.names), self.keys, self.order)
        entries = self._write(last.withColumn(BATCH, F.lit(batch_id).cast("long")))

        def edit(old: dict) -> dict | None:
            if old["batches"].get(writer, -1) >= batch_id:
                return None
            return {"batches": {**old["batches"], writer: batch_id}, "live": old["live"] + entries}

        return self._change(edit)

    def compact(self) -> list[int]:
        """Rewrite the ranges that lie in more than ``max_files`` folders, one folder each.

        Only these ranges are read. Their last rows, deletions too, replace the folders read; what
        other writers add meanwhile stays beside them. Returns the ranges.
        """
        live = self.manifest()["live"]
        full = {r for r, n in Counter(e["range"] for e in live).items() if n > self.max_files}
        if not full:
            return []
        old = [e for e in live if e["range"] in full]
        gone, entries = {e["folder"] for e in old}, self._write(self._rows(old))

        def edit(now: dict) -> dict | None:
            if not gone <= {e["folder"] for e in now["live"]}:
                return None  # someone else has rewritten them
            return {**now, "live": [e for e in now["live"] if e["folder"] not in gone] + entries}

        return sorted(full) if self._change(edit) else []

    def read(self, deleted: Column | None = None, version: int | None = None) -> DataFrame:
        """The rows as they are now (or were), without keys whose last row is ``deleted``."""
        rows = self._rows(self.manifest(version)["live"]).select(*self.schema.names)
        return rows if deleted is None else rows.where(~F.coalesce(deleted, F.lit(False)))


def write_table(
    df: DataFrame, table: UpsertTable, checkpoint: str, every: str | None = None, mode: str = "update",
) -> StreamingQuery:
    """Keep ``table`` up to date with a stream, compacting between its batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)
        table.compact()

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return start(writer, every)
