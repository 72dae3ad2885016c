"""Versions of a keyed table in buckets of which only those that change are written.

A version is a small manifest that names a folder for each bucket.  A batch reads the
buckets that its keys fall into, writes new folders for those that change, and then adds
the next manifest in one step; all other buckets go on being the folders they were.  No
folder or manifest is changed after that, so a reader has a whole version or the one
before, and of two writers at once the second finds its number taken and starts again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as machine

_BUCKET = "_bucket"


class SnapshotStore:
    """A table with a unique key under a path; opened again, it goes on from the last version."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)
        now = self._manifest(self.versions()[-1]) if self.versions() else {}
        self.buckets = now.get("buckets", buckets)

    def _at(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[str]:
        """Names of the versions, oldest first."""
        at = self._at("manifests")
        found = [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(n for n in found if n.startswith("v"))

    def _manifest(self, name: str) -> dict:
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._files.open(self._at(f"manifests/{name}")), "UTF-8")
        return json.loads(lines)

    def current(self) -> dict:
        """The last manifest: buckets, the folder of each, and the last batch of each source."""
        done = self.versions()
        return self._manifest(done[-1]) if done else {"buckets": self.buckets, "folders": {}, "sources": {}}

    def _read(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in manifest["folders"].items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: str | None = None) -> DataFrame:
        """The last version, or an earlier one that is still kept."""
        return self._read(self.current() if version is None else self._manifest(version))

    def _commit(self, number: int, manifest: dict) -> bool:
        """Add a manifest; False if that number is taken."""
        draft, final = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"manifests/v{number:09}")
        out = self._files.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        self._files.mkdirs(self._at("manifests"))
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf).rename(draft, final, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            self._files.delete(draft, False)
            return False
        return True

    def apply(self, batch: DataFrame, source: str = "manual", number: int | None = None, tries: int = 5) -> bool:
        """Store complete snapshots, and incomplete ones of new keys; False if this batch of the source was stored before.

        batch: the table's columns and variants_complete.
        """
        for _ in range(tries):
            done = self.versions()
            now = self.current()
            if number is not None and now["sources"].get(source, -1) >= number:
                return False
            changed = self._write(batch, now)
            sources = now["sources"] | ({source: number} if number is not None else {})
            version = int(done[-1][1:]) + 1 if done else 1
            if self._commit(version, {"buckets": self.buckets, "folders": now["folders"] | changed, "sources": sources}):
                return True
        raise RuntimeError("other writers took the next version each time")

    def _write(self, batch: DataFrame, now: dict) -> dict[str, str]:
        """Write the buckets that a batch changes; the folder of each."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        asked = [r[0] for r in batch.select(bucket.alias(_BUCKET)).distinct().collect()]  # at most as many as there are buckets
        stored = self._read(now, asked)
        new = machine.accepted(batch, stored, self.key).select(*stored.columns)
        touched = new.select(bucket.alias(_BUCKET)).distinct()
        after = machine.upsert(stored, new, [self.key]).withColumn(_BUCKET, bucket).join(F.broadcast(touched), _BUCKET, "left_semi")
        folder = f"data/{uuid.uuid4().hex}"
        after.repartition(self.buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        names = [x.getPath().getName() for x in self._files.listStatus(self._at(folder)) if x.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests before the last ``keep``, and folders that none of those names; how many folders."""
        done = self.versions()
        for name in done[:-keep]:
            self._files.delete(self._at(f"manifests/{name}"), False)
        used = {f for name in done[-keep:] for f in self._manifest(name)["folders"].values()}
        gone = 0
        for top in self._files.listStatus(self._at("data")):
            for inner in self._files.listStatus(top.getPath()):
                if inner.isDirectory() and f"data/{top.getPath().getName()}/{inner.getPath().getName()}" not in used:
                    self._files.delete(inner.getPath(), True)
                    gone += 1
        return gone
