"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations only.

A store is a folder of Parquet shards and of manifests.  Arrivals are appended as small shards, in
the partitions in which they come.  Compaction puts shards of similar size in tiers (each `fanout`
times larger than the one before) and merges every tier of at least `fanout` shards: they are read
so that a task gets whole shards up to the merged size, and a task writes one file.  Nothing is
shuffled, and a row is rewritten once a tier until its shard reaches the target size.

A manifest lists the shards that make up a version.  It is written under a temporary name and moved
to v<N>.json, which fails if that version exists: of two writers one wins, and the other, having
changed no listed file, starts again from the new version.  Readers see a version whole or not.
`vacuum` removes shards that an older manifest lists and the versions to be kept do not, once they
are old enough for their readers to be done; what no manifest has listed yet belongs to a writer
that has not committed, and stays.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_path


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


class Conflict(Exception):
    """Another writer has committed the version first."""


class ShardStore:
    """Shards below a root that the driver and the executors share.

    target: bytes of a full shard; small: bytes of the first tier; fanout: shards merged into one,
    and the ratio of tiers.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 256 << 20, small: int = 4 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.small, self.fanout = spark, root.rstrip("/"), target, small, fanout
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the last by default; none before the first commit."""
        known = self.versions()
        if not known:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{known[-1] if version is None else version}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(s["path"], s["size"]) for s in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], after: int) -> int:
        """Make these shards version after + 1; raises Conflict if it exists."""
        version = after + 1
        temporary = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "shards": [s.__dict__ for s in shards]}).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            files.rename(temporary, self._path(f"{self.root}/manifests/v{version}.json"), options)
        except Exception as error:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} exists") from error
            raise
        return version

    def _written(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        found = self._fs.listStatus(self._path(folder))
        return [Shard(f.getPath().toString(), f.getLen()) for f in found if f.getPath().getName().endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        """Commit the rows of df as new shards, one for each partition that has rows."""
        written = self._written(df)
        return self._changed(lambda shards: shards + written)

    def _changed(self, change, tries: int = 20) -> int:
        """Commit a change of the shards, of the newest version each time another writer has been faster. A change that gives None is off: returns 0."""
        for _ in range(tries):
            version = (self.versions() or [0])[-1]
            shards = change(self.shards(version) if version else [])
            if shards is None:
                return 0
            try:
                return self.commit(shards, version)
            except Conflict:
                continue
        raise Conflict(f"{tries} versions were committed by others")

    def tier(self, size: int) -> int:
        t = 0
        while size > self.small * self.fanout**t:
            t += 1
        return t

    def compact(self, reclaim: float | None = None) -> int:
        """Merge tiers until none has `fanout` shards below the target; returns the last version. Each round is a commit.

        reclaim: vacuum shards after each round that are older than so many seconds; by default none.
        """
        while True:
            version = (self.versions() or [0])[-1]
            shards = self.shards(version) if version else []
            tiers: dict[int, list[Shard]] = {}
            for s in shards:
                if s.size < self.target:
                    tiers.setdefault(self.tier(s.size), []).append(s)
            ready = {t: own for t, own in tiers.items() if len(own) >= self.fanout}
            if not ready:
                return version
            merged, gone = [], set()
            for t, own in sorted(ready.items()):
                merged += self._merged(own, min(self.target, self.small * self.fanout ** (t + 1)))
                gone |= {s.path for s in own}
            fewer = len(merged) < len(gone)

            def swapped(now: list[Shard]) -> list[Shard] | None:
                return [s for s in now if s.path not in gone] + merged if gone <= {s.path for s in now} else None

            if not fewer or not self._changed(swapped):
                for s in merged:  # no version lists them
                    self._fs.delete(self._path(s.path), False)
                if not fewer:
                    return version
            elif reclaim is not None:
                self.vacuum(retention=reclaim)

    def _merged(self, own: list[Shard], size: int) -> list[Shard]:
        """Shards of about `size` bytes from whole ones, packed by the reader: a map-only job."""
        session = self.spark.newSession()
        for key, value in (("maxPartitionBytes", str(size)), ("openCostInBytes", "0"), ("minPartitionNum", "1")):
            session.conf.set(f"spark.sql.files.{key}", value)
        return self._written(session.read.parquet(*[s.path for s in own]))

    def vacuum(self, keep: int = 1, retention: float = 7 * 86400.0) -> None:
        """Remove the shards that only manifests before the last `keep` list and that are older than `retention` seconds, and manifests whose shards are all gone or kept."""
        known = self.versions()
        listed = {s.path for v in known[-keep:] for s in self.shards(v)}
        before = (time.time() - retention) * 1000
        for v in known[:-keep]:
            left = False
            for path in {s.path for s in self.shards(v)} - listed:
                file = self._path(path)
                if self._fs.exists(file):
                    if self._fs.getFileStatus(file).getModificationTime() <= before:
                        self._fs.delete(file, False)
                    else:
                        left = True
            if not left:
                self._fs.delete(self._path(f"{self.root}/manifests/v{v}.json"), False)

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version; an empty version needs a schema."""
        paths = [s.path for s in self.shards(version)]
        if not paths:
            return self.spark.createDataFrame([], schema or "value string")
        return self.spark.read.parquet(*paths)


def arrive_and_compact(spark: SparkSession, sf_dir: str, arrivals: int = 4, target: int = 32 << 20, small: int = 1 << 20) -> tuple[ShardStore, DataFrame]:
    """A store in the shared folder that `documents` has reached in several arrivals and that has been compacted; and its rows.

    Rows arrive by a hash of the id, whatever its type; nulls, empty texts and repeated rows are
    rows like others.  An arrival without rows adds no shard.  Target and first tier are smaller than
    the store's own, so that a small table makes several tiers too.
    """
    docs = read(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_path(spark, "shards"), target, small)
    for i in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == i))
    store.compact(reclaim=0)  # nobody else reads this store
    return store, store.read(schema=docs.schema)
