"""Size-tiered compaction of immutable shards under a versioned manifest.

A shard table is a folder::

    data/<batch>/part-*.parquet     shards, never changed
    manifest/m-<id>/                a manifest: one row per shard (Parquet, written by Spark), never moved
    manifest/v00000001              a version: the manifest that it names, and the version on which it rests

Nothing that counts is ever moved or deleted by a commit. A writer takes a version's number by creating its file, which
fails if it is there, looks whether the last version is still the one on which it rests, and
writes the file's line. The last version with a line is the head; versions count if the head rests on them. A
writer that stalls between the two steps is passed by: others take the next number on top of what
counts, and when it goes on it finds that the head does not rest on its version and commits again. It is enough that the
store creates a file for one writer alone and shows a closed file to all; a store without that is not supported.
Arrivals are appended as small shards. Compaction sorts shards into tiers by size;
a tier with ``fanout`` shards or more is read and written again as files of the
target size, up to ``MERGE_SHARDS`` of them at a time, and the next version names those instead. Rows pass through Spark's
readers and writers alone, and which shards count is a join with the manifest: the
driver holds the names of the shards of one merge.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
#: Shards of a tier that make a merge worthwhile.
FANOUT = 4
#: Sizes in a tier differ by less than this factor.
TIER_FACTOR = 4
#: Most shards of a tier that are merged at a time.
MERGE_SHARDS = 10_000
#: How long a writer waits for one that has taken a higher number to write its line, before it takes a number above it.
CLAIM_SECONDS = 600
#: Tries of a commit before a writer gives up, with growing waits between.
TRIES = 20
#: Manifests of up to this many shards (some 60 MB) are sent to all executors to tell which rows count; larger ones are joined by shuffle.
BROADCAST_SHARDS = 500_000
#: In place of a manifest's name: the writer has stepped back.
VOID = "void"
_SHARDS = "shard string, rows long, bytes long, version long"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class ShardTable:
    """A table of shards in a folder that all executors share."""

    spark: SparkSession
    root: str
    target_bytes: int = TARGET_BYTES
    fanout: int = FANOUT
    claim_seconds: float = CLAIM_SECONDS

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, tuple[str, int] | None]:
        """Numbers that are taken, each with the manifest's name and the version on which it rests; None as long as (or if never) its line is written."""
        fs, folder = self._fs(), self._path("manifest")
        files = [f for f in (fs.listStatus(folder) if fs.exists(folder) else []) if f.isFile() and f.getPath().getName().startswith("v")]
        out: dict[int, tuple[str, int] | None] = {}
        for number in sorted(int(f.getPath().getName()[1:]) for f in files):
            name, _, base = self._line(number).partition(" ")
            out[number] = (name, int(base)) if base.endswith("\n") and name != VOID else None
        return out

    def _line(self, number: int) -> str:
        fs, path = self._fs(), self._path("manifest", f"v{number:08d}")
        try:
            stream = fs.open(path)
        except Py4JJavaError:  # an old version that has just been dropped
            return ""
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    @staticmethod
    def _chain(versions: dict[int, tuple[str, int] | None]) -> list[int]:
        """The head and the versions on which it rests, newest first."""
        at = max((n for n, x in versions.items() if x), default=0)
        out = []
        while at and versions.get(at):
            out.append(at)
            at = versions[at][1]
        return out

    def version(self) -> int:
        """The last version that counts; 0 before the first."""
        return next(iter(self._chain(self._versions())), 0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards of a version: shard (path below data/), rows, bytes, version (in which it came)."""
        versions = self._versions()
        version = next(iter(self._chain(versions)), 0) if version is None else version
        if not version:
            return self.spark.createDataFrame([], _SHARDS)
        if not versions.get(version):
            raise ValueError(f"no version {version}")
        return self.spark.read.schema(_SHARDS).parquet(f"{self.root}/manifest/{versions[version][0]}")

    def _take(self) -> tuple[int, object]:
        """The number above all that are taken, for this writer alone, and the open file; Conflict if another one is quicker."""
        number = max(self._versions(), default=0) + 1
        try:
            return number, self._fs().create(self._path("manifest", f"v{number:08d}"), False)
        except Py4JJavaError as e:
            raise Conflict(f"version {number} was taken") from e

    def _write(self, file, name: str, base: int) -> None:
        """The line of a version; a store shows it once the file is closed."""
        file.write(bytearray(f"{name} {base}\n".encode()))
        file.close()

    def commit(self, base: int, shards: DataFrame) -> int:
        """Make ``shards`` the version after ``base``; its number. Conflict if another one counts by then."""
        name = f"m-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        try:
            return self._count(name, base)
        except Conflict:
            self._fs().delete(self._path("manifest", name), True)
            raise

    def _count(self, name: str, base: int) -> int:
        number, file = self._take()
        if self.version() != base:  # read after the number was taken: who writes later than this sees the number
            self._write(file, VOID, base)
            raise Conflict(f"version {base} is not the last one")
        self._write(file, name, base)
        # who took a higher number before that line was there may rest on something else
        until = time.time() + self.claim_seconds
        while True:
            versions = self._versions()
            chain = self._chain(versions)
            higher = [n for n in versions if n > number and not self._line(n).endswith("\n")]
            if chain and chain[0] > number:
                if number in chain:
                    return number
                raise Conflict(f"version {chain[0]} does not rest on version {number}")
            if not higher:
                return number
            if time.time() > until:  # its writer is dead or stalls: a version above it settles the matter
                return self._count(name, number)
            time.sleep(0.05)

    def _commit_next(self, shards: Callable[[int], DataFrame | None]) -> int | None:
        """Commit what ``shards`` makes of the last version, on top of whatever others commit meanwhile; None once it makes nothing of it."""
        for turn in range(TRIES):
            base = self.version()
            made = shards(base)
            if made is None:
                return None
            try:
                return self.commit(base, made)
            except Conflict:
                time.sleep(min(5.0, 0.05 * 2**turn) * random.random())
        raise Conflict(f"gave up after {TRIES} tries")

    def _listed(self, batch: str, version: int) -> DataFrame:
        """The shards that a write has left in a batch, with their rows; file sizes come from the scan's metadata."""
        found = self.spark.read.parquet(f"{self.root}/data/{batch}").select("_metadata.file_path", "_metadata.file_size")
        one = found.groupBy("file_path").agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))
        return one.select(F.concat(F.lit(f"{batch}/"), F.element_at(F.split("file_path", f"/{batch}/"), -1)).alias("shard"), "rows", "bytes", F.lit(version).cast("long").alias("version"))

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Add rows as new shards, one for each task or, given a column ``arrival``, for each task and arrival; returns the version.

        That column is not stored. No rows: no shards, but a version.
        """
        batch = f"batch-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(arrival) if arrival else rows.write
        writer.parquet(f"{self.root}/data/{batch}")
        some = next(self._files("data", batch), None) is not None
        return self._commit_next(lambda base: self.manifest(base).unionByName(self._listed(batch, base + 1)) if some else self.manifest(base))

    def _files(self, *below: str) -> Iterator:
        """Shards that lie below a folder, whether a version names them or not."""
        if not self._fs().exists(self._path(*below)):
            return
        found = self._fs().listFiles(self._path(*below), True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet"):
                yield path

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """Rows of a version, with the shard of each. Without ``schema`` it is that of the shards."""
        names = self.manifest(version).select(F.col("shard").alias("__shard"))
        n = names.count()
        if not n:
            return self.spark.createDataFrame([], f"{schema}, shard string" if schema else "shard string")
        reader = self.spark.read.option("recursiveFileLookup", "true")
        # only batches that the version names are listed and scanned, unless they are very many
        batches = [r[0] for r in names.select(F.substring_index("__shard", "/", 1)).distinct().limit(MERGE_SHARDS + 1).collect()]
        folders = [f"{self.root}/data/{b}" for b in sorted(batches)] if len(batches) <= MERGE_SHARDS else [f"{self.root}/data"]
        rows = (reader.schema(schema) if schema else reader).parquet(*folders)
        rows = rows.select("*", F.element_at(F.split("_metadata.file_path", "/data/"), -1).alias("shard"))
        return rows.join(F.broadcast(names) if n <= BROADCAST_SHARDS else names, F.col("shard") == F.col("__shard"), "left_semi")

    def tiers(self, version: int | None = None) -> DataFrame:
        """Shards of up to half the target size with their tier: tier k holds sizes from factor**k to factor**(k + 1)."""
        small = self.manifest(version).filter(F.col("bytes") * 2 <= self.target_bytes)
        return small.select("shard", "bytes", F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1))) / F.log(F.lit(float(TIER_FACTOR))) + 1e-9).cast("int").alias("tier"))

    def full_tiers(self) -> list[int]:
        """Tiers of ``fanout`` shards or more."""
        return sorted(r["tier"] for r in self.tiers().groupBy("tier").agg(F.count("*").alias("n")).filter(F.col("n") >= self.fanout).collect())

    def compact(self) -> int:
        """Merge tiers until none has ``fanout`` shards; returns the version.

        A merge that another writer overtakes is committed on top of the other's version if all
        shards that it replaces are still there, and else dropped.
        """
        while tiers := self.full_tiers():
            merged = self._merge(tiers[0])
            gone = self.spark.createDataFrame([(n,) for n in merged[1]], "shard string")

            def replaced(base: int, batch: str = merged[0], gone: DataFrame = gone, n: int = len(merged[1])) -> DataFrame | None:
                now = self.manifest(base)
                if now.join(F.broadcast(gone), "shard", "left_semi").count() < n:
                    return None
                return now.join(F.broadcast(gone), "shard", "left_anti").unionByName(self._listed(batch, base + 1))

            if self._commit_next(replaced) is None:
                self._fs().delete(self._path("data", merged[0]), True)
        return self.version()

    def _merge(self, tier: int) -> tuple[str, list[str]]:
        """Write the rows of the least shards of a tier as files of the target size: the new batch, and the shards that it replaces."""
        rows = self.tiers().filter(F.col("tier") == tier).orderBy("bytes", "shard").limit(MERGE_SHARDS).collect()
        batch = f"merge-{uuid.uuid4().hex}"
        files = max(1, round(sum(r["bytes"] for r in rows) / self.target_bytes))
        # whole partitions of the scan are put together, so no row is shuffled
        self.spark.read.parquet(*(f"{self.root}/data/{r['shard']}" for r in rows)).coalesce(files).write.parquet(f"{self.root}/data/{batch}")
        return batch, [r["shard"] for r in rows]

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that none of the last ``keep`` versions names, and the manifests and versions before them; returns how many shards.

        Not to be run while a writer appends or compacts: its shards have no version yet.
        Names pass through the driver ``MERGE_SHARDS`` at a time.
        """
        fs, folder, versions = self._fs(), self._path("manifest"), self._versions()
        kept = self._chain(versions)[:keep]
        named = self.spark.createDataFrame([], "shard string")
        for v in kept:
            named = named.unionByName(self.manifest(v).select("shard"))
        files, n = self._files("data"), 0
        while some := [p.toString().rpartition("/data/")[2] for p in islice(files, MERGE_SHARDS)]:
            dead = self.spark.createDataFrame([(x,) for x in some], "shard string").join(named, "shard", "left_anti")
            for r in dead.collect():
                n += fs.delete(self._path("data", r["shard"]), False)
        keeps = {versions[v][0] for v in kept}
        for f in fs.listStatus(folder) if kept else []:
            name = f.getPath().getName()
            if name.startswith("m-") and name not in keeps:
                fs.delete(f.getPath(), True)
        for v in versions:
            if kept and v < kept[-1]:
                fs.delete(self._path("manifest", f"v{v:08d}"), False)
        return n


def shard(df: DataFrame, root: str, arrivals: int = 8, doc_id: str = "doc_id", target_bytes: int = TARGET_BYTES) -> ShardTable:
    """Append ``df`` in ``arrivals`` batches by doc_id, compact, and drop what was merged.

    Every row is stored as often as it occurs, nulls and empty texts too (null
    doc_id: batch 0). Columns named like a partition column are kept: the batch
    number goes by a name that no column has.
    """
    table = ShardTable(df.sparkSession, root, target_bytes)
    name = "__arrival"
    while name in df.columns:
        name += "_"
    table.append(df.withColumn(name, F.coalesce(F.pmod(F.col(f"`{doc_id}`"), F.lit(arrivals)), F.lit(0)).cast("int")), name)
    table.compact()
    table.vacuum()
    return table
