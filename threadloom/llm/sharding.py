"""Operator 10: size-tiered compaction into target-sized shards.

A store is a folder of immutable Parquet shards and numbered manifests. An append
writes small shards and commits a manifest that lists them too. Compaction takes
tiers (shards of like size) that hold enough runs, packs their shards into bins of
the target size and writes each bin as one shard; a manifest then names the new
shards instead of the old. Readers see a manifest's shards and nothing else, so a
failed job leaves no trace in what they read.

No row is shuffled: a bin is read and written by one task, whose size is the target.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Collection
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import measured_join, own_path


@dataclass(frozen=True)
class Shard:
    """A data file: its path below the store, bytes and rows."""

    path: str
    bytes: int
    rows: int


@dataclass(frozen=True)
class Tiers:
    """Target size of a shard, size ratio of neighbouring tiers, and runs that make a tier due."""

    target_bytes: int = 256 << 20
    ratio: int = 4
    runs: int = 4
    #: Bins written by one Spark job.
    bins_per_job: int = 64

    def tier(self, size: int) -> int:
        """0 for shards of target size (within 1/ratio), then one more for each ratio below."""
        return max(0, math.ceil(math.log(self.target_bytes / max(size, 1), self.ratio)) - 1)


def united(known: str | None, new: StructType) -> StructType:
    """The schema (JSON) of earlier arrivals with a later one's further columns at its end, all of them nullable."""
    fields = {f.name: f for f in (StructType.fromJson(json.loads(known)) if known else [])}
    for f in new:
        old = fields.setdefault(f.name, StructField(f.name, f.dataType, True))
        if old.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {old.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType(list(fields.values()))


def shard_column(schema: StructType) -> str:
    """``shard``, with underscores before it if the table has a column of that name."""
    name, taken = "shard", {n.lower() for n in schema.names}
    while name in taken:
        name = f"_{name}"
    return name


class ManifestConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A folder with ``data`` and ``manifests``; paths go through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """Version, shards and schema (JSON) of a manifest; the last by default."""
        version = self.version() if version is None else version
        if not version:
            return 0, [], None
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        return version, [Shard(**s) for s in got["shards"]], got["schema"]

    def commit(self, seen: int, shards: list[Shard], schema: str) -> int:
        """Commit version ``seen + 1``: written aside, then renamed, which fails if it exists."""
        aside, place = f"{self.root}/manifests/.{uuid.uuid4().hex}", f"{self.root}/manifests/v{seen + 1:08d}.json"
        stream = self._fs.create(self._path(aside), False)
        stream.write(json.dumps({"schema": schema, "shards": [asdict(s) for s in shards]}).encode())
        stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._path(aside), self._path(place), none)
        except Exception as error:
            self._fs.delete(self._path(aside), False)
            raise ManifestConflict(f"version {seen + 1} exists") from error
        return seen + 1

    def _written(self, df: DataFrame) -> list[Shard]:
        """Write rows as new shards and list them; empty files are left out."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).count()
        counts = {r["name"]: r["count"] for r in rows.collect()}
        listed = self._fs.listStatus(self._path(f"{self.root}/{folder}"))
        return sorted((Shard(f"{folder}/{x.getPath().getName()}", x.getLen(), counts[x.getPath().getName()]) for x in listed if x.getPath().getName() in counts), key=lambda s: s.path)

    def append(self, df: DataFrame) -> int:
        """Add an arrival as it is partitioned, and commit it.

        An arrival may lack columns of earlier ones (null there) or bring new ones (null
        in earlier rows); one with another type for a column is an error and adds nothing.
        """
        united(self.manifest()[2], df.schema)
        return self.add(self._written(df), df.schema)

    def add(self, new: list[Shard], schema: StructType) -> int:
        """Commit written shards; retried on another writer's commit."""
        while True:
            version, shards, known = self.manifest()
            try:
                return self.commit(version, shards + new, united(known, schema).json())
            except ManifestConflict:
                continue

    def plan(self, tiers: Tiers) -> list[list[Shard]]:
        """Bins of shards to merge: tiers that hold enough runs, smallest first, by first fit in path order."""
        _, shards, _ = self.manifest()
        due: dict[int, list[Shard]] = {}
        for s in shards:
            if tier := tiers.tier(s.bytes):
                due.setdefault(tier, []).append(s)
        bins: list[list[Shard]] = []
        for _, runs in sorted(due.items(), reverse=True):
            if len(runs) < tiers.runs:
                continue
            size = tiers.target_bytes + 1
            for s in sorted(runs, key=lambda s: s.path):
                if size + s.bytes > tiers.target_bytes:
                    bins.append([])
                    size = 0
                bins[-1].append(s)
                size += s.bytes
        return [b for b in bins if len(b) > 1]

    def _merged(self, bins: list[list[Shard]], schema) -> list[Shard]:
        made: list[Shard] = []
        step = Tiers.bins_per_job
        for at in range(0, len(bins), step):
            parts = [self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in b)).coalesce(1) for b in bins[at : at + step]]
            made += self._written(reduce(DataFrame.unionAll, parts))
        return made

    def compact(self, tiers: Tiers = Tiers()) -> int:
        """Merge tiers until none is due; returns the last version. A conflict plans anew."""
        while bins := self.plan(tiers):
            version, shards, schema = self.manifest()
            new = self._merged(bins, StructType.fromJson(json.loads(schema)))
            gone = {s.path for b in bins for s in b}
            if sum(s.rows for s in new) != sum(s.rows for b in bins for s in b):
                raise RuntimeError("a merge lost rows; nothing was committed")
            while True:
                try:
                    self.commit(version, [s for s in shards if s.path not in gone] + new, schema)
                    break
                except ManifestConflict:
                    version, shards, schema = self.manifest()
                    if not gone <= {s.path for s in shards}:  # another compaction took some of them
                        break
        return self.version()

    def vacuum(self, keep: int = 1, spared: Collection[str] = ()) -> int:
        """Delete shards that none of the last ``keep`` manifests names; returns how many.

        Shards that a writer has not committed yet must be ``spared``.
        """
        last = self.version()
        named = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)[1]}
        count = 0
        for folder in self._fs.listStatus(self._path(f"{self.root}/data")):
            for x in self._fs.listStatus(folder.getPath()):
                path = f"data/{folder.getPath().getName()}/{x.getPath().getName()}"
                if path not in named and path not in spared and path.endswith(".parquet"):
                    self._fs.delete(x.getPath(), False)
                    count += 1
        return count

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, with ``shard``, the path below the store (``_shard`` if the table has such a column, and so on)."""
        _, shards, schema = self.manifest(version)
        if schema is None:
            raise FileNotFoundError(f"{self.root} has no version")
        schema = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], schema).withColumn(shard_column(schema), F.lit(None).cast("string"))
        df = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in shards))
        return df.withColumn(shard_column(schema), F.concat(F.lit("data/"), F.array_join(F.slice(F.split(F.input_file_name(), "/"), -2, 2), "/")))

    def shards(self, version: int | None = None) -> DataFrame:
        """The manifest as rows: ``version, shard, shard_bytes, shard_rows``."""
        version, shards, _ = self.manifest(version)
        return self.spark.createDataFrame([(version, s.path, s.bytes, s.rows) for s in shards], "version bigint, shard string, shard_bytes bigint, shard_rows bigint")


def shard_documents(docs: DataFrame, store: ShardStore, tiers: Tiers = Tiers(), arrivals: int = 4) -> ShardStore:
    """Append a table in ``arrivals`` parts, compacting after each pair.

    The table is read once: each of its partitions is written as a small shard, and an
    arrival is every so many of them. Defined cases: all columns and rows are kept as
    they are, nulls, repeats and very long texts too; an empty table commits versions
    without shards.
    """
    new = store._written(docs)
    for k in range(arrivals):
        store.add(new[k::arrivals], docs.schema)
        if k % 2:
            store.compact(tiers)
            store.vacuum(spared={s.path for j in range(k + 1, arrivals) for s in new[j::arrivals]})
    store.compact(tiers)
    store.vacuum()
    return store


def query(spark, sf_dir: str) -> DataFrame:
    """Each document of the compacted store, its text's checksum, and its shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shard_documents(docs, ShardStore(spark, own_path(spark, "shards")), Tiers(target_bytes=64 << 20))
    rows = store.read().select("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source", "n_chars", "shard")
    return measured_join(rows, store.shards(), "shard", "left")
