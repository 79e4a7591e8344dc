"""Stored tables that change by whole commits.

Files are never changed. A manifest lists the folders that make up the table, by partition, and the batches that have been applied. A commit writes new
folders, then a manifest under a passing name, and renames it to the next version: before the rename readers see the old table, after it the new one, and
a job that ends in between leaves files that no manifest names. Two jobs that commit the same version can't both rename; the later one gets ``Conflict`` and may run again.
A batch that is in the ledger is not applied again.

Manifests grow with the number of partitions, not with rows. A partition is an expression on the rows, so folders can be read one by one without its
value in the files, and a reader that needs some partitions opens no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.sources.schemas import TABLES
from leafsift.sources.tables import shaped


class Conflict(RuntimeError):
    """Another job has committed this version."""


@dataclass
class Manifest:
    version: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)  # by partition
    batches: dict[str, int] = field(default_factory=dict)  # the highest number applied, by source
    digests: list[str] = field(default_factory=list)  # batches without a number

    def has(self, batch: tuple[str, int] | str | None) -> bool:
        if isinstance(batch, tuple):
            return batch[1] <= self.batches.get(batch[0], -1)
        return batch is not None and batch in self.digests


@dataclass
class Snapshots:
    """A stored table ``name`` at ``path``, partitioned by the text that ``by`` makes of its columns."""

    spark: SparkSession
    name: str
    path: str
    by: Column

    # ------------------------------------------------------------ files

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self, folder: str) -> list[str]:
        at = self._at(folder)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(f[:-5]) for f in self._files("manifests") if f.endswith(".json") and f[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or that of a version; an empty one before the first commit."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return Manifest()
        at = self._at("manifests", f"{version:012d}.json")
        stream = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(at)
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, new: Manifest) -> None:
        """Write the manifest under a passing name and rename it, which fails if the version is there."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        passing, final = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"{new.version:012d}.json")
        out = passing.getFileSystem(conf).create(passing)
        try:
            out.write(json.dumps(new.__dict__, sort_keys=True).encode())
        finally:
            out.close()
        step("manifest written")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(passing, final, options)
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            raise Conflict(f"{self.path}: version {new.version} is there") from error
        step("manifest renamed")

    # ------------------------------------------------------------ reading

    def read(self, only: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The table as of the latest or a given version, or some of its partitions."""
        return self._rows(self.manifest(version), only)

    def _rows(self, now: Manifest, only: Iterable[str] | None = None) -> DataFrame:
        chosen = now.folders if only is None else {v: now.folders[v] for v in only if v in now.folders}
        folders = [f"{self.path}/data/{f}" for fs in chosen.values() for f in fs]
        if not folders:
            return self.spark.createDataFrame([], TABLES[self.name])
        return self.spark.read.schema(TABLES[self.name]).parquet(*folders)

    # ------------------------------------------------------------ changing

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """New folders of ``rows``, by partition."""
        commit = uuid.uuid4().hex
        dealt = shaped(rows, self.name).withColumn("_by", F.coalesce(self.by.cast("string"), F.lit("")))
        dealt.withColumn("_folder", F.hex(F.col("_by").cast("binary"))).drop("_by").write.partitionBy("_folder").parquet(f"{self.path}/data/{commit}")
        step("data written")
        found = [f for f in self._files(f"data/{commit}") if f.startswith("_folder=")]
        value = lambda f: "" if f.endswith("__HIVE_DEFAULT_PARTITION__") else bytes.fromhex(f.removeprefix("_folder=")).decode()
        return {value(f): f"{commit}/{f}" for f in found}

    def _commit(self, now: Manifest, folders: dict[str, list[str]], batch: tuple[str, int] | str | None) -> None:
        new = Manifest(now.version + 1, folders, dict(now.batches), list(now.digests))
        if isinstance(batch, tuple):
            new.batches[batch[0]] = batch[1]
        elif batch is not None:
            new.digests.append(batch)
        self._publish(new)

    def append(self, rows: DataFrame, batch: tuple[str, int] | str | None = None) -> bool:
        """Add rows; False if the batch had been added."""
        now = self.manifest()
        if now.has(batch):
            return False
        fresh = self._write(rows)
        self._commit(now, {v: now.folders.get(v, []) + ([fresh[v]] if v in fresh else []) for v in {**now.folders, **fresh}}, batch)
        return True

    def change(self, ids: DataFrame, work: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | str | None = None) -> bool:
        """Apply ``work`` to the partitions that hold any of ``ids(id)``; False if the batch had been applied. ``work`` must leave rows in their partition."""
        now = self.manifest()
        if now.has(batch):
            return False
        value = F.coalesce(self.by.cast("string"), F.lit(""))
        # partitions, not rows, are listed on the driver
        touched = {r[0] for r in self._rows(now).join(ids.select("id"), "id", "left_semi").select(value).distinct().collect()}
        step("partitions chosen")
        fresh = self._write(work(self._rows(now, touched))) if touched else {}
        kept = {v: fs for v, fs in now.folders.items() if v not in touched}
        self._commit(now, kept | {v: [f] for v, f in fresh.items()}, batch)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that only versions before the last ``keep`` name; the number of folders deleted."""
        versions = self.versions()
        old, held = versions[:-keep], versions[-keep:]
        named = {f for v in held for fs in self.manifest(v).folders.values() for f in fs}
        gone = {f for v in old for fs in self.manifest(v).folders.values() for f in fs} - named
        for place in [("data", f) for f in sorted(gone)] + [("manifests", f"{v:012d}.json") for v in old]:
            at = self._at(*place)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return len(gone)


def step(name: str) -> None:
    """Called between any two steps of a commit, with what has been done; tests end a job here."""


def batch_digest(rows: DataFrame, *columns: str) -> str:
    """A name for a batch made of its rows, whatever their order: the same rows give the same name."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in columns])
    n, mixed, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}:{mixed:x}:{int(total):x}"
