"""Tables that grow batch by batch and stay cheap to look up.

Every batch is one run of files, dealt to buckets by the hash of a key and sorted by it. Runs of neighbouring batches are merged as digits
are carried when counting: once ``fan`` runs of one size lie side by side they become one run. After n batches there are at most
``(fan - 1) * (1 + log n)`` runs, the logarithm to base ``fan``, and a row has been written at most ``1 + log n`` times.

Which runs hold the first n batches follows from n alone, so there is no list that could be lost or out of date. A batch that is run again after
a failure reads the runs it read before, and overwrites its own run and the merges it caused. Runs that went into a merge are deleted by the next
batch, when the merge is known to be complete; a reader that is slower than that starts again.

A merge of ``combine`` rows, such as sums by key, keeps one row for each key in a run. Rows with a null key are stored and read, and never found by key.
An empty batch leaves an empty run. Batches are numbered 0, 1, 2 ... without gaps, and ``fan`` and ``buckets`` stay as they are for the life of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Keys of a lookup, in bytes, that are sent to the tasks instead of being met by a shuffle.
SENT = 32 << 20


def spans(n: int, fan: int) -> list[tuple[int, int]]:
    """The runs [first, end) that hold the batches 0..n-1, longest first."""
    size = 1
    while size * fan <= n:
        size *= fan
    out, at = [], 0
    while at < n:
        while size > n - at:
            size //= fan
        out.append((at, at + size))
        at += size
    return out


@dataclass
class Runs:
    """A table of rows with ``schema`` at ``path``, looked up by the column ``key``."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    buckets: int = 256
    fan: int = 8
    combine: Callable[[DataFrame], DataFrame] | None = None

    def _folder(self, span: tuple[int, int]) -> str:
        return f"{self.path}/run-{span[0]:09d}-{span[1]:09d}"

    def _file(self, place: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their bucket."""
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _read(self, live: list[tuple[int, int]]) -> DataFrame:
        schema = f"{self.schema}, bucket int"
        if not live:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(self._folder(s)) for s in live]  # few: see above
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _write(self, rows: DataFrame, span: tuple[int, int]) -> None:
        shaped = rows.repartition("bucket").sortWithinPartitions("bucket", self.key)
        shaped.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(span))

    def before(self, batch: int, keys: DataFrame) -> DataFrame:
        """Rows of earlier batches whose key is among ``keys``, a frame with the key column. Only buckets that hold such keys are read; keys of at most
        ``SENT`` bytes are sent to those rows, which then stay where they are."""
        if not batch:
            return self._read([]).drop("bucket")
        wanted = self.dealt(keys.select(self.key).distinct())
        size = F.coalesce(F.sum(F.octet_length(F.col(self.key).cast("string")) + 64), F.lit(0))
        touched = wanted.groupBy("bucket").agg(size.alias("bytes")).collect()  # at most ``buckets`` rows
        held = self._read(spans(batch, self.fan)).filter(F.col("bucket").isin([r["bucket"] for r in touched]))
        few = sum(r["bytes"] for r in touched) <= SENT
        return held.join(F.broadcast(wanted) if few else wanted, ["bucket", self.key], "left_semi").drop("bucket")

    def append(self, batch: int, rows: DataFrame) -> None:
        """Store a batch, and merge the runs it completes."""
        self._drop_merged(batch)
        fields = [f.name for f in self._read([]).drop("bucket").schema]
        self._write(self.dealt(rows.select(*fields)), (batch, batch + 1))
        merged = spans(batch + 1, self.fan)[-1]
        if merged != (batch, batch + 1):
            held = self._read(self._parts(batch, merged))
            self._write(self.dealt(self.combine(held.drop("bucket"))) if self.combine else held, merged)

    def _parts(self, batch: int, merged: tuple[int, int]) -> list[tuple[int, int]]:
        """The runs of which the merge after ``batch`` is made."""
        return [s for s in spans(batch, self.fan) if s[0] >= merged[0]] + [(batch, batch + 1)]

    def _drop_merged(self, batch: int) -> None:
        """Delete what the batch before this one merged."""
        if batch and (merged := spans(batch, self.fan)[-1]) != (batch - 1, batch):
            for span in self._parts(batch - 1, merged):
                system, at = self._file(self._folder(span))
                system.delete(at, True)

    def live(self) -> list[tuple[int, int]]:
        """The complete runs that no other complete run covers, for readers that know no batch number."""
        system, at = self._file(self.path)
        if not system.exists(at):
            return []
        found = []
        for status in system.listStatus(at):
            name = status.getPath().getName()
            if name.startswith("run-") and system.exists(self._file(f"{self.path}/{name}/_SUCCESS")[1]):
                first, end = name.split("-")[1:]
                found.append((int(first), int(end)))
        return sorted(s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found))

    def read(self) -> DataFrame:
        """All rows."""
        rows = self._read(self.live()).drop("bucket")
        return self.combine(rows) if self.combine else rows
