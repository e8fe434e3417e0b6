"""Keyed Parquet state that changes by appending: merged when read, compacted now and then.

A change is one folder, a segment, named by the numbers of the changes it covers. A batch of
rows adds a segment as long as the batch, however large the store is; a delete adds a segment
of marks. A segment counts from the moment its writer leaves its success file, so a change that
ended half-way is as if it had never begun, and repeating it is harmless. Readers take the base
and, in place of its rows, what the later segments last said of their keys. Compaction writes
one segment for many; the segments it covers stay until the next one, for readers still at
work.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Later segments are joined into one when they are this many, and into the base when they
# hold more than this share of its bytes: what is rewritten is in proportion to what changed.
SEGMENTS, SHARE = 16, 0.25
ROWS_A_FILE = 2_000_000
_NAME = re.compile(r"seg-(\d{12})-(\d{12})-([0-9a-f]{32})$")
_AT, _GONE = "_at", "_gone"


@dataclass(frozen=True)
class Segment:
    first: int
    last: int
    path: str

    def covers(self, other: "Segment") -> bool:
        """Whether the other's changes are all in this one (of equal ones the greater name counts)."""
        if (self.first, self.last) == (other.first, other.last):
            return self.first < self.last and self.path > other.path
        return self.first <= other.first and other.last <= self.last and self.first < self.last


@dataclass(frozen=True)
class KeyedStore:
    """``root`` holds rows of ``ddl`` with unique ``key``; its base is cut into ``buckets`` ranges of the key.

    Changes are numbered by their writer, of which there is one at a time.
    """

    root: str
    key: str
    ddl: str
    buckets: int = 64

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(_AT, T.LongType()), T.StructField(_GONE, T.BooleanType())])

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, spark: SparkSession) -> "KeyedStore":
        """Make an empty store unless there is one."""
        path, files = self._files(spark)
        files.mkdirs(path)
        return self

    def _listed(self, spark: SparkSession, done: bool) -> list[Segment]:
        """Segments found in the folder; ``done`` leaves out those without a success file."""
        path, files = self._files(spark)
        new = spark._jvm.org.apache.hadoop.fs.Path
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            place = status.getPath().toString()
            m = _NAME.search(place)
            if m and (not done or files.exists(new(f"{place}/_SUCCESS"))):
                found.append(Segment(int(m[1]), int(m[2]), place))
        return found

    def segments(self, spark: SparkSession) -> tuple[Segment | None, list[Segment], list[Segment]]:
        """``(base, later, covered)``: the segments that count, in order, and those a compaction has replaced."""
        found = self._listed(spark, True)
        live = [s for s in found if not any(o.covers(s) for o in found)]
        base = max((s for s in live if s.first == 0), key=lambda s: (s.last, s.path), default=None)
        later = sorted((s for s in live if s.first > 0), key=lambda s: (s.first, s.path))
        return base, later, [s for s in found if s not in live]

    def _scan(self, spark: SparkSession, segments: list[Segment]) -> DataFrame:
        return spark.read.schema(self._stored).parquet(*[s.path for s in segments])

    def _newest(self, spark: SparkSession, later: list[Segment]) -> DataFrame:
        """What segments last said of each key, marks of deletion included."""
        said = self._scan(spark, later)
        if len(later) == 1:
            return said
        row = F.struct(*self._stored.names)
        return said.groupBy(self.key).agg(F.max_by(row, F.struct(_AT, row)).alias("_row")).select("_row.*")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows as they are now. Conditions on columns reach the scans.

        The base is neither sorted nor shuffled while the keys of the later segments are few
        enough to be broadcast by their measured size; compaction keeps them a share of it.
        """
        base, later, _ = self.segments(spark)
        names = self.schema.names
        if base is None and not later:
            return spark.createDataFrame([], self.schema)
        if not later:
            return self._scan(spark, [base]).select(*names)
        newest = self._newest(spark, later)
        live = newest.filter(~F.col(_GONE)).select(*names)
        if base is None:
            return live
        kept = self._scan(spark, [base]).select(*names).join(newest.select(self.key), self.key, "left_anti")
        return kept.select(*names).unionByName(live)

    def _append(self, rows: DataFrame, at: int, first: int | None = None) -> None:
        path = f"{self.root}/seg-{at if first is None else first:012d}-{at:012d}-{uuid.uuid4().hex}"
        rows.select(*self._stored.names).write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(path)

    def _next(self, spark: SparkSession) -> int:
        return max((s.last for s in self._listed(spark, False)), default=0) + 1

    def upsert(self, batch: DataFrame, latest: str | None = None) -> None:
        """Insert or replace by key; the row with the greatest ``latest`` wins in a batch.

        Keys the batch does not mention stay as they are. Rows without a key are left out. The
        batch is written once; the store is not read.
        """
        spark = batch.sparkSession
        at = self._next(spark)
        rows = latest_per_key(batch.filter(F.col(self.key).isNotNull()), self.key, latest).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        rows = rows.withColumns({_AT: F.lit(at).cast("long"), _GONE: F.lit(False)})
        # The first rows of a store are its base.
        self._append(rows, at, 0 if at == 1 else None)
        self._tidy(spark)

    def delete(self, spark: SparkSession, condition: Column) -> None:
        """Remove the rows for which ``condition`` is true; NULL keeps a row."""
        at = self._next(spark)
        doomed = self.read(spark).filter(F.coalesce(condition, F.lit(False))).select(self.key)
        others = {f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name != self.key}
        self._append(doomed.withColumns({**others, _AT: F.lit(at).cast("long"), _GONE: F.lit(True)}), at)
        self._tidy(spark)

    def _tidy(self, spark: SparkSession) -> None:
        base, later, _ = self.segments(spark)
        if not later:
            return
        _, files = self._files(spark)
        size = lambda s: files.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(s.path)).getLength()
        changed = sum(map(size, later))
        if changed > SHARE * (size(base) if base else 0):
            # Small stores are not worth a rewrite for each change.
            if len(later) >= SEGMENTS or changed > 64 << 20:
                self.compact(spark)
        elif len(later) >= SEGMENTS:
            self._join(spark, later)

    def _join(self, spark: SparkSession, later: list[Segment]) -> None:
        """One segment for several, marks included."""
        self._remove_covered(spark)
        self._append(self._newest(spark, later), later[-1].last, later[0].first)

    def compact(self, spark: SparkSession) -> None:
        """Write the rows as they are now as the base, in files by range of the key."""
        base, later, _ = self.segments(spark)
        if not later:
            return
        self._remove_covered(spark)
        at = max(s.last for s in later)
        rows = self.read(spark).withColumns({_AT: F.lit(at).cast("long"), _GONE: F.lit(False)})
        self._append(rows.repartitionByRange(self.buckets, self.key).sortWithinPartitions(self.key), at, 0)

    def _remove_covered(self, spark: SparkSession) -> None:
        _, files = self._files(spark)
        done = self._listed(spark, True)
        # There is one writer, so what has no success file by now will have none.
        for s in [*self.segments(spark)[2], *(s for s in self._listed(spark, False) if s not in done)]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(s.path), True)


def latest_per_key(batch: DataFrame, key: str, latest: str | None) -> DataFrame:
    """One row per key: greatest ``latest``, ties (or no ``latest``) by the greatest row.

    Combines on the map side: a key's copies never meet in a window.
    """
    row = F.struct(*batch.columns)
    newest = F.max(row) if latest is None else F.max_by(row, F.struct(latest, row))
    return batch.groupBy(key).agg(newest.alias("_row")).select("_row.*")
