"""Keyed tables with versions, for ``foreachBatch`` sinks: folders of Parquet files and manifests that name the live ones.

A batch writes its rows as new files, by bucket (a hash of the key), and then one manifest: the list of every live file
folder of every bucket.  The manifest's file is renamed into place as the last step of its write, so it is the commit: a reader
takes the last manifest and sees whole batches only, and what a failed write leaves behind is in no manifest.  A batch that runs
again is known by its number and changes nothing.

A batch costs what it brings: a bucket's folders are a base and the batches since, and the newest row of a key (by the order
column, of equal ones the later write) is the table's.  A bucket with more than ``deltas`` folders is rewritten as one
(compaction), together with the batch that makes it so.  Columns may be added at any time (older rows have null there); a column
that changes its type is refused, and the stored table stays as it is.  Two manifests give the changes between them from the
buckets that differ.  One writer at a time, as Spark keeps for a checkpoint; a second one fails on the manifest's name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, batch long, bucket int, folder string, keys array<string>, ordered_by string, schema string"


@dataclass(frozen=True)
class Version:
    """A manifest: the version's number, the batch that made it, the table's columns, and each bucket's folders, oldest first."""

    number: int
    batch: int
    schema: T.StructType
    folders: dict[int, list[str]]


def widened(stored: T.StructType, new: T.StructType) -> T.StructType:
    """The stored columns and those that ``new`` adds; a column of another type is refused."""
    have = {f.name.lower(): f for f in stored}
    out = list(stored)
    for f in new:
        old = have.get(f.name.lower())
        if old is None:
            out.append(T.StructField(f.name, f.dataType, True))
        elif old.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {old.dataType.simpleString()} in the table, not {f.dataType.simpleString()}")
    return T.StructType(out)


class KeyedTable:
    """The newest row of each key, by the column ``order``, in a folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 16, deltas: int = 8):
        self.spark, self.path, self.keys, self.order, self.buckets, self.deltas = spark, path.rstrip("/"), keys, order, buckets, deltas

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> KeyedTable:
        """The table in a folder, with the keys and the order that its last manifest names."""
        m = cls(spark, path, [], "")._manifests()
        row = None if m is None else m.orderBy(F.desc("version")).select("keys", "ordered_by").first()
        if row is None:
            raise ValueError(f"no table in {path}")
        return cls(spark, path, list(row["keys"]), row["ordered_by"])

    # ---- manifests

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/*/*.json")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def versions(self) -> list[int]:
        """The numbers of the versions that are kept, in order."""
        m = self._manifests()
        return [] if m is None else sorted(r.version for r in m.select("version").distinct().collect())

    def version(self, number: int | None = None) -> Version | None:
        """A version, the last one by default; None where there is none.  A manifest has a row for each folder that is live."""
        m = self._manifests()
        if m is None:
            return None
        number = m.agg(F.max("version")).first()[0] if number is None else number
        rows = m.where(F.col("version") == number).collect() if number is not None else []
        if not rows:
            return None
        folders: dict[int, list[str]] = {}
        for r in sorted(rows, key=lambda r: r.folder or ""):
            if r.folder:
                folders.setdefault(r.bucket, []).append(r.folder)
        return Version(number, rows[0].batch, T.StructType.fromJson(json.loads(rows[0].schema)), folders)

    def _commit(self, v: Version) -> None:
        places = [(b, f) for b, fs in v.folders.items() for f in fs] or [(-1, None)]
        rows = [(v.number, v.batch, b, f, self.keys, self.order, v.schema.json()) for b, f in places]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").json(f"{self.path}/manifests/{v.number:012d}")

    # ---- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(F.col(self.order).desc_nulls_last(), F.col("_write").desc())
        return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def _stored(self, v: Version, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a version's folders, with ``_write`` (the folder's write) and ``_bucket``."""
        paths = [f"{self.path}/rows/{f}" for b, fs in v.folders.items() for f in fs if buckets is None or b in buckets]
        schema = T.StructType([*v.schema, T.StructField("_write", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*paths)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        v = self.version(number)
        if v is None:
            raise ValueError(f"no such version in {self.path}")
        return self._newest(self._stored(v)).drop("_write", "_bucket")

    def upsert(self, batch: DataFrame, batch_id: int) -> int:
        """Merges the rows of a batch and gives the version that has them; a batch that the table has changes nothing."""
        last = self.version()
        if last is not None and batch_id <= last.batch:
            return last.number
        number = 0 if last is None else last.number + 1
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in batch.schema]) if last is None else widened(last.schema, batch.schema)
        folders = {} if last is None else {b: list(fs) for b, fs in last.folders.items()}
        write = f"{number:012d}-{uuid.uuid4().hex[:12]}"
        rows = batch.select(*[F.col(c.name) if c.name.lower() in {x.lower() for x in batch.columns} else F.lit(None).cast(c.dataType).alias(c.name) for c in schema]).withColumn("_bucket", self._bucket()).withColumn("_write", F.lit(write))
        rows = rows.persist()
        try:
            touched = {r._bucket for r in rows.select("_bucket").distinct().collect()}  # ``buckets`` numbers at most
            full = {b for b in touched if len(folders.get(b, [])) >= self.deltas}
            out = self._newest(rows)
            if full:
                old = self._stored(Version(number, batch_id, schema, {b: folders[b] for b in full}))
                out = self._newest(rows.where(~F.col("_bucket").isin(*full)).unionByName(old).unionByName(rows.where(F.col("_bucket").isin(*full))))
            out.drop("_write").repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/rows/_write={write}")
        finally:
            rows.unpersist()
        for b in touched:
            folders[b] = ([] if b in full else folders.get(b, [])) + [f"_write={write}/_bucket={b}"]
        self._commit(Version(number, batch_id, schema, folders))
        return number

    def changes(self, since: int | None, until: int | None = None) -> DataFrame:
        """Rows that differ between two versions, with ``change`` (insert or update), as the later one has them.  Only buckets with
        different folders are read; a compaction alone is no change.  ``since`` None: from the empty table."""
        after = self.version(until)
        if after is None:
            raise ValueError(f"no such version in {self.path}")
        before = None if since is None else self.version(since)
        if since is not None and before is None:
            raise ValueError(f"version {since} is not kept in {self.path}")
        differ = {b for b, fs in after.folders.items() if before is None or before.folders.get(b) != fs}
        new = self._newest(self._stored(after, differ)).drop("_write", "_bucket")
        if before is None:
            return new.withColumn("change", F.lit("insert"))
        names = after.schema.names
        old = self._newest(self._stored(Version(before.number, before.batch, after.schema, before.folders), differ))
        old = old.select(F.struct(*names).alias("_old"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        on = F.lit(True)
        for i, k in enumerate(self.keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        j = new.join(old, on, "left").where(~F.struct(*names).eqNullSafe(F.col("_old")))
        return j.select(*names, F.when(F.col("_old").isNull(), "insert").otherwise("update").alias("change"))

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` versions with the folders that none of the kept ones names, and what failed writes left;
        gives what was deleted.  Runs where no batch is being written."""
        kept = self.versions()[-max(1, keep):]
        live = {f.split("/")[0] for n in kept for fs in self.version(n).folders.values() for f in fs}
        single = {f for n in kept for fs in self.version(n).folders.values() for f in fs}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = lambda p: [x.getPath().getName() for x in fs.listStatus(path(p))] if fs.exists(path(p)) else []
        gone = [f"manifests/{n}" for n in names(f"{self.path}/manifests") if int(n) not in kept]
        for w in names(f"{self.path}/rows"):
            gone += [f"rows/{w}"] if w not in live else [f"rows/{w}/{b}" for b in names(f"{self.path}/rows/{w}") if b.startswith("_bucket=") and f"{w}/{b}" not in single]
        for g in gone:
            fs.delete(path(f"{self.path}/{g}"), True)
        return gone


def upsert(target: str, keys: list[str], order: str, buckets: int = 16, deltas: int = 8) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the newest row of each key in a ``KeyedTable``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, target, keys, order, buckets, deltas).upsert(batch, batch_id)

    return write
