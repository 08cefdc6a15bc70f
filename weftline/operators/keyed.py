"""Tables that are written: rows by key in hash buckets, changed bucket by bucket, with versions.

A table is a folder. `data` holds a folder for each write, with the Parquet files of the
buckets that it wrote; `versions` holds a file for each version, which tells of each bucket
the write that has its rows. A change finds the buckets of the keys it brings, reads those,
writes them anew under a new folder, and last of all creates the next version's file, which
fails if that is there already. So readers see a version as a whole, a job that dies before
its end changes nothing, two writers cannot both win, and files of other buckets stay.

Hot buckets: what is written is rebalanced by bucket, so Spark deals a large bucket out to
several tasks and files. What goes to the driver is the numbers of the touched buckets, at
most as many as the table has.

A key that is null, or that a change brings twice without telling which row is the latest, ends the job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators.incremental import deleted, of_dimension, upserted
from weftline.operators.persist import replaced
from weftline.operators.storage import stored

#: Buckets of a table: so many that one of them, with what changes, is a few tasks' work.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the version first."""


class Folder:
    """Small files of a folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._utf8 = spark._jvm.org.apache.commons.io.IOUtils
        self.root = path.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if self._fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._utf8.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that is not there yet."""
        if self._fs.exists(self.at(name)):
            raise Conflict(name)
        stream = self._fs.create(self.at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


class KeyedTable:
    """A table in the folder `path`; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._folder = spark, path.rstrip("/"), Folder(spark, path)
        told = json.loads(self._folder.read("table.json"))
        self.schema = StructType.fromJson(told["schema"])
        self.key, self.by, self.buckets, self.dimensions = tuple(told["key"]), tuple(told["by"]), told["buckets"], told["dimensions"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], by: Sequence[str] | None = None, buckets: int = BUCKETS, dimensions: Mapping[str, int] | None = None) -> KeyedTable:
        """An empty table. Rows go to buckets by the columns `by`, of the key, the whole key if not given; dimensions are those of vector columns."""
        by = tuple(by or key)
        if not set(by) <= set(key):
            raise ValueError("buckets are told by columns of the key")
        told = {"schema": schema.jsonValue(), "key": list(key), "by": list(by), "buckets": buckets, "dimensions": dict(dimensions or {})}
        Folder(spark, path).create("table.json", json.dumps(told))
        return cls(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._folder.names("versions") if x.endswith(".json")]

    def _told(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """A version and the write of each bucket; a file that its writer did not finish is no version."""
        known = [v for v in self.versions() if version is None or v == version]
        for v in reversed(known):
            try:
                return v, {int(b): w for b, w in json.loads(self._folder.read(f"versions/{v:010}.json"))["buckets"].items()}
            except (ValueError, KeyError):
                continue
        if version is not None:
            raise ValueError(f"there is no version {version}")
        return 0, {}

    @property
    def version(self) -> int:
        """The newest version; 0 where nothing was written yet."""
        return self._told()[0]

    def _rows(self, buckets: Mapping[int, str]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{w}/_bucket={b}" for b, w in sorted(buckets.items())]
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest or of the given version."""
        return self._rows(self._told(version)[1])

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # at most as many as the table has buckets

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; other buckets are not read."""
        keys = keys.select(*self.key).distinct()
        buckets, wanted = self._told()[1], self._touched(keys)
        return self._rows({b: w for b, w in buckets.items() if b in wanted}).join(keys, list(self.key), "left_semi")

    def _checked(self, rows: DataFrame, latest: Column | None) -> DataFrame:
        """rows with the table's columns, each key once."""
        rest = [c for c in self.schema.names if c not in self.key]
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        order = F.lit(0) if latest is None else latest
        some = rows.select(*cast, order.alias("_order")).groupBy(*self.key).agg(F.max_by(F.struct(*rest, F.lit(0).alias("_")), "_order").alias("_row"), F.count("*").alias("_n"))
        null = F.greatest(*(F.col(c).isNull() for c in self.key), F.lit(False))
        wrong = lambda text: F.raise_error(F.lit(text)).cast("boolean")
        fits = F.when(null, wrong("a key is null")).when((F.col("_n") > 1) & F.lit(latest is None), wrong("a key is there twice")).otherwise(True)
        out = some.filter(fits).select(*self.key, "_row.*").select(*self.schema.names)
        for column, dim in self.dimensions.items():
            out = of_dimension(out, column, dim)
        return out

    def _change(self, brings: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Buckets that hold keys of brings become how(their rows, brings); the new version."""
        brings = stored(brings, "brings")
        base, buckets = self._told()
        touched = self._touched(brings)
        if not touched:
            return base
        write = uuid.uuid4().hex
        rows = how(self._rows({b: w for b, w in buckets.items() if b in touched}), brings).select(*self.schema.names)
        self._written(rows, write)
        made = {int(x.removeprefix("_bucket=")) for x in self._folder.names(f"data/{write}") if x.startswith("_bucket=")}
        if not made <= touched:
            raise ValueError("a change made rows of buckets that its keys are not in")
        now = {b: w for b, w in buckets.items() if b not in touched} | dict.fromkeys(made, write)
        return self._committed(base, now)

    def _written(self, rows: DataFrame, write: str) -> None:
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{write}")

    def _committed(self, base: int, buckets: Mapping[int, str]) -> int:
        """The version after base; a version that was begun but not finished keeps its number."""
        newest = max(self.versions(), default=0)
        if self._told()[0] != base:
            raise Conflict(f"version {base} is not the newest any more")
        self._folder.create(f"versions/{newest + 1:010}.json", json.dumps({"buckets": {str(b): w for b, w in sorted(buckets.items())}}))
        return newest + 1

    def upsert(self, rows: DataFrame, latest: Column | None = None) -> int:
        """rows replace those of the same key; of several with one key the latest stays."""
        return self._change(self._checked(rows, latest), lambda old, new: upserted(old, new, self.key))

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], latest: Column | None = None) -> int:
        """The touched buckets become how(old, new), which must keep the other rows of old."""
        return self._change(self._checked(rows, latest), how)

    def replace(self, rows: DataFrame, latest: Column | None = None) -> int:
        """What rows bring of a value of `by` (a run's, say) replaces all that the table has of it."""
        if len(self.by) != 1:
            raise ValueError("the table has no single column by which rows are replaced")
        return self._change(self._checked(rows, latest), lambda old, new: replaced(old, new, self.by[0]))

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of these keys; keys may have the columns `by` only."""
        on = self.key if set(self.key) <= set(keys.columns) else self.by
        gone = keys.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in on)).distinct()
        if len(on) == 1:
            return self._change(gone, lambda old, new: deleted(old, new, on[0]))
        return self._change(gone, lambda old, new: old.join(new, list(on), "left_anti"))

    def clear(self) -> int:
        """A version without rows."""
        return self._committed(self._told()[0], {})

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last `keep`, and of each write the buckets that none of these needs; no writer may be at work. The buckets deleted."""
        finished = []
        for v in reversed(self.versions()):
            try:
                finished.append((v, {(w, f"_bucket={b}") for b, w in self._told(v)[1].items()}))
            except ValueError:
                continue
        kept = finished[:keep]
        needed = set().union(*(w for _, w in kept))
        for v in set(self.versions()) - {v for v, _ in kept}:
            self._folder.remove(f"versions/{v:010}.json")
        deleted = 0
        for w in self._folder.names("data"):
            every = [x for x in self._folder.names(f"data/{w}") if x.startswith("_bucket=")]
            gone = [x for x in every if (w, x) not in needed]
            for x in gone:
                self._folder.remove(f"data/{w}/{x}")
            if len(gone) == len(every):
                self._folder.remove(f"data/{w}")
            deleted += len(gone)
        return deleted
