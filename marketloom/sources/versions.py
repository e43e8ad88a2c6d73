"""Tables of rows by key that are changed under their readers: copy-on-write by bucket, one atomic step for each version.

Keys are hashed into a fixed number of buckets, each a folder of Parquet files that never changes. A write makes new
folders for the buckets it touches and then publishes the next version, a list of all buckets' folders, by a rename that
does not overwrite. A reader holds one version whatever others write. A writer that finds its version taken goes on
from the newest one, and merges again only those of its buckets that the other has changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import stored

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class VersionedTable:
    """``schema`` as DDL; ``keys`` tell rows apart; ``buckets`` is set when the table is first written. Object stores without an atomic rename give no guarantee."""

    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 16

    def _path(self, *parts: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path("/".join([self.root.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 for a table that was never written."""
        path, fs = self._path("versions")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def folders(self, version: int) -> dict[int, str]:
        """The folder of each bucket that has rows; as many entries as there are buckets, at most."""
        if not version:
            return {}
        path, fs = self._path("versions", str(version), "list")
        stream = fs.open(path)
        found = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        self.buckets = found["buckets"]
        return {int(b): f for b, f in found["folders"].items()}

    def _publish(self, version: int, folders: dict[int, str]) -> bool:
        """Make ``folders`` the version, unless another writer has; a reader sees all of the list or nothing."""
        own = f".{uuid.uuid4().hex}"
        path, fs = self._path("versions", own, "list")
        text = json.dumps({"buckets": self.buckets, "folders": folders, "by": own})
        stream = fs.create(path, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        (tried, _), (final, _) = self._path("versions", own), self._path("versions", str(version))
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(tried), fs.makeQualified(final), options)
        except Py4JJavaError:
            fs.delete(tried, True)
            if fs.exists(final):
                return False
            raise
        stream = fs.open(self._path("versions", str(version), "list")[0])
        mine = bytes(stream.readAllBytes()).decode() == text  # a laxer rename is noticed
        stream.close()
        return mine

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.root.rstrip('/')}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; later writes do not change what it gives."""
        return self._rows(self.folders(self.version() if version is None else version).values())

    def _written(self, rows: DataFrame) -> dict[int, str]:
        """``rows`` in new folders by bucket."""
        part = f"data/{uuid.uuid4().hex}"
        names = [c.name for c in self.spark.createDataFrame([], self.schema).schema]
        by_bucket = rows.select(*names).withColumn("bucket_", self.bucket())
        by_bucket.write.partitionBy("bucket_").option("compression", "zstd").parquet(f"{self.root.rstrip('/')}/{part}")
        path, fs = self._path(part)
        made = [f.getPath().getName() for f in fs.listStatus(path)]
        return {int(n.split("=")[1]): f"{part}/{n}" for n in made if n.startswith("bucket_=")}

    def upsert(self, changes: DataFrame, merge: Merge) -> int:
        """Merge ``changes`` into the buckets of their keys by ``merge(old rows, changes)`` and publish; returns the version.

        ``merge`` sees whole buckets, so it may replace, add, change or leave out rows, of keys that hash to its rows'
        buckets. It may run again on newer rows if another writer was first.
        """
        version = self.version()
        known = self.folders(version)
        changes = stored(changes.withColumn("bucket_", self.bucket()), "changes")
        touched = {r.bucket_ for r in changes.select("bucket_").distinct().collect()}  # as many as there are buckets, at most
        todo, made = set(touched), {}
        while True:
            if todo:
                old = self._rows(known[b] for b in sorted(todo) if b in known)
                fresh = self._written(merge(old, changes.where(F.col("bucket_").isin(*todo)).drop("bucket_")))
                made = {b: f for b, f in made.items() if b not in todo} | {b: f for b, f in fresh.items() if b in todo}
            if self._publish(version + 1, {b: f for b, f in known.items() if b not in touched} | made):
                return version + 1
            version = self.version()
            newest = self.folders(version)
            todo = {b for b in touched if newest.get(b) != known.get(b)}
            known = newest

    def replace(self, rows: DataFrame) -> int:
        """Publish ``rows`` as all there is; of several such writers the last to publish stands."""
        return self._replaced(self._written(rows))

    def clear(self) -> int:
        return self._replaced({})

    def _replaced(self, folders: dict[int, str]) -> int:
        version = self.version() + 1
        while not self._publish(version, folders):
            version = self.version() + 1
        return version


def newest(keys: Iterable[str], order: Iterable[str]) -> Merge:
    """A merge that keeps of each key the last row by ``order``; of equals a change counts before what is stored."""
    keys, order = list(keys), list(order)

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.withColumn("new_", F.lit(0)).unionByName(changes.select(*old.columns).withColumn("new_", F.lit(1)))
        rest = [c for c in old.columns if c not in keys]
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "new_")).alias("v")).select(*keys, "v.*")

    return merge
