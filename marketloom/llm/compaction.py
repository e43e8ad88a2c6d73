"""Size-tiered compaction of a sharded corpus, by DataFrame operations alone.

Arrivals are appended as runs of small immutable shards, one run from each group of tasks. Compaction merges
neighbouring runs of one tier (sizes within a factor of FANOUT), FANOUT of them or more, and runs whose files are far
smaller than they could be, into runs of files of the target size. What is as it should be is left alone, so repeated
compaction comes to rest. The manifest of a version, a table of the runs that make up the corpus in order, becomes
current by one atomic rename; readers take the highest version, so they see either the old runs or the new.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import file_system, free_name, scratch_path, without_names

#: Rows of an arriving shard at most; runs of one append; bytes of text of a merged file; the ratio of sizes within a tier.
ARRIVAL_ROWS, ARRIVAL_RUNS, TARGET_BYTES, FANOUT = 500, 8, 256 << 20, 4
#: Bytes up to which a run is of tier 0.
TIER_BYTES = 1 << 20
#: How often an append is tried again on top of what another writer committed meanwhile.
TRIES = 20
MANIFEST = "seq bigint, folder string, n_files bigint, n_docs bigint, n_bytes bigint"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def current_version(spark: SparkSession, root: str) -> int:
    """The highest committed version; 0 for a corpus that was never written."""
    path, fs = file_system(spark, f"{root}/committed")
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def commit(spark: SparkSession, root: str, manifest: DataFrame, base: int) -> int:
    """Publish ``manifest`` as the version after ``base``; ``Conflict`` if another writer was first.

    The pointer is written whole in a folder of its own, which is then renamed to the version's number without
    overwriting: on HDFS and local disks a reader sees no marker or a whole one, and of two writers one wins. What
    stands there is read back, so that a file system whose rename is laxer is noticed.
    """
    version, own = base + 1, uuid.uuid4().hex
    folder = f"{root}/manifests/{version}-{own}"
    manifest.coalesce(1).write.parquet(folder)
    tried, fs = file_system(spark, f"{root}/committed/.{own}")
    stream = fs.create(file_system(spark, f"{root}/committed/.{own}/pointer")[0], False)
    stream.write(bytearray(folder.encode()))
    stream.close()
    final, _ = file_system(spark, f"{root}/committed/{version}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tried), fs.makeQualified(final), options)
    except Py4JJavaError as e:
        fs.delete(tried, True)
        if not fs.exists(final):
            raise
        raise Conflict(f"version {version} was committed by another writer") from e
    if _pointer(spark, root, version) != folder:
        raise Conflict(f"version {version} was committed by another writer")
    return version


def _pointer(spark: SparkSession, root: str, version: int) -> str:
    path, fs = file_system(spark, f"{root}/committed/{version}/pointer")
    stream = fs.open(path)
    folder = bytes(stream.readAllBytes()).decode()
    stream.close()
    return folder


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The runs of a version, in order: seq, folder, n_files, n_docs, n_bytes. Files are not listed: a run is a folder."""
    version = version or current_version(spark, root)
    return spark.read.schema(MANIFEST).parquet(_pointer(spark, root, version)) if version else spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The documents of a version; its runs, a few for each tier, pass through the driver, the names of files do not."""
    folders = [r.folder for r in manifest(spark, root, version).orderBy("seq").collect()]
    return spark.read.parquet(*folders)


def _measured(spark: SparkSession, folders: list[str], text_col: str) -> list[tuple]:
    """(folder, n_files, n_docs, n_bytes) of each run that has a document."""
    folder = F.col("_metadata.file_path")
    rows = spark.read.parquet(*folders).select(F.regexp_replace(folder, "/[^/]*$", "").alias("folder"), folder.alias("file"), F.octet_length(F.col(f"`{text_col}`")).cast("long").alias("b"))
    files = rows.groupBy("folder", "file").agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    runs = files.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_docs"), F.sum("b").alias("n_bytes"))
    return [tuple(r) for r in runs.orderBy("folder").collect()]


def append(docs: DataFrame, root: str, text_col: str = "text", rows: int = ARRIVAL_ROWS, runs: int = ARRIVAL_RUNS) -> int:
    """Write arrivals as at most ``runs`` runs of small immutable shards, without a shuffle, and commit a version that has them too.

    When another writer commits first, the manifest is made anew on top of that; what was written stays.
    """
    spark = docs.sparkSession
    folder, name = f"{root}/data/{uuid.uuid4().hex}", free_name(docs.columns, "run")
    arriving = docs.withColumn(name, F.pmod(F.spark_partition_id(), F.lit(runs)))
    arriving.write.option("compression", "zstd").option("maxRecordsPerFile", rows).partitionBy(name).parquet(folder)
    path, fs = file_system(spark, folder)
    folders = [str(f.getPath()) for f in fs.listStatus(path) if f.isDirectory()]
    found = _measured(spark, folders, text_col) if folders else []
    for _ in range(TRIES):
        base = current_version(spark, root)
        known = [tuple(r) for r in manifest(spark, root, base).orderBy("seq").collect()] if base else []
        first = known[-1][0] + 1 if known else 0
        try:
            return commit(spark, root, spark.createDataFrame(known + [(first + k, *f) for k, f in enumerate(found)], MANIFEST), base)
        except Conflict:
            continue
    raise Conflict(f"{TRIES} other versions were committed meanwhile")


def tier(n_bytes: int) -> int:
    """0 up to TIER_BYTES, then one more for each factor of FANOUT."""
    found = 0
    while n_bytes > TIER_BYTES * FANOUT**found:
        found += 1
    return found


def plan(runs: list[tuple], target: int = TARGET_BYTES) -> list[list[tuple]]:
    """Runs to merge, each group in order. ``runs``: manifest rows by seq.

    A group is FANOUT or more neighbours of one tier, or one run alone that holds more than twice the files it needs.
    """
    groups = []
    for _, near in itertools.groupby(runs, key=lambda r: tier(r[4])):
        near = list(near)
        if len(near) >= FANOUT:
            groups.append(near)
        else:
            groups += [[r] for r in near if r[2] > 2 * files_needed(r[4], target)]
    return groups


def files_needed(n_bytes: int, target: int) -> int:
    return max(1, -(-n_bytes // target))


def compact(spark: SparkSession, root: str, text_col: str = "text", target: int = TARGET_BYTES) -> int:
    """Merge what ``plan`` finds in the current version, and commit the outcome. Old files stay for old readers.

    ``Conflict`` if another writer committed meanwhile; nothing is lost, and compaction may be called again.
    """
    base = current_version(spark, root)
    runs = [tuple(r) for r in manifest(spark, root, base).orderBy("seq").collect()]
    groups = plan(runs, target)
    if not groups:
        return base
    merged = {}
    for group, folder in _merges(spark, root, groups, target):
        merged |= {r[0]: None for r in group}
        merged[group[0][0]] = (group[0][0], *_measured(spark, [folder], text_col)[0])  # at the place of the first
    after = [merged.get(r[0], r) for r in runs]
    return commit(spark, root, spark.createDataFrame([r for r in after if r], MANIFEST), base)


def _merges(spark: SparkSession, root: str, groups: list[list[tuple]], target: int) -> Iterator[tuple[list[tuple], str]]:
    for group in groups:
        folder = f"{root}/data/{uuid.uuid4().hex}"
        n_files = files_needed(sum(r[4] for r in group), target)
        spark.read.parquet(*[r[1] for r in group]).repartition(n_files).write.option("compression", "zstd").parquet(folder)
        yield group, folder


def ingest_and_compact(docs: DataFrame, text_col: str = "text", target: int = TARGET_BYTES) -> DataFrame:
    """Append ``docs`` to a new corpus, compact it until it rests, and read the committed version back.

    Null texts and ids, empty texts, repeated rows and all columns, whatever their names, come back as they were, in
    other files. With them come manifest_docs and manifest_bytes, what the version's manifest says it holds (existing
    columns of these names, in any case, are replaced). An empty table comes back empty.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "corpus")
    version, seen = append(docs, root, text_col), 0
    while version != seen:
        seen, version = version, compact(spark, root, text_col, target)
    held = manifest(spark, root, version).agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    found = read(spark, root, version) if held[0] else docs.where("false")
    kept = [F.col(f"`{c}`") for c in without_names(docs.columns, "manifest_docs", "manifest_bytes")]
    return found.select(*kept, F.lit(held[0]).cast("long").alias("manifest_docs"), F.lit(held[1]).cast("long").alias("manifest_bytes"))
