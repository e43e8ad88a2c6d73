"""Session settings and table loading shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Rows that make up a task where tables are dealt by their number of rows.
ROWS_A_TASK = 200_000


def get_session(app: str = "marketloom", cores: str | None = None) -> SparkSession:
    """A session for local use; on a cluster the caller brings its own."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt over the cores, for work that is dear for each row: a small file is one task else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over as many tasks as ``rows`` ask for: a task's rows, and so its memory, stay the same as tables grow.

    It is joined by merging: sizes estimated from compressed files would broadcast tables that are many times as large.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // ROWS_A_TASK)), *keys).hint("merge")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="marketloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; only a local session may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = _own_dir()
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: what several steps read is worked out once, and a lost executor costs a read.

    ``rows_a_file`` bounds the rows of a file, where they compress so well that a task would read too many of them.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
