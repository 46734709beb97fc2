"""Session helpers: a sane local session, the shared scratch folder, and written cut points in a lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SCRATCH = "bookweave_scratch"  # the database of bucketed tables
_MADE: dict[str, list[str]] = {}  # application -> names of the tables it wrote


def local_session(cpus: int | str = "*", name: str = "bookweave", shuffle: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests, one machine) is a temporary folder made, and removed when
    Python ends; on a cluster each machine would write to a disk of its own, so there it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="bookweave-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return "file://" + made


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/bookweave-{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it back (survives the loss of executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets of written tables: the session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_bucketed(df: DataFrame, keys: list[str], what: str, partition: list[str] | None = None, table: str | None = None) -> str:
    """Write (or append to) a table hash-bucketed by keys in the shared folder; returns its name in the catalog.

    df must be hash-partitioned by ``keys`` into ``buckets(spark)`` parts for one file per bucket; later joins,
    windows and aggregations on the keys then read it without a shuffle.
    """
    spark = df.sparkSession
    fresh = table is None
    if fresh:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH}")
        name = f"{SCRATCH}.{what}_{uuid.uuid4().hex[:12]}"
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(name)
    else:
        name = table
    w = df.write.format("parquet").mode("errorifexists" if fresh else "append").bucketBy(buckets(spark), *keys)
    if partition:
        w = w.partitionBy(*partition)
    if fresh:
        w = w.option("path", f"{scratch_root(spark)}/bookweave-{name.split('.')[1]}")
    w.saveAsTable(name)
    return name


def drop_scratch(spark: SparkSession) -> int:
    """Drop the bucketed tables that this application has written, with their files, once no result that reads them is needed."""
    names = _MADE.pop(spark.sparkContext.applicationId, [])
    for name in names:
        if spark.catalog.tableExists(name):
            where = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()[1]
            spark.sql(f"DROP TABLE {name}")
            path = spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
