"""Session settings and the shared folder for checkpoints and landed tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "bibspark", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or by the context's checkpoint folder.

    It is required on every master: a folder of one machine would be lost with that
    machine, and other executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named is None and current is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if current is None:
        spark.sparkContext.setCheckpointDir(named)
    return named or current


# (application, path) of every table landed and not yet deleted.
_LANDED: list[tuple[str, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LANDED.append((spark.sparkContext.applicationId, path))
    return path


def land(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later jobs share the result and its lineage is cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def land_bucketed(df: DataFrame, name: str, by: str, buckets: int) -> tuple[DataFrame, str]:
    """Write once into `buckets` buckets by the hash of `by`, read back; and the path.

    Tables with as many buckets by the same column are grouped by it and further columns without an
    exchange, and joined so by queries that run in `joined_in_buckets`. The session's catalog names
    the table only until it is read back.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay, as their path was given
    return read, path


@contextmanager
def joined_in_buckets(spark: SparkSession):
    """Queries that run within join tables where their buckets lie, also by more keys than the buckets'.

    Outside, such joins give the same rows by an exchange. Results should be landed within.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def delete_landed(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete what this application has landed, or what it has landed at `paths`: when no result reads it any more."""
    own = [x for x in _LANDED if x[0] == spark.sparkContext.applicationId and (paths is None or x[1] in paths)]
    for entry in own:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _LANDED.remove(entry)


def stamp(spark: SparkSession, folder: str) -> str:
    """Names, lengths and change times in `folder`: changes when a table below it is written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return ",".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in found))
