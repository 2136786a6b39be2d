"""Spark sessions with the settings that event-time work relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC makes event time mean the same everywhere; RocksDB keeps large keyed state off the heap, writing change logs per batch.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "eventflow", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; ``settings`` take underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    extra = {k.replace("__", "-").replace("_", "."): v for k, v in settings.items()}
    return builder.config(map=SETTINGS | extra).getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """SETTINGS on a session that exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def append_lines(spark: SparkSession, folder: str, name: str, lines: list[str]) -> None:
    """A new file of lines in a folder of any file system that Spark reaches; readers see it whole or not at all."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    hidden = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_{name}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hidden)
    try:
        out.write(bytearray("".join(f"{line}\n" for line in lines).encode()))
    finally:
        out.close()
    fs.rename(hidden, target)


def make_folder(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder
