"""Session defaults and the shared folder for checkpoints and staged tables."""

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name="faultline", master=None, **conf):
    """A session with the defaults above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The cluster's shared scratch folder, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: the executors
    of a cluster could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        configured = tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark, name):
    """A fresh path inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def shuffles_dropped(spark):
    """Shuffle files of the writes inside go as soon as the write has ended.

    Else they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def _write(df, path):
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def stage(df, name):
    """Write a table that several branches of a plan read, and read it back.

    This also cuts lineage, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark, path):
    """Delete a table's folder in whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scope:
    """Staged tables that live until their last reader has written.

    ``drop`` deletes tables at once; leaving the scope, also by an error, deletes those
    that are left but not the ones it was told to ``keep``.
    """

    def __init__(self):
        self._tables = []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.drop(*[table for table, _ in self._tables])

    def stage(self, df, name):
        path = scratch_path(df.sparkSession, name)
        _write(df, path)
        table = df.sparkSession.read.schema(df.schema).parquet(path)
        self._tables.append((table, path))
        return table

    def drop(self, *tables):
        for table, path in self._tables:
            if any(table is given for given in tables):
                remove(table.sparkSession, path)
        self.keep(*tables)

    def keep(self, *tables):
        """Leave tables to the caller, who still reads them."""
        self._tables = [(t, p) for t, p in self._tables if not any(t is given for given in tables)]
