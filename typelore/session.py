"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "typelore",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the settings the operators count on.

    Timestamps are read and printed in UTC. Adaptive execution coalesces small shuffle partitions, turns joins with a
    small side into broadcast joins by measured size and splits skewed join partitions. ``shuffle_partitions`` is an
    upper bound under adaptive execution: give a cluster a few times its core count.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this process (a ``local`` master, as in tests) may leave it unset: a
    temporary folder is then made and remembered. Elsewhere executors would write to disks of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and executors of {master} share no other folder")
    fallback = tempfile.mkdtemp(prefix="typelore-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


_RUN = "spark.typelore.run"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Owns what is written in between: a folder of its own below the shared one, removed on leaving.

    Results must be collected or written elsewhere before that. Work outside of it goes to a folder that nobody removes.
    """
    before = spark.conf.get(_RUN, None)
    folder = f"{shared_dir(spark)}/typelore/run-{uuid.uuid4().hex}"
    spark.conf.set(_RUN, folder)
    try:
        yield folder
    finally:
        if before is None:
            spark.conf.unset(_RUN)
        else:
            spark.conf.set(_RUN, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, below the folder of the current ``scratch`` or else the shared one."""
    folder = spark.conf.get(_RUN, None) or f"{shared_dir(spark)}/typelore"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps do not recompute it.

    The written table survives the loss of executors. Whoever calls an operator that does this owns the files: run it
    within ``scratch``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
