"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "vulnspark") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the cluster's own session."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let batches between Spark and Python hold a few MB: each task has several in memory on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name).rstrip("b")
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session for the statements within."""
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each statement at its end, for steps that hand on through tables.

    They would stay until the driver happens to collect its garbage.
    """
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


_local_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder the cluster names for checkpoints.

    Tables written there survive the loss of an executor; whoever writes one owns
    it. A local run may do without and gets a temporary one; on a cluster that would
    be a folder of one machine, so the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="vulnspark-"))
        base = _local_scratch[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
