"""Session settings the package reads.

``feedwatch.hotKeyRows``   rows a join key may have before its rows are spread over tasks
``spark.checkpoint.dir``   shared folder for streaming state, checkpoints and model versions
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

HOT_KEY_ROWS = 1_000_000
#: Settings for steps that read texts: partitions small by their bytes are much work, and fewer of them leave cores idle.
TEXT_WORK = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}


def hot_key_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("feedwatch.hotKeyRows", str(HOT_KEY_ROWS)))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="feedwatch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold within."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is executed within leaves no shuffle files behind: a job of several steps holds those of one step at a time."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})
