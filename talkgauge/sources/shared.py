"""The folder that driver and executors share, and small files put there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one. Only a session on one machine, as in tests, may leave that unset."""
    path = spark.conf.get(_CHECKPOINT_DIR, None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
        path = f"{tempfile.gettempdir()}/checkpoints"
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put_files(spark: SparkSession, files: dict[str, bytes], name: str) -> str:
    """Small files (by path) in a new shared folder: its path."""
    root, hadoop = shared_folder(spark, name), spark._jvm.org.apache.hadoop.fs
    for path, content in files.items():
        place = hadoop.Path(f"{root}/{path}")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    return root
