"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import shared_dir


# Folders of the tables written inside each open ``scratch``, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later jobs start from files, not from lineage.

    A table that ``outlives`` the innermost ``scratch`` goes with the next one around it.
    """
    path = folder(df.sparkSession, name)
    around = _open.get()[:-1] if outlives else _open.get()
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was written inside; only frames that are themselves written may outlive it."""
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield
    finally:
        _open.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
