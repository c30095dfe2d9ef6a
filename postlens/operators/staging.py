"""Cuts a long plan: rows are written to the folder that all executors share and read back. Also what repeated values decide, once each."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder of its own only where none is set and the session is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="postlens-state-")
            atexit.register(shutil.rmtree, folder, True)
            _own[app] = f"file://{folder}"
        base = _own[app]
    return base.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The same rows, from files that go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/postlens-state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def once_each(rows: DataFrame, keys: list[str], made: Callable[[DataFrame], DataFrame], carried: tuple[str, ...] = ()) -> DataFrame:
    """rows with the columns that made adds to a table of their different keys, so long expressions run once a value and not once a row.

    made keeps the keys and gives a row for each. The values are dealt to all cores, as few bytes may be much work. Keys may be null. The
    rows are read twice, so they must be the same each time. A small table of values is broadcast by its size; a large one is joined by
    a shuffle, where a value that many rows have is split as any skewed key. carried: columns that the keys decide and made reads, such as
    a long text whose hash is a key; made need not keep them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = staged(made(rows.select(*keys, *carried).distinct().repartition(parts)))
    theirs = facts.select(*[F.col(c).alias(f"_of_{c}" if c in keys else c) for c in facts.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(theirs, same, "left").drop(*[f"_of_{k}" for k in keys])
