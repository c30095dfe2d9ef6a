"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_folder

#: Rows of an Arrow batch handed to Python; bounds a worker's memory for long texts.
ARROW_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def stage_table(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut by files any executor can read. by: a column of few values
    that names folders, so that a read of one value skips the others.

    The shuffles of the write go with it. The files go by drop_tables, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/postlens-{name}-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path, partitionBy=by)
    jvm_path, files = _path(spark, path)
    files.deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    out.staged_at = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Deletes what stage_table wrote for them; nothing may read them afterwards."""
    for table in tables:
        jvm_path, files = _path(table.sparkSession, table.staged_at)
        files.delete(jvm_path, True)


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed for a while."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """A setting that the operators with Python workers need; it stays, since their results are computed after they return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(col: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body: a lambda variable is bound, not inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan_before(values: Column, combine) -> Column:
    """For each place what combine makes of 0 and the values before it. In blocks of the root of their number, since an array
    that grows by appending is copied at each step."""

    def folded(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: combine(a, x))

    def in_blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(x["v"]) - 1, x["w"]), lambda s: F.slice(x["v"], s + 1, x["w"]))

        def placed(p: Column) -> Column:
            def block(part: Column, before: Column) -> Column:
                return F.transform(part, lambda _, k: combine(before, folded(F.slice(part, F.lit(1), k))))

            return let(F.transform(p, folded), lambda t: F.flatten(F.transform(p, lambda part, j: let(folded(F.slice(t, F.lit(1), j)), lambda before: block(part, before)))))

        return F.when(F.size(x["v"]) > 0, let(parts, placed)).otherwise(F.array().cast("array<int>"))

    return let(values, lambda v: let(F.struct(v.alias("v"), F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int").alias("w")), in_blocks))


def row_key(id_col: str, text: Column) -> list[Column]:
    """Two 64-bit hashes naming a row by its id and text; rows that repeat share the name and the result."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000null"))
    return [F.xxhash64(ident, text), F.xxhash64(F.lit("second"), text, ident)]
