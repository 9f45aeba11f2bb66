"""What the text operators share: reading tables, cutting lineage, Arrow row mapping."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.workers import importable

#: White space of the contracts: space and \x09-\x0D. bytes.split() uses the same six.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def id_remainder(c: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k; a null id gives null."""
    return F.crc32(c.cast("string").cast("binary")) % k


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir; only a local session that sets none, as in tests, gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith(("local[", "local,")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and drops its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing refers to any more; they would stay until the driver happens to collect its garbage.

    Checkpoints go with them only where the session was started with
    spark.cleaner.referenceTracking.cleanCheckpoints=true, which can't be set later; else they stay
    in the shared folder until it is emptied.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def plain(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_map(df: DataFrame, columns: list[str | Column], schema: T.StructType | str, start: Callable[[], Callable[..., Iterator[dict]]]) -> DataFrame:
    """Maps Arrow batches of the columns; start() runs once a task and returns a function of column lists.

    That function yields dicts of output columns; called with None it yields what is left at the end.
    """
    importable(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, width = [f.name for f in schema.fields], len(columns)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def batch(out: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[n], type=target.field(n).type) for n in names], schema=target)

        step = start()
        for b in batches:
            if b.num_rows:
                for out in step(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                    yield batch(out)
        for out in step(*[None] * width) or ():
            yield batch(out)

    return df.select(*[plain(c) if isinstance(c, str) else c for c in columns]).mapInArrow(run, schema)
