"""Publishing tables: all of them or none.

Each table is written once, to a staging folder beside the output, and what its gates need is
observed in that same pass: rows, an order-free content hash, personal data by column, rows that
break a rule, totals. Keys that must be unique are read back from the staged files, that column
alone. If every gate holds, staged folders take the place of the old ones, the manifest last; if
one fails, or moving does, the old output stands as it was and the staging folder goes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import PII

IDS = ("user_id", "message_id", "turn_id", "reply_key")
MANIFEST = "_manifest_table"


class PrivacyError(Exception):
    """A table to be written holds personal data."""


class QualityError(Exception):
    """A table to be written breaks a rule of its gate."""


@dataclass(frozen=True)
class Gate:
    """What must hold of a table, in SQL by a message: of each row (null doesn't hold), of aggregates over all rows; and columns without doubled values."""

    rows: Mapping[str, str] = field(default_factory=dict)
    totals: Mapping[str, str] = field(default_factory=dict)
    unique: tuple[str, ...] = ()


def named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def string_columns(df: DataFrame, skip: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in skip]


def metrics_of(df: DataFrame, gate: Gate, skip: tuple[str, ...] | list[str]) -> dict[str, Column]:
    """Aggregates to observe, by a name of their own: columns and rules are numbered, since they may have any name."""
    out = {"rows": F.count(F.lit(1)), "hash": F.sum(F.xxhash64(*[named(c) for c in df.columns]).cast("decimal(38,0)"))}
    out |= {f"pii_{i}": F.count_if(named(c).rlike(PII)) for i, c in enumerate(string_columns(df, skip))}
    out |= {f"row_{i}": F.count_if(~F.coalesce(F.expr(c), F.lit(False))) for i, c in enumerate(gate.rows.values())}
    return out | {f"total_{i}": F.coalesce(F.expr(c), F.lit(False)) for i, c in enumerate(gate.totals.values())}


def broken(name: str, df: DataFrame, staged: DataFrame, gate: Gate, got: dict, skip: tuple[str, ...] | list[str]) -> tuple[list[str], list[str]]:
    """(columns with personal data, rules that don't hold) of a staged table."""
    private = [f"{name}.{c}" for i, c in enumerate(string_columns(df, skip)) if got[f"pii_{i}"]]
    rules = [f"{name}: {rule} ({got[f'row_{i}']} rows)" for i, rule in enumerate(gate.rows) if got[f"row_{i}"]]
    rules += [f"{name}: {rule}" for i, rule in enumerate(gate.totals) if not got[f"total_{i}"]]
    for key in gate.unique:
        if not staged.groupBy(named(key)).count().where("count > 1").isEmpty():
            rules.append(f"{name}: {key} stands in several rows")
    return private, rules


class Folders:
    """Moves folders of any file system that Spark writes to, and can take moves back."""

    def __init__(self, spark: SparkSession, root: str):
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.make(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.moves: list[tuple[str, str]] = []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.make(path))

    def create(self, path: str) -> None:
        self.fs.mkdirs(self.make(path))

    def move(self, a: str, b: str) -> None:
        if not self.fs.rename(self.make(a), self.make(b)):
            raise OSError(f"{a} can't be moved to {b}")
        self.moves.append((a, b))

    def undo(self) -> None:
        for a, b in reversed(self.moves):
            self.fs.rename(self.make(b), self.make(a))
        self.moves = []

    def delete(self, path: str) -> None:
        self.fs.delete(self.make(path), True)


def replace_all(folders: Folders, staging: str, out: str, names: list[str]) -> None:
    """Puts the staged folders in place of the old ones, in order; all or none."""
    folders.create(out)
    folders.create(f"{staging}/_old")
    try:
        for name in names:
            if folders.exists(f"{out}/{name}"):
                folders.move(f"{out}/{name}", f"{staging}/_old/{name}")
            folders.move(f"{staging}/{name}", f"{out}/{name}")
    except BaseException:
        folders.undo()
        raise


def write_all(tables: dict[str, DataFrame], out: str, skip: tuple[str, ...] | list[str] = IDS, fmt: str = "parquet", gates: Mapping[str, Gate] | None = None, told: Callable[[str, float, int], None] | None = None) -> DataFrame:
    """Writes every table and a manifest: rows, columns, content hash. Nothing is published if a table holds personal data or breaks its gate.

    told: called with the name, seconds and rows of each table as it is staged.
    """
    if not tables:
        raise ValueError("no table to write")
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"tables are written as parquet or csv, not {fmt}")
    spark = next(iter(tables.values())).sparkSession
    staging = f"{out.rstrip('/')}-staging-{uuid.uuid4().hex}"
    folders, lines, private, rules = Folders(spark, out), [], [], []
    try:
        for name in sorted(tables):
            df, gate, began, seen = tables[name], (gates or {}).get(name, Gate()), time.time(), Observation()
            spark.sparkContext.setJobDescription(f"write {name}")
            watched = df.observe(seen, *[c.alias(k) for k, c in metrics_of(df, gate, skip).items()])
            (watched.write.option("header", True).csv if fmt == "csv" else watched.write.parquet)(f"{staging}/{name}")
            staged = spark.read.schema(df.schema).csv(f"{staging}/{name}", header=True) if fmt == "csv" else spark.read.parquet(f"{staging}/{name}")
            got = seen.get
            hits, wrong = broken(name, df, staged, gate, got, skip)
            private, rules = private + hits, rules + wrong
            lines.append((name, got["rows"], ", ".join(df.columns), str(got["hash"])))
            if told:
                told(name, time.time() - began, got["rows"])
        if private:
            raise PrivacyError("personal data in " + ", ".join(sorted(private)))
        if rules:
            raise QualityError("; ".join(rules))
        manifest = spark.createDataFrame(lines, "table string, rows long, columns string, hash string")
        manifest.coalesce(1).write.parquet(f"{staging}/{MANIFEST}")
        replace_all(folders, staging, out, [*sorted(tables), MANIFEST])
        return spark.read.parquet(f"{out}/{MANIFEST}")
    finally:
        spark.sparkContext.setJobDescription(None)
        folders.delete(staging)
