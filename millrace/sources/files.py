"""Reading workbooks and registries, resolving the newest file of a role; ``publish`` writes."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions import text as X
from millrace.operators.terms import check_registry
from millrace.sources.contract import ContractError
from millrace.sources.publish import PrivacyError, write_all  # noqa: F401  read from here too

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class DatasetError(Exception):
    """No file for a role; the message says where it was looked for."""


def found(folder: str, suffix: str = ".xlsx") -> list[Path]:
    """Files of a role's folder, the newest first by time and then name; lock files are skipped, as are files that go meanwhile."""
    out = []
    for p in Path(folder).glob("*") if Path(folder).is_dir() else ():
        try:
            if p.is_file() and p.suffix.lower() == suffix and not p.name.startswith("~$"):
                out.append((p.stat().st_mtime, p.name, p))
        except FileNotFoundError:
            continue
    return [p for _, _, p in sorted(out, reverse=True)]


def newest(folder: str, suffix: str = ".xlsx") -> Path | None:
    return next(iter(found(folder, suffix)), None)


def require_file(root: str, role: str, suffix: str = ".xlsx") -> Path:
    """The newest file of a role's folder under root; raises where there is none."""
    path = newest(f"{root}/{role}", suffix)
    if path is None:
        raise DatasetError(f"no {suffix} file for {role}: looked in {root}/{role}; save the export there, under any name, or give its path")
    return path


def describe(root: str, role: str, suffix: str = ".xlsx") -> str:
    """One line: the chosen file, its date, how many older ones are passed over."""
    every = found(f"{root}/{role}", suffix)
    if not every:
        return f"no {suffix} in {root}/{role}"
    day = datetime.fromtimestamp(every[0].stat().st_mtime).strftime("%Y-%m-%d")
    return f"{every[0]} (modified {day}" + (f", {len(every) - 1} older ignored" if len(every) > 1 else "") + ")"


def stale(out: str, tables: list[str]) -> list[str]:
    """Names in an output folder that this run doesn't write."""
    known = {*tables, "_manifest_table"}
    return sorted(p.name for p in Path(out).glob("*") if p.stem not in known and not p.name.startswith(".")) if Path(out).is_dir() else []


def column_of(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text, by streaming the workbook's XML; empty cells are null."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        with z.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{NS}row":
                    continue
                out: list[str | None] = []
                for c in row.iter(f"{NS}c"):
                    at = column_of(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    v = c.find(f"{NS}v")
                    if c.get("t") == "s" and v is not None:
                        out[at] = shared[int(v.text)]
                    elif c.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                    elif v is not None:
                        out[at] = v.text
                yield out
                row.clear()


class Workbook(DataSource):
    """spark.read.format("workbook").option("role", ...).load(path): columns as text, the header found by markers.

    Without a role, columns are named by ``columns`` (comma-separated) and the first row is data.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _head(self) -> tuple[list[str], int]:
        if self.options.get("columns"):
            return self.options["columns"].split(","), 0
        from itertools import islice

        from .contract import HEADER_ROWS, header_row

        rows = list(islice(sheet_rows(self.options["path"]), HEADER_ROWS))
        at = header_row(rows, self.options["role"])
        return [c or f"_{i}" for i, c in enumerate(rows[at])], at + 1

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self._head()[0])

    def reader(self, schema) -> DataSourceReader:
        names, skip = self._head()
        return WorkbookReader(self.options["path"], len(names), skip)


class WorkbookReader(DataSourceReader):
    """A workbook is one zip stream, so it is one partition."""

    def __init__(self, path: str, width: int, skip: int):
        self.path, self.width, self.skip = path, width, skip

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for i, row in enumerate(sheet_rows(self.path)):
            if i >= self.skip and any(c is not None for c in row):
                yield tuple((row + [None] * self.width)[: self.width])


def read_workbook(spark: SparkSession, path: str, role: str) -> DataFrame:
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").option("role", role).option("path", path).load()


def read_labels(spark: SparkSession, path: str, label: str) -> DataFrame:
    return spark.read.schema(f"message_id string, {label} string").csv(path, header=True)


REGISTRY_COLUMNS = ["entity", "kind", "pattern", "notes"]


def read_registry(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """A checked registry, a few hundred rows at most; anything larger, with another header or with a problem in a row isn't one."""
    rows = spark.read.csv(path).limit(2002).collect()
    head = [(c or "").replace("\ufeff", "").strip() for c in rows[0]] if rows else []
    if head != REGISTRY_COLUMNS[: len(head)] or len(head) < 3:
        raise ContractError(f"a registry has the columns {', '.join(REGISTRY_COLUMNS)}; found {', '.join(head)}")
    if len(rows) > 2001:
        raise ContractError("a registry of more than 2000 rows")
    out = [tuple((c or "").strip() for c in r[:3]) for r in rows[1:] if any(r)]
    if problems := check_registry(out):
        raise ContractError("registry: " + "; ".join(problems))
    return out


BOT_LOG = ["ts", "wa_id", "user_message", "bot_reply"]


def bot_log(raw: DataFrame, salt: str, gap: str, handoff: str) -> DataFrame:
    """Flagged turns of a log without a header, four text columns in order: time, address, message, reply. Rows without a time go; raises if none has one."""
    if len(raw.columns) != len(BOT_LOG):
        raise ContractError(f"a bot log has {len(BOT_LOG)} columns and no header ({', '.join(BOT_LOG)}); found {len(raw.columns)}")
    rows = raw.toDF(*BOT_LOG).withColumn("at", F.try_to_timestamp("ts")).where("at is not null")
    if rows.isEmpty():
        raise ContractError("a bot log's first column holds the times; none can be read")
    key, user = X.reply_key(F.col("bot_reply")), X.pseudonym(F.col("wa_id"), salt)
    rows = rows.select(user.alias("user_id"), F.col("at").alias("ts"), key.alias("reply_key"), "user_message", "bot_reply", X.probe(F.col("bot_reply"), gap).alias("gap_flag"), X.probe(F.col("bot_reply"), handoff).alias("handoff_flag"))
    return rows.select(X.turn_key(F.col("user_id"), F.col("ts"), F.col("reply_key")).alias("turn_id"), *rows.columns)


def read_bot_log(spark: SparkSession, path: str, salt: str, gap: str, handoff: str) -> DataFrame:
    spark.dataSource.register(Workbook)
    raw = spark.read.format("workbook").option("columns", ",".join(BOT_LOG)).option("path", path).load()
    return bot_log(raw, salt, gap, handoff)
