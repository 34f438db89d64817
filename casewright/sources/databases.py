"""Session stores in SQLite files, read in parallel by ranges of row ids; joins of what they hold."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

KINDS = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.names = options["path"], options["table"], schema.fieldNames()
        self.parts = int(options.get("partitions", "8"))
        self.where = [(c[6:], v) for c, v in options.items() if c.startswith("equal.")]

    def partitions(self) -> list[RowRange]:
        with _open(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        same = "".join(f" AND {_quoted(c)} = ?" for c, _ in self.where)
        sql = f"SELECT {', '.join(map(_quoted, self.names))} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?{same}"
        con = _open(self.path)
        try:
            yield from con.execute(sql, (partition.low, partition.high, *(v for _, v in self.where)))
        finally:
            con.close()


class SqliteTable(DataSource):
    """``spark.read.format("sqlite_table")`` with options ``path``, ``table``, ``partitions`` and ``equal.<column>``; opened read only.

    The file must lie where every executor can read it. Column names are matched whatever their case in ``equal.``.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with _open(self.options["path"]) as con:
            rows = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {KINDS.get((kind or '').upper()[:4].rstrip('E'), KINDS.get((kind or '').upper()[:3], 'string'))}" for _, name, kind, *_ in rows)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8, **equal: str) -> DataFrame:
    """A table of a SQLite file; ``equal`` keeps rows with those values, in the file itself."""
    spark.dataSource.register(SqliteTable)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions)
    for column, value in equal.items():
        reader = reader.option(f"equal.{column}", value)
    return reader.load()


def read_session_store(spark: SparkSession, path: str, directory: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(session, message, part) of a session store; sessions of one directory only if it is given."""
    keep = {"directory": directory} if directory else {}
    return read_sqlite(spark, path, "session", **keep), read_sqlite(spark, path, "message"), read_sqlite(spark, path, "part")


def transcripts_of(transcripts: DataFrame, sessions: DataFrame, agent: str | None = None) -> DataFrame:
    """Transcripts with agent, status and directory of their session (``lab_session_id`` to ``id``); of one agent if it is given."""
    s = sessions.select(F.col("id").alias("lab_session_id"), "agent", "status", "directory")
    return transcripts.join(s if agent is None else s.where(F.col("agent") == agent), "lab_session_id")
