"""Database tables: one query builder, Spark's JDBC reader where a driver is at hand, SQLite in tasks.

What a database filters exactly goes into its query and is not applied again; what it filters
inexactly goes there too, to save transfer, and Spark filters again.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.errors import ContractError
from sluice.functions.expressions import COMPARISONS, parse_comparison
from sluice.plans.resource import SOURCES, pushdown, pushes_limit

_QUOTES = {"postgres": '"', "mysql": "`", "sqlite": '"', "clickhouse": "`", "duckdb": '"'}


@dataclass(frozen=True)
class Scan:
    """What is asked of a table."""

    table: str
    columns: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()  # "column op literal"
    order_by: tuple[str, ...] = ()
    limit: int | None = None
    cursor: str | None = None
    after: object = None  # committed cursor: strictly greater values are read


def quoted(name: str, dialect: str) -> str:
    q = _QUOTES[dialect]
    return ".".join(q + part.replace(q, q * 2) + q for part in name.split("."))


def literal(value, dialect: str) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper() if dialect != "sqlite" else str(int(value))
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value).replace("'", "''")
    if dialect in ("mysql", "clickhouse"):
        text = text.replace("\\", "\\\\")
    return f"'{text}'"


def build_query(scan: Scan, dialect: str) -> tuple[str, list[str]]:
    """(SQL, filters that Spark must apply again)."""
    sheet = SOURCES[dialect]
    tests, again, ops = [], [], []
    for text in scan.filters:
        column, op, value = parse_comparison(text)
        how = pushdown(sheet, op)
        ops.append(op)
        if how != "unsupported":
            tests.append(f"{quoted(column, dialect)} {op} {literal(value, dialect)}")
        if how != "exact":
            again.append(text)
    if scan.cursor and scan.after is not None:
        tests.append(f"{quoted(scan.cursor, dialect)} > {literal(scan.after, dialect)}")
    sql = f"SELECT {', '.join(quoted(c, dialect) for c in scan.columns) or '*'} FROM {quoted(scan.table, dialect)}"
    if tests:
        sql += " WHERE " + " AND ".join(tests)
    if scan.order_by:
        if not sheet.order:
            raise ContractError(f"{dialect} does not order")
        sql += " ORDER BY " + ", ".join(quoted(c, dialect) for c in scan.order_by)
    if scan.limit is not None and pushes_limit(sheet, ops, scan.cursor is not None):
        sql += f" LIMIT {scan.limit}"
    return sql, again


def _applied(df: DataFrame, scan: Scan, again: list[str]) -> DataFrame:
    for text in again:
        column, op, value = parse_comparison(text)
        df = df.where(COMPARISONS[op](F.col(column), F.lit(value)))
    if scan.limit is not None:
        df = (df.orderBy(*scan.order_by) if scan.order_by else df).limit(scan.limit)
    return df


def read_jdbc(spark: SparkSession, url: str, scan: Scan, dialect: str, partition: tuple[str, list] | None = None, **properties) -> DataFrame:
    """A table through Spark's JDBC reader; ``partition`` = (column, bounds) reads ranges in parallel.

    The driver's jar must be on the class path, which this package does not bring.
    """
    if partition is None:
        sql, again = build_query(scan, dialect)
        return _applied(spark.read.format("jdbc").options(url=url, query=sql, **properties).load(), scan, again)
    column, bounds = partition
    q, edges = quoted(column, dialect), [literal(b, dialect) for b in bounds]
    ranges = [f"{q} < {edges[0]} OR {q} IS NULL", *[f"{q} >= {a} AND {q} < {b}" for a, b in zip(edges, edges[1:])], f"{q} >= {edges[-1]}"]
    sql, again = build_query(Scan(scan.table, scan.columns, scan.filters, (), None, scan.cursor, scan.after), dialect)
    return _applied(spark.read.jdbc(url, f"({sql}) AS t", predicates=ranges, properties=properties), scan, again)


def resume_after(df: DataFrame, cursor: str, committed) -> DataFrame:
    """Rows whose cursor is strictly beyond the committed one; rows that share it and come later are not read again."""
    return df if committed is None else df.where(F.col(cursor) > F.lit(committed))


# -- SQLite ------------------------------------------------------------------------------------


@dataclass
class _Range(InputPartition):
    low: int | None
    high: int | None

    def __post_init__(self) -> None:
        super().__init__(0)


_SQLITE_KINDS = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))


class SqliteSource(DataSource):
    """Options: path (which every executor must see), table or query, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sluice_sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            if table := self.options.get("table"):
                rows = db.execute(f"PRAGMA table_info({quoted(table, 'sqlite')})").fetchall()
                if not rows:
                    raise ContractError(f"no table {table}")
                kinds = {r[1]: next((k for word, k in _SQLITE_KINDS if word in (r[2] or "").upper()), T.StringType()) for r in rows}
                return T.StructType([T.StructField(n, k) for n, k in kinds.items()])
            names = [d[0] for d in db.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0").description]
            return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.schema = options, schema
        self.tests = json.loads(options.get("tests", "[]"))

    def _base(self) -> str:
        return quoted(self.options["table"], "sqlite") if "table" in self.options else f"({self.options['query']})"

    def partitions(self) -> Sequence[InputPartition]:
        n = int(self.options.get("partitions", 1))
        if n == 1 or "table" not in self.options:
            return [_Range(None, None)]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self._base()}").fetchone()
        if low is None:
            return [_Range(None, None)]
        step = (high - low) // n + 1
        return [_Range(low + i * step, low + (i + 1) * step) for i in range(n)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        tests, values = list(self.tests), []
        if partition.low is not None:
            tests.append("rowid >= ? AND rowid < ?")
            values += [partition.low, partition.high]
        sql = f"SELECT {', '.join(quoted(f.name, 'sqlite') for f in self.schema)} FROM {self._base()}"
        sql += " WHERE " + " AND ".join(tests) if tests else ""
        convert = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: lambda v: v if isinstance(v, bytes) else str(v).encode()}
        casts = [convert[type(f.dataType)] for f in self.schema]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(sql, values):
                yield tuple(None if v is None else c(v) for v, c in zip(row, casts))


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, partitions: int = 1, filters: Sequence[str] = ()) -> DataFrame:
    """A table or query; ``filters`` ("column op literal") go to SQLite to save transfer, and, its typing being loose, Spark applies them again.

    They are options rather than filters that Spark pushes down: a Python source keeps what was pushed into it,
    and the same DataFrame read again without the filter would still lack the rows.
    """
    spark.dataSource.register(SqliteSource)
    parsed = [parse_comparison(text) for text in filters]
    tests = [f"{quoted(c, 'sqlite')} {op} {literal(v, 'sqlite')}" for c, op, v in parsed if pushdown(SOURCES["sqlite"], op) != "unsupported" and isinstance(v, (int, float))]
    options = {"path": path, "partitions": partitions, "tests": json.dumps(tests)} | ({"table": table} if table else {"query": query})
    return _applied(spark.read.format("sluice_sqlite").options(**options).load(), Scan(table or ""), list(filters))
