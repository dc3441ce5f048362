"""Reading files into untyped columns, and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.cells import is_blank
from siltstone.functions.names import quoted
from siltstone.operators import nested
from siltstone.operators.query import guard_read_only, with_rows
from siltstone.sources import workbooks

DELIMITERS = (",", "\t", ";", "|")


def sniff(line: str) -> str:
    """The delimiter that a header line has most of."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes over a line end: then a line has an odd number of quotes. One parallel look at the text."""
    odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1
    return bool(spark.read.text(path).filter(odd).head(1))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, limit: int | None = None) -> DataFrame:
    """All columns as text; empty cells are null, lines without anything but blanks and columns without a name are left out.

    Which columns have a name is read from the header line itself, by place: Spark
    makes names for the others that a file may have too. A file is split among tasks unless
    a quoted cell holds a line end. A header without rows is an error.
    """
    if delimiter is None:
        first = spark.read.text(path).filter(F.trim("value") != "").first()
        if first is None:
            raise ValueError("the file has no header")
        delimiter = sniff(first[0])
    # the escape of an escape is a NUL if not given, which cells then lose
    options = {"sep": delimiter, "multiLine": _spans_lines(spark, path), "escape": '"', "charToEscapeQuoteEscaping": '"', "nullValue": ""}
    header = spark.read.options(header=False, **options).csv(path).first()
    df = spark.read.options(header=True, **options).csv(path)
    named = [c for c, h in zip(df.columns, header, strict=True) if h is not None and h.strip()]
    if not named:
        raise ValueError("the file has no header")
    df = df.select(*(F.col(quoted(c)) for c in named))
    # a lambda, as forall gives a function a Column for each of its parameters
    df = df.filter(~F.forall(F.array(*(F.col(quoted(c)) for c in df.columns)), lambda c: is_blank(c)))
    if not df.head(1):
        raise ValueError("the file has a header but no rows")
    return df if limit is None else df.limit(limit)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of objects, one object, or (``lines``) one a line, as a flat table (:func:`nested.flat`): columns in the order first seen.

    Nested fields are columns ``a_b``, three levels deep; of two fields with one name the later wins. Empty texts, arrays and deeper objects are null.
    """
    if lines:
        rows = spark.read.text(path).filter(F.trim("value") != "")
    else:
        one = F.ltrim("value")
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.when(one.startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))).alias("value"))
    return nested.flat(with_rows(rows), "value")


#: Seconds that a database may take to answer.
TIMEOUT = 8


def plain_columns(df: DataFrame) -> DataFrame:
    """Dates as ISO days; numbers, truth values and texts as they are; all else as text (nested values as JSON)."""

    def plain(n: str, t: str) -> Column:
        c = F.col(quoted(n))
        if t in ("date", "timestamp", "timestamp_ntz"):
            return F.date_format(c, "yyyy-MM-dd")
        if t.startswith(("array", "map", "struct", "variant")):
            return F.to_json(c)
        return F.hex(c) if t == "binary" else c.cast("string") if t.startswith(("interval", "time")) else c

    return df.select(*(plain(n, t).alias(n) for n, t in df.dtypes))


def read_database(spark: SparkSession, url: str, sql: str, limit: int | None = None, **options: str) -> DataFrame:
    """A guarded query of a database, as :func:`plain_columns`; its first ``limit`` rows if given. The driver's jar must be on Spark's class path."""
    given = {"queryTimeout": str(TIMEOUT), **options}
    df = plain_columns(spark.read.format("jdbc").options(url=url, query=guard_read_only(sql), **given).load())
    return df if limit is None else df.limit(limit)


def load(spark: SparkSession, path: str) -> DataFrame:
    """By the ending of the name: csv, tsv, txt, json, jsonl, xlsx, xlsm (its first sheet), parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt"):
        return read_csv(spark, path)
    if kind == "tsv":
        return read_csv(spark, path, "\t")
    if kind in ("json", "jsonl"):
        return read_json(spark, path, kind == "jsonl")
    if kind in ("xlsx", "xlsm"):
        first = workbooks.list_sheets(spark, path).orderBy("file", "position").first()
        if first is None:
            raise ValueError("the workbook has no sheet")
        return workbooks.read_workbook(spark, path, first["sheet"])
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{kind}")


def list_tables(spark: SparkSession, url: str, most: int = 200, **options: str) -> list[str]:
    """Names of a database's own tables, by its information schema; the driver's jar must be on Spark's class path."""
    sql = "SELECT table_name FROM information_schema.tables WHERE table_schema NOT IN ('information_schema', 'pg_catalog', 'mysql', 'sys', 'performance_schema') ORDER BY table_name"
    return [r[0] for r in spark.read.format("jdbc").options(url=url, query=sql, **options).load().limit(most).collect()]


def quoted_table(url: str, table: str) -> str:
    """A table's name, with its schema, in the quotes of the database: backticks for MySQL and MariaDB, else double ones."""
    mark = "`" if url.lower().startswith(("jdbc:mysql:", "jdbc:mariadb:")) else '"'
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in table.split("."))


def import_table(spark: SparkSession, url: str, table: str, limit: int | None = None, **options: str) -> DataFrame:
    """A whole table of a database, or its first ``limit`` rows, by a guarded query."""
    return read_database(spark, url, f"SELECT * FROM {quoted_table(url, table)}", limit, **options)


def dataset_name(path: str, sheet: str | None = None) -> str:
    """What a dataset is called: its file, with the sheet of a workbook in brackets."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return f"{name} ({sheet})" if sheet else name


def source_kind(name: str) -> str:
    """What a dataset comes from, by its name."""
    low = name.lower()
    for kind, marks in (("Query result", ("query",)), ("Joined data", (" + ", "join"))):
        if any(m in low for m in marks):
            return kind
    return {"csv": "CSV", "tsv": "TSV", "txt": "Text", "json": "JSON", "jsonl": "JSON", "xlsx": "Workbook", "xlsm": "Workbook", "parquet": "Parquet"}.get(low.rsplit(".", 1)[-1], "Table")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; null is empty."""
    df.write.mode("overwrite").options(header=True, nullValue="", emptyValue="").csv(path)
