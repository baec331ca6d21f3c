"""Tables inside zip archives. An archive is opened by the task that reads its file; members
are decompressed as they are read, some lines at a time, never as a whole."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import kept

LINES = 10_000
_SCHEMA = pa.schema([("path", pa.string()), ("member", pa.string()), ("n", pa.int64()), ("line", pa.string()), ("error", pa.string())])


def _batch(path: str, member: str | None, first: int, lines: list[str], error: str | None = None) -> pa.RecordBatch:
    n = len(lines) or 1
    columns = [[path] * n, [member] * n, range(first, first + n), lines or [None], [error] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _lines(batches, pattern: str):
    import fnmatch

    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                archive = zipfile.ZipFile(pa.BufferReader(content.as_buffer()))
            except (zipfile.BadZipFile, OSError) as e:
                yield _batch(path, None, 0, [], repr(e))
                continue
            for info in archive.infolist():
                if info.is_dir() or not fnmatch.fnmatch(info.filename, pattern):
                    continue
                n, some = 0, []
                try:
                    with archive.open(info) as raw:
                        for line in io.TextIOWrapper(raw, "utf-8", newline="\n"):
                            some.append(line.rstrip("\r\n"))
                            if len(some) == LINES:
                                yield _batch(path, info.filename, n, some)
                                n, some = n + len(some), []
                    if some:
                        yield _batch(path, info.filename, n, some)
                except Exception as e:  # noqa: BLE001  whatever a broken member raises is its row of the error table
                    yield _batch(path, info.filename, n, [], repr(e))


def zipped_lines(spark: SparkSession, path: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(path, member, n, line) of all members whose names fit the pattern, and (path, member,
    error) of archives (member null) and members that cannot be read; of these no line is given."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = kept(files.mapInArrow(lambda b: _lines(b, pattern), "path string, member string, n long, line string, error string"), "zipped-lines")
    errors = rows.where("error is not null").select("path", "member", "error")
    return rows.where("error is null").drop("error").join(errors.select("path", "member"), ["path", "member"], "left_anti"), errors


def read_zipped_csv(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv", header: bool = True, separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """The rows (path, member, columns of schema) of all tables in the archives, and the errors.
    A member's first line is left out with header; values that do not fit their type are null."""
    lines, errors = zipped_lines(spark, path, pattern)
    lines = lines.where("n > 0") if header else lines
    parsed = lines.select("path", "member", F.explode(F.array(F.from_csv("line", schema, {"sep": separator}))).alias("r"))
    return parsed.select("path", "member", "r.*"), errors
