"""CSV folders without a declared schema: files whose columns differ, types from all values.

Names come from each file's header, so files may order their columns differently or lack some
(NULL there); files of equal headers share one scan. Types come from one aggregate over every
value of every file: whole numbers, numbers, dates, booleans, else text. Whole numbers and
numbers of different files meet as numbers. Other differences between files are a clash: an
error that names a file of each kind, or text if the caller says so. A number with leading
zeros (a code) and a whole number of more than 18 digits are text. Empty fields and ``NA`` are
NULL; a column without values is text.

Headers are read by tasks, one small read a file. The driver holds the list of files, the
different headers (``most_headers`` at most) and one row of kinds.
"""

from __future__ import annotations

import csv
from typing import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import file_system

KINDS = ("bigint", "double", "date", "boolean", "string")
PATTERNS = {"bigint": r"^[+-]?(0|[1-9]\d{0,17})$",
            "double": r"^[+-]?(((0|[1-9]\d{0,17})(\.\d*)?|\.\d+)([eE][+-]?\d+)?|Inf|NaN)$",
            "date": r"^\d{4}-\d{2}-\d{2}$", "boolean": r"^(TRUE|FALSE|true|false)$"}


def header_of(path: str, sep: str) -> list[str]:
    """The names in a file's first line; none for an empty file."""
    fs, at = file_system(path)
    raw = b""
    with fs.open_input_file(at) as f:
        while b"\n" not in raw:
            more = f.read(1 << 16)
            if not more:
                break
            raw += more
    line = raw.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")
    names = [n.strip() for n in next(csv.reader([line], delimiter=sep))] if line else []
    if "" in names or len(set(map(str.lower, names))) != len(names):
        raise ValueError(f"{path}: names of the header are empty or repeat: {names}")
    return names


def files_by_header(spark: SparkSession, files: Sequence[str], sep: str, most_headers: int) -> dict[tuple[str, ...], list[str]]:
    """{names: files}, the headers read by Spark tasks."""

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(
                [header_of(p, sep) for p in paths], pa.list_(pa.string()))], ["path", "names"])

    table = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, min(1000, len(files) // 16)))
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in table.mapInArrow(run, "path string, names array<string>").toLocalIterator():
        if r["names"]:
            groups.setdefault(tuple(r["names"]), []).append(r["path"])
        if len(groups) > most_headers:
            raise ValueError(f"more than {most_headers} different headers")
    return {k: sorted(v) for k, v in sorted(groups.items())}


def is_kind(value: Column, kind: str) -> Column:
    fits = value.rlike(PATTERNS[kind])
    return fits & value.try_cast("date").isNotNull() if kind == "date" else fits


def kinds_by_file(rows: DataFrame, columns: Sequence[str], file: str) -> DataFrame:
    """(file, kind of each column's values in it); NULL where a file has no values."""
    counts = [F.count_if(is_kind(F.col(c), k)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in KINDS[:-1]]
    counts += [F.count(c).alias(f"{i}_n") for i, c in enumerate(columns)]
    found = rows.groupBy(file).agg(*counts)

    def kind(i: int) -> Column:
        out = F.when(F.col(f"{i}_n") == 0, None)
        # whole numbers are numbers too, so a mix of both within a file is "double"
        for k in KINDS[:-1]:
            out = out.when(F.col(f"{i}_{k}") == F.col(f"{i}_n"), k)
        return out.otherwise("string")

    return found.select(file, *[kind(i).alias(f"kind_{i}") for i in range(len(columns))])


def joined_kinds(kinds: DataFrame, columns: Sequence[str], file: str, clash: str) -> dict[str, str]:
    """{column: type} over all files."""
    found = kinds.agg(*[F.min(F.when(F.col(f"kind_{i}") == k, F.col(file))).alias(f"{i}_{k}")
                        for i in range(len(columns)) for k in KINDS]).first()
    types = {}
    for i, c in enumerate(columns):
        seen = {k: found[f"{i}_{k}"] for k in KINDS if found[f"{i}_{k}"] is not None}
        if set(seen) == {"bigint", "double"}:
            types[c] = "double"
        elif len(seen) <= 1:
            types[c] = next(iter(seen), "string")
        elif clash == "string":
            types[c] = "string"
        else:
            raise ValueError(f"{c}: types clash, " + ", ".join(f"{k} in {unquote(f)}" for k, f in seen.items()))
    return types


def read_csv_inferred(spark: SparkSession, path: str, *, sep: str = ",", missing: Sequence[str] = ("", "NA"),
                      clash: str = "error", most_headers: int = 200) -> DataFrame:
    """All CSV files of a folder as one table with inferred types (see above).

    ``clash="string"`` makes a column text whose types differ between files. Columns are in the
    order of the first header (sorted), then of those that add some.
    """
    listed = spark.read.option("recursiveFileLookup", True).text(path)
    files = sorted(unquote(f) for f in listed.inputFiles())
    groups = files_by_header(spark, files, sep, most_headers) if files else {}
    if not groups:
        raise ValueError(f"{path} holds no CSV files with a header")
    file, rows, columns = "_file of row", None, []
    for names, own in groups.items():
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        one = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).csv(own)
        value = [F.col(f"`{n.replace('`', '``')}`") for n in names]
        one = one.select(*[F.when(~F.trim(v).isin(*missing), F.trim(v)).alias(n) for v, n in zip(value, names)],
                         F.col("_metadata.file_path").alias(file))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        columns += [n for n in names if n not in columns]
    plain = rows.toDF(*[file if n == file else f"v{columns.index(n)}" for n in rows.columns])
    order = [f"v{i}" for i in range(len(columns))]
    kinds = kinds_by_file(plain, order, file)
    types = joined_kinds(kinds, columns, file, clash)
    return plain.select(*[typed(F.col(v), types[c]).alias(c) for v, c in zip(order, columns)])


def typed(value: Column, kind: str) -> Column:
    if kind == "double":
        value = F.regexp_replace(value, "Inf$", "Infinity")
    return value if kind == "string" else value.cast(kind)
