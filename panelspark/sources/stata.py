"""Stata files (``.dta``, releases 117 to 119) as a Spark data source: scans and sinks.

A ``.dta`` file holds records of one width, so a scan is split by record numbers: a task opens
the file at its first record and decodes its share in batches, and one large file is read by
many tasks. A sink writes a folder of complete files: every task puts out files of at most
``file_bytes`` under names of their own, and the driver commits by writing the list of the
tasks' files (``_committed``) last. Files of failed or repeated attempts are in no list, so no
scan sees them.

Types: byte, int, long, float and double are tinyint to double, ``%td`` dates, ``%tc`` timestamps
without a zone, ``str#`` strings. The missing codes ``.`` and ``.a`` to ``.z`` are NULL; they can be
read beside it as ``<variable>_missing``. With value labels on, a labelled variable is the text
of its label, or of the number where it has none. A missing string is the empty string, as in
the format. NaN and the infinities are written as ``.``. ``strL`` variables are an error unless
``columns`` leaves them out, as their texts lie outside the records.

The driver reads one header a file and holds one list of names. A task holds one batch (scan) or
one file (sink) and the value labels, which the format bounds.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from panelspark.session import file_system, materialize

# Fixed values of the file format: codes, widths and largest valid numbers of the types, the first
# missing code of each (".", then ".a" to ".z" at equal steps), sizes of the header's fields.
NUMERIC = {65530: ("i1", 101, 1), 65529: ("i2", 32741, 1), 65528: ("i4", 2147483621, 1),
           65527: ("f4", 0x7F000000, 1 << 11), 65526: ("f8", 0x7FE0000000000000, 1 << 40)}
BYTE, INT, LONG, FLOAT, DOUBLE, STRL, LONGEST = 65530, 65529, 65528, 65527, 65526, 32768, 2045
FIELDS = {117: dict(K="H", N="I", label="B", name=33, format=49, sort="H"),
          118: dict(K="H", N="Q", label="H", name=129, format=57, sort="H"),
          119: dict(K="I", N="Q", label="H", name=129, format=57, sort="I")}
DAYS_1960, MICROS_1960 = -3653, -3653 * 86_400_000_000
CODES = [".", *(f".{chr(c)}" for c in range(ord("a"), ord("z") + 1))]
COMMITTED = "_committed"
SPARK_TYPES = {BYTE: T.ByteType(), INT: T.ShortType(), LONG: T.IntegerType(), FLOAT: T.FloatType(), DOUBLE: T.DoubleType()}


# ---------------------------------------------------------------- files


def committed(fs: pafs.FileSystem, folder: str) -> list[str] | None:
    """Names in the folder's list of committed files, or None without one."""
    path = posixpath.join(folder, COMMITTED)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(path) as f:
        return json.loads(f.read())


def dta_files(path: str) -> list[str]:
    """The file itself, a folder's committed files, or all ``.dta`` files below a folder."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = committed(fs, at)
    if names is None:
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        names = sorted(f.path[len(at.rstrip("/")) + 1:] for f in found if f.path.endswith(".dta"))
        if any(posixpath.basename(n).startswith("part-") for n in names):
            raise ValueError(f"{path} holds files of a write that was not committed")
    return [posixpath.join(path, n) for n in names]


# ---------------------------------------------------------------- layout of a file


@dataclass(frozen=True)
class Variable:
    name: str
    code: int
    format: str = ""
    labels: str = ""

    @property
    def width(self) -> int:
        return self.code if self.code <= LONGEST else 8 if self.code == STRL else int(NUMERIC[self.code][0][1])

    @property
    def kind(self) -> str:
        if self.code <= LONGEST or self.code == STRL:
            return "text"
        return "date" if re.match(r"%-?t?d", self.format) else "time" if re.match(r"%-?tc", self.format) else "number"


@dataclass(frozen=True)
class Layout:
    path: str
    release: int
    order: str
    rows: int
    data_at: int
    labels_at: int
    labels_end: int
    variables: tuple[Variable, ...]

    @property
    def width(self) -> int:
        return sum(v.width for v in self.variables)

    @property
    def encoding(self) -> str:
        return "cp1252" if self.release == 117 else "utf-8"

    def text(self, raw: bytes) -> str:
        return raw.split(b"\0", 1)[0].decode(self.encoding, "replace")

    def dtype(self, names: Sequence[str]) -> np.dtype:
        """Fields of the wanted variables within a whole record."""
        spot, at = {}, 0
        for v in self.variables:
            spot[v.name] = (f"S{v.width}" if v.kind == "text" else self.order + NUMERIC[v.code][0], at)
            at += v.width
        return np.dtype({"names": list(names), "formats": [spot[n][0] for n in names],
                         "offsets": [spot[n][1] for n in names], "itemsize": at})


def read_layout(path: str) -> Layout:
    """Header, places of the sections and variables of one file (two small reads)."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        head, pos = f.read_at(4096, 0), 0

        def after(tag: bytes) -> int:
            found = head.find(tag, pos)
            if found < 0:
                raise ValueError(f"{path}: no {tag.decode()} in the header, not a file of release 117 to 119")
            return found + len(tag)

        pos = after(b"<release>")
        release = int(head[pos:pos + 3]) if head[pos:pos + 3].isdigit() else 0
        if release not in FIELDS:
            raise ValueError(f"{path}: release {release} is not supported (117 to 119 are)")
        size, pos = FIELDS[release], after(b"<byteorder>")
        order = "<" if head[pos:pos + 3] == b"LSF" else ">"
        read = lambda kind, start: struct.unpack_from(order + kind, head, start)[0]
        pos = after(b"<K>")
        count = read(size["K"], pos)
        pos = after(b"<N>")
        rows = read(size["N"], pos)
        pos = after(b"<label>")
        pos += struct.calcsize(size["label"]) + read(size["label"], pos)
        pos = after(b"<timestamp>")
        pos += 1 + head[pos]
        places = struct.unpack_from(order + "14Q", head, after(b"<map>"))

        def section(k: int, tag: str, each: int) -> list[bytes]:
            raw = f.read_at(count * each, places[k] + len(tag) + 2)
            return [raw[i * each:(i + 1) * each] for i in range(count)]

        cut = lambda raw: raw.split(b"\0", 1)[0].decode("cp1252" if release == 117 else "utf-8", "replace")
        types = [struct.unpack(order + "H", x)[0] for x in section(2, "variable_types", 2)]
        names, formats, labels = (list(map(cut, section(k, tag, size[n]))) for k, tag, n in (
            (3, "varnames", "name"), (5, "formats", "format"), (6, "value_label_names", "name")))
    return Layout(path, release, order, rows, places[9] + len("<data>"), places[11] + len("<value_labels>"), places[12],
                  tuple(map(Variable, names, types, formats, labels)))


def read_value_labels(layout: Layout) -> dict[str, dict[int, str]]:
    """{name of a set of labels: {value: text}}"""
    fs, at = file_system(layout.path)
    with fs.open_input_file(at) as f:
        raw = f.read_at(layout.labels_end - layout.labels_at, layout.labels_at)
    found, pos, size = {}, 0, FIELDS[layout.release]["name"]
    while raw[pos:pos + 5] == b"<lbl>":
        name = layout.text(raw[pos + 9:pos + 9 + size])
        body = pos + 9 + size + 3
        n, chars = struct.unpack_from(layout.order + "2i", raw, body)
        starts = struct.unpack_from(f"{layout.order}{n}i", raw, body + 8)
        values = struct.unpack_from(f"{layout.order}{n}i", raw, body + 8 + 4 * n)
        texts = raw[body + 8 + 8 * n:body + 8 + 8 * n + chars]
        found[name] = {v: layout.text(texts[s:]) for v, s in zip(values, starts)}
        pos = body + 8 + 8 * n + chars + len("</lbl>")
    return found


# ---------------------------------------------------------------- scan


@dataclass
class Wanted:
    """Options of a scan."""

    columns: list[str] | None
    value_labels: bool
    missing_codes: bool
    split_bytes: int

    @classmethod
    def of(cls, options: Mapping[str, str]) -> "Wanted":
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        columns = options.get("columns")
        return cls(json.loads(columns) if columns else None, flag("valueLabels"), flag("missingCodes"),
                   int(options.get("splitBytes", 128 << 20)))

    def variables(self, layout: Layout) -> list[Variable]:
        own = {v.name: v for v in layout.variables}
        missing = [c for c in self.columns or () if c not in own]
        if missing:
            raise ValueError(f"{layout.path} has no variable {missing}")
        found = [own[c] for c in self.columns] if self.columns else list(layout.variables)
        long = [v.name for v in found if v.code == STRL]
        if long:
            raise ValueError(f"{layout.path}: strL variables cannot be read, leave out {long}")
        return found


def wider(a: int, b: int) -> int:
    """A type that holds all values of two numeric types."""
    if {a, b} <= {FLOAT, INT, BYTE} or a == b:
        return min(a, b)
    return DOUBLE if FLOAT in (a, b) else min(a, b)


def scan_schema(layouts: Sequence[Layout], wanted: Wanted) -> T.StructType:
    """Types of the variables over all files; a clash is an error that names the file."""
    kinds: dict[str, tuple[str, int, bool]] = {}
    order = [v.name for v in wanted.variables(layouts[0])]
    for layout in layouts:
        own = {v.name: v for v in wanted.variables(layout)}
        if set(own) != set(order):
            raise ValueError(f"{layout.path}: variables {sorted(own)} differ from {sorted(order)} of {layouts[0].path}")
        for v in own.values():
            kind, code, labelled = kinds.get(v.name, (v.kind, v.code, bool(v.labels)))
            if kind != v.kind or labelled != bool(v.labels) and wanted.value_labels:
                raise ValueError(f"{layout.path}: {v.name} is a {v.kind}, a {kind} in files before it "
                                 "(or labelled in one file only)")
            kinds[v.name] = (kind, code if kind == "text" else wider(code, v.code), labelled)
    schema = T.StructType()
    for name in order:
        kind, code, labelled = kinds[name]
        text = kind == "text" or labelled and wanted.value_labels
        schema.add(name, T.StringType() if text else T.DateType() if kind == "date" else
                   T.TimestampNTZType() if kind == "time" else SPARK_TYPES[code])
        if wanted.missing_codes and kind != "text":
            if f"{name}_missing" in kinds:
                raise ValueError(f"{name}_missing is a variable of the file, so {name} cannot have its codes beside it")
            schema.add(f"{name}_missing", T.StringType())
    return schema


def missing_code(column: np.ndarray, code: int) -> np.ndarray:
    """-1 for a valid number, else the place of its code in ``CODES``."""
    kind, first, step = NUMERIC[code]
    if code in (FLOAT, DOUBLE):
        bits = column.astype(kind).view(f"i{kind[1]}").astype(np.int64)
        place = np.where(bits >= first, (bits - first) // step, -1)
        place = np.where(~np.isfinite(column) & (place < 0), 0, place)
    else:
        whole = column.astype(np.int64)
        place = np.where(whole >= first, whole - first, -1)
    return np.where(place >= len(CODES), 0, place)


def decode(v: Variable, column: np.ndarray, layout: Layout, labels: dict[int, str] | None,
           kind: pa.DataType) -> tuple[pa.Array, np.ndarray | None]:
    """A variable's records as an Arrow array, and the places of their missing codes."""
    if v.kind == "text":
        return pa.array([layout.text(x) for x in column.tolist()], kind), None
    place = missing_code(column, v.code)
    gone = place >= 0
    if labels is not None:
        return pa.array([None if g else labels.get(x, str(x)) for x, g in zip(column.tolist(), gone)], kind), place
    whole = np.where(gone, 0, column)
    if v.kind == "date":
        return pa.array(whole.astype(np.int64).astype(np.int32) + np.int32(DAYS_1960), pa.int32(), mask=gone).cast(kind), place
    if v.kind == "time":
        micros = np.rint(whole.astype(np.float64)).astype(np.int64) * 1000 + MICROS_1960
        return pa.array(micros, pa.int64(), mask=gone).cast(kind), place
    return pa.array(whole.astype(kind.to_pandas_dtype()), kind, mask=gone), place


@dataclass
class Records(InputPartition):
    path: str
    first: int
    rows: int


class StataReader(DataSourceReader):
    def __init__(self, path: str, wanted: Wanted, schema: T.StructType):
        self.path, self.wanted, self.schema = path, wanted, schema

    def partitions(self) -> Sequence[InputPartition]:
        found, layouts = [], read_layouts(self.path)
        for x in layouts:
            each = max(1, self.wanted.split_bytes // max(1, x.width))
            found += [Records(x.path, at, min(each, x.rows - at)) for at in range(0, x.rows, each)]
        return found or [Records(layouts[0].path, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        layout = read_layout(partition.path)
        variables = self.wanted.variables(layout)
        sets = read_value_labels(layout) if self.wanted.value_labels else {}
        dtype = layout.dtype([v.name for v in variables])
        kinds = {f.name: arrow_type(f.dataType) for f in self.schema}
        fs, at = file_system(layout.path)
        each = max(1, (4 << 20) // dtype.itemsize)
        with fs.open_input_file(at) as f:
            for first in range(partition.first, partition.first + partition.rows, each):
                n = min(each, partition.first + partition.rows - first)
                raw = f.read_at(n * dtype.itemsize, layout.data_at + first * dtype.itemsize)
                if len(raw) != n * dtype.itemsize:
                    raise ValueError(f"{layout.path} ends within its records")
                records, arrays = np.frombuffer(raw, dtype), {}
                for v in variables:
                    labels = sets.get(v.labels, {}) if v.labels and self.wanted.value_labels else None
                    arrays[v.name], place = decode(v, records[v.name], layout, labels, kinds[v.name])
                    if self.wanted.missing_codes and place is not None:
                        arrays[f"{v.name}_missing"] = pa.array(
                            [CODES[k] if k >= 0 else None for k in place.tolist()], pa.string())
                names = self.schema.names
                yield pa.RecordBatch.from_arrays([arrays[c] for c in names], names)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64(),
            "date": pa.date32(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string()}[kind.simpleString()]


def read_layouts(path: str) -> list[Layout]:
    files = dta_files(path)
    if not files:
        raise ValueError(f"{path} holds no .dta files")
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(read_layout, files))


# ---------------------------------------------------------------- sink


def tagged(name: str, body: bytes) -> bytes:
    return f"<{name}>".encode() + body + f"</{name}>".encode()


def padded(text: str, size: int) -> bytes:
    raw = text.encode()
    if len(raw) >= size:
        raise ValueError(f"{text!r} is longer than {size - 1} bytes")
    return raw + bytes(size - len(raw))


def label_set(name: str, values: Mapping[int, str]) -> bytes:
    pairs, starts, texts = sorted(values.items()), [], b""
    for _, text in pairs:
        starts.append(len(texts))
        texts += text.encode() + b"\0"
    body = struct.pack(f"<2i{len(pairs)}i{len(pairs)}i", len(pairs), len(texts), *starts, *(v for v, _ in pairs)) + texts
    return tagged("lbl", struct.pack("<i", len(body)) + padded(name, 129) + bytes(3) + body)


def file_frame(variables: Sequence[Variable], rows: int, labels: Mapping[str, Mapping[int, str]]) -> tuple[bytes, bytes]:
    """What stands before and after the records of a file of release 118."""
    k = len(variables)
    header = b"<stata_dta>" + tagged("header", tagged("release", b"118") + tagged("byteorder", b"LSF")
                                     + tagged("K", struct.pack("<H", k)) + tagged("N", struct.pack("<Q", rows))
                                     + tagged("label", bytes(2)) + tagged("timestamp", bytes(1)))
    sections = [
        tagged("variable_types", struct.pack(f"<{k}H", *(v.code for v in variables))),
        tagged("varnames", b"".join(padded(v.name, 129) for v in variables)),
        tagged("sortlist", bytes(2 * (k + 1))),
        tagged("formats", b"".join(padded(v.format, 57) for v in variables)),
        tagged("value_label_names", b"".join(padded(v.labels, 129) for v in variables)),
        tagged("variable_labels", bytes(321 * k)),
        tagged("characteristics", b"")]
    records = rows * sum(v.width for v in variables)
    places = [0, len(header), len(header) + len(tagged("map", bytes(112)))]
    for body in sections:
        places.append(places[-1] + len(body))
    places.append(places[-1] + len(tagged("data", b"")) + records)
    places.append(places[-1] + len(tagged("strls", b"")))
    ends = tagged("value_labels", b"".join(label_set(n, x) for n, x in labels.items()))
    places.append(places[-1] + len(ends))
    places.append(places[-1] + len(b"</stata_dta>"))
    before = header + tagged("map", struct.pack("<14Q", *places)) + b"".join(sections) + b"<data>"
    return before, b"</data>" + tagged("strls", b"") + ends + b"</stata_dta>"


def encode(v: Variable, column: pa.Array, codes: pa.Array | None, out: np.ndarray) -> None:
    """Fill a field of the records from an Arrow array."""
    gone = column.is_null().to_numpy(zero_copy_only=False)
    if v.kind == "text":
        out[:] = [b"" if x is None else x.encode() for x in column.cast(pa.string()).to_pylist()]
        return
    if v.kind == "date":
        values = column.cast(pa.date32()).cast(pa.int32()).fill_null(0).to_numpy().astype(np.int64) - DAYS_1960
    elif v.kind == "time":
        micros = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).fill_null(0).to_numpy()
        values = (micros - MICROS_1960) / 1000.0
    else:
        values = column.cast(pa.float64() if v.code in (FLOAT, DOUBLE) else pa.int64(), safe=False).fill_null(0).to_numpy()
    kind, first, step = NUMERIC[v.code]
    gone = gone | ~np.isfinite(values.astype(np.float64))
    out[:] = np.where(gone, 0, values)
    if (missing_code(out, v.code) >= 0).any():
        raise ValueError(f"{v.name} holds a number beyond the format's largest")
    if gone.any():
        place = np.zeros(len(gone), np.int64)
        if codes is not None:
            known = {c: i for i, c in enumerate(CODES)}
            place[:] = [known.get(c, 0) for c in codes.to_pylist()]
        raw = first + place * step
        whole = np.ascontiguousarray(out)
        whole.view(f"i{kind[1]}")[gone] = raw[gone]
        out[:] = whole


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class StataWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: Mapping[str, str], overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.variables = [Variable(*v) for v in json.loads(options["variables"])]
        self.labels = {n: {int(k): t for k, t in x.items()} for n, x in json.loads(options.get("labels", "{}")).items()}
        self.codes = json.loads(options.get("codes", "{}"))
        self.file_bytes = int(options.get("fileBytes", 128 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.path)
        dtype = np.dtype([(v.name, f"S{v.width}" if v.kind == "text" else "<" + NUMERIC[v.code][0]) for v in self.variables])
        most, held, rows, files = max(1, self.file_bytes // dtype.itemsize), [], 0, []

        def put() -> None:
            name = f"part-{uuid.uuid4().hex}.dta"
            before, after = file_frame(self.variables, rows, self.labels)
            files.append(name)
            with fs.open_output_stream(posixpath.join(folder, name)) as f:
                for piece in (before, *held, after):
                    f.write(piece)

        fs.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                while batch.num_rows:
                    part, batch = batch.slice(0, most - rows), batch.slice(most - rows)
                    records = np.zeros(part.num_rows, dtype)
                    for v in self.variables:
                        codes = part.column(self.codes[v.name]) if v.name in self.codes else None
                        encode(v, part.column(v.name), codes, records[v.name])
                    held.append(records.tobytes())
                    rows += part.num_rows
                    if rows == most:
                        put()
                        held, rows = [], 0
            if rows:
                put()
        except BaseException:
            self.remove(files)
            raise
        return Written(files)

    def remove(self, names: Sequence[str]) -> None:
        fs, folder = file_system(self.path)
        for name in names:
            path = posixpath.join(folder, name)
            if fs.get_file_info(path).type == pafs.FileType.File:
                fs.delete_file(path)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        before = committed(fs, folder) or []
        names = [n for m in messages if m for n in m.files]
        if not names and (self.overwrite or not before):  # an empty table keeps its variables
            names = [f"part-{uuid.uuid4().hex}.dta"]
            with fs.open_output_stream(posixpath.join(folder, names[0])) as f:
                f.write(b"".join(file_frame(self.variables, 0, self.labels)))
        passing = posixpath.join(folder, f".{COMMITTED}-{uuid.uuid4().hex}")
        with fs.open_output_stream(passing) as f:
            f.write(json.dumps(names if self.overwrite else before + names).encode())
        fs.move(passing, posixpath.join(folder, COMMITTED))
        if self.overwrite:
            self.remove(before)

    def abort(self, messages: list[Written | None]) -> None:
        self.remove([n for m in messages if m for n in m.files])


class StataSource(DataSource):
    """``spark.read.format("stata")`` and ``df.write.format("stata")``; see ``read_dta`` and ``write_dta``."""

    @classmethod
    def name(cls) -> str:
        return "stata"

    def schema(self) -> T.StructType:
        return scan_schema(read_layouts(self.options["path"]), Wanted.of(self.options))

    def reader(self, schema: T.StructType) -> StataReader:
        return StataReader(self.options["path"], Wanted.of(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> StataWriter:
        return StataWriter(self.options["path"], self.options, overwrite)


# ---------------------------------------------------------------- API


def read_dta(spark: SparkSession, path: str, columns: Sequence[str] | None = None, value_labels: bool = False,
             missing_codes: bool = False, split_bytes: int = 128 << 20) -> DataFrame:
    """A file, a written folder, or all ``.dta`` files below a folder, in tasks of ``split_bytes``.

    Files may differ in the widths of a variable's type; other differences are an error.
    """
    spark.dataSource.register(StataSource)
    reader = (spark.read.format("stata").option("valueLabels", value_labels).option("missingCodes", missing_codes)
              .option("splitBytes", split_bytes))
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    return reader.load(path)


def stata_variables(df: DataFrame, labels: Mapping[str, Mapping[int, str]], codes: Mapping[str, str]) -> list[Variable]:
    """The type of each column: that of its own width, a wider one where a value needs it (one aggregate)."""
    fields = [f for f in df.schema if f.name not in codes.values()]
    whole = {"tinyint", "smallint", "int", "bigint"}
    stats = []
    for f in fields:
        kind = f.dataType.simpleString()
        if not re.fullmatch(r"[A-Za-z_]\w{0,31}", f.name):
            raise ValueError(f"{f.name!r} is not a name of the format (letters, digits, _; 32 at most)")
        if kind == "string":
            stats.append(F.max(F.octet_length(f.name)).alias(f"hi_{f.name}"))
        elif kind in whole:
            stats += [F.min(f.name).alias(f"lo_{f.name}"), F.max(f.name).alias(f"hi_{f.name}")]
    bound = df.agg(*stats).first().asDict() if stats else {}
    found = []
    for f in fields:
        kind, hi, lo = f.dataType.simpleString(), bound.get(f"hi_{f.name}"), bound.get(f"lo_{f.name}")
        named = f.name if f.name in labels else ""
        if kind == "string":
            if (hi or 1) > LONGEST:
                raise ValueError(f"{f.name} holds a text of {hi} bytes, the format's longest is {LONGEST}")
            found.append(Variable(f.name, max(1, hi or 1), f"%{max(1, hi or 1)}s"))
        elif kind in whole:
            most = max(hi or 0, -(lo or 0) - 1 if lo is not None and lo < 0 else 0)
            least = {"tinyint": BYTE, "smallint": INT, "int": LONG, "bigint": LONG}[kind]
            fits = lambda c: lo is None or (-(1 << 8 * int(NUMERIC[c][0][1]) - 1) < lo and hi < NUMERIC[c][1])
            code = next((c for c in (BYTE, INT, LONG) if c <= least and fits(c)), DOUBLE)
            if code == DOUBLE and most > 1 << 53:
                raise ValueError(f"{f.name} holds whole numbers beyond 2^53, which the format cannot hold exactly")
            found.append(Variable(f.name, code, "%12.0g", named))
        elif kind == "boolean":
            found.append(Variable(f.name, BYTE, "%8.0g", named))
        elif kind == "date":
            found.append(Variable(f.name, LONG, "%td"))
        elif kind in ("timestamp", "timestamp_ntz"):
            found.append(Variable(f.name, DOUBLE, "%tc"))
        elif kind in ("float", "double") or kind.startswith("decimal"):
            found.append(Variable(f.name, FLOAT if kind == "float" else DOUBLE, "%10.0g", named))
        else:
            raise ValueError(f"{f.name}: the format has no type for {kind}")
    return found


def write_dta(df: DataFrame, path: str, labels: Mapping[str, Mapping[int, str]] | None = None,
              missing_codes: Mapping[str, str] | None = None, mode: str = "overwrite",
              file_bytes: int = 128 << 20) -> str:
    """Write a folder of ``.dta`` files.

    ``labels`` gives a whole-number column the texts of its values, ``missing_codes`` names the
    column that holds ``.a`` to ``.z`` where a column is NULL (it is not written itself). The table
    is written once as Parquet first, as types and widths are chosen over all its rows.
    """
    spark, labels, codes = df.sparkSession, labels or {}, missing_codes or {}
    spark.dataSource.register(StataSource)
    df = materialize(df, "dta")
    variables = stata_variables(df, labels, codes)
    (df.write.format("stata").mode(mode).option("fileBytes", file_bytes).option("codes", json.dumps(dict(codes)))
     .option("labels", json.dumps({n: {str(k): t for k, t in x.items()} for n, x in labels.items()}))
     .option("variables", json.dumps([(v.name, v.code, v.format, v.labels) for v in variables])).save(path))
    return path
