"""Spark data source for SAS transport (XPORT version 5) files.

The header gives the columns and the width of a row, rows have a fixed width, so a file
is cut into row ranges that tasks read and decode on their own.  A folder is read as all
its files, which must have one layout; writing puts one file per task into a folder.  Files are
opened through Arrow, which reads local paths and the usual remote file systems.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import DoubleType, NumericType, StringType, StructField, StructType

# Layout of the format.
RECORD = 80
NAMESTR_MARK = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!"
MEMBER_MARK = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!"
OBS_MARK = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!"
LIBRARY_MARK = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!"
MISSING_TAGS = b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PARTITION_BYTES = 64 * 1024 * 1024
BATCH_ROWS = 65_536


@dataclass(frozen=True)
class Variable:
    name: str
    numeric: bool
    width: int
    position: int


@dataclass(frozen=True)
class Layout:
    variables: tuple[Variable, ...]
    start: int
    row_width: int
    rows: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path inside it; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def read_layout(path: str, system: pafs.FileSystem | None = None) -> Layout:
    """Columns and row positions of the file's first member."""
    system, name = _open(path) if system is None else (system, path)
    with system.open_input_file(name) as handle:
        size = handle.size()
        if not handle.read(RECORD).startswith(LIBRARY_MARK):
            raise ValueError(f"{path} is not a transport file")
        handle.seek(3 * RECORD)
        member = handle.read(RECORD)
        if not member.startswith(MEMBER_MARK):
            raise ValueError(f"{path} has no member")
        entry = int(member[74:78])
        handle.seek(7 * RECORD)
        names = handle.read(RECORD)
        if not names.startswith(NAMESTR_MARK):
            raise ValueError(f"{path} has no variable list")
        count = int(names[54:58])
        block = handle.read(-(-count * entry // RECORD) * RECORD)
        if not handle.read(RECORD).startswith(OBS_MARK):
            raise ValueError(f"{path} has no rows section")
        start = handle.tell()
        variables = []
        for i in range(count):
            raw = block[i * entry:(i + 1) * entry]
            kind, width = int.from_bytes(raw[0:2], "big"), int.from_bytes(raw[4:6], "big")
            variables.append(Variable(raw[8:16].decode("latin-1").strip(), kind == 1, width,
                                      int.from_bytes(raw[84:88], "big")))
        row_width = sum(v.width for v in variables)
        rows = (size - start) // row_width if row_width else 0
        # The last record is filled up with blanks, which can look like whole rows when rows are short.
        while rows:
            handle.seek(start + (rows - 1) * row_width)
            if (size - start - (rows - 1) * row_width) > RECORD + row_width or handle.read(row_width).strip(b" "):
                break
            rows -= 1
    return Layout(tuple(variables), start, row_width, rows)


def decode_numbers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IBM floating-point bytes (rows × width) as doubles, and which of them are missing."""
    padded = np.zeros((len(raw), 8), dtype=np.uint8)
    padded[:, :raw.shape[1]] = raw
    words = padded.view(">u8").ravel().astype(np.uint64)
    fraction = words & np.uint64(0x00FFFFFFFFFFFFFF)
    exponent = ((words >> np.uint64(56)) & np.uint64(0x7F)).astype(np.int64)
    values = np.ldexp(fraction.astype(np.float64), (4 * (exponent - 64) - 56).astype(np.int32))
    values = np.where(words >> np.uint64(63), -values, values)
    missing = np.isin(padded[:, 0], np.frombuffer(MISSING_TAGS, dtype=np.uint8)) & (fraction == 0)
    return values, missing


def encode_numbers(values: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Doubles as IBM floating-point bytes (rows × 8); the fraction of a double fits without loss."""
    values = np.where(missing, 0.0, values)
    if not np.isfinite(values).all():
        raise ValueError("infinite values cannot be written")
    part, exponent = np.frexp(np.abs(values))
    base = -(-exponent // 4)  # of 16, rounded up, so that the fraction lies in [1/16, 1)
    fraction = np.ldexp(part, 56 + exponent - 4 * base).astype(np.uint64)
    characteristic = np.where(values == 0, 0, base + 64)
    if ((characteristic < 0) | (characteristic > 127)).any():
        raise ValueError("a value is beyond the range of the format")
    words = fraction | (characteristic.astype(np.uint64) << np.uint64(56)) | (
        np.signbit(values).astype(np.uint64) << np.uint64(63))
    words[values == 0] = 0
    words[missing] = ord(".") << 56
    return words.astype(">u8").view(np.uint8).reshape(-1, 8)


def _line(text: str) -> bytes:
    return text.encode("latin-1").ljust(RECORD, b" ")


def file_head(variables: list[Variable], member: str = "TABLE") -> bytes:
    """All records before the rows."""
    stamp = "01JAN26:00:00:00"
    names = b"".join(
        struct.pack(">hhhh8s40s8shhh2s8shhi52s", 1 if v.numeric else 2, 0, v.width, i + 1, v.name.encode("latin-1").ljust(8),
                    b" " * 40, b" " * 8, 8, 0, 0, b"", b" " * 8, 0, 0, v.position, b"") for i, v in enumerate(variables))
    return b"".join([
        _line(LIBRARY_MARK.decode() + "0" * 30), _line("SAS     SAS     SASLIB  9.4"), _line(stamp),
        _line(MEMBER_MARK.decode() + "0" * 17 + "1600000000140"), _line("HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!" + "0" * 30),
        _line(f"SAS     {member:<8}SASDATA 9.4"), _line(stamp),
        _line(NAMESTR_MARK.decode() + f"000000{len(variables):04d}" + "0" * 20),
        names.ljust(-(-len(names) // RECORD) * RECORD, b" "), _line(OBS_MARK.decode() + "0" * 30)])


@dataclass
class WrittenFile(WriterCommitMessage):
    name: str


class XportWriter(DataSourceArrowWriter):
    """One file per task, under a passing name until it is whole.

    Numbers are written as 8 bytes.  Words take the longest of the task, or ``width`` characters; null words
    become empty, which the format does not tell apart.
    """

    def __init__(self, folder: str, schema: StructType, overwrite: bool, width: int | None):
        for f in schema:
            if len(f.name) > 8 or not f.name.isascii():
                raise ValueError(f"{f.name}: names have at most 8 plain characters")
            if not isinstance(f.dataType, (NumericType, StringType)):
                raise ValueError(f"{f.name}: only numbers and words can be written")
        self.folder, self.width, self.overwrite = folder, width, overwrite
        self.columns = [(f.name, isinstance(f.dataType, NumericType)) for f in schema]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenFile:
        kept = [b for b in batches if b.num_rows]
        if not kept or not self.columns:  # a task without rows may not even get a batch
            return WrittenFile("")
        table = pa.Table.from_batches(kept)
        columns, variables, at = [], [], 0
        for name, numeric in self.columns:
            column = table[name].combine_chunks()
            if numeric:
                values = column.cast(pa.float64())
                raw = encode_numbers(values.fill_null(0.0).to_numpy(zero_copy_only=False),
                                     values.is_null(nan_is_null=True).to_numpy(zero_copy_only=False))
            else:
                words = [w.encode("latin-1", "replace") for w in column.fill_null("").to_pylist()]
                width = self.width or max([1, *map(len, words)])
                if any(len(w) > width for w in words) or width > 200:
                    raise ValueError(f"{name}: words of more than {min(width, 200)} characters")
                raw = np.frombuffer(b"".join(w.ljust(width) for w in words), np.uint8).reshape(-1, width)
            columns.append(raw)
            variables.append(Variable(name, numeric, raw.shape[1], at))
            at += raw.shape[1]
        body = np.hstack(columns).tobytes()
        system, root = _open(self.folder)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.xpt"
        passing = posixpath.join(root, f".{name}.part")
        with system.open_output_stream(passing) as out:
            out.write(file_head(variables))
            out.write(body.ljust(-(-len(body) // RECORD) * RECORD, b" "))
        return WrittenFile(posixpath.basename(passing))

    def commit(self, messages: list[WrittenFile | None]) -> None:
        """Gives the files their names; files of tasks that did not count keep passing ones and are not read."""
        system, root = _open(self.folder)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for name in _files(self.folder):
                system.delete_file(name)
        for m in messages:
            if m is not None and m.name:
                system.move(posixpath.join(root, m.name), posixpath.join(root, m.name[1:].removesuffix(".part")))

    def abort(self, messages: list[WrittenFile | None]) -> None:
        system, root = _open(self.folder)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(posixpath.join(root, m.name))


def _files(path: str) -> list[str]:
    """The path itself, or the files of a folder, without hidden ones."""
    system, name = _open(path)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != pafs.FileType.Directory:
        return [name]
    found = system.get_file_info(pafs.FileSelector(name))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


@dataclass
class RowRange(InputPartition):
    number: int
    first: int
    last: int


class XportReader(DataSourceReader):
    def __init__(self, path: str, layouts: list[tuple[str, Layout]], wanted: list[str], rows_per_partition: int | None):
        self.path = path
        self.layouts = layouts
        self.wanted = wanted
        self.rows_per_partition = rows_per_partition

    def partitions(self) -> list[RowRange]:
        found = []
        for i, (_, layout) in enumerate(self.layouts):
            step = self.rows_per_partition or max(1, PARTITION_BYTES // max(1, layout.row_width))
            found += [RowRange(i, a, min(a + step, layout.rows)) for a in range(0, layout.rows, step)]
        return found or [RowRange(0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition.last == 0:
            return
        name, layout = self.layouts[partition.number]
        chosen = [v for n in self.wanted for v in layout.variables if v.name == n]
        system, _ = _open(self.path)
        with system.open_input_file(name) as handle:
            for first in range(partition.first, partition.last, BATCH_ROWS):
                count = min(BATCH_ROWS, partition.last - first)
                handle.seek(layout.start + first * layout.row_width)
                block = np.frombuffer(handle.read(count * layout.row_width), dtype=np.uint8)
                rows = block.reshape(count, layout.row_width)
                arrays = []
                for v in chosen:
                    raw = np.ascontiguousarray(rows[:, v.position:v.position + v.width])
                    if v.numeric:
                        values, missing = decode_numbers(raw)
                        arrays.append(pa.array(values, mask=missing))
                    else:
                        texts = raw.view(f"S{v.width}").ravel()
                        arrays.append(pa.array([t.decode("latin-1").rstrip() for t in texts.tolist()]))
                yield pa.RecordBatch.from_arrays(arrays, names=[v.name for v in chosen])


class XportSource(DataSource):
    """``spark.read.format("xport").load(path)`` and ``df.write.format("xport").mode("overwrite").save(folder)``.

    Options: ``columns`` (comma-separated; only these are decoded, unknown names are left
    out) and ``rowsPerPartition``.
    """

    @classmethod
    def name(cls) -> str:
        return "xport"

    def _layouts(self) -> list[tuple[str, Layout]]:
        system, _ = _open(self.options["path"])
        found = [(name, read_layout(name, system)) for name in _files(self.options["path"])]
        kinds = {tuple((v.name, v.numeric) for v in layout.variables) for _, layout in found}
        if len(kinds) > 1:
            raise ValueError(f"the files of {self.options['path']} have different columns")
        return found

    def _wanted(self, layouts: list[tuple[str, Layout]]) -> list[str]:
        names = [v.name for v in layouts[0][1].variables] if layouts else []
        asked = self.options.get("columns")
        return names if not asked else [c for c in dict.fromkeys(asked.split(",")) if c in names]

    def schema(self) -> StructType:
        layouts = self._layouts()
        kinds = {v.name: DoubleType() if v.numeric else StringType() for v in layouts[0][1].variables} if layouts else {}
        return StructType([StructField(n, kinds[n]) for n in self._wanted(layouts)])

    def reader(self, schema: StructType) -> XportReader:
        given = self.options.get("rowsPerPartition")
        return XportReader(self.options["path"], self._layouts(), schema.fieldNames(), int(given) if given else None)

    def writer(self, schema: StructType, overwrite: bool) -> XportWriter:
        given = self.options.get("width")
        return XportWriter(self.options["path"], schema, overwrite, int(given) if given else None)
