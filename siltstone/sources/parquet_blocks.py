"""Joining Parquet files by copying their encoded column blocks.

The footer is a Thrift struct in the compact protocol. It is read into plain Python values, the
byte ranges of all column chunks are copied as they are, offsets in the footer are moved by the
distance each block moved, and the new footer is written behind them. Pages are never decoded.
Page indexes and bloom filters lie outside the copied blocks, so their pointers are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = b"PAR1"
RESULT_SCHEMA = "output_path string, inputs int, row_groups int, rows bigint, bytes bigint"
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class BlockCopyError(ValueError):
    """Inputs that can't be joined by copying blocks, or an output that failed validation."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            return self.byte() == TRUE
        if kind == BYTE:
            return struct.unpack("b", bytes([self.byte()]))[0]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack("<d", self.data[self.at - 8 : self.at])[0]
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.byte()
            n, of = head >> 4, head & 15
            n = self.varint() if n == 15 else n
            return of, [self.value(of) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            if not n:
                return 0, 0, []
            kinds = self.byte()
            return kinds >> 4, kinds & 15, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise BlockCopyError(f"unknown Thrift type {kind}")

    def struct(self) -> dict[int, tuple[int, object]]:
        out, last = {}, 0
        while (head := self.byte()) != 0:
            kind = head & 15
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            out[last] = (TRUE, kind == TRUE) if kind in (TRUE, FALSE) else (kind, self.value(kind))
        return out


def _varint(n: int, out: bytearray) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _write(kind: int, v, out: bytearray) -> None:
    if kind in (TRUE, FALSE):
        out.append(TRUE if v else FALSE)
    elif kind == BYTE:
        out += struct.pack("b", v)
    elif kind in (I16, I32, I64):
        _varint((v << 1) ^ (v >> 63), out)
    elif kind == DOUBLE:
        out += struct.pack("<d", v)
    elif kind == BINARY:
        _varint(len(v), out)
        out += v
    elif kind in (LIST, SET):
        of, items = v
        if len(items) < 15:
            out.append(len(items) << 4 | of)
        else:
            out.append(0xF0 | of)
            _varint(len(items), out)
        for x in items:
            _write(of, x, out)
    elif kind == MAP:
        a, b, items = v
        _varint(len(items), out)
        if items:
            out.append(a << 4 | b)
            for x, y in items:
                _write(a, x, out)
                _write(b, y, out)
    elif isinstance(v, bytes):  # a struct that is encoded already
        out += v
    else:
        last = 0
        for number in sorted(v):
            kind_of, x = v[number]
            tag = (TRUE if x else FALSE) if kind_of in (TRUE, FALSE) else kind_of
            if 0 < number - last <= 15:
                out.append((number - last) << 4 | tag)
            else:
                out.append(tag)
                _varint((number << 1) ^ (number >> 63), out)
            last = number
            if kind_of not in (TRUE, FALSE):
                _write(kind_of, x, out)
        out.append(0)


def read_footer(f, size: int) -> dict:
    """The footer of an open Parquet file as {field id: (Thrift type, value)}."""
    if size < 12:
        raise BlockCopyError("too short for a Parquet file")
    f.seek(size - 8)
    tail = f.read(8)
    if tail[4:] != MAGIC:
        raise BlockCopyError("no plain Parquet footer")
    n = struct.unpack("<I", tail[:4])[0]
    f.seek(size - 8 - n)
    return _Reader(f.read(n)).struct()


def _get(s: dict, number: int, default=None):
    return s[number][1] if number in s else default


def _schema_key(footer: dict) -> str:
    return repr(_get(footer, 2))


def _move(group: dict, source, sink, at: int) -> int:
    """Copy a row group's column chunks to `sink` at offset `at`, and point the footer there."""
    first = at
    for chunk in _get(group, 1)[1]:
        if 1 in chunk or 8 in chunk or 9 in chunk:
            raise BlockCopyError("column chunks in other files or encrypted ones can't be copied")
        meta = _get(chunk, 3)
        data_at, dictionary_at, length = _get(meta, 9), _get(meta, 11), _get(meta, 7)
        start = dictionary_at if dictionary_at is not None and 0 < dictionary_at < data_at else data_at
        source.seek(start)
        left = length
        while left:
            block = source.read(min(left, 8 << 20))
            if not block:
                raise BlockCopyError("a column chunk ends early")
            sink.write(block)
            left -= len(block)
        for number in (9, 10, 11):
            if number in meta:
                kind, old = meta[number]
                meta[number] = (kind, old - start + at) if start <= old < start + length else (kind, old)
        for number in (14, 15):
            meta.pop(number, None)
        for number in (4, 5, 6, 7):
            chunk.pop(number, None)
        chunk[2] = (I64, 0)
        at += length
    group[5] = (I64, first)
    return at


def _fs(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Output:
    """A file being written: the blocks are in `sink`, their footer entries encoded in `blocks`."""

    def __init__(self, name: str, footer: dict):
        self.name, self.footer, self.key = name, footer, _schema_key(footer)
        self.fs, self.path = _fs(name)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.sink = self.fs.open_output_stream(self.path + ".tmp")
        self.sink.write(MAGIC)
        self.blocks: list[bytes] = []
        self.at, self.inputs, self.rows = len(MAGIC), 0, 0

    def add(self, source, footer: dict) -> None:
        for group in _get(footer, 4)[1]:
            self.at = _move(group, source, self.sink, self.at)
            # the number of a block has 16 bits; blocks beyond go without
            if len(self.blocks) <= 32767:
                group[7] = (I16, len(self.blocks))
            else:
                group.pop(7, None)
            out = bytearray()
            _write(STRUCT, group, out)
            self.blocks.append(bytes(out))
            self.rows += _get(group, 3)
        self.inputs += 1

    def close(self) -> tuple[str, int, int, int, int]:
        # key-value metadata may be renewed per file by a writer; the first file's is kept
        self.footer[3] = (I64, self.rows)
        self.footer[4] = (LIST, (STRUCT, self.blocks))
        out = bytearray()
        _write(STRUCT, self.footer, out)
        self.sink.write(bytes(out) + struct.pack("<I", len(out)) + MAGIC)
        self.sink.close()
        size = self.fs.get_file_info(self.path + ".tmp").size
        with self.fs.open_input_file(self.path + ".tmp") as f:
            check = read_footer(f, size)
        got = _get(check, 4)[1]
        if (len(got), sum(_get(g, 3) for g in got)) != (len(self.blocks), self.rows) or _schema_key(check) != self.key:
            raise BlockCopyError(f"{self.name}: blocks, rows or schema differ from the inputs'")
        self.fs.move(self.path + ".tmp", self.path)
        return self.name, self.inputs, len(self.blocks), self.rows, size


def concat_files(inputs: list[tuple[str, int | None]], output: str) -> list[tuple[str, int, int, int, int]]:
    """Join `inputs` [(path, expected rows or None)] into `output`; a row of RESULT_SCHEMA per file.

    Schemas (names, types, nesting) must be equal to share a file. Statistics, encodings, codecs and
    dictionaries stay as they are. Sorting columns are kept with each row group. One input's footer is held at a
    time, of those before it the encoded entries of their blocks.
    """
    outputs: dict[str, _Output] = {}
    try:
        for path, expected in inputs:
            source_fs, p = _fs(path)
            size = source_fs.get_file_info(p).size
            if size is None:
                raise BlockCopyError(f"{path} is missing")
            with source_fs.open_input_file(p) as source:
                footer = read_footer(source, size)
                rows = sum(_get(g, 3) for g in _get(footer, 4)[1])
                if rows != _get(footer, 3) or expected is not None and rows != expected:
                    raise BlockCopyError(f"{path}: {rows} rows in blocks, {_get(footer, 3)} in the footer, {expected} in the plan")
                key = _schema_key(footer)
                if key not in outputs:
                    outputs[key] = _Output(output if not outputs else output.replace(".parquet", f"-s{len(outputs)}.parquet"), footer)
                outputs[key].add(source, footer)
        return [o.close() for o in outputs.values()]
    finally:
        for o in outputs.values():
            if not o.sink.closed:
                o.sink.close()
                o.fs.delete_file(o.path + ".tmp")


def concat_outputs(batches: Iterator) -> Iterator:
    """mapInArrow body: rows (output_path, inputs array<struct<path, row_count>>) to RESULT_SCHEMA."""
    import pyarrow as pa

    names = ["output_path", "inputs", "row_groups", "rows", "bytes"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        for job in batch.to_pylist():
            rows += concat_files([(x["path"], x["row_count"]) for x in job["inputs"]], job["output_path"])
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
