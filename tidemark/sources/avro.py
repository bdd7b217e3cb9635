"""Avro object containers as a Spark data source: ``spark.read.format("avro_container")``.

A container is a header (schema, codec, a marker of 16 random bytes) and blocks, each closed by the
marker. A file is read in ranges of ``splitBytes``: a task looks for the first marker at or after
the start of its range, and reads the blocks whose opening marker lies in it, so ranges need not
know of blocks. Rows go to Spark in Arrow batches, a block at a time.

Reading resolves schemas: fields go by name without regard to case, those that a file lacks are
null, numbers widen, a union takes the branch that is there. A block that can't be read (a marker,
a length or a record that doesn't fit, a broken codec stream) stops the job with the file and the
offset, unless ``badBlocks`` is ``skip``; then reading goes on at the next marker, and
``damaged`` lists what was skipped. Rows of a damaged block never come through.

Writing makes a file a task under a name of its own in ``_temporary``; the driver moves the files
of the tasks that were committed, so lost or repeated tasks leave nothing.

Files are reached through ``pyarrow.fs``: local paths and the schemes that it knows.
"""

from __future__ import annotations

import datetime
import decimal
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of the format.
MAGIC, MARKER = b"Obj\x01", 16
SPLIT = 32 << 20
#: Bytes of a block before it is closed.
BLOCK = 256 << 10
#: Rows of an Arrow batch.
BATCH = 5000
FORMAT = "avro_container"
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
_DAY = datetime.date(1970, 1, 1)


class Damaged(ValueError):
    """A block that can't be read."""

    def __init__(self, path: str, offset: int, why: str):
        super().__init__(f"{path}, block at byte {offset}: {why}")
        self.path, self.offset, self.why = path, offset, why


# Schemas


def avro_schema(kind: T.DataType, name: str = "row") -> Any:
    """The Avro schema of a Spark type; records are named by where they stand."""
    simple = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}
    if type(kind) in simple:
        return simple[type(kind)]
    if isinstance(kind, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(kind, T.TimestampType):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _nullable(avro_schema(kind.elementType, f"{name}_item"), kind.containsNull)}
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return {"type": "map", "values": _nullable(avro_schema(kind.valueType, f"{name}_value"), kind.valueContainsNull)}
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": _nullable(avro_schema(f.dataType, f"{name}_{f.name}"), f.nullable)} for f in kind]}
    raise TypeError(f"Avro has no type for {kind.simpleString()}")


def _nullable(schema: Any, is_nullable: bool) -> Any:
    return ["null", schema] if is_nullable else schema


def spark_type(schema: Any, names: dict[str, Any] | None = None) -> T.DataType:
    """The Spark type of an Avro schema; a union of several types besides null is a struct with a field for each."""
    names = {} if names is None else names
    kind, logical = _kind(schema, names)
    if logical == "date":
        return T.DateType()
    if logical in ("timestamp-micros", "timestamp-millis"):
        return T.TimestampType()
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    simple = {"null": T.NullType, "boolean": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "bytes": T.BinaryType, "fixed": T.BinaryType, "string": T.StringType, "enum": T.StringType}
    if kind in simple:
        return simple[kind]()
    if kind == "union":
        branches = [b for b in schema if _kind(b, names)[0] != "null"]
        if len(branches) == 1:
            return spark_type(branches[0], names)
        return T.StructType([T.StructField(f"member{i}", spark_type(b, names)) for i, b in enumerate(branches)])
    schema = names.get(schema, schema) if isinstance(schema, str) else schema
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"], names))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"], names))
    return T.StructType([T.StructField(f["name"], spark_type(f["type"], names)) for f in schema["fields"]])


def _kind(schema: Any, names: dict[str, Any]) -> tuple[str, str | None]:
    """The kind of a schema and its logical type; named schemas are noted in ``names``."""
    if isinstance(schema, list):
        return "union", None
    if isinstance(schema, str):
        return _kind(names[schema], names) if schema in names else (schema, None)
    kind = schema["type"]
    if isinstance(kind, (dict, list)):
        return _kind(kind, names)
    if kind in ("record", "enum", "fixed"):
        names[schema["name"]] = schema
        if "namespace" in schema:
            names[f"{schema['namespace']}.{schema['name']}"] = schema
    return kind, schema.get("logicalType")


# Decoding: every reader takes the bytes and a place, and gives a value and the place after it

Reader = Callable[[bytes, int], tuple[Any, int]]


def _long(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = b[i]
        i += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return (value >> 1) ^ -(value & 1), i
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def _raw(b: bytes, i: int) -> tuple[bytes, int]:
    n, i = _long(b, i)
    if n < 0 or i + n > len(b):
        raise ValueError("a length beyond the block")
    return b[i : i + n], i + n


def _text(b: bytes, i: int) -> tuple[str, int]:
    raw, i = _raw(b, i)
    return raw.decode("utf-8"), i


def _fixed(n: int) -> Reader:
    def read(b, i):
        if i + n > len(b):
            raise ValueError("a value beyond the block")
        return b[i : i + n], i + n

    return read


def _unpacked(fmt: str, n: int) -> Reader:
    return lambda b, i: (struct.unpack_from(fmt, b, i)[0], i + n)


_PLAIN: dict[str, Reader] = {"null": lambda b, i: (None, i), "boolean": lambda b, i: (b[i] == 1, i + 1), "int": _long, "long": _long, "float": _unpacked("<f", 4), "double": _unpacked("<d", 8), "bytes": _raw, "string": _text}


def _blocks_of(item: Callable[[bytes, int, Any], int], make: Callable[[], Any]) -> Reader:
    """Arrays and maps: counted runs of items, up to an empty one; a negative count has a size after it."""

    def read(b, i):
        out = make()
        while True:
            n, i = _long(b, i)
            if n == 0:
                return out, i
            if n < 0:
                n, (_, i) = -n, _long(b, i)
            for _ in range(n):
                i = item(b, i, out)

    return read


def _then(read: Reader, turn: Callable[[Any], Any]) -> Reader:
    def both(b, i):
        v, i = read(b, i)
        return (None if v is None else turn(v)), i

    return both


def decoder(schema: Any, want: T.DataType | None, names: dict[str, Any] | None = None) -> Reader:
    """A reader of data written by ``schema`` that gives values of the Spark type ``want``; None reads past them."""
    names = {} if names is None else names
    kind, logical = _kind(schema, names)
    if isinstance(schema, str) and schema in names:
        schema = names[schema]
    elif isinstance(schema, dict) and isinstance(schema["type"], (dict, list)):
        return decoder(schema["type"], want, names)
    if kind == "union":
        return _union(schema, want, names)
    if kind == "record":
        return _record(schema, want, names)
    if kind == "array":
        item = _later(schema["items"], want.elementType if isinstance(want, T.ArrayType) else None, names)

        def add(b, i, out):
            v, i = item(b, i)
            out.append(v)
            return i

        return _fit(_blocks_of(add, list), want, T.ArrayType, kind)
    if kind == "map":
        value = _later(schema["values"], want.valueType if isinstance(want, T.MapType) else None, names)

        def put(b, i, out):
            k, i = _text(b, i)
            out[k], i = value(b, i)
            return i

        return _fit(_blocks_of(put, dict), want, T.MapType, kind)
    if kind == "enum":
        symbols = schema["symbols"]
        return _scalar(_then(_long, lambda k: symbols[k]), "string", None, schema, want)
    return _scalar(_fixed(schema["size"]) if kind == "fixed" else _PLAIN[kind], "bytes" if kind == "fixed" else kind, logical, schema, want)


def _later(schema: Any, want: T.DataType | None, names: dict[str, Any]) -> Reader:
    """A reader made when it is first used, so that a schema may hold itself."""
    made: list[Reader] = []

    def read(b, i):
        if not made:
            made.append(decoder(schema, want, names))
        return made[0](b, i)

    return read


def _fit(read: Reader, want: T.DataType | None, kind: type, name: str) -> Reader:
    if want is not None and not isinstance(want, kind):
        raise TypeError(f"{name} can't be read as {want.simpleString()}")
    return read


def _union(schema: list, want: T.DataType | None, names: dict[str, Any]) -> Reader:
    several = [i for i, s in enumerate(schema) if _kind(s, names)[0] != "null"]
    as_struct = len(several) > 1 and isinstance(want, T.StructType) and [f.name for f in want] == [f"member{k}" for k in range(len(several))]
    readers: list[Reader] = []
    for i, s in enumerate(schema):
        if i not in several:
            readers.append(_PLAIN["null"])
        elif as_struct:
            k = several.index(i)
            readers.append(_then(_later(s, want[k].dataType, names), lambda v, k=k: {f"member{k}": v}))
        else:
            readers.append(_later(s, want, names))

    def read(b, i):
        k, i = _long(b, i)
        if not 0 <= k < len(readers):
            raise ValueError("a union without such a branch")
        return readers[k](b, i)

    return read


def _record(schema: dict, want: T.DataType | None, names: dict[str, Any]) -> Reader:
    _fit(_long, want, T.StructType, "record")
    wanted = {f.name.lower(): f for f in want} if want is not None else {}
    parts = [(wanted[n].name if (n := f["name"].lower()) in wanted else None, _later(f["type"], wanted[n].dataType if n in wanted else None, names)) for f in schema["fields"]]

    def read(b, i):
        out = {}
        for name, part in parts:
            v, i = part(b, i)
            if name is not None:
                out[name] = v
        return out, i

    return read


def _scalar(read: Reader, kind: str, logical: str | None, schema: Any, want: T.DataType | None) -> Reader:
    if want is None:
        return read
    if logical == "decimal" and isinstance(want, T.DecimalType):
        scale = decimal.Decimal(1).scaleb(-schema.get("scale", 0))
        return _then(read, lambda v: decimal.Decimal(int.from_bytes(v, "big", signed=True)) * scale)
    if isinstance(want, T.DateType) and kind == "int":
        return _then(read, lambda v: _DAY + datetime.timedelta(days=v))
    if isinstance(want, T.TimestampType) and kind == "long":
        unit = 1000 if logical == "timestamp-millis" else 1
        return _then(read, lambda v: _EPOCH + datetime.timedelta(microseconds=v * unit))
    numbers = ("int", "long", "float", "double")
    if isinstance(want, T.StringType):
        turn = {"string": None, "bytes": lambda v: v.decode("utf-8"), "boolean": lambda v: str(v).lower()}.get(kind, str)
        return read if turn is None else _then(read, turn)
    if isinstance(want, T.BinaryType) and kind in ("bytes", "string"):
        return read if kind == "bytes" else _then(read, lambda v: v.encode())
    if isinstance(want, T.BooleanType) and kind == "boolean" or isinstance(want, T.NullType):
        return read
    if isinstance(want, (T.DoubleType, T.FloatType)) and kind in numbers:
        return _then(read, float)
    if isinstance(want, T.LongType) and kind in ("int", "long") or isinstance(want, (T.IntegerType, T.ShortType, T.ByteType)) and kind == "int":
        return read
    raise TypeError(f"{kind} can't be read as {want.simpleString()}")


# Encoding: every writer adds a value's bytes to a buffer

Writer = Callable[[bytearray, Any], None]


def _put_long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _put_raw(out: bytearray, v: bytes) -> None:
    _put_long(out, len(v))
    out += v


def encoder(schema: Any) -> Writer:
    """A writer of values as Spark gives them to Python, by a schema of ``avro_schema``."""
    if isinstance(schema, list):
        inner = encoder(schema[1])

        def optional(out, v):
            out.append(0 if v is None else 2)
            if v is not None:
                inner(out, v)

        return optional
    if isinstance(schema, str):
        return {
            "boolean": lambda out, v: out.append(1 if v else 0),
            "int": _put_long,
            "long": _put_long,
            "float": lambda out, v: out.extend(struct.pack("<f", v)),
            "double": lambda out, v: out.extend(struct.pack("<d", v)),
            "string": lambda out, v: _put_raw(out, v.encode("utf-8")),
            "bytes": _put_raw,
        }[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if logical == "date":
        return lambda out, v: _put_long(out, (v - _DAY).days)
    if logical == "timestamp-micros":
        return lambda out, v: _put_long(out, (v.astimezone(datetime.timezone.utc) - _EPOCH) // datetime.timedelta(microseconds=1))
    if logical == "decimal":

        def put_decimal(out, v):
            n = int(v.scaleb(schema["scale"]))
            _put_raw(out, n.to_bytes((n.bit_length() + 8) // 8, "big", signed=True))

        return put_decimal
    if kind == "array":
        item = encoder(schema["items"])

        def put_array(out, v):
            if v:
                _put_long(out, len(v))
                for x in v:
                    item(out, x)
            out.append(0)

        return put_array
    if kind == "map":
        value = encoder(schema["values"])

        def put_map(out, v):
            if v:
                _put_long(out, len(v))
                for k, x in v.items():
                    _put_raw(out, k.encode("utf-8"))
                    value(out, x)
            out.append(0)

        return put_map
    fields = [encoder(f["type"]) for f in schema["fields"]]

    def put_record(out, v):
        for put, x in zip(fields, v, strict=True):
            put(out, x)

    return put_record


# Containers


def _codec(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    if name == "null":
        return bytes, bytes
    if name == "deflate":
        return lambda b: zlib.compress(b, 6, -15), lambda b: zlib.decompress(b, -15)
    if name == "zstandard":
        import zstandard

        return lambda b: zstandard.ZstdCompressor().compress(b), lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)
    if name in ("bzip2", "xz"):
        import bz2
        import lzma

        return {"bzip2": (bz2.compress, bz2.decompress), "xz": (lzma.compress, lzma.decompress)}[name]
    raise ValueError(f"codec {name} is not supported")


def header(schema: Any, codec: str, marker: bytes) -> bytes:
    out = bytearray(MAGIC)
    _put_long(out, 2)
    for k, v in (("avro.schema", json.dumps(schema).encode()), ("avro.codec", codec.encode())):
        _put_raw(out, k.encode())
        _put_raw(out, v)
    out.append(0)
    return bytes(out + marker)


@dataclass
class Header:
    schema: Any
    codec: str
    marker: bytes
    end: int


def read_header(f: BinaryIO, path: str) -> Header:
    size = 64 << 10
    while True:
        f.seek(0)
        b = f.read(size)
        try:
            if b[:4] != MAGIC:
                raise Damaged(path, 0, "not an Avro container")
            meta, i = _blocks_of(lambda b, i, out: _pair(b, i, out), dict)(b, 4)
            if i + MARKER > len(b):
                raise IndexError
            return Header(json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), b[i : i + MARKER], i + MARKER)
        except (IndexError, ValueError) as e:  # the header may be longer than what was read
            if isinstance(e, Damaged) or len(b) < size:
                raise e if isinstance(e, Damaged) else Damaged(path, 0, "a broken header") from e
            size *= 8


def _pair(b: bytes, i: int, out: dict) -> int:
    k, i = _text(b, i)
    out[k], i = _raw(b, i)
    return i


def _next_marker(f: BinaryIO, marker: bytes, at: int) -> int | None:
    """Where the marker next stands at or after ``at``."""
    f.seek(at)
    held, base = b"", at
    while chunk := f.read(1 << 20):
        held += chunk
        k = held.find(marker)
        if k >= 0:
            return base + k
        base += max(0, len(held) - MARKER + 1)
        held = held[-MARKER + 1 :]
    return None


def read_blocks(f: BinaryIO, path: str, start: int, end: int, want: T.StructType | None, skip: Callable[[Damaged], None] | None = None) -> Iterator[tuple[int, list]]:
    """``(offset, values)`` of the blocks whose opening marker lies in [start, end); ``skip`` is told of damaged ones."""
    try:
        head = read_header(f, path)
        read, (_, unpack) = decoder(head.schema, want), _codec(head.codec)
    except Damaged as e:
        if skip is None:
            raise
        if start == 0:
            skip(e)
        return
    total = f.seek(0, 2)
    at = head.end - MARKER if start <= head.end - MARKER else _next_marker(f, head.marker, start)
    while at is not None and at < end:
        offset = at + MARKER
        f.seek(offset)
        lead = f.read(20)
        if not lead:
            return
        try:
            try:
                count, i = _long(lead, 0)
                size, i = _long(lead, i)
                if count < 0 or not 0 <= size <= total - offset - i:
                    raise ValueError("a length that the file doesn't have")
                f.seek(offset + i)
                body = f.read(size + MARKER)
                if body[size:] != head.marker:
                    raise ValueError("no marker where the block should end")
                data, place, rows = unpack(body[:size]), 0, []
                for _ in range(count):
                    row, place = read(data, place)
                    rows.append(row)
                if place != len(data):
                    raise ValueError("bytes are left over")
            except (ValueError, IndexError, struct.error, zlib.error, OverflowError) as e:
                raise Damaged(path, offset, str(e) or type(e).__name__) from e
        except Damaged as e:
            if skip is None:
                raise
            skip(e)
            at = _next_marker(f, head.marker, offset)
            continue
        yield offset, rows
        at = offset + i + size


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str) -> list[pa.fs.FileInfo]:
    fs, at = _filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [info]
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[0] in "_." for x in p[len(at) :].strip("/").split("/"))
    return sorted((x for x in found if x.type == pa.fs.FileType.File and not hidden(x.path)), key=lambda x: x.path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.root, self.schema = options["path"], schema
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.skip = (options.get("badblocks") or options.get("badBlocks") or "fail") == "skip"
        self.report = options.get("report") == "true"

    def partitions(self) -> list[Range]:
        return [Range(f.path, a, min(a + self.split, f.size)) for f in _files(self.root) for a in range(0, max(f.size, 1), self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.root)
        bad: list[Damaged] = []
        arrow = to_arrow_schema(self.schema)
        with fs.open_input_file(part.path) as f:
            for _, rows in read_blocks(f, part.path, part.start, part.end, None if self.report else self.schema, bad.append if self.skip or self.report else None):
                for k in range(0, 0 if self.report else len(rows), BATCH):
                    yield pa.RecordBatch.from_pylist(rows[k : k + BATCH], schema=arrow)
        if self.report:
            yield pa.RecordBatch.from_pylist([{"path": e.path, "offset": e.offset, "why": e.why} for e in bad], schema=arrow)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.schema, self.codec = avro_schema(schema, options.get("recordName") or options.get("recordname") or "row"), options.get("codec", "deflate")
        self.block = int(options.get("blockbytes", options.get("blockBytes", BLOCK)))

    def write(self, rows: Iterator[Row]) -> _Written:
        fs, root = _filesystem(self.root)
        put, (pack, _), marker = encoder(self.schema), _codec(self.codec), os.urandom(MARKER)
        name, out, n = f"part-{uuid.uuid4().hex}.avro", bytearray(), 0
        f = None

        def close_block() -> None:
            data = pack(bytes(out))
            lead = bytearray()
            _put_long(lead, n)
            _put_long(lead, len(data))
            f.write(bytes(lead) + data + marker)

        for row in rows:
            if f is None:
                fs.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
                f = fs.open_output_stream(f"{root}/_temporary/{self.job}/{name}")
                f.write(header(self.schema, self.codec, marker))
            put(out, row)
            n += 1
            if len(out) >= self.block:
                close_block()
                out, n = bytearray(), 0
        if f is None:
            return _Written(None)
        if n:
            close_block()
        f.close()
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _filesystem(self.root)
        old = [f.path for f in _files(self.root)] if self.overwrite and fs.get_file_info(root).type != pa.fs.FileType.NotFound else []
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.name is not None:
                fs.move(f"{root}/_temporary/{self.job}/{m.name}", f"{root}/{m.name}")
        for path in old:
            fs.delete_file(path)
        names = [m.name for m in messages if m is not None and m.name is not None]
        if not names:  # a table without rows still has a schema
            with fs.open_output_stream(f"{root}/part-{uuid.uuid4().hex}.avro") as f:
                f.write(header(self.schema, self.codec, os.urandom(MARKER)))
        self._clear(fs, root)
        fs.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_filesystem(self.root))

    def _clear(self, fs: pa.fs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_temporary/{self.job}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary/{self.job}")
        rest = fs.get_file_info(pa.fs.FileSelector(f"{root}/_temporary", allow_not_found=True))
        if not rest and fs.get_file_info(f"{root}/_temporary").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")


class AvroContainer(DataSource):
    """Options: path, splitBytes, badBlocks (fail, skip); to write, codec, blockBytes and recordName."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Avro files below {self.options['path']}")
        fs, _ = _filesystem(self.options["path"])
        with fs.open_input_file(files[0].path) as f:
            kind = spark_type(read_header(f, files[0].path).schema)
        return kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("value", kind)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """The records of the containers below a path, by their own schema or resolved to ``schema`` (SC8, SC9)."""
    spark.dataSource.register(AvroContainer)
    r = spark.read.format(FORMAT).options(**options)
    return (r if schema is None else r.schema(schema)).load(path)


def write(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Rows as containers, a file a task (SK4)."""
    df.sparkSession.dataSource.register(AvroContainer)
    df.write.format(FORMAT).mode(mode).options(**options).save(path)


def damaged(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``path, offset, why`` of each block that can't be read."""
    shape = T.StructType([T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("why", T.StringType())])
    return read(spark, path, shape, report="true", **options)


def from_binary(df: DataFrame, content: str, schema: T.StructType, name: str | None = None) -> DataFrame:
    """The records of containers that a binary column holds, as archive members do (SC10); ``name`` is a column for error texts."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(1).to_pylist(), batch.column(0)):
                if raw.is_valid:
                    data = raw.as_py()
                    for _, rows in read_blocks(io.BytesIO(data), path or "a column", 0, len(data), schema):
                        for k in range(0, len(rows), BATCH):
                            yield pa.RecordBatch.from_pylist(rows[k : k + BATCH], schema=arrow)

    return df.select(content, (F.col(name) if name else F.lit(None)).cast("string").alias("name")).mapInArrow(run, schema)
