"""Search results as a zip archive that no single process holds (SK6).

Each task writes its rows as CSV, deflated, to a file of its own: a run of deflate blocks that ends on a
whole byte, so that runs laid end to end are one stream. The driver sees a row a task, with the run's
sizes and checksum; checksums of runs combine by arithmetic. From these it writes the archive's head, and
its end with the directory. Head, runs and end, one after another, are an archive with one member; it is
in 64-bit form, so it may have any size. ``join`` copies them into one file, a block at a time.
"""

from __future__ import annotations

import csv
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from tidemark.sources.avro import _filesystem

#: Bytes of CSV that are deflated at once.
BLOCK = 1 << 20
#: Fixed value: a last, empty deflate block, which ends the stream.
_END = b"\x03\x00"
_POLY = 0xEDB88320
_RUN = pa.schema([("part", pa.int32()), ("name", pa.string()), ("crc", pa.int64()), ("size", pa.int64()), ("packed", pa.int64())])


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2), modulo that of CRC-32, bits reversed."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
        bit >>= 1
    return out


def crc_of_both(first: int, second: int, second_length: int) -> int:
    """The CRC-32 of two texts, one after the other, from the CRC-32 of each and the length of the second."""
    power, square, n = 1 << 31, 1 << 23, second_length  # 1, and x to the 8th: a byte
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


def _texts(df: DataFrame) -> tuple[list[str], DataFrame]:
    names = ["imageURL"] * ("imageURL" in df.columns) + sorted(c for c in df.columns if c != "imageURL")
    return names, df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names))


def _line(values: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerow(values)
    return out.getvalue()


def write_zip(df: DataFrame, path: str, member: str = "images.csv") -> list[str]:
    """Write ``df`` below ``path`` as the files of an archive; their names, in the order in which they make it up.

    Columns are those of a download: imageURL first, the others by name, nulls as empty. Rows come in the order of the
    frame's partitions. Files of tasks that ran again are left out of the names.
    """
    names, rows = _texts(df)
    job = uuid.uuid4().hex
    fs, root = _filesystem(path)
    fs.create_dir(root, recursive=True)
    head = _line(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(path)
        name, deflate = f"run-{job}-{uuid.uuid4().hex}", zlib.compressobj(6, zlib.DEFLATED, -15)
        part, crc, size, packed, out = None, 0, 0, 0, None
        for batch in batches:
            numbers = batch.column(0)
            if not len(numbers):
                continue
            if out is None:
                part, out = numbers[0].as_py(), fs.open_output_stream(f"{root}/{name}")
            lines, held = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                lines.append(_line(list(row)))
                held += len(lines[-1])
                if held >= BLOCK:
                    data, lines, held = "".join(lines).encode(), [], 0
                    crc, size = zlib.crc32(data, crc), size + len(data)
                    packed += out.write(deflate.compress(data))
            data = "".join(lines).encode()
            crc, size = zlib.crc32(data, crc), size + len(data)
            packed += out.write(deflate.compress(data))
        if out is None:
            return
        packed += out.write(deflate.flush(zlib.Z_FULL_FLUSH))
        out.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "crc": crc, "size": size, "packed": packed}], schema=_RUN)

    runs = rows.select(F.spark_partition_id().alias("__part"), *names).mapInArrow(run, "part int, name string, crc long, size long, packed long").orderBy("part").collect()  # a row a task
    first = head.encode()
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    lead = deflate.compress(first) + deflate.flush(zlib.Z_FULL_FLUSH)
    crc, size, packed = zlib.crc32(first), len(first), len(lead) + len(_END)
    for r in runs:
        crc, size, packed = crc_of_both(crc, r.crc, r.size), size + r.size, packed + r.packed
    local = _local(member, crc, size, packed)
    files = [f"head-{job}", *(r.name for r in runs), f"end-{job}"]
    for name, data in ((files[0], local + lead), (files[-1], _END + _directory(member, crc, size, packed, len(local) + packed))):
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(data)
    return files


#: Fixed values of the format: versions, the flag of UTF-8 names, deflate, 1 January 1980, and markers of 64-bit sizes.
_VERSION, _UTF8, _DEFLATE, _DATE, _WIDE = 45, 1 << 11, 8, (1 << 5) | 1, 0xFFFFFFFF


def _local(member: str, crc: int, size: int, packed: int) -> bytes:
    name, extra = member.encode(), struct.pack("<HHQQ", 1, 16, size, packed)
    return struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", _VERSION, _UTF8, _DEFLATE, 0, _DATE, crc, _WIDE, _WIDE, len(name), len(extra)) + name + extra


def _directory(member: str, crc: int, size: int, packed: int, at: int) -> bytes:
    name, extra = member.encode(), struct.pack("<HHQQQ", 1, 24, size, packed, 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", _VERSION, _VERSION, _UTF8, _DEFLATE, 0, _DATE, crc, _WIDE, _WIDE, len(name), len(extra), 0, 0, 0, 0, _WIDE) + name + extra
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, _VERSION, _VERSION, 0, 0, 1, 1, len(entry), at)
    place = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    return entry + wide + place + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, len(entry), _WIDE, 0)


def join(path: str, files: list[str], out: str) -> None:
    """Copy the files of an archive into one."""
    fs, root = _filesystem(path)
    to, at = _filesystem(out)
    with to.open_output_stream(at) as f:
        for name in files:
            with fs.open_input_stream(f"{root}/{name}") as g:
                while block := g.read(1 << 20):
                    f.write(block)
