"""Arrow IPC (feather) files of events as a Spark data source.

A file may be one huge record batch. A partition is a range of its rows: only the wanted columns are opened, and of each only
the range is kept. Columns that are not compressed are read from their place; a compressed column is decompressed as a
stream, of which what stands before the range is passed over, so a task never holds a column, let alone a batch. The schema
given to the reader names the columns; `event_seq` among them is the row number in file order, files numbered as they are listed.

Columns are numbers of fixed width, as all event columns are; others may stand between them but can't be read.
"""

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import SEQ

FORMAT = "arrow_events"
ROWS_PER_TASK = 4_000_000
ROWS_PER_BATCH = 256_000
FILE_STRIDE = 1 << 40
_CHUNK = 4 << 20
_CODECS = {0: "lz4", 1: "zstd"}


def opened(path):
    """A file on any file system, to be read from any place."""
    if "://" in path or path.startswith("file:"):
        store, name = pa_fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return pa.OSFile(path, "rb")


class _Table:
    """A table of the file's metadata: fields by number, each a place in `data` or 0 if it is left out."""

    def __init__(self, data, at):
        self.data, self.at = data, at
        self.fields = at - struct.unpack_from("<i", data, at)[0]

    def place(self, number):
        size = struct.unpack_from("<H", self.data, self.fields)[0]
        offset = struct.unpack_from("<H", self.data, self.fields + 4 + 2 * number)[0] if 4 + 2 * number < size else 0
        return self.at + offset if offset else 0

    def number(self, number, kind, default=0):
        at = self.place(number)
        return struct.unpack_from(kind, self.data, at)[0] if at else default

    def below(self, number):
        at = self.place(number)
        return at + struct.unpack_from("<I", self.data, at)[0] if at else 0

    def table(self, number):
        at = self.below(number)
        return _Table(self.data, at) if at else None

    def structs(self, number, kind):
        at = self.below(number)
        count = struct.unpack_from("<I", self.data, at)[0] if at else 0
        return [struct.unpack_from(kind, self.data, at + 4 + k * struct.calcsize(kind)) for k in range(count)]


def _root(data):
    return _Table(data, struct.unpack_from("<I", data)[0])


def _at(source, place, size):
    source.seek(place)
    return source.read(size)


def record_batches(source):
    """(rows, body place, nodes (rows, nulls), buffers (offset, size), codec or None) of each record batch."""
    size = source.size()
    length, magic = struct.unpack("<i6s", _at(source, size - 10, 10))
    if magic != b"ARROW1":
        raise ValueError("not an Arrow file")
    out = []
    for place, head, _, _ in _root(_at(source, size - 10 - length, length)).structs(3, "<qiiq"):
        data = _at(source, place, head)
        message = _root(data[8:] if data[:4] == b"\xff\xff\xff\xff" else data[4:])
        batch = message.table(2)
        packed = batch.table(3)
        codec = _CODECS[packed.number(0, "<b")] if packed else None
        out.append((batch.number(0, "<q"), place + head, batch.structs(1, "<qq"), batch.structs(2, "<qq"), codec))
    return out


def _buffers(kind):
    """Number of buffers of a column in a record batch."""
    if pa.types.is_nested(kind) or pa.types.is_dictionary(kind):
        raise ValueError(f"columns of type {kind} can't stand in an event file")
    return 3 if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else 2


def columns_at(schema, names):
    """name -> (number of its node, number of its first buffer, numpy type)."""
    out, buffer = {}, 0
    for k, field in enumerate(schema):
        if field.name in names:
            if not (pa.types.is_integer(field.type) or pa.types.is_floating(field.type)):
                raise ValueError(f"column {field.name} is no number")
            out[field.name] = (k, buffer, np.dtype(field.type.to_pandas_dtype()))
        buffer += _buffers(field.type)
    if missing := set(names) - set(out):
        raise ValueError(f"no columns {sorted(missing)}")
    return out


class _Part:
    """Bytes of one buffer, read forward from `start`; what comes before is passed over."""

    def __init__(self, source, place, size, codec, start):
        self.source, self.place, self.end = source, place, place + size
        if codec and size and (whole := struct.unpack("<q", _at(source, place, 8))[0]) >= 0:
            del whole
            self.stream = pa.CompressedInputStream(pa.PythonFile(_Window(source, place + 8, place + size), "r"), codec)
            while start:
                start -= len(self.stream.read(min(start, _CHUNK)))
        else:
            self.stream = None
            self.place += start + (8 if codec and size else 0)  # -1 stands before a buffer that packing would not shorten

    def read(self, size):
        if self.stream is None:
            out = _at(self.source, self.place, size)
            self.place += size
            return out
        out = bytearray()
        while len(out) < size:
            got = self.stream.read(min(size - len(out), _CHUNK))
            if not got:
                raise ValueError("a column ends too early")
            out += got
        return bytes(out)


class _Window:
    """A span of a file as a file of its own, for the decompressor."""

    closed = False

    def __init__(self, source, start, stop):
        self.source, self.at, self.stop = source, start, stop

    def read(self, size=-1):
        size = self.stop - self.at if size is None or size < 0 else min(size, self.stop - self.at)
        out = _at(self.source, self.at, size)
        self.at += len(out)
        return out

    def readable(self):
        return True

    def close(self):
        self.closed = True


def rows_of(path, batch, start, stop, names, step=ROWS_PER_BATCH):
    """Arrow arrays by name of the rows start .. stop of one record batch, in steps of `step` rows."""
    with opened(path) as source:
        source.seek(0)
        schema = pa.ipc.open_file(source).schema
        rows, body, nodes, buffers, codec = record_batches(source)[batch]
        start8 = start - start % 8  # validity has a bit per row
        parts = {}
        for name, (node, buffer, kind) in columns_at(schema, names).items():
            part = lambda k, at: _Part(source, body + buffers[k][0], buffers[k][1], codec, at)  # noqa: B023, E731
            valid = part(buffer, start8 // 8) if nodes[node][1] else None
            parts[name] = (valid, part(buffer + 1, start8 * kind.itemsize), kind, schema.field(name).type)
        for a in range(start8, stop, step):
            n = min(step, stop - a)
            out = {}
            for name, (valid, data, kind, arrow) in parts.items():
                bits = pa.py_buffer(valid.read(-(-n // 8))) if valid else None
                out[name] = pa.Array.from_buffers(arrow, n, [bits, pa.py_buffer(data.read(n * kind.itemsize))])
            cut = max(0, start - a)
            yield a + cut, {name: x.slice(cut) for name, x in out.items()}


class Rows(InputPartition):
    def __init__(self, file, path, batch, start, stop, before):
        self.file, self.path, self.batch, self.start, self.stop, self.before = file, path, batch, start, stop, before


class _Reader(DataSourceReader):
    def __init__(self, schema, files, rows):
        self.schema, self.files, self.rows = schema, files, rows

    def partitions(self):
        out = []
        for file, path in enumerate(self.files):
            before = 0
            with opened(path) as source:
                for batch, (n, *_) in enumerate(record_batches(source)):
                    parts = max(1, -(-n // self.rows))
                    edges = [n * k // parts for k in range(parts + 1)]
                    out += [Rows(file, path, batch, a, b, before) for a, b in zip(edges, edges[1:]) if a < b]
                    before += n
        return out

    def read(self, part):
        if part is None:  # Spark asks for one empty partition where there is none
            return
        arrow = to_arrow_schema(self.schema)
        names = [f.name for f in self.schema.fields if f.name != SEQ]
        for at, columns in rows_of(part.path, part.batch, part.start, part.stop, names):
            n = len(next(iter(columns.values())))
            first = part.file * FILE_STRIDE + part.before + at
            columns = {name: x.cast(arrow.field(name).type) for name, x in columns.items()} | {SEQ: pa.array(np.arange(first, first + n), pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in self.schema.fields], schema=arrow)


class ArrowEvents(DataSource):
    """Options: files (JSON list of paths), rowsPerTask. The schema is the user's."""

    @classmethod
    def name(cls):
        return FORMAT

    def reader(self, schema):
        rows = int(self.options.get("rowsPerTask", ROWS_PER_TASK))
        return _Reader(schema, json.loads(self.options["files"]), rows)


def read_arrow(spark, files, schema, rows_per_task=ROWS_PER_TASK):
    """DataFrame of the columns of `schema` and `event_seq`; a task reads up to `rows_per_task` rows of one record batch."""
    spark.dataSource.register(ArrowEvents)
    whole = schema if SEQ in schema.fieldNames() else T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])
    return spark.read.format(FORMAT).schema(whole).option("files", json.dumps(list(files))).option("rowsPerTask", rows_per_task).load()
