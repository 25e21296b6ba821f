"""Chunked array stores (Zarr, format 2 and 3 for reading, 2 for writing) as a source and a sink of grids.

Two data sources do the work. `zarr-element` reads one element: tasks are planned from the chunk grid, filters on rows and
columns leave chunks and, within a compressed sparse matrix, rows out, and a task holds a chunk at a time. `zarr-chunks`
writes one array: every chunk is made by one task, and an array comes into being when the commit writes its metadata; an
abort deletes the chunks that tasks report. Chunks have fixed places and contents, so a task that runs again writes the same.

Layout of a store: groups obs and var (a column an array; labels under `_index`), X and layers/<k> (dense arrays, or groups of
data, indices and indptr), obsm/<k>, varm/<k> (arrays), obsp/<k>, varp/<k> (sparse groups), uns (scalars, lists, groups). The
root's metadata is written last.

Files are reached through pyarrow's file systems, from driver and executors alike: shared mounts, HDFS, object stores.
Codecs: none, zlib, gzip, bz2, lzma, zstd; others raise. Positions are the keys of a grid that is read. Null numbers and labels
are kept by masks, null floats become NaN; dates and times become text.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.window import Window

from gridlake.operators.axis import KEY, NAME, ORD, Axis, Categories, with_positions
from gridlake.operators.dictionary import Dictionary
from gridlake.operators.element import Aligned, Matrix, Pairs
from gridlake.operators.grid import Grid
from gridlake.session import materialise, settings

#: Values of a 1-D chunk, and of a dense chunk of rows.
CHUNK = 1 << 16
#: Tasks of one scan at most; beyond that a task reads several neighbouring chunks.
TASKS = 20_000
TYPES = {"double": "<f8", "float": "<f4", "bigint": "<i8", "int": "<i4", "smallint": "<i2", "tinyint": "|i1", "boolean": "|b1"}
#: Encoding words of the layout (fixed values of the format).
SPARSE = {"csr_matrix", "csc_matrix"}
NULLABLE = {"nullable-integer", "nullable-boolean", "nullable-string-array"}


class Store:
    """Named bytes under a folder."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            path = "/" + path.removeprefix("file:").lstrip("/")
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def get(self, name: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, name: str, data: bytes) -> None:
        where = f"{self.root}/{name}"
        self.fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(where) as f:
            f.write(data)

    def delete(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.File:
            self.fs.delete_file(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == pafs.FileType.Directory)

    def attributes(self, name: str) -> dict:
        old, new = self.get(f"{name}/.zattrs"), self.get(f"{name}/zarr.json")
        return json.loads(old) if old else json.loads(new).get("attributes", {}) if new else {}


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _to_zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


DECODE = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": _zstd}
ENCODE = {"zlib": zlib.compress, "gzip": lambda b: gzip.compress(b, mtime=0), "bz2": bz2.compress, "lzma": lzma.compress, "zstd": _to_zstd}


def unpacked(data: bytes) -> list[str]:
    """Strings behind their count, each behind its size."""
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", data)[0]):
        n = struct.unpack_from("<I", data, at)[0]
        out.append(data[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return out


def packed(values: list[str]) -> bytes:
    raw = [v.encode() for v in values]
    return struct.pack("<I", len(raw)) + b"".join(struct.pack("<I", len(v)) + v for v in raw)


@dataclass(frozen=True)
class Array:
    """An array's metadata."""

    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str  # numpy's, or O for strings
    codec: str | None = "zstd"
    fill: Any = 0
    order: str = "C"
    join: str = "."
    under: str = ""
    attrs: dict = field(default_factory=dict, hash=False, compare=False)

    @staticmethod
    def load(store: Store, name: str) -> Array | None:
        raw = store.get(f"{name}/.zarray")
        if raw:
            m = json.loads(raw)
            text = any(f["id"] == "vlen-utf8" for f in m.get("filters") or [])
            other = [f["id"] for f in m.get("filters") or [] if f["id"] != "vlen-utf8"]
            codec = m["compressor"] and m["compressor"]["id"]
            a = Array(name, tuple(m["shape"]), tuple(m["chunks"]), "O" if text else m["dtype"], codec, m["fill_value"], m["order"], m.get("dimension_separator", "."), "", store.attributes(name))
        else:
            raw = store.get(f"{name}/zarr.json")
            m = json.loads(raw) if raw else {}
            if m.get("node_type") != "array":
                return None
            ids = [c["name"] for c in m["codecs"]]
            text = "vlen-utf8" in ids
            rest = [i for i in ids if i not in ("bytes", "vlen-utf8")]
            other, codec = rest[1:], rest[0] if rest else None
            sep = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
            big = any(c.get("configuration", {}).get("endian") == "big" for c in m["codecs"])
            kind = "O" if text else np.dtype(m["data_type"] if m["data_type"] != "bool" else "?").newbyteorder(">" if big else "<").str
            shape = tuple(m["shape"])
            a = Array(name, shape, tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), kind, codec, m["fill_value"], "C", sep, "c" + (sep if shape else ""), m.get("attributes", {}))
        if other or a.codec not in (None, *DECODE):
            raise ValueError(f"{name}: no codec for {other or a.codec}")
        return a

    def metadata(self) -> bytes:
        return json.dumps({
            "zarr_format": 2, "shape": self.shape, "chunks": self.chunks, "dtype": "|O" if self.dtype == "O" else self.dtype, "order": "C", "fill_value": self.fill,
            "compressor": self.codec and {"id": self.codec}, "filters": [{"id": "vlen-utf8"}] if self.dtype == "O" else None}).encode()

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks))

    def key(self, *at: int) -> str:
        return f"{self.name}/{self.under}{self.join.join(map(str, at)) if at else '' if self.under else '0'}"

    def encoded(self, values) -> bytes:
        data = packed(values) if self.dtype == "O" else np.ascontiguousarray(values, self.dtype).tobytes()
        return ENCODE[self.codec](data) if self.codec else data

    def read(self, store: Store, *at: int):
        """A chunk: of strings a list, of numbers an array, cut to the array's shape."""
        raw = store.get(self.key(*at))
        size = tuple(min(c, n - i * c) for c, n, i in zip(self.chunks, self.shape, at))
        if raw is None:
            return [self.fill or ""] * size[0] if self.dtype == "O" else np.full(size, np.nan if self.fill == "NaN" else self.fill or 0, np.dtype(self.dtype).newbyteorder("="))
        raw = DECODE[self.codec](raw) if self.codec else raw
        if self.dtype == "O":
            return unpacked(raw)[: size[0] if size else 1]
        a = np.frombuffer(raw, self.dtype).reshape(self.chunks, order=self.order)[tuple(slice(n) for n in size)]
        return a.astype(a.dtype.newbyteorder("="), copy=False)

    def part(self, store: Store, start: int, stop: int):
        """Values start to stop of a 1-D array."""
        c = self.chunks[0]
        got = [(i, self.read(store, i)) for i in range(start // c, -(-stop // c))] if stop > start else []
        cut = [v[max(0, start - i * c) : stop - i * c] for i, v in got]
        if self.dtype == "O":
            return [x for v in cut for x in v]
        return np.concatenate(cut) if cut else np.zeros(0, np.dtype(self.dtype).newbyteorder("="))


def _spark_type(dtype: str) -> str:
    if dtype == "O" or np.dtype(dtype).kind in "US":
        return "string"
    d = np.dtype(dtype)
    return {"b1": "boolean", "f8": "double", "f4": "float", "i8": "bigint", "i4": "int", "i2": "smallint", "i1": "tinyint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "decimal(20,0)", "f2": "float"}[d.kind + str(d.itemsize)]


ARROW = {"boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "decimal(20,0)": pa.decimal128(20, 0)}


class Bounds:
    """What filters leave of a column of positions: a range, and perhaps a few points."""

    def __init__(self, n: int):
        self.low, self.high, self.points = 0, n - 1, None

    def take(self, f) -> None:
        match f:
            case EqualTo(value=x):
                self.points = [x] if self.points is None or x in self.points else []
            case In(value=xs):
                self.points = sorted(x for x in set(xs) if x is not None and (self.points is None or x in self.points))
            case GreaterThan(value=x):
                self.low = max(self.low, x + 1)
            case GreaterThanOrEqual(value=x):
                self.low = max(self.low, x)
            case LessThan(value=x):
                self.high = min(self.high, x - 1)
            case LessThanOrEqual(value=x):
                self.high = min(self.high, x)

    def hits(self, start: int, stop: int) -> bool:
        """May a row from start to stop (left out) be wanted?"""
        if stop <= self.low or start > self.high:
            return False
        return self.points is None or any(start <= p < stop for p in self.points)

    def mask(self, at: np.ndarray) -> np.ndarray:
        ok = (at >= self.low) & (at <= self.high)
        return ok if self.points is None else ok & np.isin(at, self.points)


class ElementSource(DataSource):
    """spark.read.format("zarr-element").option("path", store).option("element", name): o, v and value of a matrix; with
    option rows, key and an array for each row of a dense one; _key, _name and columns of an annotation group."""

    @classmethod
    def name(cls) -> str:
        return "zarr-element"

    def schema(self) -> str:
        store, name = Store(self.options["path"]), self.options["element"]
        a, attrs = Array.load(store, name), store.attributes(name)
        if a is not None:
            kind = _spark_type(a.dtype)
            return f"{KEY} bigint, value array<{kind}>" if self.options.get("rows") else f"o bigint, v bigint, value {kind}"
        if attrs.get("encoding-type") in SPARSE:
            return f"o bigint, v bigint, value {_spark_type(Array.load(store, f'{name}/data').dtype)}"
        if attrs.get("encoding-type") == "dataframe":
            return ", ".join([f"{KEY} bigint", f"{NAME} string"] + [f"`{c}` {column_type(store, f'{name}/{c}')}" for c in attrs["column-order"]])
        raise ValueError(f"{name!r} is no element that can be read as rows")

    def reader(self, schema) -> DataSourceReader:
        store, name = Store(self.options["path"]), self.options["element"]
        a, attrs = Array.load(store, name), store.attributes(name)
        kind = DenseReader if a is not None else SparseReader if attrs["encoding-type"] in SPARSE else FrameReader
        return kind(self.options["path"], name, bool(self.options.get("rows")), schema)


def chunks_of(partition: InputPartition | None) -> list:
    """A scan without any task still gets one, of nothing."""
    return partition.value if partition is not None and partition.value is not None else []


class ElementReader(DataSourceReader):
    #: The columns that hold positions along the first and the second dimension.
    dims: tuple[str, ...] = ()

    def __init__(self, path: str, name: str, rows: bool, schema):
        self.path, self.name, self.rows = path, name, rows
        self.columns = list(schema.names)
        self.store = Store(path)
        self.open()
        self.bounds = {c: Bounds(n) for c, n in zip(self.dims, self.shape)}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "store"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.store = Store(self.path)

    def pushFilters(self, filters):
        """Filters on positions choose chunks; Spark applies all of them again to what the chunks hold."""
        for f in filters:
            b = self.bounds.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if b is not None:
                b.take(f)
            yield f

    def grouped(self, chunks: list) -> list[InputPartition]:
        step = -(-len(chunks) // TASKS) or 1
        return [InputPartition(chunks[i : i + step]) for i in range(0, len(chunks), step)]


class DenseReader(ElementReader):
    def open(self) -> None:
        self.array = Array.load(self.store, self.name)
        self.shape = self.array.shape
        self.dims = (KEY,) if self.rows else ("o", "v")

    def partitions(self):
        r, c = (*self.array.chunks, 1)[:2]
        rows, cols = (*self.array.grid, 1)[:2]
        first = self.bounds[self.dims[0]]
        wanted = [i for i in range(rows) if first.hits(i * r, (i + 1) * r)]
        if self.rows:
            return self.grouped(wanted)
        across = [j for j in range(cols) if len(self.shape) < 2 or self.bounds["v"].hits(j * c, (j + 1) * c)]
        return self.grouped([(i, j) for i in wanted for j in across])

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        a, two = self.array, len(self.shape) > 1
        for chunk in chunks_of(partition):
            if self.rows:
                parts = [a.read(self.store, chunk, j) for j in range(a.grid[1])]
                block = np.concatenate(parts, axis=1)
                n, w = block.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(block.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + chunk * a.chunks[0]), lists], [KEY, "value"])
                continue
            i, j = chunk
            block = a.read(self.store, i, j) if two else np.asarray(a.read(self.store, i), object if a.dtype == "O" else None)[:, None]
            n, w = block.shape
            at = np.arange(n) + i * a.chunks[0]
            keep = self.bounds["o"].mask(at)
            at, block = at[keep], block[keep]
            v = np.arange(w) + (j * a.chunks[1] if two else 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, w)), pa.array(np.tile(v, len(at))), pa.array(block.ravel())], ["o", "v", "value"])


class SparseReader(ElementReader):
    """Tasks are chunks of indptr, so the driver reads metadata alone; a task reads the chunks of data and indices under the rows that are wanted."""

    def open(self) -> None:
        attrs = self.store.attributes(self.name)
        self.shape = tuple(attrs["shape"])
        self.turned = attrs["encoding-type"] == "csc_matrix"
        self.data, self.indices, self.indptr = (Array.load(self.store, f"{self.name}/{x}") for x in ("data", "indices", "indptr"))
        self.dims = ("o", "v")

    @property
    def major(self) -> Bounds:
        return self.bounds["v" if self.turned else "o"]

    def partitions(self):
        c, n = self.indptr.chunks[0], self.shape[self.turned]
        return self.grouped([(i, min(i + c, n)) for i in range(0, n, c) if self.major.hits(i, min(i + c, n))])

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        near = lru_cache(2)(lambda i: self.indices.read(self.store, i))
        for start, stop in chunks_of(partition):
            ptr = self.indptr.part(self.store, start, stop + 1).astype(np.int64)
            want = self.major.mask(np.arange(start, stop))
            c = self.data.chunks[0]
            full = want & (np.diff(ptr) > 0)
            first, last = ptr[:-1][full] // c, (ptr[1:][full] - 1) // c
            # Runs of wanted rows, by the chunks that they lie in: each chunk is read once, in order.
            for chunk in np.unique(np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last)])) if len(first) else []:
                low, high = max(chunk * c, ptr[0]), min((chunk + 1) * c, ptr[-1])
                at = np.arange(low, high)
                row = np.searchsorted(ptr, at, "right") - 1
                keep = want[row]
                at, row = at[keep], row[keep] + start
                value = self.data.read(self.store, int(chunk))[at - chunk * c]
                other = np.empty(len(at), np.int64)
                for i in np.unique(at // self.indices.chunks[0]):
                    here = at // self.indices.chunks[0] == i
                    other[here] = near(int(i))[at[here] - i * self.indices.chunks[0]]
                o, v = (other, row) if self.turned else (row, other)
                yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(v), pa.array(value)], ["o", "v", "value"])


def column_type(store: Store, name: str) -> str:
    a, kind = Array.load(store, name), store.attributes(name).get("encoding-type")
    if a is not None:
        return _spark_type(a.dtype)
    if kind == "categorical":
        return _spark_type(Array.load(store, f"{name}/categories").dtype)
    if kind in NULLABLE:
        return _spark_type(Array.load(store, f"{name}/values").dtype)
    raise ValueError(f"column {name!r} is of unknown kind {kind!r}")


class FrameReader(ElementReader):
    """A task reads the same rows of every column."""

    dims = (KEY,)

    def open(self) -> None:
        attrs = self.store.attributes(self.name)
        self.index = f"{self.name}/{attrs.get('_index', '_index')}"
        a = Array.load(self.store, self.index) or Array.load(self.store, f"{self.index}/values")
        self.shape, self.step = a.shape, a.chunks[0]
        self.kinds = {n: column_type(self.store, self.index if n == NAME else f"{self.name}/{n}") for n in self.columns if n != KEY}

    def partitions(self):
        n = self.shape[0]
        return self.grouped([(i, min(i + self.step, n)) for i in range(0, n, self.step) if self.bounds[KEY].hits(i, i + self.step)])

    def column(self, name: str, start: int, stop: int, kind: str) -> pa.Array:
        a = Array.load(self.store, name)
        if a is not None:
            v = a.part(self.store, start, stop)
            return pa.array(v if a.dtype == "O" else v.astype(str) if kind == "string" else v, ARROW[kind])
        if self.store.attributes(name)["encoding-type"] == "categorical":
            values = Array.load(self.store, f"{name}/categories")
            names = values.part(self.store, 0, values.shape[0])
            codes = Array.load(self.store, f"{name}/codes").part(self.store, start, stop)
            return pa.array(names, ARROW[kind]).take(pa.array(codes, pa.int64(), mask=codes < 0))
        values = Array.load(self.store, f"{name}/values").part(self.store, start, stop)
        return pa.array(values, ARROW[kind], mask=Array.load(self.store, f"{name}/mask").part(self.store, start, stop).astype(bool))

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for start, stop in chunks_of(partition):
            made = {KEY: pa.array(np.arange(start, stop))} | {n: self.column(self.index if n == NAME else f"{self.name}/{n}", start, stop, k) for n, k in self.kinds.items()}
            yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)


@dataclass
class Written(WriterCommitMessage):
    keys: list[str]


class ChunkSink(DataSource):
    """df (chunk, at, value), chunk by name or by number in row order, sorted by chunk with whole chunks in one partition each, to the array that option `array` describes."""

    @classmethod
    def name(cls) -> str:
        return "zarr-chunks"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        spec = json.loads(self.options["array"])
        return ChunkWriter(self.options["path"], Array(spec["name"], tuple(spec["shape"]), tuple(spec["chunks"]), spec["dtype"], spec["codec"], spec["fill"], attrs=spec["attrs"]))


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, array: Array):
        self.path, self.array = path, array

    def write(self, iterator) -> Written:
        store, a, keys = Store(self.path), self.array, []
        size = int(np.prod(a.chunks))
        name, values = None, None

        def close() -> None:
            if name is not None:
                keys.append(f"{a.name}/{name}")
                store.put(keys[-1], a.encoded(values))

        for b in iterator:
            chunks, at = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            new = b.column(2).to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])), len(chunks)) if len(chunks) else [0]
            for i, j in zip(edges[:-1], edges[1:]):
                here = chunks[i] if isinstance(chunks[i], str) else ".".join(map(str, np.unravel_index(chunks[i], a.grid)))
                if here != name:
                    close()
                    name = here
                    values = np.full(size, "", object) if a.dtype == "O" else np.full(size, np.nan if a.fill == "NaN" else a.fill, a.dtype)
                values[at[i:j]] = new[i:j]
        close()
        return Written(keys)

    def commit(self, messages) -> None:
        store = Store(self.path)
        if self.array.attrs:
            store.put(f"{self.array.name}/.zattrs", json.dumps(self.array.attrs).encode())
        store.put(f"{self.array.name}/.zarray", self.array.metadata())

    def abort(self, messages) -> None:
        store = Store(self.path)
        for m in messages:
            for k in m.keys if m is not None else ():
                store.delete(k)


def use(spark: SparkSession) -> None:
    """Register both sources with a session, and let filters reach the one that reads."""
    spark.dataSource.register(ElementSource)
    spark.dataSource.register(ChunkSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)


class Sink:
    """Writes elements into one store."""

    def __init__(self, spark: SparkSession, path: str, chunk: int, codec: str | None):
        self.spark, self.path, self.chunk, self.codec, self.store = spark, path, chunk, codec, Store(path)
        use(spark)

    def group(self, name: str, **attrs) -> None:
        self.store.put(f"{name}/.zattrs", json.dumps(attrs).encode())
        self.store.put(f"{name}/.zgroup", b'{"zarr_format": 2}')

    def array(self, df: DataFrame, name: str, shape: tuple[int, ...], chunks: tuple[int, ...], places: tuple[str, ...], dtype: str, fill: Any = 0, **attrs) -> None:
        """A column `value` at places (columns of positions)."""
        chunk = at = F.lit(0).cast("long")
        for p, n, c in zip(places, shape, chunks):
            chunk = chunk * -(-n // c) + F.floor(F.col(p) / c)
            at = at * c + F.col(p) % c
        spec = {"name": name, "shape": shape, "chunks": chunks, "dtype": dtype, "codec": self.codec, "fill": fill, "attrs": attrs}
        rows = df.select(chunk.alias("chunk"), at.alias("at"), F.col("value"))
        tasks = max(1, min(int(np.prod([-(-n // c) for n, c in zip(shape, chunks)])), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        rows.repartition(tasks, "chunk").sortWithinPartitions("chunk").write.format("zarr-chunks").mode("append").option("path", self.path).option("array", json.dumps(spec)).save()

    def line(self, df: DataFrame, name: str, n: int, dtype: str, **attrs) -> None:
        """A 1-D array of (pos, value)."""
        kind = "string-array" if dtype == "O" else "array"
        self.array(df, name, (n,), (max(1, min(self.chunk, n)),), ("pos",), dtype, "" if dtype == "O" else 0, **{"encoding-type": kind, "encoding-version": "0.2.0"} | attrs)

    def column(self, df: DataFrame, name: str, n: int, categories: Categories | Dictionary | None, nulls: bool) -> None:
        kind = df.schema["value"].dataType.simpleString()
        if kind not in TYPES:
            kind = "double" if kind.startswith("decimal") else "string"
            df = df.withColumn("value", F.col("value").cast(kind))
        dtype = TYPES.get(kind, "O")
        if categories is not None:
            table = isinstance(categories, Dictionary)
            codes = materialise(categories.coded()) if table else self.spark.createDataFrame([(v, i) for i, v in enumerate(categories.values)], "value string, code int")
            self.line(codes.select(F.col("code").cast("long").alias("pos"), "value"), f"{name}/categories", codes.count() if table else len(categories.values), "O")
            self.line(df.join(codes, "value", "left").select("pos", F.coalesce(F.col("code").cast("int"), F.lit(-1)).alias("value")), f"{name}/codes", n, "<i4")
            self.group(name, **{"encoding-type": "categorical", "encoding-version": "0.2.0", "ordered": categories.ordered})
        elif nulls and kind not in ("double", "float"):
            empty = F.lit("") if dtype == "O" else F.lit(0).cast(kind)
            self.line(df.select("pos", F.coalesce("value", empty).alias("value")), f"{name}/values", n, dtype)
            self.line(df.select("pos", F.col("value").isNull().alias("value")), f"{name}/mask", n, "|b1")
            word = {"string": "nullable-string-array", "boolean": "nullable-boolean"}.get(kind, "nullable-integer")
            self.group(name, **{"encoding-type": word, "encoding-version": "0.1.0"})
        else:
            self.line(df.select("pos", F.coalesce("value", F.lit(float("nan"))).alias("value")) if nulls else df, name, n, dtype)

    def frame(self, axis: Axis, rows: DataFrame, name: str, n: int) -> None:
        """rows: the axis with positions."""
        columns = axis.columns
        gaps = rows.agg(*(F.coalesce(F.max(F.col(f"`{c}`").isNull()), F.lit(False)).alias(f"c{i}") for i, c in enumerate([NAME, *columns]))).first()
        for i, c in enumerate([NAME, *columns]):
            values = rows.select(F.col(ORD).alias("pos"), F.col(f"`{c}`").alias("value"))
            self.column(values, f"{name}/{'_index' if c == NAME else c}", n, axis.categories.get(c), bool(gaps[f"c{i}"]))
        self.group(name, **{"encoding-type": "dataframe", "encoding-version": "0.2.0", "_index": "_index", "column-order": columns})

    def sparse(self, cells: DataFrame, name: str, n: int, width: int, dtype: str) -> None:
        """Cells (o, v, value) by positions, as rows end to end: sorted and written once, and numbered. Where a row begins comes
        from counts of rows, summed within blocks of rows and over blocks."""
        cells = with_positions(cells.select("o", "v", "value"), ["o", "v"], "pos")
        block = F.floor(F.col("pos") / self.chunk).alias("block")
        counts = cells.groupBy(F.col("o").alias("pos")).agg(F.count("*").alias("n"))
        every = self.spark.range(n + 1).select(F.col("id").alias("pos")).join(counts, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"), block)
        blocks = every.groupBy("block").agg(F.sum("n").alias("m"))
        blocks = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("before"))  # a row for `chunk` rows
        start = every.join(blocks, "block").select("pos", (F.col("before") + F.sum("n").over(Window.partitionBy("block").orderBy("pos")) - F.col("n")).alias("value"))
        total = cells.count()
        self.line(cells.select("pos", "value"), f"{name}/data", total, dtype)
        self.line(cells.select("pos", F.col("v").alias("value")), f"{name}/indices", total, "<i8" if width > 2**31 - 1 else "<i4")
        self.line(start, f"{name}/indptr", n + 1, "<i8")
        self.group(name, **{"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": [n, width]})

    def dense(self, cells: DataFrame, name: str, n: int, width: int, dtype: str) -> None:
        cols = max(1, min(width, 4096))
        kind = "NaN" if dtype in ("<f8", "<f4") else 0
        self.array(cells, name, (n, width), (max(1, min(n, -(-self.chunk // cols))), cols), ("o", "v"), dtype, kind, **{"encoding-type": "array", "encoding-version": "0.2.0"})

    def small(self, name: str, value: Any) -> None:
        """Metadata: mappings, scalars, lists of numbers or of strings."""
        if isinstance(value, dict):
            self.group(name, **{"encoding-type": "dict", "encoding-version": "0.1.0"})
            for k, v in value.items():
                self.small(f"{name}/{k}", v)
            return
        if isinstance(value, str) or isinstance(value, list) and value and all(isinstance(x, str) for x in value):
            items, dtype, word = ([value], "O", "string") if isinstance(value, str) else (value, "O", "string-array")
        elif isinstance(value, (bool, int, float, list)) and np.asarray(value).dtype.kind in "bif":
            items, word = np.atleast_1d(np.asarray(value)), "array" if isinstance(value, list) else "numeric-scalar"
            dtype = items.dtype.str
        else:
            raise TypeError(f"cannot write {type(value).__name__} at {name!r}")
        shape = (len(items),) if isinstance(value, list) else ()
        a = Array(name, shape, tuple(max(1, x) for x in shape), dtype, self.codec, "" if dtype == "O" else 0)
        if len(items):
            self.store.put(a.key(*(0 for _ in shape)), a.encoded(items))
        self.store.put(f"{name}/.zattrs", json.dumps({"encoding-type": word, "encoding-version": "0.2.0"}).encode())
        self.store.put(f"{name}/.zarray", a.metadata())


def write_zarr(g: Grid, path: str, chunk: int = CHUNK, codec: str | None = "zstd", root: str = "grid") -> None:
    """Save a grid. root: the word that the store's own encoding gets, for readers that want a certain one."""
    g = g.realised()
    spark = g.obs.df.sparkSession
    sink = Sink(spark, path, chunk, codec)
    if sink.store.get(".zgroup") or sink.store.get("zarr.json"):
        raise FileExistsError(path)
    rows = {"obs": with_positions(g.obs.rows), "var": with_positions(g.var.rows)}
    n = {"obs": g.n_obs, "var": g.n_vars}
    place = lambda side, c: rows[side].select(F.col(KEY).alias(c), F.col(ORD).alias(f"_{c}"))

    def numeric(df: DataFrame) -> tuple[DataFrame, str]:
        kind = df.schema["value"].dataType.simpleString()
        return (df, TYPES[kind]) if kind in TYPES else (df.withColumn("value", F.col("value").cast("double")), "<f8")

    def matrix(df: DataFrame, name: str, sides: tuple[str, str], sparse: bool) -> None:
        a, b = df.columns[:2]
        cells = df.join(place(sides[0], a), a).join(place(sides[1], b), b).select(F.col(f"_{a}").alias("o"), F.col(f"_{b}").alias("v"), "value")
        cells, dtype = numeric(cells)
        (sink.sparse if sparse else sink.dense)(cells, name, n[sides[0]], n[sides[1]], dtype)

    for side in ("obs", "var"):
        sink.frame(g.axis(side), rows[side], side, n[side])
    for k, m in g.elements.items():
        matrix(m.df.select("o", "v", "value"), "X" if k is None else f"layers/{k}", ("obs", "var"), m.sparse)
    for slot, side in (("obsm", "obs"), ("varm", "var")):
        for k, a in getattr(g, slot + "_").items():
            if a.width is None:
                raise ValueError(f"{slot}/{k}: arrays of any length have no place in this store")
            cells = a.df.join(place(side, KEY), KEY).select(F.col(f"_{KEY}").alias("o"), F.posexplode("value").alias("v", "value"))
            cells, dtype = numeric(cells)
            sink.dense(cells, f"{slot}/{k}", n[side], a.width, dtype)
    for slot, side in (("obsp", "obs"), ("varp", "var")):
        for k, p in getattr(g, slot + "_").items():
            matrix(p.df.select("i", "j", "value"), f"{slot}/{k}", (side, side), True)
    sink.small("uns", dict(g.uns))
    for slot in ("layers", "obsm", "varm", "obsp", "varp"):
        sink.group(slot, **{"encoding-type": "dict", "encoding-version": "0.1.0"})
    sink.store.put(".zattrs", json.dumps({"encoding-type": root, "encoding-version": "0.1.0"}).encode())
    sink.store.put(".zgroup", b'{"zarr_format": 2}')


def read_element(spark: SparkSession, path: str, name: str, rows: bool = False) -> DataFrame:
    use(spark)
    r = spark.read.format("zarr-element").option("path", path).option("element", name)
    return (r.option("rows", "true") if rows else r).load()


def _small(store: Store, name: str) -> Any:
    a = Array.load(store, name)
    if a is None:
        return {k: _small(store, f"{name}/{k}") for k in store.names(name) if k != "c"}
    if a.shape:
        v = a.part(store, 0, a.shape[0])
        return v if isinstance(v, list) else v.tolist()
    v = a.read(store)
    return v[0] if isinstance(v, list) else v.item()


def read_zarr(spark: SparkSession, path: str, elements: list[str] | None = None) -> Grid:
    """Load lazily: the driver reads metadata and categories. Positions are the keys. elements: which to take, such as X or layers/a; axes always."""
    store = Store(path)
    if store.get(".zgroup") is None and store.get("zarr.json") is None:
        raise FileNotFoundError(f"no store at {path}")
    wanted = lambda name: elements is None or name in elements

    def axis(side: str) -> Axis:
        attrs, cats = store.attributes(side), {}
        for c in attrs["column-order"]:
            kind = store.attributes(f"{side}/{c}")
            if kind.get("encoding-type") == "categorical" and column_type(store, f"{side}/{c}") == "string":
                values = Array.load(store, f"{side}/{c}/categories")
                if values.shape[0] > settings().local_categories:
                    cats[c] = Dictionary.at_places(read_element(spark, path, f"{side}/{c}/categories").select("o", "value"), "o", bool(kind.get("ordered")))
                    continue
                cats[c] = Categories(tuple(map(str, values.part(store, 0, values.shape[0]))), bool(kind.get("ordered")))
        index = f"{side}/{attrs.get('_index', '_index')}"
        return Axis(read_element(spark, path, side), True, cats, None, (Array.load(store, index) or Array.load(store, f"{index}/values")).shape[0])

    def matrix(name: str) -> Matrix:
        return Matrix(read_element(spark, path, name), store.attributes(name).get("encoding-type") in SPARSE)

    def aligned(name: str) -> Aligned:
        return Aligned(read_element(spark, path, name, rows=True), Array.load(store, name).shape[1])

    def pairs(name: str) -> Pairs:
        return Pairs(read_element(spark, path, name).select(F.col("o").alias("i"), F.col("v").alias("j"), "value"))

    slot = lambda s, make: {k: make(f"{s}/{k}") for k in store.names(s) if wanted(f"{s}/{k}")}
    has_x = wanted("X") and ("X" in store.names(""))
    layers: dict[str | None, Matrix] = ({None: matrix("X")} if has_x else {}) | slot("layers", matrix)
    uns = _small(store, "uns") if "uns" in store.names("") else {}
    return Grid(axis("obs"), axis("var"), layers, slot("obsm", aligned), slot("varm", aligned), slot("obsp", pairs), slot("varp", pairs), uns)


