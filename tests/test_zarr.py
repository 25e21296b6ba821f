"""Chunked stores: round trips, what a selection reads, formats, failures."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, NAME, Axis, Categories
from gridlake.operators.element import Aligned, Matrix, Pairs
from gridlake.operators.grid import Grid
from gridlake.sources import zarr


@pytest.fixture(scope="module")
def g(spark):
    n, w = 90, 40
    r = np.random.default_rng(1)
    cells = [(10 * i, f"k{j:02}", float(i * w + j)) for i in range(n) for j in range(w) if r.random() < 0.1 and i % 9]
    rows = [(10 * i, None if i == 4 else f"row {i}é", "uvw"[i % 3] if i % 5 else None, None if i % 7 == 0 else i, i % 2 == 0, float(i), f"2024-01-{1 + i % 28:02}") for i in range(n)]
    obs = spark.createDataFrame(rows, f"{KEY} long, {NAME} string, kind string, size int, even boolean, weight double, day string").withColumn("day", F.col("day").cast("date"))
    var = spark.createDataFrame([(f"k{j:02}", f"col {j}") for j in range(w)], f"{KEY} string, {NAME} string")
    dense = spark.createDataFrame([(10 * i, f"k{j:02}", i * 100 + j) for i in range(n) for j in range(w)], "o long, v string, value int")
    sparse = spark.createDataFrame(cells, "o long, v string, value double")
    emb = spark.createDataFrame([(10 * i, [float(i), float(-i), 0.5]) for i in range(n)], f"{KEY} long, value array<double>")
    near = spark.createDataFrame([(10 * i, 10 * ((i + 1) % n), 1.5) for i in range(n)], "i long, j long, value double")
    uns = {"title": "näme", "n": 3, "share": 0.25, "on": True, "tags": ["a", "é"], "deep": {"levels": [1, 2, 3]}}
    return Grid(Axis(obs, True, {"kind": Categories(("w", "v", "u", "t"))}), Axis(var), {None: Matrix(sparse), "full": Matrix(dense, False)}, {"emb": Aligned(emb, 3)}, {}, {"near": Pairs(near)}, {}, uns)


@pytest.fixture(scope="module")
def stored(g, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zarr") / "grid")
    zarr.write_zarr(g, path, chunk=32)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark, g, stored):
    h = zarr.read_zarr(spark, stored)
    assert h.shape == g.shape and h.uns == g.uns and h.obs.columns == g.obs.columns and h.obs.categories == g.obs.categories
    back = lambda df: rows(df.select((F.col("o") * 10).alias("o"), F.format_string("k%02d", "v").alias("v"), "value"))
    assert back(h.X.df) == rows(g.X.df) and h.X.sparse
    assert back(h.layer("full").df) == rows(g.layer("full").df) and not h.layer("full").sparse
    assert rows(h.obs.rows.withColumn(KEY, F.col(KEY) * 10)) == rows(g.obs.rows.withColumn("day", F.col("day").cast("string")))
    assert rows(h.obsm["emb"].df.withColumn(KEY, F.col(KEY) * 10)) == rows(g.obsm["emb"].df) and h.obsm_["emb"].width == 3
    assert rows(h.obsp["near"].df.select(F.col("i") * 10, F.col("j") * 10, "value")) == rows(g.obsp["near"].df)
    assert set(zarr.read_zarr(spark, stored, elements=["X"]).elements) == {None}
    with pytest.raises(FileExistsError):
        zarr.write_zarr(g, stored)


def test_metadata_is_of_the_format(stored):
    get = lambda name: json.load(open(f"{stored}/{name}"))
    assert get("X/.zattrs")["encoding-type"] == "csr_matrix" and get("X/.zattrs")["shape"] == [90, 40]
    assert get("X/indptr/.zarray")["shape"] == [91] and get("layers/full/.zarray")["chunks"] == [1, 40] and get("obs/_index/.zattrs")["encoding-type"] == "nullable-string-array"
    assert get("obs/kind/.zattrs")["encoding-type"] == "categorical" and get("obs/size/.zattrs")["encoding-type"] == "nullable-integer"
    assert os.path.exists(f"{stored}/.zgroup")


def test_selection_reads_its_chunks_alone(spark, g, tmp_path):
    """Chunks beside the selection are gone, and it isn't noticed; a scan of all does notice."""
    path = str(tmp_path / "grid")
    zarr.write_zarr(g, path, chunk=32)
    full = zarr.read_element(spark, path, "layers/full").where("o between 40 and 42 and v < 20")
    want, cells = rows(full), rows(zarr.read_element(spark, path, "X").where("o in (41, 43)"))
    for i in range(90):
        if not 40 <= i <= 42:
            os.remove(f"{path}/layers/full/{i}.0")
    assert rows(full) == want and len(want) == 60
    indptr = np.concatenate([zarr.Array.load(zarr.Store(path), "X/indptr").part(zarr.Store(path), 0, 91)])
    keep = {int(p) // 32 for r in (41, 43) for p in range(indptr[r], indptr[r + 1])}
    for name in ("data", "indices"):
        for i in {int(f) for f in os.listdir(f"{path}/X/{name}") if f.isdigit()} - keep:
            open(f"{path}/X/{name}/{i}", "wb").close()
    assert rows(zarr.read_element(spark, path, "X").where("o in (41, 43)")) == cells and cells
    with pytest.raises(Exception):
        zarr.read_element(spark, path, "X").collect()
    # plan: a task for each of three chunks
    assert full.rdd.getNumPartitions() == 3


def test_frames_prune_columns_and_rows(spark, stored):
    df = zarr.read_element(spark, stored, "obs").where(f"{KEY} = 70").select("weight", "kind")
    assert [tuple(r) for r in df.collect()] == [(70.0, None)] and df.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("codec", [None, "zlib", "gzip", "bz2", "lzma", "zstd"])
def test_codecs(spark, tmp_path, codec):
    a, b = (Axis.of_names(spark, [f"{c}{i}" for i in range(5)]) for c in "xy")
    m = Matrix(spark.createDataFrame([(i, j, i - j) for i in range(5) for j in range(5)], "o long, v long, value long"), False)
    zarr.write_zarr(Grid(a, b, {None: m}), str(tmp_path / "s"), codec=codec)
    assert rows(zarr.read_zarr(spark, str(tmp_path / "s")).X.df) == rows(m.df)


def test_empty_grid(spark, tmp_path):
    a, b = Axis.of_names(spark, []), Axis.of_names(spark, ["y"])
    zarr.write_zarr(Grid(a, b, {None: Matrix(spark.createDataFrame([], "o long, v long, value double"))}), str(tmp_path / "s"))
    h = zarr.read_zarr(spark, str(tmp_path / "s"))
    assert h.shape == (0, 1) and h.X.df.count() == 0 and h.obs.rows.count() == 0


def test_foreign_arrays(spark, tmp_path):
    """Format 3, column order, big ends, chunks that are missing, sparse columns, codecs that aren't here."""
    put = lambda name, data: zarr.Store(str(tmp_path)).put(name, data if isinstance(data, bytes) else json.dumps(data).encode())
    v3 = {"zarr_format": 3, "node_type": "array", "shape": [3, 2], "data_type": "int16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 2]}}, "fill_value": 7,
          "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {}}]}
    put("three/zarr.json", v3)
    put("three/c/0/0", zarr.ENCODE["gzip"](struct.pack(">4h", 1, 2, 3, 4)))
    assert rows(zarr.read_element(spark, str(tmp_path), "three")) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4), (2, 0, 7), (2, 1, 7)]
    v2 = {"zarr_format": 2, "shape": [2, 2], "chunks": [2, 2], "dtype": "<f4", "order": "F", "fill_value": "NaN", "compressor": {"id": "zlib"}, "filters": None, "dimension_separator": "/"}
    put("two/.zarray", v2)
    put("two/0/0", zlib.compress(struct.pack("<4f", 1, 2, 3, 4)))
    assert [x[2] for x in rows(zarr.read_element(spark, str(tmp_path), "two"))] == [1, 3, 2, 4]
    line = lambda n, values, t: (put(f"csc/{n}/.zarray", v2 | {"shape": [len(values)], "chunks": [2], "dtype": t, "order": "C", "compressor": None}), [put(f"csc/{n}/{i}", np.resize(np.array(values[2 * i : 2 * i + 2], t), 2).tobytes()) for i in range((len(values) + 1) // 2)])
    put("csc/.zattrs", {"encoding-type": "csc_matrix", "shape": [4, 3]})
    line("data", [5, 6, 7], "<i4")
    line("indices", [3, 0, 2], "<i4")
    line("indptr", [0, 1, 1, 3], "<i8")
    assert rows(zarr.read_element(spark, str(tmp_path), "csc")) == [(0, 2, 6), (2, 2, 7), (3, 0, 5)] and rows(zarr.read_element(spark, str(tmp_path), "csc").where("v = 0")) == [(3, 0, 5)]
    put("odd/.zarray", v2 | {"compressor": {"id": "blosc"}})
    with pytest.raises(Exception, match="blosc"):
        zarr.read_element(spark, str(tmp_path), "odd").collect()


def test_commit_and_abort(tmp_path):
    """An array is there once the commit wrote its metadata; an abort leaves nothing of what tasks reported."""
    import pyarrow as pa

    a = zarr.Array("x", (4,), (2,), "<i8")
    w = zarr.ChunkWriter(str(tmp_path), a)
    batch = lambda *r: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*r)], ["chunk", "at", "value"])
    one, two = w.write(iter([batch(("0", 0, 5), ("0", 1, 6))])), w.write(iter([batch(("1", 1, 8)), batch(("1", 0, 7))]))
    store = zarr.Store(str(tmp_path))
    assert zarr.Array.load(store, "x") is None and os.path.exists(tmp_path / "x/1")
    w.abort([one, None])
    assert not os.path.exists(tmp_path / "x/0") and os.path.exists(tmp_path / "x/1")
    w.write(iter([batch(("0", 0, 5), ("0", 1, 6))]))
    w.commit([one, two])
    assert zarr.Array.load(store, "x").part(store, 0, 4).tolist() == [5, 6, 7, 8]


def test_cells_are_sorted_once_and_no_row_is_ranked(spark, tmp_path, monkeypatch):
    """Where cells of a sparse matrix stand comes from one sort, whatever order they come in; chunks are told by number."""
    rng = np.random.default_rng(3)
    x = rng.integers(1, 9, (60, 40)) * (rng.random((60, 40)) < 0.3)
    x[[0, 17, 59]] = 0
    o, v = np.nonzero(x)
    mix = rng.permutation(len(o))
    cells = spark.createDataFrame([(int(o[i]), int(v[i]), float(x[o[i], v[i]])) for i in mix], "o long, v long, value double").repartition(5)
    g = Grid(Axis.of_names(spark, list(map(str, range(60)))), Axis.of_names(spark, list(map(str, range(40)))), {None: Matrix(cells)})
    with monkeypatch.context() as m:
        m.setattr(zarr.F, "row_number", None)
        zarr.write_zarr(g, str(tmp_path / "z"), chunk=16)
    store = zarr.Store(str(tmp_path / "z"))
    whole = lambda n: (a := zarr.Array.load(store, f"X/{n}")).part(store, 0, a.shape[0])
    assert whole("data").tolist() == x[o, v].tolist() and whole("indices").tolist() == v.tolist()
    assert whole("indptr").tolist() == [0, *np.cumsum((x != 0).sum(1)).tolist()]
    assert sorted(map(tuple, zarr.read_zarr(spark, str(tmp_path / "z")).X.df.collect())) == [(a, b, float(x[a, b])) for a, b in zip(o, v)]
