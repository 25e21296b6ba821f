"""Typed element store: Parquet folders for each element, and versions that say which of them are the grid.

    <path>/_versions/<n>.json               encodings, folders of each element, widths, categories, uns
    <path>/obs/<id>, layers/<k>/<id>, ...   one folder for each write, sorted by row key
    <path>/<element>/<id>/_zones            the least and the largest row key of each file
    <path>/obs/<id>/_labels/bucket=<b>      labels and their keys, by a hash of the label

Reading is lazy and by element: elements that are not asked for are never scanned. A selection of row keys opens only
files whose zone it meets, and within them Parquet's statistics leave row groups out.

A version is made by creating its file, which fails if there is one: a write or an append that dies on the way leaves the
grid as it was, and of two that began from one version the second is refused. (The store must create files atomically, as
HDFS does.) Old versions stay readable until clean_up().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, NAME, Axis, Categories, LabelIndex
from gridlake.operators.blocks import Blocks
from gridlake.operators.dictionary import Dictionary
from gridlake.operators.element import Aligned, Matrix, Pairs
from gridlake.operators.grid import Grid, Raw, check_key

VERSION = "1"
#: encoding -> (frame of an element, element of a frame and its manifest entry). register() adds to it.
ENCODINGS: dict[str, tuple[Callable[[Any], DataFrame], Callable[[DataFrame, dict], Any]]] = {}


def register(encoding: str, write: Callable[[Any], DataFrame], read: Callable[[DataFrame, dict], Any]) -> None:
    ENCODINGS[encoding] = (write, read)


def _categories(df: DataFrame, v: dict, base: str) -> Categories | Dictionary:
    return Dictionary(df.sparkSession.read.parquet(f"{base}/{v['table']}"), v["ordered"]) if "table" in v else Categories(tuple(v["values"]), v["ordered"])


def _axis(df: DataFrame, e: dict) -> Axis:
    a = Axis(df, True, {c: _categories(df, v, e.get("base", "")) for c, v in e.get("categories", {}).items()}, None, e.get("n"))
    have = e.get("labels", {})
    if have and set(have) == set(e.get("folders", [])) and not e.get("selected"):
        parts = tuple((df.sparkSession.read.parquet(f"{e['base']}/{f}/_labels"), n) for f, n in have.items())
        a = replace(a, labels=LabelIndex(parts, a.df))
    return a


register("axis", lambda a: a.rows, _axis)
register("sparse-matrix", lambda m: m.df, lambda df, e: Matrix(df, True))
register("block-matrix", lambda b: b.blocks, lambda df, e: Blocks(df, tuple(e["columns"])))
register("dense-matrix", lambda m: m.df, lambda df, e: Matrix(df, False))
register("aligned-array", lambda a: a.df, lambda df, e: Aligned(df, e.get("width")))
register("ragged-array", lambda a: a.df, lambda df, e: Aligned(df, None))
register("pairs", lambda p: p.df, lambda df, e: Pairs(df))
register("dataframe", lambda df: df, lambda df, e: df)


def encoding_of(x: Any) -> str:
    match x:
        case Axis():
            return "axis"
        case Blocks():
            return "block-matrix"
        case Matrix():
            return "sparse-matrix" if x.sparse else "dense-matrix"
        case Aligned():
            return "ragged-array" if x.width is None else "aligned-array"
        case Pairs():
            return "pairs"
        case DataFrame():
            return "dataframe"
    raise TypeError(f"no encoding for {type(x).__name__}")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Make a file, and fail if it exists."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def _get_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a store's versions, rising."""
    fs, p = _fs(spark, f"{path}/_versions")
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version (the last one unless given) says; FileNotFoundError if there is none."""
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        raise FileNotFoundError(f"no version {version or ''} of a grid at {path}")
    return json.loads(_get_text(spark, f"{path}/_versions/{(have[-1] if version is None else version):08d}.json")) | {"version": have[-1] if version is None else version}


def _publish(spark: SparkSession, path: str, base: int, body: dict) -> int:
    _create(spark, f"{path}/_versions/{base + 1:08d}.json", json.dumps({k: v for k, v in body.items() if k != "version"}, indent=1))
    return base + 1


def clean_up(spark: SparkSession, path: str, keep: int = 1, grace: float = 3600) -> list[str]:
    """Delete versions but for the last `keep`, and folders that none of these names and nothing has touched for `grace` seconds (a writer may be at work)."""
    have = versions(spark, path)
    used = {f"{w}/{f}" for v in have[-keep:] for w, e in snapshot(spark, path, v)["elements"].items() for f in e.get("folders", [])}
    known = {w for v in have for w, e in snapshot(spark, path, v)["elements"].items() if "folders" in e}
    for v in have[:-keep]:
        fs, p = _fs(spark, f"{path}/_versions/{v:08d}.json")
        fs.delete(p, False)
    now, gone = spark._jvm.java.lang.System.currentTimeMillis(), []
    for w in sorted(known):
        fs, p = _fs(spark, f"{path}/{w}")
        for x in fs.listStatus(p) if fs.exists(p) else []:
            name = x.getPath().getName()
            if name.startswith("w-") and f"{w}/{name}" not in used and now - x.getModificationTime() >= grace * 1000:
                fs.delete(x.getPath(), True)
                gone.append(f"{w}/{name}")
    return gone


# Selections of row keys
@dataclass(frozen=True)
class Keys:
    """Row keys: runs of them (both ends included), and the points that are meant if a run holds others as well."""

    runs: tuple[tuple[Any, Any], ...]
    points: tuple | None = None

    @staticmethod
    def between(low: Any, high: Any) -> Keys:
        return Keys(((low, high),))

    @staticmethod
    def of(points: list, gap: int = 64) -> Keys:
        """Points, clumped: neighbours at most `gap` apart are read as one run and told apart afterwards."""
        runs: list[list] = []
        for x in sorted(set(points)):
            if runs and isinstance(x, int) and x - runs[-1][1] <= gap:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        whole = sum(z - a + 1 if isinstance(a, int) else 1 for a, z in runs) == len(set(points))
        return Keys(tuple(map(tuple, runs)), None if whole else tuple(sorted(set(points))))

    #: With more runs or points than these, they are a table to join with rather than a condition.
    MANY = 200

    def files(self, zones: DataFrame) -> list[str]:
        """Files (of those whose zones are given) that a run meets."""
        if len(self.runs) <= self.MANY:
            hit = F.lit(False)
            for a, z in self.runs:
                hit = hit | ((F.col("low") <= F.lit(z)) & (F.col("high") >= F.lit(a)))
            found = zones.where(hit)
        else:
            runs = zones.sparkSession.createDataFrame(list(self.runs), ["_a", "_z"])
            found = zones.join(runs, (F.col("low") <= F.col("_z")) & (F.col("high") >= F.col("_a")), "left_semi")
        return [r.file for r in found.select("file").collect()]  # no more than the selection opens

    def applied(self, df: DataFrame, column: str) -> DataFrame:
        c = F.col(column)
        if not self.runs:
            return df.where(F.lit(False))
        df = df.where((c >= F.lit(self.runs[0][0])) & (c <= F.lit(self.runs[-1][1])))  # for Parquet's statistics
        if len(self.runs) > self.MANY or self.points is not None and len(self.points) > self.MANY:
            points = self.points or [x for a, z in self.runs for x in (range(a, z + 1) if isinstance(a, int) else [a])]
            return df.join(df.sparkSession.createDataFrame([(x,) for x in points], [column]), column, "left_semi").select(*df.columns)
        if self.points is not None:
            return df.where(c.isin(*self.points))
        hit = F.lit(False)
        for a, z in self.runs:
            hit = hit | ((c >= F.lit(a)) & (c <= F.lit(z)))
        return df.where(hit) if len(self.runs) > 1 else df


SORT = {"block-matrix": ["start"], "sparse-matrix": ["o", "v"], "dense-matrix": ["o", "v"], "axis": [KEY], "pairs": ["i", "j"], "aligned-array": [KEY], "ragged-array": [KEY]}


def write_elem(path: str, x: Any, mode: str = "errorifexists", spark: SparkSession | None = None, folder: str | None = None) -> dict:
    """Write one element, into a folder of its own below path if one is named; returns its manifest entry."""
    enc = encoding_of(x)
    df = ENCODINGS[enc][0](x)
    entry: dict[str, Any] = {"encoding-type": enc, "encoding-version": VERSION}
    if enc == "axis":
        df = df.drop("_from")
        entry |= {"categories": {c: {"values": list(v.values), "ordered": v.ordered} for c, v in x.categories.items() if isinstance(v, Categories)}}
    if enc == "block-matrix":
        entry["columns"] = list(x.columns)
    if enc == "aligned-array":
        entry["width"] = x.width
    order = SORT.get(enc)
    where = path if folder is None else f"{path}/{folder}"
    try:
        (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode(mode).parquet(where)
        for i, (c, v) in enumerate(x.categories.items() if enc == "axis" else ()):
            if isinstance(v, Dictionary):
                entry["categories"][c] = _put_dictionary(where, f"{folder}/" if folder else "", i, v)
        if folder is not None:
            entry["folders"] = [folder]
            if order:
                _write_zones(df.sparkSession, where, order[0])
            if enc == "axis":
                entry["labels"] = {folder: _write_labels(df.sparkSession, where)}
    except Exception as e:
        e.add_note(f"while writing element {path}")
        raise
    return entry


def _put_dictionary(where: str, folder: str, i: int, v: Dictionary) -> dict:
    """A table of categories beside the axis that has them, where scans of the axis don't see it."""
    v.table.write.mode("overwrite").parquet(f"{where}/_categories/{i}")
    return {"table": f"{folder}_categories/{i}", "ordered": v.ordered}


def _write_zones(spark: SparkSession, where: str, column: str) -> None:
    """The least and the largest key of each file: one pass over the key column."""
    zones = spark.read.parquet(where).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))
    zones.coalesce(1).write.mode("overwrite").parquet(f"{where}/_zones")  # a row a file


#: Rows behind a bucket of the label index.
LABELS = 1_000_000


def _write_labels(spark: SparkSession, where: str) -> int:
    """The label index of an axis's folder: labels and keys by a hash of the label. Returns its number of buckets."""
    rows = spark.read.parquet(where).select(NAME, KEY)
    n = max(16, rows.count() // LABELS)
    bucket = F.pmod(F.xxhash64(NAME), F.lit(n)).cast("int").alias("bucket")
    # rows of one label may be any share of all: dealt by key as well, a bucket is several files
    rows.where(f"{NAME} is not null").select(NAME, KEY, bucket).repartition(n, "bucket", F.pmod(F.xxhash64(KEY), F.lit(max(1, n // 16)))).sortWithinPartitions("bucket", NAME).write.partitionBy("bucket").parquet(f"{where}/_labels")
    return n


def zones_of(spark: SparkSession, path: str, entry: dict) -> DataFrame | None:
    """(file, low, high, n) of an element's files, with whole paths; None if it has none."""
    out = None
    for f in entry.get("folders", []):
        z = spark.read.parquet(f"{path}/{f}/_zones").withColumn("file", F.concat(F.lit(f"{path}/{f}/"), "file"))
        out = z if out is None else out.unionByName(z)
    return out


def _frame(spark: SparkSession, path: str, entry: dict, keys: Keys | None = None) -> DataFrame:
    folders = [f"{path}/{f}" for f in entry["folders"]] if "folders" in entry else [path]
    order = SORT.get(entry["encoding-type"])
    if keys is None or order is None or entry["encoding-type"] == "block-matrix":
        return spark.read.parquet(*folders)
    zones = zones_of(spark, path, entry)
    files = folders if zones is None else keys.files(zones)
    # all folders of an element have one schema; reading it needs no file that is asked for
    df = spark.read.schema(spark.read.parquet(folders[0]).schema).parquet(*(files or folders[:1]))
    if not files:
        return df.where(F.lit(False))
    for c in order if entry["encoding-type"] == "pairs" else order[:1]:
        df = keys.applied(df, c)
    return df


def read_elem(spark: SparkSession, path: str, entry: dict, keys: Keys | None = None) -> Any:
    enc = entry["encoding-type"]
    if enc not in ENCODINGS:
        raise KeyError(f"unknown encoding {enc!r} of {path}")
    try:
        return ENCODINGS[enc][1](_frame(spark, path, entry, keys), {k: v for k, v in entry.items() if keys is None or k != "n"} | {"base": path, "selected": keys is not None})
    except Exception as e:
        e.add_note(f"while reading element {path}")
        raise


def unwriteable(g: Grid) -> list[str]:
    """Places that write() would refuse."""
    bad = []
    for slot in ("elements", "obsm_", "varm_", "obsp_", "varp_", "uns"):
        for k in getattr(g, slot):
            if k is not None and (not isinstance(k, str) or "/" in k):
                bad.append(f"{slot.rstrip('_')}/{k}")
    for k, v in g.uns.items():
        if not isinstance(v, DataFrame):
            try:
                json.dumps(v)
            except TypeError:
                bad.append(f"uns/{k}")
    return bad


def write(g: Grid, path: str, mode: str = "errorifexists", callback: Callable | None = None) -> None:
    """Save a grid. callback(write_elem, path, element) may replace how an element is written."""
    bad = unwriteable(g)
    if bad:
        raise ValueError(f"cannot write {bad}")
    g = g.realised()
    spark = g.obs.df.sparkSession
    have = versions(spark, path)
    if have and mode in ("error", "errorifexists"):
        raise FileExistsError(path)
    if have and mode == "ignore":
        return
    entries: dict[str, dict] = {}
    one = partial(write_elem, folder=f"w-{uuid.uuid4().hex}")

    def put(where: str, x: Any) -> None:
        f = (lambda p, e: callback(one, p, e, mode)) if callback else (lambda p, e: one(p, e, mode))
        entries[where] = f(f"{path}/{where}", x) or {"encoding-type": encoding_of(x), "encoding-version": VERSION}

    put("obs", g.obs)
    put("var", g.var)
    for k, m in g.elements.items():
        put("X" if k is None else f"layers/{check_key(k)}", m)
    for slot in ("obsm", "varm", "obsp", "varp"):
        for k, e in getattr(g, slot + "_").items():
            put(f"{slot}/{check_key(k)}", e)
    if g.raw_:
        put("raw/X", g.raw_.x)
        put("raw/var", g.raw_.var)
        for k, e in g.raw_.varm.items():
            put(f"raw/varm/{k}", e)
    frames = {k: v for k, v in g.uns.items() if isinstance(v, DataFrame)}
    for k, v in frames.items():
        put(f"uns/{check_key(k)}", v)
    _publish(spark, path, have[-1] if have else 0, {"encoding-type": "grid", "encoding-version": VERSION, "elements": entries, "uns": {k: v for k, v in g.uns.items() if k not in frames}})


def read(spark: SparkSession, path: str, *, elements: list[str] | None = None, obs_columns: list[str] | None = None, var_columns: list[str] | None = None,
         obs: Any = None, var: Any = None, callback: Callable | None = None, keys: Keys | None = None, version: int | None = None) -> Grid:
    """Load lazily; keys: rows, by key, and only of files that hold such; version: an older one. elements: which to take (such as `X`, `layers/a`, `obsm/e`; axes always); *_columns prune
    annotation; obs and var select at once. callback(read_elem, spark, path, entry) may replace how one is read."""
    manifest = snapshot(spark, path, version)
    along = lambda w: keys if w in ("obs", "X", "raw/X") or w.split("/")[0] in ("layers", "obsm", "obsp") else None
    f = (lambda w, e: callback(partial(read_elem, keys=along(w)) if keys else read_elem, spark, f"{path}/{w}", e)) if callback else (lambda w, e: read_elem(spark, f"{path}/{w}", e, along(w)))
    got = {w: f(w, e) for w, e in manifest["elements"].items() if w in ("obs", "var") or elements is None or w in elements}
    axes = {}
    for side, cols in (("obs", obs_columns), ("var", var_columns)):
        a = got[side]
        axes[side] = a if cols is None else replace(a, df=a.df.select(KEY, NAME, *cols), categories={c: v for c, v in a.categories.items() if c in cols})
    part = lambda slot: {w.split("/", 1)[1]: x for w, x in got.items() if w.startswith(slot + "/")}
    layers = ({None: got["X"]} if "X" in got else {}) | part("layers")
    raw = Raw(got["raw/X"], got["raw/var"], {w.split("/", 2)[2]: x for w, x in got.items() if w.startswith("raw/varm/")}) if "raw/X" in got else None
    g = Grid(axes["obs"], axes["var"], layers, part("obsm"), part("varm"), part("obsp"), part("varp"), manifest["uns"] | part("uns"), raw)
    if obs is not None or var is not None:
        g = g[obs if obs is not None else slice(None), var if var is not None else slice(None)]
    return g


def append(path: str, g: Grid, mark: tuple[str, int] | None = None) -> None:
    """Append rows to a stored grid. Keys must be new, and g must have every element that runs along obs, so that none is left short.

    obs, every layer, obsm, obsp and raw grow; categories that are new are added; var and what belongs to it stay. All of it
    is there at once, as a new version, or nothing is; Conflict if another writer was faster.

    mark: a stream's name and the number of its batch. The version keeps it, and a batch that a version has is not appended again."""
    spark = g.obs.df.sparkSession
    manifest = snapshot(spark, path)
    if mark:
        marks = manifest.setdefault("streams", {})
        if marks.get(mark[0], -1) >= mark[1]:
            return
        marks[mark[0]] = mark[1]
    entries = manifest["elements"]
    old = read(spark, path)
    ends = g.obs.rows.agg(F.min(KEY).alias("a"), F.max(KEY).alias("z"), F.count("*").alias("n")).first()
    if ends.n:
        near = _frame(spark, f"{path}/obs", entries["obs"], Keys.between(ends.a, ends.z))  # files whose keys lie elsewhere are not opened
        if near.join(g.obs.rows.select(KEY), KEY, "left_semi").limit(1).count():
            raise ValueError("keys exist already")
    g = g.realised()
    for mine, theirs, what in ((g.var, old.var, "columns"), *(((g.raw_.var, old.raw_.var, "raw columns"),) if g.raw_ and old.raw_ else ())):
        if mine.rows.select(KEY).join(theirs.df, KEY, "left_anti").limit(1).count():
            raise ValueError(f"{what} that the stored grid lacks")
    named = lambda x: {"X" if k is None else f"layers/{k}": m for k, m in x.elements.items()} | {f"{s}/{k}": e for s in ("obsm", "obsp") for k, e in getattr(x, s + "_").items()} | ({"raw/X": x.raw_.x} if x.raw_ else {})
    have, grow = named(g), named(old)
    if set(have) != set(grow):
        raise ValueError(f"elements along obs differ: {sorted(set(have) ^ set(grow))}")
    for where, e in grow.items():
        if encoding_of(have[where]) != encoding_of(e) or getattr(have[where], "width", None) != getattr(e, "width", None):
            raise ValueError(f"{where} is of another kind than the stored one")
    if any(isinstance(e, Blocks) for e in have.values()):
        have = {w: e.shifted(old.n_obs) if isinstance(e, Blocks) else e for w, e in have.items()}
    folder = f"w-{uuid.uuid4().hex}"
    try:
        made = write_elem(f"{path}/obs", replace(g.obs, df=g.obs.df.select(*old.obs.df.columns)), folder=folder)
        if "labels" in entries["obs"]:
            entries["obs"]["labels"] |= made["labels"]
        for where, e in have.items():
            write_elem(f"{path}/{where}", e, folder=folder)
        for where in ("obs", *have):
            entries[where] = {k: v for k, v in entries[where].items() if k != "n"} | {"folders": [*entries[where]["folders"], folder]}
        stored = entries["obs"].get("categories", {})
        for i, (c, cats) in enumerate(g.obs.categories.items()):
            if c in stored and (isinstance(cats, Dictionary) or "table" in stored[c]):
                table = lambda v: v if isinstance(v, Dictionary) else Dictionary.of_values(spark, v.values)
                stored[c] = _put_dictionary(f"{path}/obs/{folder}", f"{folder}/", i, table(old.obs.categories[c]).union(table(cats)))
            elif c in stored:
                stored[c]["values"] += [v for v in cats.values if v not in stored[c]["values"]]
        _publish(spark, path, manifest["version"], manifest)
    except BaseException:
        for where in ("obs", *have):
            fs, p = _fs(spark, f"{path}/{where}/{folder}")
            fs.delete(p, True)
        raise


def concat_on_disk(spark: SparkSession, paths: list[str] | dict[str, str], out: str, mode: str = "errorifexists", **how) -> None:
    """Concatenate stored grids into a new store; how: the options of concat(). Cells go from scans to files, none is held."""
    from gridlake.operators.concat import concat

    grids = {k: read(spark, p) for k, p in paths.items()} if isinstance(paths, dict) else [read(spark, p) for p in paths]
    write(concat(grids, **how), out, mode)


def write_csvs(g: Grid, path: str, layers: bool = True, sep: str = ",") -> list[str]:
    """One CSV folder per slot; returns what was left out (graphs, and values of uns that are no frames)."""
    g = g.realised()
    out = lambda df, name: df.write.mode("overwrite").option("header", True).option("sep", sep).csv(f"{path}/{name}")
    out(g.obs.df.drop(KEY), "obs")
    out(g.var.df.drop(KEY), "var")
    if layers and None in g.elements:
        out(g.to_df().drop(KEY).orderBy(NAME), "X")
    for slot, axis in (("obsm", g.obs), ("varm", g.var)):
        for k, a in getattr(g, slot + "_").items():
            if a.width is not None:
                out(a.to_df(k, axis).drop(KEY), f"{slot}/{k}")
    left = [f"{s}/{k}" for s in ("obsp", "varp") for k in getattr(g, s + "_")]
    for k, v in g.uns.items():
        out(v, f"uns/{k}") if isinstance(v, DataFrame) else left.append(f"uns/{k}")
    return left
