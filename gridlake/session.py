"""Session defaults and settings."""

from __future__ import annotations

import contextlib
import tempfile
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "gridlake", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


@dataclass(frozen=True)
class Settings:
    """Options of the engine; change them with override()."""

    remove_unused_categories: bool = True
    check_uniqueness: bool = True
    disallow_slash_in_keys: bool = True
    restrict_index_types: bool = True
    #: Categories of a column are kept on the driver up to so many, and as a table (a Dictionary) beyond.
    local_categories: int = 100_000
    #: to_memory() refuses more rows than these.
    max_local_rows: int = 5_000_000
    #: More cells than this are not made when a fill value makes a sparse concatenation dense.
    max_filled_cells: int = 10_000_000_000


_current = [Settings()]


def settings() -> Settings:
    return _current[-1]


@contextlib.contextmanager
def override(**changes):
    unknown = set(changes) - {f.name for f in fields(Settings)}
    if unknown:
        raise AttributeError(f"no such setting: {sorted(unknown)}")
    _current.append(replace(settings(), **changes))
    try:
        yield settings()
    finally:
        _current.pop()


def reset() -> None:
    _current[:] = [Settings()]


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridlake-"))
    return df.checkpoint(eager=True)
