"""Text sources: delimited matrices, long counts, and coordinate files."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.names import convert_string, is_float, to_double
from gridlake.operators.axis import KEY, NAME, Axis
from gridlake.operators.element import Matrix
from gridlake.operators.grid import Grid
from gridlake.session import materialise


def _number(s: str) -> bool:
    return isinstance(convert_string(s.strip()), float) or (s.strip().lstrip("+-").replace("_", "").isdigit())


def _fields(line: str, delimiter: str | None) -> list[str]:
    return line.split(delimiter) if delimiter else line.split()


#: Where a line stands: by file name, then by its place in the file.
_AT = "struct(_metadata.file_path AS f, _metadata.file_block_start AS b) AS _file"


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines that are not empty with their number, part files in the order of their names.

    Nothing is sorted: a split's lines have ids that count on, and what stands before a split comes from counts. Lines are written once, so that ids hold."""
    local = materialise(lines.where("line <> ''").select("line", "_file", F.monotonically_increasing_id().alias("_i")))
    splits = local.groupBy("_file").agg(F.count("*").alias("n"), F.min("_i").alias("a")).orderBy("_file").collect()  # a row a split of a file
    before = accumulate((r.n for r in splits), initial=0)
    starts = local.sparkSession.createDataFrame([(r["_file"], b - r.a) for r, b in zip(splits, before)], "_file struct<f string, b long>, _start long")
    return local.join(starts, "_file").withColumn("n", F.col("_start") + F.col("_i")).drop("_i", "_start", "_file")


def read_text(spark: SparkSession, path: str, delimiter: str | None = None, first_column_names: bool | None = None) -> Grid:
    """A delimited matrix (plain, .gz or .bz2) as a dense grid.

    Lines that start with # are comments, and the last one may hold the column names. The first other line is a
    header if its last field is no number; the first column holds row names if its field is no number. Spark reads
    the rest; the driver sees the leading lines only.
    """
    numbered = _numbered(spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"), F.expr(_AT)))
    head: list[tuple[int, str]] = []
    comments: list[str] = []
    size = 64
    while True:  # leading lines until two that are no comments
        got = [(r.n, r.line) for r in numbered.where(F.col("n") < size).orderBy("n").collect()]
        head = [(n, x) for n, x in got if not x.startswith("#")]
        comments = [c for _, x in got if x.startswith("#") and (c := x.lstrip("# "))]
        if len(head) > 2 or len(got) < size:
            break
        size *= 4
    if not head:
        raise ValueError(f"no rows in {path}")
    first_at, first = head[0]
    if delimiter is not None and delimiter not in first:
        raise ValueError(f"delimiter {delimiter!r} is not in the first line")
    f = _fields(first, delimiter)
    header = None
    data_from = first_at
    if not _number(f[-1]):
        header, data_from = f, first_at + 1
    elif first_column_names is None and not _number(f[0]):
        first_column_names = True
    body = [x for n, x in head if n >= data_from]
    if first_column_names is None:
        first_column_names = bool(body) and not _number(_fields(body[0], delimiter)[0]) or (len(body) > 1 and not _number(_fields(body[1], delimiter)[0]))
    if len(body) > 1 and header is None and not first_column_names and len(_fields(body[0], delimiter)) != len(_fields(body[1], delimiter)):
        header, first_column_names = [str(int(float(x))) for x in _fields(body[0], delimiter)], True  # integers as names
        data_from += 1
        body = body[1:]
    width = len(_fields(body[0], delimiter)) - bool(first_column_names)
    if header is None:
        header = comments[-1].split() if comments else [str(i) for i in range(width)]
    if len(header) > width:
        header = header[1:]
    if len(header) != width:
        raise ValueError(f"{len(header)} column names for {width} columns")
    header = [h.strip('"') for h in header]
    cut = F.split("line", r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E")
    rows = numbered.where((F.col("n") >= data_from) & ~F.col("line").startswith("#")).select((F.col("n") - data_from).alias("n"), cut.alias("f"))
    uneven = rows.where(F.size("f") != width + bool(first_column_names)).limit(1).collect()
    if uneven:
        raise ValueError(f"line {uneven[0].n} has {len(uneven[0].f)} fields, the first {width + bool(first_column_names)}")
    name = F.regexp_replace(F.get("f", 0), '^"+|"+$', "") if first_column_names else F.col("n").cast("string")
    rows = rows.select("n", name.alias("name"), (F.slice("f", 2, width) if first_column_names else F.col("f")).alias("f"))
    cells = rows.select(F.col("n").alias("o"), F.posexplode("f").alias("v", "t"))
    bad = cells.where(~is_float(F.col("t"))).limit(1).collect()
    if bad:
        raise ValueError(f"no number: {bad[0].t!r} in row {bad[0].o}")
    return Grid(Axis.of(rows, "n", "name", []), Axis.of_names(spark, header), {None: Matrix(cells.select("o", F.col("v").cast("long").alias("v"), to_double(F.col("t")).alias("value")), False)})


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", first_column_names: bool | None = None) -> Grid:
    return read_text(spark, path, delimiter, first_column_names)


def from_long(df: DataFrame, obs: str, var: str, value: str) -> Grid:
    """A long table (row label, column label, value) as a sparse grid; axes are the sorted distinct labels."""
    axis = lambda c: Axis(df.select(F.col(c).cast("string").alias(KEY)).where(F.col(KEY).isNotNull()).distinct().withColumn(NAME, F.col(KEY)))
    cells = df.groupBy(F.col(obs).cast("string").alias("o"), F.col(var).cast("string").alias("v")).agg(F.sum(value).alias("value"))
    return Grid(axis(obs), axis(var), {None: Matrix(cells, True)})


def read_umi(spark: SparkSession, path: str) -> Grid:
    """Tab-separated gene, cell, count; cells become rows."""
    return from_long(spark.read.option("sep", "\t").option("header", True).csv(path, schema="gene string, cell string, count double"), "cell", "gene", "count")


def read_mtx(spark: SparkSession, path: str) -> Grid:
    """A Matrix Market coordinate file (general or symmetric, real, integer or pattern), or an array file (column by column). It may be cut into part files."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.expr(_AT)).where("line <> ''")
    banner = next((r[0] for r in lines.where(F.col("line").startswith("%%")).limit(1).collect()), "%%MatrixMarket matrix coordinate real general").lower().split()
    data = lines.where(~F.col("line").startswith("%"))
    head = data.select("line", F.struct("_file", F.monotonically_increasing_id()).alias("at")).agg(F.min_by("line", "at").alias("line")).first().line
    if head is None:
        raise ValueError(f"no size in {path}")
    size = head.split()
    rows, cols = int(size[0]), int(size[1])
    f = F.split("line", r"\s+")
    if "array" in banner:
        at, k = _numbered(data), F.col("n") - 1
        cells = at.where("n > 0").select((k % rows).alias("o"), F.floor(k / rows).alias("v"), F.col("line").cast("double").alias("value"))
        m = Matrix(cells, False)
    else:
        # Cells say where they are, so lines need no order: the size goes, and cells that read like it stay.
        alike = data.where(F.col("line") == head).count() - 1
        entries = data.where(F.col("line") != head).select("line")
        if alike:
            entries = entries.unionByName(spark.range(alike).select(F.lit(head).alias("line")))
        value = F.lit(1.0) if "pattern" in banner else F.get(f, 2).cast("double")
        cells = entries.select((F.get(f, 0).cast("long") - 1).alias("o"), (F.get(f, 1).cast("long") - 1).alias("v"), value.alias("value"))
        if "symmetric" in banner:
            cells = cells.unionByName(cells.where("o <> v").select(F.col("v").alias("o"), F.col("o").alias("v"), "value"))
        m = Matrix(cells, True)
    axis = lambda n: Axis(spark.range(n).select(F.col("id").alias(KEY), F.col("id").cast("string").alias(NAME)), _n=n)
    return Grid(axis(rows), axis(cols), {None: m})


def read_excel(spark: SparkSession, path: str, sheet: str | int) -> Grid:
    """A sheet whose first column holds row names (needs pandas and an Excel reader on the driver)."""
    import pandas as pd

    df = pd.read_excel(path, sheet, index_col=0)
    df.columns = [str(c) for c in df.columns]
    frame = spark.createDataFrame(df.astype(float).reset_index(names="_row").assign(_row=lambda d: d["_row"].astype(str), _at=range(len(df))))
    return Grid.from_frame(frame, "_at", "_row", columns=list(df.columns))
