"""Nested values of any depth (lists of lists of structs ...), led by their types: made alike, measured, cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StructField, StructType

WIDER: list[DataType] = [ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType()]


def common_type(a: DataType, b: DataType, join: str) -> DataType:
    """What both can be: at every depth the fields that both have (inner) or any has (outer), and the wider of two numbers."""
    if isinstance(a, NullType):
        return b
    if isinstance(b, NullType) or a == b:
        return a
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(common_type(a.elementType, b.elementType, join))
    if isinstance(a, StructType) and isinstance(b, StructType):
        mine, theirs = ({f.name: f.dataType for f in t} for t in (a, b))
        names = [n for n in mine if join == "outer" or n in theirs] + [n for n in theirs if join == "outer" and n not in mine]
        return StructType([StructField(n, common_type(mine[n], theirs[n], join) if n in mine and n in theirs else mine.get(n, theirs.get(n))) for n in names])
    if a in WIDER and b in WIDER:
        both = {a, b}
        return DoubleType() if both & {WIDER[4], WIDER[5]} and len(both) == 2 else max(a, b, key=WIDER.index)
    raise ValueError(f"{a.simpleString()} and {b.simpleString()} have no common type")


def conformed(c: Column, have: DataType, want: DataType) -> Column:
    """A value of one type as another: lists item by item, structs field by field (null where one is new), leaves by cast. Nulls stay nulls."""
    if have == want:
        return c
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(c, lambda x: conformed(x, have.elementType, want.elementType))
    if isinstance(want, StructType) and isinstance(have, StructType):
        mine = {f.name: f.dataType for f in have}
        made = F.struct(*((conformed(c[f.name], mine[f.name], f.dataType) if f.name in mine else F.lit(None).cast(f.dataType)).alias(f.name) for f in want))
        return F.when(c.isNotNull(), made)
    return c.cast(want)


def alike(frames: list[DataFrame | None], join: str) -> list[DataFrame | None]:
    """(_key, value) frames with values of one type."""
    have = [f.schema["value"].dataType for f in frames if f is not None]
    want = reduce(lambda a, b: common_type(a, b, join), have)
    return [f if f is None else f.select("_key", conformed(F.col("value"), f.schema["value"].dataType, want).alias("value")) for f in frames]


def depth(t: DataType) -> int:
    """Lists in lists."""
    return 1 + depth(t.elementType) if isinstance(t, ArrayType) else 0


def sizes(df: DataFrame, dim: int) -> DataFrame:
    """(size) of every list at a depth: 1 is the values themselves, 2 the lists in them."""
    t = df.schema["value"].dataType
    if not 1 <= dim <= depth(t):
        raise IndexError(f"dimension {dim} of {1 + depth(t)}")
    df = df.select("value")
    for _ in range(dim - 1):
        df = df.select(F.explode("value").alias("value"))
    return df.select(F.size("value").alias("size"))


def cut(c: Column, t: DataType, *at: slice | int) -> Column:
    """Items of nested lists by place, a slice or a number for each depth; a number takes its list away, and is null where it is too short."""
    if not at:
        return c
    if not isinstance(t, ArrayType):
        raise IndexError(f"{t.simpleString()} has no places")
    first, rest = at[0], at[1:]
    if isinstance(first, int):
        return cut(F.get(c, first) if first >= 0 else F.try_element_at(c, F.lit(first)), t.elementType, *rest)
    n = F.size(c)
    end = lambda x, default: default if x is None else F.lit(x) if x >= 0 else F.greatest(n + x, F.lit(0))
    low, high = F.least(end(first.start, F.lit(0)), n), F.least(end(first.stop, n), n)
    if first.step not in (None, 1):
        raise IndexError("nested lists are cut without steps")
    some = F.slice(c, low + 1, F.greatest(high - low, F.lit(0)))
    return F.transform(some, lambda x: cut(x, t.elementType, *rest)) if rest else some
