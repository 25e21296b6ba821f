"""Functions over labels and categories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_key(s: str) -> list:
    """Sort key that takes digit runs as numbers."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", s) if p]


def is_float(c: Column) -> Column:
    """What Python's float() accepts, but for underscores between digits."""
    number = r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity|nan))\s*$"
    return F.coalesce(c.rlike(number), F.lit(False))


def to_double(c: Column) -> Column:
    return F.expr("null").cast("double") if c is None else F.when(is_float(c), F.regexp_replace(F.trim(c), "_", "").try_cast("double"))


def convert_string(s: str):
    """A literal as float, int, bool, None or string."""
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return {"True": True, "False": False, "None": None}.get(s, s)


def make_unique(df: DataFrame, name: str, order: str, join: str = "-") -> DataFrame:
    """Suffix later occurrences of a label with the next number that gives a free label; nulls stay.

    Occurrences are counted from positions in a range sort by label and order, so a label on any share of the rows
    gathers nowhere. A suffixed label that some row has already is skipped, as many times as needed: free numbers are
    the sequence without the taken ones.
    """
    from gridlake.operators.axis import with_positions

    whole, df = df, df.select(name, order)  # annotation stays where it is
    at = with_positions(df.withColumn("_by", F.struct(name, order)), "_by", "_at").drop("_by")
    first = at.groupBy(F.col(name).alias("_label")).agg(F.min("_at").alias("_first"))
    ranked = at.join(first, F.col(name) == F.col("_label"), "left").withColumn("_rank", F.when(F.col(name).isNotNull(), F.col("_at") - F.col("_first")).otherwise(0)).drop("_label", "_first", "_at")
    later = ranked.where("_rank > 0").groupBy(F.col(name).alias("_base")).agg(F.max("_rank").alias("_most"))
    # numbers that are taken for a base: labels of the form base + join + number
    suffix = F.regexp_extract(F.col(name), re.escape(join) + r"([1-9]\d{0,17})$", 1)
    taken = (
        df.select(F.col(name), suffix.alias("_n")).where("_n <> ''").distinct()
        .select(F.expr(f"substring({name}, 1, length({name}) - length(_n) - {len(join)})").alias("_base"), F.col("_n").cast("long").alias("_n")))
    taken = taken.join(later, "_base", "left_semi").groupBy("_base").agg(F.sort_array(F.collect_set("_n")).alias("_taken"))
    numbered = ranked.join(taken, F.col(name) == F.col("_base"), "left").drop("_base")
    # the k-th free number: k plus how many taken ones lie at or below it, found by walking the sorted taken list
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_rank").cast("long"), lambda acc, t: F.when(t <= acc, acc + 1).otherwise(acc))
    new = F.when(F.col("_rank") > 0, F.concat(F.col(name), F.lit(join), free.cast("string"))).otherwise(F.col(name))
    got = numbered.select(order, new.alias(name))
    return got.select(*whole.columns) if set(whole.columns) == {name, order} else whole.drop(name).join(got, order).select(*whole.columns)


def as_structs(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    """Some columns as one column of structs, in their order and with their types; the others stay."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(*(c for c in df.columns if c not in columns), F.struct(*columns).alias(name))


def from_structs(df: DataFrame, name: str = "value") -> DataFrame:
    """A column of structs as columns of their own, in the struct's order; the others stay."""
    fields = df.schema[name].dataType.names
    clash = [f for f in fields if f in df.columns and f != name]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    return df.select(*(c for c in df.columns if c != name), *(F.col(name)[f].alias(f) for f in fields))
