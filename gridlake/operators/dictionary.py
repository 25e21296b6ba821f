"""Category dictionaries as tables: for columns with more categories than a driver should hold.

A dictionary is lazy: keeping the used values is a semi-join, a union a distinct, and no job runs until someone asks for codes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def natural_order(c: Column) -> Column:
    """Sorts text with runs of digits as numbers of any size: by length without leading zeros, then digit by digit."""
    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        number = p.rlike(r"^[0-9]+$")
        return F.struct(F.when(number, 0).otherwise(1).alias("kind"), F.when(number, F.length(digits)).otherwise(0).alias("size"), F.when(number, digits).otherwise(p).alias("text"))

    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part)


def _place(c: Column) -> Column:
    """An order by numbers given, of the same type."""
    text = c.cast("string")
    return F.array(F.struct(F.lit(0).alias("kind"), F.length(text).alias("size"), text.alias("text")))


@dataclass(frozen=True)
class Dictionary:
    """Categories (value, by): values are distinct, `by` is their order."""

    table: DataFrame
    ordered: bool = False

    @staticmethod
    def of(rows: DataFrame, column: str, ordered: bool = False) -> Dictionary:
        """The values of a column, in natural order."""
        v = rows.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct()
        return Dictionary(v.select("value", natural_order(F.col("value")).alias("by")), ordered)

    @staticmethod
    def of_values(spark: SparkSession, values: Iterable[str], ordered: bool = False) -> Dictionary:
        """Values in the order given."""
        df = spark.createDataFrame(list(enumerate(values)), "at long, value string")
        return Dictionary.at_places(df, "at", ordered)

    @staticmethod
    def at_places(df: DataFrame, place: str, ordered: bool = False) -> Dictionary:
        """From (place, value)."""
        return Dictionary(df.select("value", _place(F.col(place)).alias("by")), ordered)

    def kept(self, rows: DataFrame, column: str) -> Dictionary:
        """Those that a column of some rows has."""
        return replace(self, table=self.table.join(rows.select(F.col(f"`{column}`").alias("value")), "value", "left_semi"))

    def union(self, *others: Dictionary) -> Dictionary:
        """All values, in natural order."""
        every = self.table.select("value")
        for o in others:
            every = every.union(o.table.select("value"))
        return Dictionary.of(every, "value")

    def renamed(self, names: Mapping[str, str]) -> Dictionary:
        """Other names for some values, at their places; they must stay distinct."""
        new = self.table.withColumn("value", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("value")), F.col("value"))) if names else self.table
        if new.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError("categories would not be unique")
        return replace(self, table=new)

    def coded(self) -> DataFrame:
        """(value, code): codes count from 0 in the order."""
        from gridlake.operators.axis import with_positions

        return with_positions(self.table.select("value", F.struct("by", "value").alias("_by")), "_by", "code").select("value", "code")

    def same_as(self, other: Dictionary) -> bool:
        from gridlake.operators.axis import same_rows

        return self is other or self.ordered == other.ordered and same_rows(self.table, other.table)

    def count(self) -> int:
        return self.table.count()

    def head(self, n: int) -> list[str]:
        return [r.value for r in self.table.orderBy("by", "value").limit(n).collect()]
