"""A fluent read with the reference's null order and cardinality rules; everything else is the DataFrame's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


class CardinalityError(Exception):
    """single() or maybe_single() found another number of rows than allowed."""


def ordered(c: str | Column, ascending: bool = True) -> Column:
    """Nulls last when ascending, first when descending."""
    c = F.col(c) if isinstance(c, str) else c
    return c.asc_nulls_last() if ascending else c.desc_nulls_first()


class Relation:
    def __init__(self, df: DataFrame, orders: tuple[Column, ...] = ()):
        self.df, self._orders = df, orders

    def select(self, columns: str = "*") -> Relation:
        names = [c.strip() for c in columns.split(",")]
        return self if names == ["*"] else Relation(self.df.select(*names), self._orders)

    def eq(self, column: str, value) -> Relation:
        return Relation(self.df.where(F.col(column) == F.lit(value)), self._orders)

    def is_in(self, column: str, values: list) -> Relation:
        return Relation(self.df.where(F.col(column).isin(values)), self._orders)

    def order(self, column: str, ascending: bool = True) -> Relation:
        return Relation(self.df, (*self._orders, ordered(column, ascending)))

    def limit(self, n: int) -> Relation:
        return Relation(self.frame().limit(n))

    def frame(self) -> DataFrame:
        return self.df.orderBy(*self._orders) if self._orders else self.df

    def single(self) -> Row:
        """The only row; an error for none or several."""
        rows = self.df.limit(2).collect()
        if len(rows) != 1:
            raise CardinalityError("none" if not rows else "several")
        return rows[0]

    def maybe_single(self) -> Row | None:
        """The only row or None; an error for several."""
        rows = self.df.limit(2).collect()
        if len(rows) > 1:
            raise CardinalityError("several")
        return rows[0] if rows else None


def or_else(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """df, or the fallback where df has no rows."""
    return df.unionByName(fallback.join(df.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"))


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with the place of each row in the order of the number column by, from 0. Ranges of by are numbered apart, then set one after the other."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)], 1000)).first()[0] if parts > 1 else None
    part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds or []))]), lambda b: b < F.col(by))) if bounds else F.lit(0)
    rows = df.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return rows.withColumn(name, within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col(name)).drop("_part", "_start")
