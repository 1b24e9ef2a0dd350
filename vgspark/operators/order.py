"""Ranks, running totals and components over tables of any size: no group of rows is held by one task.

Rows are sorted by ranges. What a task's range holds of a group is counted there; only a number for each range and group goes on
from range to range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, kept


def _sorted(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` by ranges, stored, with ``_part`` (the range) and ``_at`` (increasing)."""
    at = F.monotonically_increasing_id()
    rows = kept(df.orderBy(*by, *order).withColumn("_at", at))
    return rows.withColumn("_part", F.shiftright("_at", 33))


def _same(l: DataFrame, r: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (l[c].eqNullSafe(r[f"_{c}"]) for c in cols))


def _ends(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``(by.., _part, _own)`` of the first and the last group of each range: a group that goes on from range to range is one of them in each."""
    own, part = rows.groupBy(*by, "_part").agg(value.alias("_own"), F.min("_at").alias("_low")), Window.partitionBy("_part")
    return own.withColumns({"_first": F.min("_low").over(part), "_last": F.max("_low").over(part)}).where("_low = _first OR _low = _last")


def _carried(rows: DataFrame, by: list[str], value: Column, merged) -> DataFrame:
    """``(_by.., __part, _before)``: what the earlier ranges have of a group, where they have any."""
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return _named(_ends(rows, by, value).withColumn("_before", merged(F.col("_own")).over(w)), by)


def _named(carried: DataFrame, by: list[str]) -> DataFrame:
    return carried.where("_before IS NOT NULL").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("__part"), "_before")


def _joined(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(F.broadcast(carried), _same(rows, carried, by) & (rows["_part"] == carried["__part"]) if by else rows["_part"] == carried["__part"], "left")


def numbered(df: DataFrame, order: list[str | Column], by: list[str] = (), name: str = "nth", start: int = 1) -> DataFrame:
    """``df`` with each row's number in the order of its group. What is broadcast is a row for each task's range.

    Rows that ``order`` leaves tied are numbered in any order. Null groups are groups.
    """
    by = list(by)
    rows = _sorted(df, by, order)
    carried = _carried(rows, by, F.count("*"), F.sum)
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy("_at"))
    out = _joined(rows.withColumn("_nth", own), carried, by)
    return out.withColumn(name, (F.col("_nth") + F.coalesce("_before", F.lit(0)) + (start - 1)).cast("long")).select(*df.columns, name)


def running(df: DataFrame, order: list[str | Column], value: str, name: str, by: list[str] = (), kind: str = "sum", itself: bool = True) -> DataFrame:
    """``df`` with the sum or the maximum of ``value`` over the rows of its group up to each, ``itself`` included or not; null where there is none."""
    by, total, both = list(by), {"sum": F.sum, "max": F.max}[kind], {"sum": lambda x, y: F.coalesce(x + y, x, y), "max": F.greatest}[kind]
    rows = _sorted(df, by, order)
    carried = _carried(rows, by, total(value), total)
    upto = total(value).over(Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if itself else -1))
    out = _joined(rows.withColumn("_upto", upto), carried, by)
    return out.withColumn(name, both(F.col("_upto"), F.col("_before"))).select(*df.columns, name)


def following(df: DataFrame, order: list[str | Column], value: str, name: str, by: list[str] = ()) -> DataFrame:
    """``df`` with the ``value`` of the next row of the group; null for the last one."""
    by = list(by)
    rows = _sorted(df, by, order)
    w = Window.partitionBy(*by).orderBy("_part")
    after = _named(_ends(rows, by, F.min_by(value, "_at")).withColumn("_before", F.lead("_own").over(w)), by)
    here = F.lead(value).over(Window.partitionBy("_part", *by).orderBy("_at"))
    last = F.lead("_at").over(Window.partitionBy("_part", *by).orderBy("_at")).isNull()
    out = _joined(rows.withColumn("_next", here).withColumn("_last", last), after, by)
    return out.withColumn(name, F.when(F.col("_last"), F.col("_before")).otherwise(F.col("_next"))).select(*df.columns, name)


def components(edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``(keys.., node, root)`` of the nodes of ``(keys.., a, b)``; the root is the least node that can be reached.

    Large stars and small stars by turns, until nothing moves: each step joins a node with its least neighbour, so a node with many neighbours can be split.
    """
    keys = list(keys)
    turned = lambda d: d.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"))
    e = kept(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    mark = None
    while True:
        both = e.unionByName(turned(e))
        low = both.groupBy(*keys, "x").agg(F.min("y").alias("m")).select(*keys, "x", F.least("m", "x").alias("m"))
        large = kept(both.join(low, [*keys, "x"]).where("y > x").select(*keys, F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        low = large.groupBy(*keys, "x").agg(F.min("y").alias("m"))
        small = large.join(low, [*keys, "x"]).select(*keys, F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("s"))
        after = kept(small.select(*keys, F.col("s.x").alias("x"), F.col("s.y").alias("y")).where("x <> y").distinct())
        now = after.agg(F.count("*"), F.sum(F.xxhash64(*keys, "x", "y").cast("decimal(38,0)"))).first()
        dropped(e, large)
        e = after
        if now == mark:
            return e.select(*keys, F.col("x").alias("node"), F.col("y").alias("root")).unionByName(e.select(*keys, F.col("y").alias("node"), F.col("y").alias("root")).distinct())
        mark = now
