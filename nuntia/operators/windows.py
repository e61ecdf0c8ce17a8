"""Sequences: values carried forward, numbering, chunks, first rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from nuntia.functions.text import col
from nuntia.operators.stored import discard, stored


def sticky(value: Column | str, by: list, order: list) -> Column:
    """The last value that isn't null, up to and including the row. One task holds a group; for groups of any size see
    carried()."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(value, ignorenulls=True).over(frame)


def numbered(by: list, order: list) -> Column:
    """1, 2, 3 … within each group."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")


def sorted_parts(df: DataFrame, by: list, order: list, name: str) -> tuple[DataFrame, list[str]]:
    """df sorted by group and a total order and stored, with a column for each of by, _part, the task that sorted the row,
    and _place, which grows with the order; and the names of the columns of by.

    A group of any size spreads over the parts that it needs, and only the first group of a part can have begun in an
    earlier one. Sorting is a job of its own: the input is read once for the limits of the parts and once to be sorted.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select("*", *[col(b).alias(k) for b, k in zip(by, keys, strict=True)])
    rows = rows.orderBy(*keys, *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    return stored(rows, name), keys


def same_part(keys: list[str]) -> Column:
    """Whether a row belongs to the group and part of another, whose columns end with an underscore."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.col("_part") == F.col("_part_"))


def other_side(keys: list[str]) -> list[Column]:
    return [*[F.col(k).alias(f"{k}_") for k in keys], F.col("_part").alias("_part_")]


def of_group(keys: list[str]) -> WindowSpec:
    """The parts of each group in order. One row a group and part: a group has no more than the parts it spreads over."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part")


def places(df: DataFrame, by: list, order: list, name: str) -> DataFrame:
    """df with each row's place (from 0) within its group, in a total order, as a new column.

    Each task numbers its own part of a group, and continues where the parts before it end.
    """
    rows, keys = sorted_parts(df, by, order, "sorted")
    parts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    parts = parts.withColumn("_before", F.sum("_n").over(of_group(keys)) - F.col("_n"))
    out = rows.join(parts.select(*other_side(keys), "_first", "_before"), same_part(keys)).withColumn(name, F.col("_before") + F.col("_place") - F.col("_first"))
    return out.select(*df.columns, name)


#: Rows of a group up to which one task carries its values forward.
IN_ONE_TASK = 1 << 20


def carried(df: DataFrame, values: dict[str, Column | str], by: list, order: list, most: int = IN_ONE_TASK) -> DataFrame:
    """df with, for each of values, the last value that isn't null up to and including the row, in a total order.

    Like sticky(), for groups of any size. Groups of at most `most` rows, which one count by group tells, are carried
    forward by a window. Those above, and the whole table where by is empty, go through a segmented scan.
    """
    if not by:
        return segmented(df, values, by, order)
    keys = [f"_of{i}" for i in range(len(by))]
    named = df.select("*", *[col(b).alias(k) for b, k in zip(by, keys, strict=True)])
    large = stored(named.groupBy(*keys).count().where(F.col("count") > most).select(*[F.col(k).alias(f"{k}_") for k in keys]), "large")
    by_window = lambda rows: rows.select(*df.columns, *[sticky(v, by, order).alias(name) for name, v in values.items()])
    if large.isEmpty():
        discard(large)
        return by_window(df)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    small, hot = (named.join(large, same, how).drop(*keys) for how in ("left_anti", "left_semi"))
    return by_window(small).unionByName(segmented(hot, values, by, order))


def segmented(df: DataFrame, values: dict[str, Column | str], by: list, order: list) -> DataFrame:
    """carried() by a segmented scan, whatever the size of the groups.

    1. Rows are sorted by group and order over all tasks, so a group takes as many parts as it needs.
    2. Each group's last value in each part is passed on to the group's later parts: an exclusive scan over one row a
       group and part. Only what a part has to take over from earlier ones is kept, at most a row a part.
    3. Within its part a row takes the last value, and the part's inheritance before the first of them.
    """
    names = list(values)
    rows, keys = sorted_parts(df.select("*", *[col(v).alias(f"_value{i}") for i, v in enumerate(values.values())]), by, order, "segments")
    here = [f"_value{i}" for i in range(len(names))]
    parts = rows.groupBy(*keys, "_part").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_place"))).alias(v) for v in here])
    before = of_group(keys).rowsBetween(Window.unboundedPreceding, -1)
    inherited = parts.select(*other_side(keys), *[F.last(v, ignorenulls=True).over(before).alias(f"{v}_") for v in here])
    inherited = inherited.where(F.coalesce(*[F.col(f"{v}_").cast("string") for v in here]).isNotNull())
    local = Window.partitionBy(*keys, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.select("*", *[F.last(v, ignorenulls=True).over(local).alias(f"{v}_here") for v in here])
    out = filled.join(F.broadcast(inherited), same_part(keys), "left")
    return out.select(*df.columns, *[F.coalesce(f"{v}_here", f"{v}_").alias(n) for v, n in zip(here, names, strict=True)])


def joined_pieces(df: DataFrame, value: Column | str, by: list[str], order: list, size: int, separator: str = ", ") -> DataFrame:
    """by, piece (from 0), joined and n: each group's values as text, in order, in pieces of `size` values, so that a group of
    any size spreads over tasks; the pieces, joined in their order, are the whole text."""
    rows = places(df.select(*by, *[o for o in order if o not in by], col(value).alias("_text")), by, order, "_at")
    rows = rows.withColumn("piece", F.floor(F.col("_at") / size).cast("long"))
    held = F.array_sort(F.collect_list(F.struct("_at", F.col("_text").cast("string").alias("t"))))
    return rows.groupBy(*by, "piece").agg(F.array_join(F.transform(held, lambda x: x["t"]), separator).alias("joined"), F.count("*").alias("n"))


def chunked(df: DataFrame, size: int, by: list, order: list) -> DataFrame:
    """Adds chunk (from 0), chunk_pos (from 0 in the chunk) and is_first (of its group), within each group."""
    place = F.col("_at")
    out = places(df, by, order, "_at").withColumn("chunk", F.floor(place / size).cast("int"))
    return out.withColumn("chunk_pos", (place % size).cast("int")).withColumn("is_first", place == 0).drop("_at")


def first_per_key(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key. Spark keeps a group limit below the shuffle, so a frequent key costs little."""
    return df.withColumn("_place", numbered(key, order)).where("_place = 1").drop("_place")


def numbered_overall(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """1, 2, 3 … over all rows in a total order, without moving them to one task."""
    return places(df, [], order, "_at").withColumn(name, F.col("_at") + 1).drop("_at")
