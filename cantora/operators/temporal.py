"""Ordered-table kit: islands, edges, interval joins, nearest joins, anchor groups, n-grams.

Interval and nearest joins are unions and running windows, so they cost a sort of both sides by recording, never a product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def islands(df: DataFrame, keys: list[str], order: list, linked: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows that are each linked to the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_break", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def rapid_pairs(df: DataFrame, keys: list[str], order: list, linked: Column) -> DataFrame:
    """Pairs 1-2, 3-4, .. within runs of linked rows: a ``pair`` number within the run (``island``)."""
    rows = islands(df, keys, order, linked)
    nth = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order)) - 1
    return rows.withColumn("pair", F.floor(nth / 2).cast("long"))


def spaced(df: DataFrame, keys: list[str], at: str, wait: int) -> DataFrame:
    """Of each key's rows in order those that lie more than ``wait`` behind the last one taken. Only runs of rows that are closer
    than that to one another are walked through."""
    order = Window.partitionBy(*keys).orderBy(at)
    rows = islands(df, keys, [at], F.col(at) - F.lag(at).over(order) <= wait, "_run")
    rows = rows.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(at, *[c for c in df.columns if c not in (at, *keys)]))).alias("_rows"))
    none = F.struct(F.lit(None).cast(df.schema[at].dataType).alias("last"), F.slice("_rows", 1, 0).alias("taken"))
    take = lambda s, r: F.when(s["last"].isNull() | (r[at] - s["last"] > wait), F.struct(r[at].alias("last"), F.concat(s["taken"], F.array(r)).alias("taken"))).otherwise(s)
    return rows.select(*keys, F.explode(F.aggregate("_rows", none, take, lambda s: s["taken"])).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def even_grid(bounds: DataFrame, points: Column, end: str = "end") -> DataFrame:
    """file_id, i, t: so many points from 0 to the end of each file, both included."""
    rows = bounds.withColumn("_n", points).where("_n > 0").select("file_id", end, "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
    return rows.select("file_id", "i", F.when(F.col("_n") > 1, F.col(end) * F.col("i") / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias("t"))


def count_covering(grid: DataFrame, intervals: DataFrame, start: str = "start_tick", end: str = "end_tick") -> DataFrame:
    """grid (file_id, i, t) with the number of closed intervals that hold t: starts at or before t less ends before t."""
    points = grid.select("file_id", F.col("t").cast("double").alias("x"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "i", "t")
    none = F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("t")
    begins = intervals.select("file_id", F.col(start).cast("double").alias("x"), F.lit(0).alias("kind"), F.lit(1).alias("step"), *none)
    ends = intervals.select("file_id", F.col(end).cast("double").alias("x"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), *none)
    w = Window.partitionBy("file_id").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return points.unionByName(begins).unionByName(ends).withColumn("n", F.sum("step").over(w)).where("kind = 1").select("file_id", "i", "t", "n")


def nearest(left: DataFrame, right: DataFrame, key: str = "file_id", at: str = "t", tolerance: float | None = None, name: str = "nearest") -> DataFrame:
    """left with the closest value of right in ``name``, ties to the smaller; null beyond the tolerance."""
    tag = F.struct(*left.columns)
    rows = left.select(key, F.col(at).alias("_x"), tag.alias("_row"), F.lit(None).cast(left.schema[at].dataType).alias("_there"))
    other = right.select(key, F.col(at).alias("_x"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(at).cast(left.schema[at].dataType).alias("_there")).distinct()
    w = Window.partitionBy(key).orderBy("_x")
    before = F.last("_there", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(key).orderBy(F.desc("_x"))  # a running frame from the other end; frames up to the end cost a square
    after = F.last("_there", ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, 0))
    out = rows.unionByName(other).withColumn("_b", before).withColumn("_a", after).where("_row is not null")
    pick = F.when(F.col("_a").isNull() | ((F.col("_x") - F.col("_b")) <= (F.col("_a") - F.col("_x"))), F.col("_b")).otherwise(F.col("_a"))
    out = out.select("_row.*", pick.alias(name))
    return out if tolerance is None else out.withColumn(name, F.when(F.abs(F.col(name) - F.col(at)) <= tolerance, F.col(name)))


def edges(df: DataFrame, down: Column, order: str = "t") -> DataFrame:
    """Rows where a state changes, up at first, and one up at the end of a file that ends down. df: file_id, t; end: file_id, end."""
    w = Window.partitionBy("file_id").orderBy(order)
    rows = df.withColumn("down", down)
    return rows.withColumn("_before", F.lag("down", 1, False).over(w)).where("down <> _before").select("file_id", order, "down")


def drop_short(events: DataFrame, least: float, order: str = "t") -> DataFrame:
    """A down and its next go if they are less than ``least`` apart; other rows and files of one event stay."""
    w = Window.partitionBy("file_id").orderBy(order)
    rows = events.select("*", F.lead(order).over(w).alias("_next"), F.lag(order).over(w).alias("_last"), F.lag("down").over(w).alias("_was"), F.count("*").over(Window.partitionBy("file_id")).alias("_n"))
    short_down = F.col("down") & ((F.col("_next") - F.col(order)) < least)
    short_up = ~F.col("down") & F.coalesce(F.col("_was"), F.lit(False)) & ((F.col(order) - F.col("_last")) < least)
    return rows.where((F.col("_n") < 2) | ~(F.coalesce(short_down, F.lit(False)) | F.coalesce(short_up, F.lit(False)))).drop("_next", "_last", "_was", "_n")


def folded(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str | T.StructType) -> DataFrame:
    """Rows of each key, in order, through a fold whose state is all that is held: step(state, rows) gives the next state and rows to put
    out (or None), from batches of rows of one key; at a key's end rows are None. A key of any length needs one batch of
    memory besides the state, which starts as None.

    Rows are dealt out by a hash of the keys. By the keys themselves, they would be left as a join or window below has dealt them; that isn't
    kept where a join becomes a broadcast as it runs, as nothing tells Spark that the fold relies on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            values = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            i = 0
            while i < len(values):
                j = i + 1
                while j < len(values) and values[j] == values[i]:
                    j += 1
                if values[i] != current and current is not None:
                    state, out = step(state, None)
                    if out is not None:
                        yield out
                    state = None
                current = values[i]
                state, out = step(state, batch.slice(i, j - i))
                if out is not None:
                    yield out
                i = j
        if current is not None:
            _, out = step(state, None)
            if out is not None:
                yield out

    rows = df.select(*keys, *[c for c in df.columns if c not in keys])
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def anchor_groups(df: DataFrame, within: int, keys: list[str], at: str, tie: str) -> DataFrame:
    """(keys, at, tie, group): a group holds the rows within so many ticks of its first row, which is where the last group ended:
    a jump from anchor to anchor over each key's sorted rows, of which the last anchor is carried on."""
    rows = df.select(*keys, F.col(at).cast("long").alias(at), F.col(tie).cast("long").alias(tie))
    names = [*rows.columns, "group"]

    def step(state: tuple[int, int] | None, batch: pa.RecordBatch | None):
        if batch is None:
            return None, None
        t = batch.column(len(keys)).to_numpy()
        anchor, group = state or (t[0] - within - 1, 0)
        out, i = np.empty(len(t), np.int32), 0
        while i < len(t):
            j = int(np.searchsorted(t, anchor + within, side="right"))
            out[i:j] = group
            i = max(i, j)
            if i < len(t):
                anchor, group = t[i], group + 1
        return (anchor, group), pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names)

    return folded(rows, keys, [at, tie], step, T.StructType([*rows.schema.fields, T.StructField("group", T.IntegerType())]))


def wasserstein(a: DataFrame, b: DataFrame, key: str = "file_id", value: str = "v") -> DataFrame:
    """1-D distance of two samples a key: the area between their distribution functions."""
    both = a.select(key, F.col(value).alias("v"), F.lit(1).alias("is_a")).unionByName(b.select(key, F.col(value).alias("v"), F.lit(0).alias("is_a")))
    at = both.groupBy(key, "v").agg(F.sum("is_a").alias("na"), F.sum(1 - F.col("is_a")).alias("nb"))
    w, run = Window.partitionBy(key), Window.partitionBy(key).orderBy("v")
    at = at.select("*", (F.sum("na").over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("na").over(w)).alias("ca"), (F.sum("nb").over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("nb").over(w)).alias("cb"), F.lead("v").over(run).alias("next"))
    return at.groupBy(key).agg(F.coalesce(F.sum(F.abs(F.col("ca") - F.col("cb")) * (F.col("next") - F.col("v"))), F.lit(0.0)).alias("distance"))
