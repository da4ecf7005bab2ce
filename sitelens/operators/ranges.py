"""Ordered operators: as-of and exact position lookups, interval algebra, runs, bins, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], tie: str | None = None) -> DataFrame:
    """The latest right row at or before each left row's position, by keys; nulls if there is none.

    Both sides are unioned and one window per key carries the last right row forward, so
    the cost is a sort and never a product. ``tie`` breaks equal positions of the right side.
    """
    ours, payload = [c for c in left.columns], F.struct(*[F.col(v) for v in values]).alias("_value")
    blank = F.lit(None)
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*ours).alias("_row"))
    b = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), (F.col(tie).cast("long") if tie else blank.cast("long")).alias("_tie"), payload)
    rows = a.unionByName(b, allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last("_value", ignorenulls=True).over(window)).filter("_side = 1")
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(f"{v}_found" if v in ours else v) for v in values])


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Points with the values of the innermost interval [start, end) of their keys that holds them; nulls if none does.

    Intervals of one key nest or are apart; equal ones count as one, of which any values
    are given. One sorted pass keeps a stack of open intervals, so the cost is a sort and
    memory the depth of nesting, however many rows a key has. Points with a null place or
    key are in none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in intervals.schema.fields}
    a = points.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_end"), F.struct(*points.columns).alias("_row"))
    b = intervals.select(*keys, F.col(start).cast("long").alias("_at"), F.lit(0).alias("_side"), F.col(end).cast("long").alias("_end"), F.struct(*values).alias("_value"))
    b = b.filter("_at is not null and _end is not null")
    rows = a.unionByName(b, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "_at", "_side", F.desc("_end"))
    out = points.schema
    added = [(f"{v}_found" if v in points.columns else v, v) for v in values]
    schema = f"_row {out.simpleString()}, _found struct<{', '.join(f'`{v}`: {kinds[v]}' for v in values)}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_, held = None, [], None  # an open interval is its end and the row of its value
        for batch in batches:
            key_, place_, side_, stop_ = zip(*[batch.column(k).to_pylist() for k in range(len(keys))]), *[batch.column(len(keys) + k).to_pylist() for k in range(3)]
            value = batch.column(len(keys) + 4)
            if held is not None:  # what is open from before goes behind this batch's values
                open_ = [(stop, len(value) + k) for k, (stop, _) in enumerate(open_)]
                value = pa.concat_arrays([value, held])
            found, kept = [], []
            for k, (key, place, side, stop) in enumerate(zip(key_, place_, side_, stop_)):
                if key != group:
                    group, open_ = key, []
                while open_ and place is not None and open_[-1][0] <= place:
                    open_.pop()
                if side == 0:
                    open_.append((stop, k))
                else:
                    kept.append(k)
                    found.append(open_[-1][1] if open_ and place is not None and None not in key else None)
            if kept:
                rows_ = batch.column(len(keys) + 3).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows_, value.take(pa.array(found, pa.int64()))], names=["_row", "_found"])
            held = value.take(pa.array([at for _, at in open_], pa.int64())) if open_ else None

    done = rows.mapInArrow(run, schema)
    return done.select("_row.*", *[F.col(f"_found.{v}").alias(name) for name, v in added])


def merge_adjacent(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Ranges of one key that directly continue each other (next start = end + 1) become one."""
    order = Window.partitionBy(*keys).orderBy(start)
    fresh = (F.lag(end).over(order).isNull() | (F.col(start) != F.lag(end).over(order) + 1)).cast("int")
    marked = rows.withColumn("_run", fresh)
    marked = marked.withColumn("_run", F.sum("_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def interval_union(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of half-open intervals, by key, as disjoint ones in order."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_run")


def interval_gaps(union: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What lies between the disjoint intervals of a key."""
    order = Window.partitionBy(*keys).orderBy(start)
    gap = union.withColumn("_before", F.lag(end).over(order)).filter(F.col("_before").isNotNull())
    return gap.select(*keys, F.col("_before").alias("gap_start"), F.col(start).alias("gap_end"))


def runs(rows: DataFrame, keys: list[str], order: list[str], tag: str) -> DataFrame:
    """Add run, the number (from 1) of the stretch of equal neighbouring tags a row is in."""
    window = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((~F.col(tag).eqNullSafe(F.lag(tag).over(window))).cast("int"), F.lit(1))
    first = F.row_number().over(window) == 1
    marked = rows.withColumn("_change", F.when(first, 1).otherwise(change))
    return marked.withColumn("run", F.sum("_change").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def gap_sessions(rows: DataFrame, keys: list[str], at: Column, order: list[str], gap_seconds: int) -> DataFrame:
    """Add session: a new one begins after a pause over the gap."""
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_at", at)
    marked = marked.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(window) > gap_seconds).cast("int"), F.lit(0)))
    return marked.withColumn("session", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_at", "_new")


def unique_names(rows: DataFrame, name: str, order: list[str], into: str = "unique_name") -> DataFrame:
    """The n-th duplicate (n from 2) of a name gets the suffix ``-n``."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(into, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), F.col("_n").cast("string")))).drop("_n")


#: A fold's step: from the state (null at a group's start) and a size to the next state and the row's number.
Step = Callable[[tuple | None, int], tuple[tuple, int]]


def fold(step: Step, sizes: list[int]) -> list[int]:
    """The numbers of one group's ordered sizes."""
    state, out = None, []
    for size in sizes:
        state, number = step(state, size)
        out.append(number)
    return out


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], size: str, step: Step, into: str, kept: Sequence[str] = ()) -> DataFrame:
    """An ordered fold within each group whose state depends on what came before; ``kept`` columns go along.

    Rows are sorted within partitions and pass in batches; only the fold's state is held,
    however many rows a group has. Null keys are a group; a null size counts as 0.
    """
    narrow = rows.select(*keys, *order, size, *kept)
    at = len(keys) + len(order)

    def plain(value: object) -> object:
        return None if value != value else value  # NaN, as a key, equals itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(keys))]
            numbers = []
            for n, *values in zip(batch.column(at).to_pylist(), *columns):
                key = [plain(v) for v in values]
                state = state if key == group else None
                group = key
                state, number = step(state, int(plain(n) or 0))
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, into])

    schema = narrow.withColumn(into, F.lit(0).cast("long")).schema
    return narrow.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def greedy_bins(target: int) -> Step:
    """A new bin begins when the next size would take a started bin over the target."""

    def step(state: tuple | None, size: int) -> tuple[tuple, int]:
        at, filled = state or (0, 0)
        if filled and filled + size > target:
            at, filled = at + 1, 0
        return (at, filled + size), at

    return step


def cluster_fold(tiny: int, most: int) -> Step:
    """Clusters that absorb what follows while it, or what came before it, is tiny and the whole isn't over most."""

    def step(state: tuple | None, size: int) -> tuple[tuple, int]:
        if state is None:
            return (0, size, size), 0
        at, filled, before = state
        joins = filled + size <= most and (size < tiny or before < tiny)
        at, filled = (at, filled + size) if joins else (at + 1, size)
        return (at, filled, size), at

    return step
