"""Ordered analytics (running totals, neighbours, rolling windows) that survive a hot key.

A window over a key puts all rows of that key into one task. That is fine for
ordinary keys and fails for a key holding a large part of the table. So the key
sizes are checked first. Keys of up to ``hot_rows`` rows use a plain window. The
rows of larger keys, of which there are few, are range-partitioned by (key, order),
so one key spreads over many chunks; each chunk is scanned on its own, and what
earlier chunks of the same key add up to is carried in. A chunk border cuts one key at most, so the carry table has
fewer rows than there are chunks and can be broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint_dir

HOT_ROWS = 20_000_000  # rows of one key that one task may own

_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of ordinary keys, rows of hot keys or None, number of hot rows).

    Counts are combined before the shuffle; there are at most rows / ``limit`` hot
    keys, so their list can be sent to all tasks. Null keys are keys like others.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    found = hot.collect()
    if not found:
        return df, None, 0
    names = df.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], hot.drop("_n").schema)
    names = F.broadcast(names.select([F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(names[f"_h{i}"])
    return df.join(names, on, "left_anti"), df.join(names, on, "left_semi"), sum(r["_n"] for r in found)


class OrderedScan:
    """Adds ordered columns to ``df`` per ``keys`` in the total order ``order`` (unique within a key)."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None):
        self.keys, self.order = list(keys), list(order)
        limit = hot_rows or HOT_ROWS
        plain, hot, rows = split_hot(df, self.keys, limit)
        self.chunked, self.df, self.hot = False, plain, None
        if hot is not None:
            self.hot = OrderedScan._of_chunks(self.keys, self.order, hot, max(2, math.ceil(rows / limit)))

    @classmethod
    def _of_chunks(cls, keys: list[str], order: list[str], df: DataFrame, parts: int) -> "OrderedScan":
        scan = cls.__new__(cls)
        scan.keys, scan.order, scan.chunked, scan.hot = keys, order, True, None
        checkpoint_dir(df.sparkSession)
        # The checkpoint pins the chunk of each row: range bounds come from a sample
        # and could differ if the exchange were computed a second time.
        scan.df = df.repartitionByRange(parts, *keys, *order).withColumn("_chunk", F.spark_partition_id()).checkpoint()
        return scan

    def _window(self, reverse: bool):
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        part = (["_chunk"] if self.chunked else []) + self.keys
        return Window.partitionBy(*part).orderBy(*order)

    def running(self, specs: dict[str, tuple], reverse: bool = False, inclusive: bool = True) -> "OrderedScan":
        """``{out: (kind, column)}`` with kind sum, count, min, max or last (last non-null value).

        ``reverse`` runs from the end of the order to its start; ``inclusive``
        says whether the current row takes part.
        """
        if self.hot:
            self.hot.running(specs, reverse, inclusive)
        end = 0 if inclusive else -1
        frame = self._window(reverse).rowsBetween(Window.unboundedPreceding, end)
        specs = {k: (kind, F.col(c) if isinstance(c, str) else c) for k, (kind, c) in specs.items()}
        base = self.df
        out = base
        for name, (kind, col) in specs.items():
            out = out.withColumn(name, self._over(kind, col, frame))
        if self.chunked:
            out = self._carry(base, out, specs, reverse)
        else:
            for name, (kind, _) in specs.items():
                if kind == "count":
                    out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
        self.df = out
        return self

    @staticmethod
    def _over(kind: str, col: Column, frame) -> Column:
        if kind == "last":
            return F.last(col, ignorenulls=True).over(frame)
        return getattr(F, kind)(col).over(frame)

    def _carry(self, base: DataFrame, out: DataFrame, specs: dict, reverse: bool) -> DataFrame:
        first = (F.max_by if not reverse else F.min_by)
        rank = F.struct(*self.order)
        parts = []
        for name, (kind, col) in specs.items():
            if kind == "last":
                # The non-null value at the far end of the chunk.
                parts.append(first(col, F.when(col.isNotNull(), rank)).alias(f"_p_{name}"))
            else:
                parts.append(getattr(F, kind)(col).alias(f"_p_{name}"))
        totals = base.groupBy("_chunk", *self.keys).agg(*parts)
        w = (
            Window.partitionBy(*self.keys)
            .orderBy(F.col("_chunk").desc() if reverse else F.col("_chunk").asc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = totals.withColumn("_has", F.count("*").over(w) > 0)
        for name, (kind, _) in specs.items():
            p = F.col(f"_p_{name}")
            merged = F.last(p, ignorenulls=True) if kind == "last" else _MERGE[kind](p)
            carried = carried.withColumn(f"_c_{name}", merged.over(w))
        carried = carried.filter("_has").select(
            "_chunk",
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)],
            *[f"_c_{n}" for n in specs],
        )
        on = F.col("r._chunk") == F.col("c._chunk")
        for i, k in enumerate(self.keys):
            on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"c._k{i}"))
        joined = out.alias("r").join(F.broadcast(carried).alias("c"), on, "left")
        cols = []
        for c in out.columns:
            if c not in specs:
                cols.append(F.col(f"r.{c}"))
                continue
            kind = specs[c][0]
            here, before = F.col(f"r.{c}"), F.col(f"c._c_{c}")
            if kind == "count":
                v = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
            elif kind == "sum":
                v = F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)
            elif kind == "last":
                v = F.coalesce(here, before)
            else:
                v = (F.least if kind == "min" else F.greatest)(here, before)
            cols.append(v.alias(c))
        return joined.select(*cols)

    def prev(self, cols: dict[str, str]) -> "OrderedScan":
        """``{out: column}``: the value of the row before, NULL on the first row."""
        return self._neighbour(cols, reverse=False)

    def next(self, cols: dict[str, str]) -> "OrderedScan":
        """``{out: column}``: the value of the row after, NULL on the last row."""
        return self._neighbour(cols, reverse=True)

    def _neighbour(self, cols: dict[str, str], reverse: bool) -> "OrderedScan":
        if self.hot:
            self.hot._neighbour(cols, reverse)
        if not self.chunked:
            w = self._window(False)
            move = F.lead if reverse else F.lag
            for out, c in cols.items():
                self.df = self.df.withColumn(out, move(c).over(w))
            return self
        # A struct is never NULL, so "last non-null struct before me" is the row before.
        self.running({"_near": ("last", F.struct(*cols.values()))}, reverse=reverse, inclusive=False)
        for out, c in cols.items():
            self.df = self.df.withColumn(out, F.col(f"_near.{c}"))
        self.df = self.df.drop("_near")
        return self

    def with_columns(self, cols: dict[str, Column]) -> "OrderedScan":
        if self.hot:
            self.hot.with_columns(cols)
        self.df = self.df.withColumns(cols)
        return self

    def drop(self, *cols: str) -> "OrderedScan":
        if self.hot:
            self.hot.drop(*cols)
        self.df = self.df.drop(*cols)
        return self

    def result(self) -> DataFrame:
        out = self.df.drop("_chunk")
        return out.unionByName(self.hot.result()) if self.hot else out


def rolling(
    df: DataFrame,
    keys: list[str],
    time: str,
    tie: str,
    frames: dict[str, tuple],
    hot_rows: int | None = None,
) -> DataFrame:
    """Sums over time frames: ``{out: (column, back, until)}`` sums rows with time in [t-back, t-until].

    ``time`` is a whole number (microseconds), ``column`` a whole number or
    decimal so the sums are exact; the result has the type of the column's sum.
    Rows at the same time count for each other. A frame's sum is the running sum
    up to its end less the one before its start: Spark adds each row to a running
    sum once, but adds up a sliding frame anew for each row, which is quadratic in
    the rows of a key. For a hot key each row is turned
    into an entry (+v when it comes into the frame) and an exit (-v when it
    leaves), and the frame sum is a running sum.
    """
    types = df.select(*[F.sum(c).alias(out) for out, (c, _, _) in frames.items()]).schema
    for f in types:
        if f.dataType.typeName() not in ("long", "decimal"):
            raise ValueError(f"{f.name}: {f.dataType.simpleString()} sums are not exact")
    plain, hot, _ = split_hot(df, keys, hot_rows or HOT_ROWS)
    order = Window.partitionBy(*keys).orderBy(time)
    totals = {}
    for out, (c, back, until) in frames.items():
        v, kind = (F.col(c) if isinstance(c, str) else c), types[out].dataType
        # Running sums may outgrow the type of the frame's sum.
        v, zero = v.cast(_wide(kind)), F.lit(0).cast(_wide(kind))
        upto = lambda at: F.coalesce(F.sum(v).over(order.rangeBetween(Window.unboundedPreceding, -at)), zero)
        # Rows without a time are peers of each other and come first, so all frames before hold them.
        earlier = F.when(F.col(time).isNull(), zero).otherwise(upto(back + 1))
        totals[out] = (upto(until) - earlier).cast(kind)
    plain = plain.withColumns(totals)
    if hot is None:
        return plain
    return plain.unionByName(_rolling_hot(hot, keys, time, tie, frames, types, hot_rows))


def _wide(kind) -> str:
    return f"decimal(38,{getattr(kind, 'scale', 0)})"


def _rolling_hot(df: DataFrame, keys: list[str], time: str, tie: str, frames: dict[str, tuple], types, hot_rows: int | None) -> DataFrame:
    """``rolling`` for hot keys, by running sums of entries and exits."""
    names = list(frames)
    wide = {n: _wide(types[n].dataType) for n in names}
    probe = df.withColumn("_at", F.col(time)).withColumn("_step", F.lit(1))
    for n in names:
        probe = probe.withColumn(f"_v_{n}", F.lit(0).cast(wide[n]))
    moves = []
    for out, (c, back, until) in frames.items():
        v = (F.col(c) if isinstance(c, str) else c).cast(wide[out])
        for at, sign in ((until, 1), (back + 1, -1)):
            vals = [(v * sign if n == out else F.lit(0)).cast(wide[n]).alias(f"_v_{n}") for n in names]
            moves.append(
                df.filter(v.isNotNull()).select(*keys, tie, (F.col(time) + at).alias("_at"), F.lit(0).alias("_step"),
                          F.lit(f"{out}{sign}").alias("_move"), *vals)
            )
    stream = probe.withColumn("_move", F.lit(""))
    for m in moves:
        stream = stream.unionByName(m, allowMissingColumns=True)
    scan = OrderedScan(stream, keys, ["_at", "_step", tie, "_move"], hot_rows)
    scan.running({n: ("sum", f"_v_{n}") for n in names})
    done = scan.result().filter("_step = 1")
    for n in names:
        done = done.withColumn(n, F.col(n).cast(types[n].dataType))
    return done.drop("_at", "_step", "_move", *[f"_v_{n}" for n in names])


def group_total(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Per-key totals beside each row: aggregate (combined before the shuffle), then join back.

    Unlike a window this never sorts a hot key in one task; adaptive skew
    handling splits the join.
    """
    return df.join(df.groupBy(*keys).agg(*aggs), keys)


def islands(scan: OrderedScan, is_new: Column, out: str) -> OrderedScan:
    """Number runs of consecutive rows: a new run starts where ``is_new`` holds."""
    scan.with_columns({"_new": F.when(is_new, 1).otherwise(0)})
    scan.running({out: ("sum", "_new")})
    return scan.drop("_new")
