"""Ordered work on groups of any size.

A Spark window puts one group into one task.  That is right for ordinary recordings and wrong
for one that holds a large share of all rows, so ``Ordered`` checks group sizes with one
aggregate first.  Where every group is small it uses plain windows.  Where some are not, their
rows are cut into consecutive chunks by position, windows run inside a chunk, and what a chunk
needs from the earlier ones (a running total, the last row) comes from a summary with one row
per chunk.  Only groups with more rows than the limit are listed; the list and the summaries are
joined like any table, so the optimizer sends them to all tasks only where they are small.

Positions follow the order of the rows: NULLs lie where the first order column puts them, NaN above
every number, infinities at the ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.session import checkpoint_dir

CHUNK_CONF = "spark.voxlake.chunkRows"
CHUNK_ROWS = 1 << 18
LEVELS = 8
CHUNK = "__chunk"
HOT = "__hot"


def chunk_rows(df: DataFrame) -> int:
    """Rows a group may have before it is cut; 0 means never cut."""
    return int(df.sparkSession.conf.get(CHUNK_CONF, str(CHUNK_ROWS)))


def oversized(df: DataFrame, keys: list[str]) -> bool:
    """Whether any group has more rows than one task should take."""
    rows = chunk_rows(df)
    if rows <= 0 or df.isStreaming:
        return False
    return len(df.groupBy(*keys).count().where(F.col("count") > rows).take(1)) > 0


def _dense(df: DataFrame, by: list[str], limit: int) -> DataFrame | None:
    """Rows, first and last position of the groups with more than ``limit`` rows; None where there are none."""
    sized = (
        df.groupBy(*by)
        .agg(F.count("*").alias("__n"), F.min("__pos").alias("__lo"), F.max("__pos").alias("__hi"))
        .where((F.col("__n") > limit) & (F.col("__hi") > F.col("__lo")))
    )
    if not sized.take(1):
        return None
    checkpoint_dir(df.sparkSession)
    return sized.checkpoint()


def _divide(df: DataFrame, by: list[str], found: DataFrame, rows: int) -> DataFrame:
    """Divide the found groups evenly between their first and last position; chunk numbers keep the order."""
    pieces = F.ceil(F.col("__n") * 2.0 / rows)  # positions are rarely even, so aim below the limit
    most = found.agg(F.max(pieces)).first()[0]
    renamed = found.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], "__lo", "__hi", pieces.alias("__pieces"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]
    step = (F.col("__pos") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.col("__pieces")
    inner = F.least(F.floor(step), F.col("__pieces") - 1)
    piece = F.when(F.col("__side") < 0, 0).when(F.col("__side") > 0, F.col("__pieces") - 1).otherwise(inner)
    return (
        df.join(renamed, on, "left")
        .withColumn(CHUNK, F.col(CHUNK) * int(most) + F.coalesce(piece, F.lit(0)))
        .withColumn(HOT, F.col(HOT) | F.col("__pieces").isNotNull())
        .drop("__lo", "__hi", "__pieces", *[f"__k{i}" for i in range(len(by))])
    )


def _cut(df: DataFrame, keys: list[str], pos: Column, falling: bool) -> DataFrame | None:
    """``df`` with chunk numbers for oversized groups, or None where there are none.

    Chunks that are still too dense are divided again, up to LEVELS times.  ``falling`` tells on which side
    NULL and NaN stand.
    """
    rows = chunk_rows(df)
    if rows <= 0 or df.isStreaming:
        return None
    place, nulls = pos.cast("double"), 1 if falling else -1
    endless = F.abs(place) == float("inf")
    side = F.when(place.isNull(), nulls).when(F.isnan(place), -1 if falling else 1).when(endless, F.signum(place).cast("int")).otherwise(0)
    placed = df.withColumns({"__side": side, "__pos": F.when(side == 0, place)})
    found = _dense(placed, keys, rows)
    if found is None:
        return None
    zero = F.lit(0).cast("bigint")
    placed = _divide(placed.withColumns({CHUNK: zero, HOT: F.lit(False)}), keys, found, rows)
    for _ in range(LEVELS - 1):
        found = _dense(placed.where(HOT), [*keys, CHUNK], 2 * rows)
        if found is None:
            break
        placed = _divide(placed, [*keys, CHUNK], found, rows)
    return placed.drop("__pos", "__side")


@dataclass(frozen=True)
class Ordered:
    """Rows in groups ``keys``, ordered by ``order`` inside each group."""

    df: DataFrame
    keys: list[str]
    order: list[Column] = field(default_factory=list)
    cut: bool = False

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str | Column], pos: Column | None = None, falling: bool = False) -> Ordered:
        """``pos`` is a number that never decreases along ``order``; the first order column by default, or its
        negative where that is ``falling``: largest first, NULL last."""
        columns = [F.col(c) if isinstance(c, str) else c for c in order]
        default = -columns[0] if falling else columns[0]
        chunked = _cut(df, keys, default if pos is None else pos, falling)
        if falling:
            columns[0] = columns[0].desc()
        if chunked is None:
            return cls(df, list(keys), columns, False)
        return cls(chunked, list(keys), columns, True)

    @property
    def window(self):
        by = [*self.keys, CHUNK] if self.cut else self.keys
        return Window.partitionBy(*by).orderBy(*self.order)

    def with_column(self, name: str, value: Column) -> Ordered:
        return replace(self, df=self.df.withColumn(name, value))

    def where(self, condition: Column) -> Ordered:
        return replace(self, df=self.df.where(condition))

    def done(self, *drop: str) -> DataFrame:
        return self.df.drop(*drop, CHUNK, HOT)

    def _hot_rows(self) -> DataFrame:
        return self.df.where(F.col(HOT))

    def _attach(self, summary: DataFrame, on: list[str]) -> DataFrame:
        renamed = summary
        for i, key in enumerate(on):
            renamed = renamed.withColumnRenamed(key, f"__k{i}")
        match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(on)]
        return self.df.join(renamed, match, "left").drop(*[f"__k{i}" for i in range(len(on))])

    def running_sum(self, name: str, value: Column, before: bool = False) -> Ordered:
        """Running total of ``value`` up to this row, or up to the row before it."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        zero = value * 0
        if not self.cut:
            return self.with_column(name, F.coalesce(F.sum(value).over(frame), zero))
        totals = self._hot_rows().groupBy(*self.keys, CHUNK).agg(F.sum(value).alias("__total"))
        earlier = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*self.keys, CHUNK, F.sum("__total").over(earlier).alias("__earlier"))
        local = replace(self, df=self.df.withColumn(name, F.coalesce(F.sum(value).over(frame), zero)))
        out = local._attach(totals, [*self.keys, CHUNK])
        return replace(self, df=out.withColumn(name, F.col(name) + F.coalesce("__earlier", F.lit(0))).drop("__earlier"))

    def row_number(self, name: str) -> Ordered:
        """Position in the group, from 1."""
        if not self.cut:
            return self.with_column(name, F.row_number().over(self.window))
        return self.running_sum(name, F.lit(1))

    def previous(self, name: str, value: Column) -> Ordered:
        """``value`` of the row before, NULL on the first row of a group."""
        return self._neighbour(name, value, ahead=False)

    def following(self, name: str, value: Column) -> Ordered:
        """``value`` of the row after, NULL on the last row of a group."""
        return self._neighbour(name, value, ahead=True)

    def _neighbour(self, name: str, value: Column, ahead: bool) -> Ordered:
        shift, edge, step = (F.lead, F.min_by, F.lead) if ahead else (F.lag, F.max_by, F.lag)
        if not self.cut:
            return self.with_column(name, shift(value).over(self.window))
        # A struct keeps a NULL value apart from "no such row".
        boxed = F.struct(value.alias("v"))
        ends = self._hot_rows().groupBy(*self.keys, CHUNK).agg(
            edge(boxed, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])).alias("__edge")
        )
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        ends = ends.select(*self.keys, CHUNK, step("__edge").over(chunks).alias("__edge"))
        local = replace(self, df=self.df.withColumn(name, shift(boxed).over(self.window)))
        out = local._attach(ends, [*self.keys, CHUNK])
        return replace(self, df=out.withColumn(name, F.coalesce(name, "__edge")["v"]).drop("__edge"))

    def last_before(self, name: str, value: Column) -> Ordered:
        """``value`` of the nearest row before that has one, NULL where none has."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, -1)
        local = self.with_column(name, F.last(value, ignorenulls=True).over(frame))
        if not self.cut:
            return local
        turn = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])
        ends = self._hot_rows().groupBy(*self.keys, CHUNK).agg(F.max_by(value, F.when(value.isNotNull(), turn)).alias("__end"))
        earlier = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*self.keys, CHUNK, F.last("__end", ignorenulls=True).over(earlier).alias("__end"))
        out = local._attach(ends, [*self.keys, CHUNK])
        return replace(self, df=out.withColumn(name, F.coalesce(name, "__end")).drop("__end"))

    def total(self, name: str, aggregate: Column) -> Ordered:
        """An aggregate over the whole group on each of its rows."""
        by = [*self.keys, CHUNK] if self.cut else self.keys
        local = self.with_column(name, aggregate.over(Window.partitionBy(*by)))
        if not self.cut:
            return local
        whole = self._hot_rows().groupBy(*self.keys).agg(aggregate.alias("__whole"))
        out = local._attach(whole, self.keys)
        return replace(self, df=out.withColumn(name, F.coalesce("__whole", name)).drop("__whole"))


def parts(position: Column, size: int) -> Column:
    """Number of the part of ``size`` rows a 0-based position falls into."""
    return F.floor(position / size).cast("int")
