"""Sample grids: chunks with a margin, dense positions, and bucketed range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID_ROWS = 1 << 16
BLOCK = "__block"
CLASS = "__class"


def with_margin(df: DataFrame, keys: list[str], pos: str, before: int, after: int, size: int = GRID_ROWS) -> DataFrame:
    """Rows with the block they are needed in: their own, and the neighbours whose margin they are in.

    A frame of ``before`` rows back and ``after`` rows ahead is then complete inside
    (keys, block) for every row whose own block it is.
    """
    size = max(size, before, after, 1)
    own = F.floor(F.col(pos) / size)
    offset = F.pmod(F.col(pos), F.lit(size))
    blocks = F.filter(
        F.array(
            own,
            F.when(offset >= size - before, own + 1),
            F.when((offset < after) & (own > 0), own - 1),
        ),
        lambda b: b.isNotNull(),
    )
    return df.withColumn(BLOCK, F.explode(blocks)).withColumn("__own", F.col(BLOCK) == own)


def framed(df: DataFrame, keys: list[str], pos: str, before: int, after: int, size: int = GRID_ROWS, **columns) -> DataFrame:
    """Add window columns over ROWS [-before, +after] by ``pos``; a column is a function of the frame."""
    frame = Window.partitionBy(*keys, BLOCK).orderBy(pos).rowsBetween(-before, after)
    out = with_margin(df, keys, pos, before, after, size)
    for name, expression in columns.items():
        out = out.withColumn(name, expression(frame))
    return out.where("__own").drop(BLOCK, "__own")


def dense_positions(lengths: DataFrame, keys: list[str], length: str, size: int = GRID_ROWS) -> DataFrame:
    """All positions 0..length-1 of each row.  Blocks are spread over the tasks before they are filled."""
    blocks = (
        lengths.where(F.col(length) > 0)
        .withColumn(BLOCK, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(length) - 1) / size))))
        .repartition(*keys, BLOCK)
    )
    first = F.col(BLOCK) * size
    last = F.least(first + size, F.col(length)) - 1
    return blocks.withColumn("pos", F.explode(F.sequence(first, last))).drop(BLOCK)


FINEST, STEP, CLASSES = 64, 2, 28  # cells of 64 positions, then four times as long in each class


def length_class(length: Column) -> Column:
    """The first class whose cells are at least as long as an interval of ``length`` positions."""
    exact = F.ceil(F.log2(F.greatest(length, F.lit(FINEST)) / FINEST) / STEP).cast("int")
    return F.least(F.greatest(exact, F.lit(0)), F.lit(CLASSES - 1))


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, low: str, high: str) -> DataFrame:
    """Points with every interval of their group where low <= pos < high, as an equi join on cells.

    Intervals are kept by classes of their length. The cells of a class are at least as long as its intervals and
    less than four times as long (but for the finest), so an interval lies in one or two of them and fills a good
    part, and what is compared grows with what is found. A point is looked up once in each class that occurs:
    these, CLASSES numbers at most, are asked for while the plan is built.
    """
    ranges = intervals.where(F.col(low) < F.col(high)).withColumn(CLASS, length_class(F.col(high) - F.col(low)))
    classes = sorted(r[0] for r in ranges.select(CLASS).distinct().collect())
    if not classes:
        classes = [0]
    size = F.lit(FINEST) * F.pow(F.lit(2.0), F.col(CLASS) * STEP)  # powers of two, exact
    cell = lambda at: F.floor(at / size).cast("bigint")
    placed = points.withColumn(CLASS, F.explode(F.array(*[F.lit(c) for c in classes]))).withColumn(BLOCK, cell(F.col(pos)))
    ranges = ranges.withColumn(BLOCK, F.explode(F.sequence(cell(F.col(low)), cell(F.col(high) - 1))))
    return (
        placed.join(ranges, [*keys, CLASS, BLOCK])
        .where((F.col(pos) >= F.col(low)) & (F.col(pos) < F.col(high)))
        .drop(CLASS, BLOCK)
    )
