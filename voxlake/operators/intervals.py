"""Time intervals: speech from frames, splitting, packing, chunking, slicing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions.audio import sample_at
from voxlake.plans.grid import range_join
from voxlake.plans.ordered import CHUNK, HOT, Ordered

SERIES = ["series_id"]


def _pieces(low: Column, high: Column, max_len: float, step: float, min_tail: float) -> Column:
    """Array of (start_s, end_s): the interval, or ``step`` long pieces whose short tail joins the last."""
    length = high - low
    count = F.when(length > max_len, F.floor((length - min_tail) / step) + 1).otherwise(F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.struct(
            (low + k * step).alias("start_s"),
            F.when(k == count - 1, high).otherwise(low + (k + 1) * step).alias("end_s"),
        ),
    )


def split_long(intervals: DataFrame, max_len: float = 30.0, step: float = 25.0, min_tail: float = 5.0) -> DataFrame:
    """Intervals above ``max_len`` seconds cut into pieces; ``piece_no`` counts from 0."""
    rest = [c for c in intervals.columns if c not in ("start_s", "end_s")]
    cut = _pieces(F.col("start_s"), F.col("end_s"), max_len, step, min_tail)
    return intervals.select(*rest, F.posexplode(cut).alias("piece_no", "p")).select(*rest, "piece_no", "p.*")


def speech_segments(
    frames: DataFrame,
    meta: DataFrame,
    threshold: float = 0.15,
    min_silence: float = 1.0,
    min_speech: float = 0.1,
    pad: float = 0.3,
    min_length: float = 0.1,
    max_len: float = 30.0,
    step: float = 25.0,
    min_tail: float = 5.0,
) -> DataFrame:
    """Speech intervals of each series from frame probabilities.

    Frames at or above ``threshold`` closer than ``min_silence`` form one interval; short ones
    go, the others get ``pad`` seconds on both sides (the start not below 0) and are split when
    long.  A series without speech is one interval over its whole ``duration`` (from ``meta``).
    """
    rows = Ordered.of(frames.where(F.col("prob") >= threshold).select("series_id", "t"), SERIES, ["t"])
    rows = rows.previous("__prev", F.col("t"))
    starts = F.col("__prev").isNull() | (F.col("t") - F.col("__prev") >= min_silence)
    rows = rows.with_column("__new", F.when(starts, 1).otherwise(0)).running_sum("__island", F.col("__new"))
    found = (
        rows.done()
        .groupBy("series_id", "__island")
        .agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
        .where(F.col("end_s") - F.col("start_s") >= min_speech)
        .select("series_id", F.greatest(F.lit(0.0), F.col("start_s") - pad).alias("start_s"), (F.col("end_s") + pad).alias("end_s"))
        .where(F.col("end_s") - F.col("start_s") >= min_length)
    )
    out = split_long(found, max_len, step, min_tail).drop("piece_no")
    # The fallback only needs to know whether a series has speech, which is one row per series.
    silent = meta.where(F.col("duration") > 0).join(found.select("series_id").distinct(), "series_id", "left_anti")
    whole = silent.select("series_id", F.lit(0.0).alias("start_s"), F.col("duration").alias("end_s"))
    return out.unionByName(whole)


def sliding_chunks(meta: DataFrame, length: float = 30.0, overlap: float = 1.0) -> DataFrame:
    """Chunks of ``length`` seconds that overlap; the last ends with the recording."""
    step = length - overlap
    duration = F.col("duration")
    count = (
        F.when(duration <= 0, 0).when(duration <= length, 1).otherwise(F.ceil((duration - length) / step) + 1).cast("int")
    )
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    start = F.col("chunk_no") * F.lit(float(step))
    return meta.withColumn("chunk_no", F.explode(numbers)).select(
        *meta.columns, "chunk_no", start.alias("start_s"), F.least(start + length, duration).alias("end_s")
    )


def successors(durations: np.ndarray, ends: np.ndarray, budget: float) -> np.ndarray:
    """For each row the first later one that no longer fits a block which it begins, at most ``ends`` (of its series).

    A binary search on the running sums. A block's total is its durations added one after the other; where the
    running sums are too close to ``budget`` to tell, these additions are made, for all such rows at once.
    """
    at, run = np.arange(len(durations)), np.cumsum(durations)
    base = run - durations
    found = np.minimum(np.maximum(np.searchsorted(run, base + budget, side="right"), at + 1), ends)
    unsure = np.ones(len(durations), bool)
    if not (durations < 0).any():
        near = budget + np.array([-1, 1]) * 1e-9 * max(1.0, float(run[-1]) if len(run) else 0.0, budget)
        inside = run[found - 1] - base
        beyond = np.where(found < ends, run[np.minimum(found, len(run) - 1)] - base, np.inf)
        unsure = ((found > at + 1) & (inside > near[0])) | (beyond < near[1])
    rows = np.flatnonzero(unsure)
    total, place = durations[rows].astype(float), rows + 1
    found[rows] = ends[rows]
    while len(rows):
        going = place < ends[rows]
        rows, total, place = rows[going], total[going], place[going]
        total = total + durations[place]
        over = total > budget
        found[rows[over]] = place[over]
        rows, total, place = rows[~over], total[~over], place[~over] + 1
    return found


def chained(first: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Rows that the ``first`` ones (true) lead to over their links, by doubling the distance covered."""
    reached, jump = np.append(first, False), np.append(links, len(links))
    while True:
        further = reached.copy()
        further[jump[reached]] = True
        if (further[:-1] == reached[:-1]).all():
            return reached[:-1]
        reached, jump = further, jump[jump]


def first_break(total: float, durations: np.ndarray, budget: float) -> int:
    """The first row that no longer fits a block whose total is ``total`` before them; their number if all fit."""
    over = np.cumsum(np.concatenate([[total], durations]))[1:] > budget
    return int(over.argmax()) if over.any() else len(durations)


def _pack_rows(keys: np.ndarray, durations: np.ndarray, entry_sum: np.ndarray, entry_block: np.ndarray, budget: float, carry: tuple) -> tuple[np.ndarray, tuple]:
    """Block number of each row of a batch whose rows of one key stand together; ``carry`` is the key, open total and
    block left by the batch before. A missing duration counts as none."""
    n = len(keys)
    durations = np.nan_to_num(durations)
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    lengths = np.diff(np.append(begin, n))
    opened, block = entry_sum[begin].copy(), entry_block[begin].copy()
    if carry[0] == keys[0]:
        opened[0], block[0] = carry[1:]
    first = np.zeros(n, bool)
    fresh = np.isnan(opened)  # nothing in the block yet: the first row goes there whatever its length
    first[begin[fresh]] = True
    for i in np.flatnonzero(~fresh):
        own = durations[begin[i] : begin[i] + lengths[i]]
        at = first_break(opened[i], own, budget)
        if at < len(own):
            first[begin[i] + at] = True
    ends = np.repeat(begin + lengths, lengths)
    links = successors(durations, ends, budget)
    starts = chained(first, np.where(links == ends, n, links))  # a series' last block leads nowhere
    counted = np.cumsum(starts)
    before = counted[begin] - starts[begin] + fresh
    blocks = np.repeat(block - before, lengths) + counted
    last = np.flatnonzero(starts[begin[-1] :])
    tail = durations[begin[-1] + last[-1] :] if len(last) else np.concatenate([opened[-1:], durations[begin[-1] :]])
    return blocks, (keys[-1], float(np.cumsum(tail)[-1]), int(blocks[-1]))


def _chunk_effect(durations: np.ndarray, budget: float) -> tuple[list[float], list[float], list[int]]:
    """What a chunk does to a block that is open when it begins.

    The first break can only happen on the leading rows that fit one block.  For each of them:
    its duration, and the open total and number of breaks at the chunk's end if it breaks there.
    """
    durations = np.nan_to_num(durations)
    n = len(durations)
    heads = min(first_break(0.0, durations, budget) + 1, n)
    links = successors(durations, np.full(n, n), budget)
    # The last block begun and the breaks on the way there: distances double until every row has arrived.
    jump, steps = np.append(links, n), np.append(np.ones(n, np.int64), 0)
    last = np.where(jump == n, np.arange(n + 1), jump)
    steps = np.where(jump == n, 0, steps)
    while (last[last] != last).any():
        steps, last = steps + steps[last], last[last]
    totals = {i: float(np.cumsum(durations[i:])[-1]) for i in np.unique(last[:heads]).tolist()}
    return durations[:heads].tolist(), [totals[i] for i in last[:heads].tolist()], (steps[:heads] + 1).tolist()


def pack_blocks(intervals: DataFrame, budget: float = 30.0, keys: str = "series_id") -> DataFrame:
    """Greedy blocks of intervals in time order: a new one starts when the next would pass ``budget``.

    The total counts the intervals only, so a block may span more time than ``budget``.  Rows stream
    sorted by series; where a block begun at a row would end is a binary search on running sums, and the rows
    that do begin one are found by following these links at doubled distances.  An oversized series is folded chunk by chunk: one pass
    finds what each chunk does to the block open at its start, those effects are chained, and the
    second pass folds all chunks at once, each from its own start state.
    """
    order = ["start_s", "end_s"]
    rows = Ordered.of(intervals.select(keys, *order), [keys], order)
    columns = rows.df.withColumn("__dur", F.col("end_s") - F.col("start_s"))
    kind = dict(intervals.dtypes)[keys]
    if rows.cut:
        columns = columns.join(_entries(columns, keys, kind, budget), [keys, CHUNK], "left")
    else:
        columns = columns.withColumns({CHUNK: F.lit(0).cast("bigint"), "__sum": F.lit(None).cast("double"), "__block": F.lit(0)})
    columns = columns.withColumn("__block", F.coalesce("__block", F.lit(0)).cast("bigint"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = (None, float("nan"), 0)
        for batch in batches:
            if len(batch) == 0:
                continue
            # Equal neighbours have one code; the key itself tells whether the first of them goes on from the batch before.
            run = (batch[keys].ne(batch[keys].shift()) & ~(batch[keys].isna() & batch[keys].shift().isna())) | batch[CHUNK].ne(batch[CHUNK].shift())
            codes = run.cumsum().to_numpy()
            here = (None if pd.isna(batch[keys].iloc[0]) else batch[keys].iloc[0], batch[CHUNK].iloc[0])
            if carry[0] == here:
                carry = (codes[0], *carry[1:])
            else:
                carry = (-1, float("nan"), 0)
            blocks, carry = _pack_rows(
                codes, batch["__dur"].to_numpy(float), batch["__sum"].to_numpy(float), batch["__block"].to_numpy(np.int64), budget, carry)
            carry = ((None if pd.isna(batch[keys].iloc[-1]) else batch[keys].iloc[-1], batch[CHUNK].iloc[-1]), *carry[1:])
            # One line per block and batch, so that only blocks are shuffled.
            batch = batch.assign(block_no=blocks)
            grouped = batch.groupby([keys, "block_no"], sort=False, dropna=False)
            yield grouped.agg(start_s=("start_s", "first"), last_start=("start_s", "last"), end_s=("end_s", "last"),
                              intervals=("end_s", "size")).reset_index()

    sized = columns.select(keys, CHUNK, *order, "__dur", "__sum", "__block")
    packed = sized.repartition(keys, CHUNK).sortWithinPartitions(keys, CHUNK, *order).mapInPandas(
        fold, f"{keys} {kind}, block_no bigint, start_s double, last_start double, end_s double, intervals bigint"
    )
    return packed.groupBy(keys, "block_no").agg(
        F.min("start_s").alias("start_s"),
        F.max(F.struct("last_start", "end_s"))["end_s"].alias("end_s"),
        F.sum("intervals").alias("intervals"),
    )


def _entries(rows: DataFrame, keys: str, kind: str, budget: float) -> DataFrame:
    """(series, chunk) -> open total and block number at the start of each chunk of an oversized series."""

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_s", "end_s"])
        heads, ends, breaks = _chunk_effect(pdf["__dur"].to_numpy(), budget)
        return pd.DataFrame(
            {keys: [pdf[keys].iloc[0]], CHUNK: [pdf[CHUNK].iloc[0]], "heads": [heads], "ends": [ends], "breaks": [breaks]}
        )

    effects = (
        rows.where(HOT).select(keys, CHUNK, "start_s", "end_s", "__dur").groupBy(keys, CHUNK).applyInPandas(
            effect, f"{keys} {kind}, {CHUNK} bigint, heads array<double>, ends array<double>, breaks array<bigint>"
        )
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, total, block = None, None, 0
        for batch in batches:
            out = []
            for key, chunk, heads, ends, breaks in batch.itertuples(index=False):
                if key != series:
                    series, total, block = key, None, 0
                out.append((key, chunk, total, block))
                if total is None:
                    # The first row of a series opens block 0, as a break would, without counting one.
                    total, block = ends[0], block + breaks[0] - 1
                    continue
                at = first_break(total, np.asarray(heads), budget)
                if at < len(heads):
                    total, block = ends[at], block + breaks[at]
                else:
                    total = float(np.cumsum(np.concatenate([[total], heads]))[-1])
            yield pd.DataFrame(out, columns=[keys, CHUNK, "__sum", "__block"])

    return effects.repartition(keys).sortWithinPartitions(keys, CHUNK).mapInPandas(
        chain, f"{keys} {kind}, {CHUNK} bigint, __sum double, __block bigint"
    )


def rebase_times(segments: DataFrame, blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Block-local times to times in the recording."""
    keys = keys or ["series_id", "block_no"]
    starts = blocks.select(*keys, F.col("start_s").alias("__base"))
    return segments.join(starts, keys).withColumns({
        "start_s": F.col("start_s") + F.col("__base"),
        "end_s": F.col("end_s") + F.col("__base"),
    }).drop("__base")


def _bounds(intervals: DataFrame, rate: int, min_samples: int) -> DataFrame:
    return intervals.withColumns({
        "__low": F.greatest(F.lit(0), sample_at(F.col("start_s"), rate)),
        "__high": sample_at(F.col("end_s"), rate),
    }).where(F.col("__high") - F.col("__low") >= min_samples)


def long_enough(intervals: DataFrame, rate: int = K.SPEECH_RATE, min_samples: int = 0) -> DataFrame:
    """Intervals of at least so many samples."""
    return _bounds(intervals, rate, min_samples).drop("__low", "__high")


def slice_samples(samples: DataFrame, intervals: DataFrame, rate: int = K.SPEECH_RATE, min_samples: int = 0) -> DataFrame:
    """Samples inside each interval of their series of at least ``min_samples``, with their place in the slice."""
    return range_join(samples, _bounds(intervals, rate, min_samples), SERIES, "pos", "__low", "__high").withColumn(
        "slice_pos", F.col("pos") - F.col("__low")
    ).drop("__low", "__high")
