"""Static binary-fuse filters over 64-bit digests, one for every shard of a snapshot."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tables import saved
from voxlake.llm.wordcodes import STEP, mixed

PER_SHARD = 1 << 16  # digests of one filter, about; a snapshot gets as many shards as it needs
ATTEMPTS = 100
FILTER_SQL = "shard int, seed long, length long, segments long, cells binary"
FILTER = pa.schema([("shard", pa.int32()), ("seed", pa.int64()), ("length", pa.int64()), ("segments", pa.int64()), ("cells", pa.binary())])


def layout(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments in which a slot 0 may lie, for ``n`` keys."""
    length = min(1 << 18, 1 << max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    return length, max(1, math.ceil(n * factor / length) - 2)


def _hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(keys ^ (np.uint64(seed + 1) * STEP))


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three cells of every key: in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    inside, step = np.uint64(length - 1), np.uint64(length)
    second = (first + step) ^ ((h >> np.uint64(18)) & inside)
    third = (first + step + step) ^ (h & inside)
    return np.stack([first, second, third]).astype(np.int64)


def _marks(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def _peeled(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Layers (keys, their own cells): a cell that only one key is left at belongs to it. None if keys remain."""
    n = at.shape[1]
    degree = np.bincount(at.ravel(), minlength=size)
    holders = np.zeros(size, np.int64)  # exclusive or of the keys left at a cell
    for row in at:
        np.bitwise_xor.at(holders, row, np.arange(n))
    layers, done, alone = [], 0, np.flatnonzero(degree == 1)
    while len(alone):
        keys, first = np.unique(holders[alone], return_index=True)
        layers.append((keys, alone[first]))
        done += len(keys)
        cells = at[:, keys].ravel()
        np.subtract.at(degree, cells, 1)
        np.bitwise_xor.at(holders, cells, np.tile(keys, 3))
        alone = np.unique(cells[degree[cells] == 1])
    return layers if done == n else None


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, segments and cells for distinct uint64 keys: 8 bits a cell, about 9 a key."""
    length, segments = layout(len(keys))
    for seed in range(ATTEMPTS):
        h = _hashed(keys, seed)
        at = _slots(h, length, segments)
        layers = _peeled(at, (segments + 2) * length)
        if layers is not None:
            cells, marks = np.zeros((segments + 2) * length, np.uint8), _marks(h)
            for own, slot in reversed(layers):  # the other two cells of a key are settled before its own
                a, b, c = at[:, own]
                cells[slot] = marks[own] ^ cells[a] ^ cells[b] ^ cells[c]
            return seed, length, segments, cells.tobytes()
        segments += 1 + segments // 16
    raise ValueError("equal keys given to a filter")


def contains(keys: np.ndarray, seed: int, length: int, segments: int, cells: bytes) -> np.ndarray:
    """True for every key of the filter, and for one in 256 of the others."""
    h = _hashed(keys, seed)
    a, b, c = np.frombuffer(cells, np.uint8)[_slots(h, length, segments)]
    return (a ^ b ^ c) == _marks(h)


def _shard(digest: str | Column, shards: int) -> Column:
    return F.pmod(F.col(digest) if isinstance(digest, str) else digest, F.lit(shards)).cast("int")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for every run of equal shards."""

    def made(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        built = build_filter(np.concatenate(parts).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, *built), FILTER.types)], schema=FILTER)

    now, parts = -1, []
    for batch in batches:
        shards, digests = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        edges = np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1)) if len(shards) else []
        for begin, end in zip(edges, [*edges[1:], len(shards)]):
            if shards[begin] != now and parts:
                yield made(now, parts)
                parts = []
            now = int(shards[begin])
            parts.append(digests[begin:end].copy())
    if parts:
        yield made(now, parts)


def build_filters(digests: DataFrame) -> tuple[DataFrame, int]:
    """The filters of a table of ``digest`` (null-free), saved, and their number of shards. A task holds the digests of
    one shard, about PER_SHARD, at a time; shards grow in number, not in size."""
    distinct = digests.select("digest").distinct()
    n = distinct.count()
    shards = 1 << max(0, math.ceil(math.log2(max(n, 1) / PER_SHARD)))
    sharded = distinct.select(_shard("digest", shards).alias("shard"), "digest")
    return saved(sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, FILTER_SQL), "fuse-filters"), shards


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by shard, a filter first, the digests that the filter lets through."""
    now, known = -1, None
    for batch in batches:
        shards, kinds, digests = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edges = np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1)) if len(shards) else []
        out = []
        for begin, end in zip(edges, [*edges[1:], len(shards)]):
            if shards[begin] != now:
                now, known = shards[begin], None
            if kinds[begin] == 0:
                known = [batch.column(i)[int(begin)].as_py() for i in range(3, 7)]
                begin += 1
            if known is not None:
                asked = digests[begin:end]
                out.append(asked[contains(asked.view(np.uint64), *known)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], ["digest"])


def let_through(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct digests of ``digests`` that may be in the snapshot of the filters. The digests go to their shard's
    filter, so no task holds more than one filter and none is broadcast."""
    parts = ["seed", "length", "segments", "cells"]
    kinds = {f.split()[0]: f.split()[1] for f in FILTER_SQL.split(", ")}
    asked = digests.select("digest").distinct().select(
        _shard("digest", shards).alias("shard"), F.lit(1).alias("kind"), "digest", *[F.lit(None).cast(kinds[c]).alias(c) for c in parts])
    held = filters.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("digest"), *parts)
    return held.unionAll(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_probe, "digest long")
