"""Passages that occur in more than one place, found from sparse anchors.

A string of ``span`` units (words or bytes) always holds the smallest hash among its grams of ``gram`` units,
and equal strings hold it at the same offset. So only the places of such minima (anchors) are compared, about
two in ``span - gram`` units, and no repeated string is missed. Anchors that occur once end here; around the
others a context of all strings that hold the anchor goes to the task of its anchor, where the operator's own
matcher decides exactly. An anchor with more than ``hot`` occurrences has its contexts cut into single strings
of ``span`` units, which meet by a 128-bit hash under partial aggregation, so no task holds a hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tables import saved, whole
from voxlake.llm.wordcodes import mixed

SLICE = 1 << 20
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd multipliers
Ranges = list[tuple[int, int]]
#: Document, distance of the anchor, text, and at how many places of the document it stands.
Context = tuple[int, int, bytes, int]
#: The ranges of every context, for the contexts of several anchors.
Matcher = Callable[[list[list[Context]]], list[list[Ranges]]]
MATCHED = 2048


@dataclass(frozen=True)
class Unit:
    """How a text is read: its codes (one 64-bit number per unit), a stretch of it, and what is left of it."""

    span: int
    gram: int
    read: Callable[[str], tuple[np.ndarray, object]]
    body: Callable[[object, int, int], bytes]
    join: Callable[[object, np.ndarray | None], bytes]


def rolled(codes: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """The polynomial hash of every ``n`` neighbours, by doubling."""
    size, power, h = 1, factor, codes
    out: np.ndarray | None = None
    done = 0
    while True:
        if n & size:  # the next ``size`` units behind those already taken
            part = h[done : done + len(codes) - n + 1]
            out = part.copy() if out is None else out * power + part
            done += size
        if size * 2 > n:
            return mixed(out)
        h = h[: len(h) - size] * power + h[size:]
        power = power * power
        size *= 2


def sliding(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = op(x[: len(x) - size], x[size:])
        size *= 2
    return op(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(codes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all grams that are the smallest of some ``span`` units; long texts in slices."""
    n = len(codes)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, hashes = [], []
    width = span - gram + 1
    with np.errstate(over="ignore"):
        for at in range(0, n, SLICE):
            begin = max(0, at - span)
            part = codes[begin : at + SLICE + span]
            if len(part) < span:
                continue
            h = rolled(part, gram, FIRST)
            key = (h >> np.uint64(32)).astype(np.uint32)  # half the bytes for the minima; of equal keys all are anchors
            least = sliding(key, width, np.minimum)
            edge = np.zeros(width - 1, np.uint32)
            p = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == key)
            p = p[(p + begin >= at) & (p + begin < at + SLICE)]
            places.append(p + begin)
            hashes.append(h[p].view(np.int64))
    return np.concatenate(places), np.concatenate(hashes)


def merged(ranges: Ranges) -> Ranges:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _anchor_rows(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sizes, sums, once, again = [], [], [], []
                for text in part.column(2).to_pylist():
                    codes, parsed = unit.read(text)
                    h, count = np.unique(anchors(codes, unit.span, unit.gram)[1], return_counts=True)
                    sizes.append(len(codes))
                    sums.append(sha256(unit.join(parsed, None)).hexdigest())
                    once.append(h)
                    again.append(h[count > 1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(sums), _lists(once), _lists(again)],
                    ["doc", "print", "n_units", "sha", "once", "again"])

    return run


def _contexts(unit: Unit) -> Callable:
    reach = unit.span - unit.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                rows = []
                for doc, mark, text, wanted in zip(*(c.to_pylist() for c in part.columns)):
                    codes, parsed = unit.read(text)
                    places, hashes = anchors(codes, unit.span, unit.gram)
                    own = np.isin(hashes, np.array(wanted, np.int64))
                    lows: dict[tuple[int, int, bytes], list[int]] = {}  # periodic text has one context at many places
                    lead: dict[int, int] = {}
                    for p, h in zip(places[own].tolist(), hashes[own].tolist()):
                        low, high = max(0, p - reach), min(len(codes), p + unit.span)
                        lows.setdefault((h, p - low, unit.body(parsed, low, high)), []).append(low)
                        if h not in lead:
                            lead[h] = int.from_bytes(unit.body(parsed, p, min(high, p + 8))[:8].ljust(8, b"\0"), "big", signed=False) >> 1
                    rows += [(h, lead[h], doc, mark, at, own_lows, body) for (h, at, body), own_lows in lows.items()]
                columns = zip(*rows) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CONTEXT.types)], schema=CONTEXT)

    return run


CONTEXT = pa.schema([("hash", pa.int64()), ("lead", pa.int64()), ("doc", pa.int64()), ("print", pa.binary()), ("at", pa.int64()), ("lows", pa.list_(pa.int64())), ("body", pa.binary())])
CONTEXT_SQL = "hash long, lead long, doc long, print binary, at long, lows array<long>, body binary"
RANGE_SQL = "doc long, print binary, low long, high long"


def _strings(unit: Unit) -> Callable:
    """The strings of ``span`` units that hold a hot anchor, each once per document place."""
    reach = unit.span - unit.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                codes, _ = unit.read(text)
                places, hashes = anchors(codes, unit.span, unit.gram)
                own = places[np.isin(hashes, np.array(wanted, np.int64))]
                starts = np.unique((own[:, None] - np.arange(reach + 1)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts <= len(codes) - unit.span)]
                with np.errstate(over="ignore"):
                    one, two = (rolled(codes, unit.span, f)[starts].view(np.int64) for f in (FIRST, SECOND))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array([doc] * len(starts), pa.int64()), pa.array([mark] * len(starts), pa.binary()), pa.array(starts)],
                    ["one", "two", "doc", "print", "low"])

    return run


def _matched(unit: Unit, matcher: Matcher) -> Callable:
    """Runs the matcher on the contexts of the anchors, which stand together; about MATCHED contexts at a time."""

    def ranges(groups: list[list[tuple]]) -> pa.RecordBatch:
        found = matcher([[(r[2], r[4], r[6], len(r[5])) for r in own] for own in groups])
        out = []
        for own, parts in zip(groups, found):
            for r, part in zip(own, parts):
                if part:
                    out += [(r[2], r[3], a, b) for a, b in merged([(low + a, low + b) for low in r[5] for a, b in part])]
        return _range_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(begin, 256) for batch in batches for begin in range(0, batch.num_rows, 256))
        rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns)))
        groups, size = [], 0
        for _, group in groupby(rows, key=lambda r: r[0]):
            own = list(group)
            if len(own) > 1 or len(own[0][5]) > 1:
                groups.append(own)
                size += len(own)
            if size >= MATCHED:
                yield ranges(groups)
                groups, size = [], 0
        yield ranges(groups) if groups else _range_batch([])

    return run


def _range_batch(rows: list[tuple[int, bytes, int, int]]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], ["doc", "print", "low", "high"])


def _left(unit: Unit) -> Callable:
    """What is left of a document without its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, mark, text, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                codes, parsed = unit.read(text)
                keep = np.ones(len(codes), bool)
                spans = merged([(r["low"], r["high"]) for r in ranges])
                for a, b in spans:
                    keep[a:b] = False
                rest = unit.join(parsed, keep)
                rows.append((doc, mark, int((~keep).sum()), len(spans), sha256(rest).hexdigest(), rest.decode("utf-8", "replace"), [{"low": a, "high": b} for a, b in spans]))
            columns = zip(*rows) if rows else [[]] * 7
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc", "print", "n_removed", "n_spans", "sha", "rest", "removed"])

    return run


def find_repeats(
    docs: DataFrame, unit: Unit, matcher: Matcher,
    earlier: bool, by_lead: bool, hot: int = 16384, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
) -> DataFrame:
    """One row per document: id, ``n_units, n_removed, n_spans, kept_sha256, removed`` (ranges of units) and, on
    request, the ``kept`` text (null where nothing was removed).

    ``earlier``: a string counts as repeated if it occurs in a document with a smaller id (a missing id is the
    largest); else if it occurs at any other place. Equal texts are compared by one of them. ``by_lead``:
    contexts are range-partitioned by their leading units (sampled splitters; equal leads stay together), else
    by the anchor's hash.
    """
    least_id = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    source = docs.select(least_id.alias("doc"), F.unhex(F.md5(whole(text_col).cast("binary"))).alias("print"), whole(text_col).alias("text"))
    rows = saved(
        source.mapInArrow(_anchor_rows(unit), "doc long, print binary, n_units long, sha string, once array<long>, again array<long>"), "anchors")
    groups = rows.groupBy("print").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    mark = F.xxhash64("print")
    seen = rows.select(F.explode("once").alias("hash"), mark.alias("mark"))
    if not earlier:  # a second place in the same document counts like another document
        seen = seen.unionAll(rows.select(F.explode("again").alias("hash"), (mark + 1).alias("mark")))
    shared = (
        seen.groupBy("hash").agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.count(F.lit(1)).alias("n"))
        .filter("a < b").select("hash", (F.col("n") > hot).alias("hot"))
    )
    reps = groups.select("print", F.col("rep").alias("doc"))
    wanted = (
        rows.select("doc", "print", F.explode("once").alias("hash")).join(shared, "hash")
        .groupBy("doc", "print").agg(
            F.collect_set(F.when(~F.col("hot"), F.col("hash"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("hash"))).alias("hot"))
        .join(reps, ["doc", "print"])
    )
    found = saved(source.join(wanted, ["doc", "print"]), "repeat-candidates")

    contexts = found.filter(F.size("cold") > 0).select("doc", "print", "text", "cold").mapInArrow(_contexts(unit), CONTEXT_SQL)
    dealt = contexts.repartitionByRange("lead", "hash") if by_lead else contexts.repartition("hash")
    cold = dealt.sortWithinPartitions("lead", "hash", "doc").mapInArrow(_matched(unit, matcher), RANGE_SQL)

    strings = saved(
        found.filter(F.size("hot") > 0).select("doc", "print", "text", "hot")
        .mapInArrow(_strings(unit), "one long, two long, doc long, print binary, low long"), "hot-strings")
    met = strings.groupBy("one", "two").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = strings.join(met, ["one", "two"]).filter("least < doc" if earlier else "n > 1")
    warm = repeated.select("doc", "print", "low", (F.col("low") + unit.span).alias("high"))

    ranges = cold.unionAll(warm).groupBy("doc", "print").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    span_type = "array<struct<low:long,high:long>>"
    cut = found.select("doc", "print", "text").join(ranges, ["doc", "print"]).select("doc", "print", "text", "ranges").mapInArrow(
        _left(unit), f"doc long, print binary, n_removed long, n_spans long, cut_sha string, rest string, removed {span_type}").dropDuplicates(["doc", "print"])

    gone = (F.col("doc") > F.col("rep") if earlier else F.col("copies") > 1) & (F.col("n_units") >= unit.span)
    pick = lambda all_gone, some, none: F.when(gone, all_gone).when(F.col("n_removed").isNotNull(), some).otherwise(none)
    nothing = F.lit(0).cast("long")
    table = rows.select("doc", "print", "n_units", "sha").join(groups, "print").join(cut, ["doc", "print"], "left")
    columns = [
        F.when(F.col("doc") < (1 << 63) - 1, F.col("doc")).alias(id_col),
        "n_units",
        pick(F.col("n_units"), F.col("n_removed"), nothing).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), nothing).alias("n_spans"),
        pick(F.sha2(F.lit("").cast("binary"), 256), F.col("cut_sha"), F.col("sha")).alias("kept_sha256"),
        pick(F.array(F.struct(nothing.alias("low"), F.col("n_units").alias("high"))).cast(span_type), F.col("removed"), F.array().cast(span_type)).alias("removed"),
    ]
    if keep_text:
        columns.append(pick(F.lit(""), F.col("rest"), F.lit(None).cast("string")).alias("kept"))
    return table.select(*columns)
