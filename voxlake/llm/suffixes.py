"""Exact byte repeats from sorted suffixes."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from voxlake.llm.repeats import FIRST, SECOND, Context, Ranges, Unit, find_repeats, rolled
from voxlake.llm.wordcodes import CODES


COLUMNS = 32
PAIRED = 512  # contexts of one anchor that are compared by pairs of places in order


def _tokens(strings: list[bytes], token: int) -> np.ndarray:
    """The strings as rows of numbers, ``token`` (up to 8) bytes each, filled with zeros."""
    columns = max(1, -(-max(map(len, strings), default=0) // token))
    flat = b"".join([s.ljust(columns * token, b"\0") for s in strings])
    parts = np.zeros((len(strings), columns, 8), np.uint8)
    parts[:, :, :token] = np.frombuffer(flat, np.uint8).reshape(len(strings), columns, token)
    return parts.view(">u8")[:, :, 0].astype(np.uint64)


def sorted_prefixes(group: np.ndarray, strings: list[bytes], token: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the strings in order within their groups (numbers that ascend), and for each place the bytes shared
    with the next one of its group, ends counted as zeros. Multikey quicksort of all groups at once: one token a
    round parts the strings that agree so far, and only those that still agree go on."""
    columns, order = _tokens(strings, token), np.arange(len(strings))
    shared = np.zeros(len(strings), np.int64)
    at, run = order.copy(), np.asarray(group, np.int64)

    def part(keys: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((keys, run))
        order[at], keys = order[at][by], keys[by]
        other, same = keys[1:] ^ keys[:-1], run[1:] == run[:-1]
        ends = same & (other != 0)
        if begin >= 0:
            zeros = sum((other[ends] < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
            shared[at[:-1][ends]] = begin + zeros
        first = np.concatenate([[True], ~same | ends])
        alone = first & np.append(first[1:], True)
        return at[~alone], np.cumsum(first)[~alone]

    for c in range(columns.shape[1]):
        if not len(at):
            break
        at, run = part(columns[order[at], c], c * token)
    if len(at):  # equal but for zeros at their ends
        shared[at[:-1][run[1:] == run[:-1]]] = columns.shape[1] * token
        part(np.array([len(s) for s in strings], np.uint64)[order[at]], -1)
    return order, shared


def multikey_quicksort(strings: list[bytes], token: int = 8) -> list[int]:
    """Indexes of the strings in order."""
    return sorted_prefixes(np.zeros(len(strings), np.int64), strings, token)[0].tolist()


class _Side:
    """Strings of several groups in order, to tell how many leading bytes any two of a group share."""

    def __init__(self, group: np.ndarray, strings: list[bytes]) -> None:
        self.group, self.sizes = group, np.array([len(s) for s in strings], np.int64)
        self.order, self.shared = sorted_prefixes(group, strings)

    def best(self) -> np.ndarray:
        """The most that each string shares with any other: one of its neighbours in order has it."""
        out = np.zeros(len(self.order), np.int64)
        n = np.where(self.group[1:] == self.group[:-1], self.shared[:-1], 0)
        for x, y in ((self.order[:-1], self.order[1:]), (self.order[1:], self.order[:-1])):
            out[x] = np.maximum(out[x], np.minimum(n, np.minimum(self.sizes[x], self.sizes[y])))
        return out

    def pairs(self, chosen: np.ndarray, row: np.ndarray, column: np.ndarray, size: int) -> np.ndarray:
        """What every two chosen strings of a group share, at ``row`` of one and ``column`` of the other: the least
        of what neighbours share between them."""
        out = np.zeros(size, np.int32)
        place = np.flatnonzero(chosen[self.order])
        if not len(place):
            return out
        order, group, least = self.order[place], self.group[place], np.minimum.reduceat(self.shared, place)
        at, run, d = np.arange(len(order)), np.full(len(order), np.iinfo(np.int64).max), 0
        while True:
            on = (at + d + 1 < len(order)) & (group[np.minimum(at + d + 1, len(order) - 1)] == group[at])
            at, run = at[on], run[on]
            if not len(at):
                return out
            run, d = np.minimum(run, least[at + d]), d + 1
            x, y = order[at], order[at + d]
            out[row[x] + column[y]] = out[row[y] + column[x]] = np.minimum(run, np.minimum(self.sizes[x], self.sizes[y]))


def _repeated_starts(keys: list[tuple[int, bytes]], span: int) -> list[np.ndarray]:
    """For each context the starts of its strings of ``span`` bytes that another context holds at the same
    distance from the anchor, by sorting all of them (128-bit hashes): linear in the contexts, not in pairs.
    Distances are taken COLUMNS at a time, which bounds what the sort needs."""
    before = max((at for at, _ in keys), default=0)
    width = max((len(body) - span + 1 + before - at for at, body in keys), default=0)
    if width <= 0:
        return [np.zeros(0, np.int64)] * len(keys)
    one, two = (np.zeros((len(keys), width), np.uint64) for _ in range(2))
    valid, hit = (np.zeros((len(keys), width), bool) for _ in range(2))
    for i, (at, body) in enumerate(keys):
        n = len(body) - span + 1
        if n > 0:
            codes, own = CODES[np.frombuffer(body, np.uint8)], slice(before - at, before - at + n)
            with np.errstate(over="ignore"):
                one[i, own], two[i, own] = rolled(codes, span, FIRST), rolled(codes, span, SECOND)
            valid[i, own] = True
    for begin in range(0, width, COLUMNS):
        row, shift = np.nonzero(valid[:, begin : begin + COLUMNS])
        shift += begin
        x, y = one[row, shift], two[row, shift]
        order = np.lexsort((shift, y, x))  # the same place may stand in two contexts, but not at one distance
        row, shift, x, y = row[order], shift[order], x[order], y[order]
        same = np.flatnonzero((x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (shift[1:] == shift[:-1]))
        hit[row[same], shift[same]] = hit[row[same + 1], shift[same + 1]] = True
    return [np.flatnonzero(h) - before + at for h, (at, _) in zip(hit, keys)]


def repeated_bytes(span: int):
    """A matcher: the ranges of bytes in strings of ``span`` bytes that another context of the anchor holds.

    The suffixes from the anchors and the reversed prefixes before them are sorted, for many anchors at once; where
    the best neighbours of a context don't add up to ``span`` bytes, none of its strings is repeated. Of the others
    any two share the least that neighbours between them share, to the right and to the left; where both add up to
    ``span``, all of it is in repeated strings. Above PAIRED contexts of one anchor the strings themselves are compared."""

    def match(groups: list[list[Context]]) -> list[list[Ranges]]:
        counts: list[Counter] = []
        for contexts in groups:
            counts.append(Counter())
            for _, at, body, places in contexts:
                counts[-1][at, body] += places
        keys = [key for count in counts for key in count]
        whole = [n > 1 and len(body) >= span for count in counts for (_, body), n in count.items()]
        found: list[Ranges] = [[(0, len(body))] if x else [] for (_, body), x in zip(keys, whole)]
        group = np.repeat(np.arange(len(counts)), [len(count) for count in counts])
        first = np.searchsorted(group, np.arange(len(counts)))
        right, left = _Side(group, [body[at:] for at, body in keys]), _Side(group, [body[:at][::-1] for at, body in keys])
        hopeful = right.best() + left.best() >= span
        n = np.bincount(group[hopeful], minlength=len(counts))
        few = hopeful & (n <= PAIRED)[group]
        own, size = np.flatnonzero(few), np.where(n <= PAIRED, n, 0)
        if len(own):
            before = np.cumsum(few) - few
            column = before - before[first][group]
            row = (np.cumsum(size * size) - size * size)[group] + column * size[group]
            ends = int((size * size).sum())
            r, l = right.pairs(few, row, column, ends), left.pairs(few, row, column, ends)  # noqa: E741
            enough = r + l >= span
            high, low = (np.maximum.reduceat(np.where(enough, x, 0), row[own]) for x in (r, l))
            for i, a, b in zip(own.tolist(), low.tolist(), high.tolist()):
                if not whole[i] and a + b >= span:
                    found[i] = [(keys[i][0] - a, keys[i][0] + b)]
        for g in np.flatnonzero(n > PAIRED).tolist():
            own = first[g] + np.flatnonzero(hopeful[group == g])
            for i, starts in zip(own.tolist(), _repeated_starts([keys[i] for i in own.tolist()], span)):
                if not whole[i] and len(starts):
                    cuts = np.nonzero(np.diff(starts) > 1)[0] + 1
                    found[i] = [(int(x[0]), int(x[-1]) + span) for x in np.split(starts, cuts)]
        out = []
        for contexts, count, begin in zip(groups, counts, first.tolist()):
            place = {key: begin + i for i, key in enumerate(count)}
            out.append([found[place[at, body]] for _, at, body, _ in contexts])
        return out

    return match


def byte_unit(span: int, gram: int) -> Unit:
    def read(text: str) -> tuple[np.ndarray, bytes]:
        data = text.encode("utf-8", "surrogatepass")
        return CODES[np.frombuffer(data, np.uint8)], data

    def join(data: bytes, keep: np.ndarray | None) -> bytes:
        return data if keep is None else np.frombuffer(data, np.uint8)[keep].tobytes()

    return Unit(span, gram, read, lambda data, a, b: data[a:b], join)


def remove_repeated_bytes(docs: DataFrame, span: int = 400, gram: int = 64, hot: int = 16384, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per document: ``id_col, n_units`` (UTF-8 bytes), ``n_removed, n_spans, kept_sha256, removed`` and,
    with ``keep_text``, ``kept``: the text without the bytes in strings of ``span`` bytes that also start at any
    other place (null where nothing is removed; cut characters read as U+FFFD).

    A full suffix array of a corpus moves every suffix with its leading bytes, hundreds of times the input. Here
    only the suffixes at the anchors of ``repeats`` that occur again are sorted: Spark range-partitions them by
    their leading bytes (sampled splitters), a bucket sorts the suffixes of equal anchors by multikey quicksort,
    many anchors at once, and compares neighbours. The range partitioner never parts equal leading bytes, so no comparison across
    a boundary is open; anchors with more than ``hot`` occurrences are cut into single strings instead.

    Null and empty texts have no bytes; copies and repeated rows remove one another if they have ``span`` bytes;
    matches never cross documents; an empty table gives no rows.
    """
    return find_repeats(docs, byte_unit(span, gram), repeated_bytes(span), False, True, hot, id_col, text_col, keep_text)
