"""Packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tables import saved

CHUNK = re.compile(r"[^ \t\n\r]+")
PIECES = "doc long, piece int, start long, length long, ids_crc32 long"
PIECE_TYPE = pa.schema([("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class ChunkEncoder:
    """Token ids as little-endian bytes. The tokenizer drops white space and joins nothing across it, so texts
    are encoded chunk by chunk, and chunks seen before come from a cache of bounded size."""

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most, self.longest = Tokenizer.from_file(path), {}, most, longest
        # A special token's string parts a text before anything else is done to it, so many chunks go in one call.
        self.mark_id, mark = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark = mark.content

    def encode(self, texts: list[str]) -> list[bytes]:
        # str.split() parts at the same white space but for four separators that the tokenizer keeps.
        chunks = [CHUNK.findall(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new = list(set(chain.from_iterable(chunks)).difference(known))
        plain = [c for c in new if "<|" not in c]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            data, begin = ids.tobytes(), 0
            for chunk, end in zip(part, ends, strict=True):
                known[chunk] = data[4 * begin : 4 * end]
                begin = end + 1
        for chunk in new:
            if "<|" in chunk:  # may hold a special token's string
                known[chunk] = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        out = [b"".join(map(known.__getitem__, own)) for own in chunks]
        for chunk in new:
            if len(chunk) > self.longest:
                del known[chunk]
        return out


def worker_encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker. Functions travel by value, so globals are new in every task; what the
    tasks of a worker share has to live in its module table."""
    shared = sys.modules.setdefault("voxlake_worker_state", ModuleType("voxlake_worker_state"))
    encoders = shared.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = ChunkEncoder(path)
    return encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, piece, start, length, ids_crc32): the tokens of every document and the closing id, cut only
    where a document is longer than a sequence. Null texts have the closing id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, close = worker_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        step = 4 * length
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += close
                    rows += [(doc, i, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(memoryview(ids)[at : at + step])) for i, at in enumerate(range(0, len(ids), step))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE_TYPE)], schema=PIECE_TYPE)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, PIECES)


def configurations(sizes: np.ndarray, counts: np.ndarray, room: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """How often to use which configuration (numbers of items of each size that fit in ``room``), by column
    generation: the dual prices of the configurations in use price the items, a knapsack over the prices finds
    a better configuration. Shares are rounded down, so no more items are placed than there are."""
    k = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        best, taken = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(1, room + 1):  # the best value of every room, one item on top of a smaller one
            fits = np.nonzero(sizes <= c)[0]
            if not len(fits):
                continue
            value = best[c - sizes[fits]] + prices[fits]
            i = int(value.argmax())
            if value[i] > best[c - 1] + 1e-12:
                best[c], taken[c] = value[i], fits[i]
            else:
                best[c] = best[c - 1]
        if best[room] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), room
        while c > 0:
            if taken[c] < 0:
                c -= 1
            else:
                column[taken[c]] += 1
                c -= sizes[taken[c]]
        use, turn = np.linalg.solve(basis, counts.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(turn > 1e-9, use / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    use = np.floor(np.maximum(np.linalg.solve(basis, counts.astype(float)), 0) + 1e-9).astype(int)
    return [(basis[:, j].round().astype(int), int(n)) for j, n in enumerate(use) if n > 0]


def best_fit(order: np.ndarray, lengths: np.ndarray, rooms: list[int], bins: np.ndarray, room: int) -> None:
    """Put the items of ``order`` into the fullest bins that still take them; ``rooms`` and ``bins`` change."""
    free: dict[int, list[int]] = {}
    for b, r in enumerate(rooms):
        free.setdefault(r, []).append(b)
    mask = sum(1 << r for r in free)
    for i in order:
        n = int(lengths[i])
        over = mask >> n
        if over:
            r = n + (over & -over).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
                del free[r]
        else:
            b, r = len(rooms), room
            rooms.append(room)
        bins[i] = b
        rooms[b] = left = r - n
        if left not in free:
            free[left] = []
            mask |= 1 << left
        free[left].append(b)


def grouped(lengths: np.ndarray, room: int, heads: int, groups: int, tight: bool) -> tuple[np.ndarray, list[int]]:
    """The bin of every item and the room left in each bin, with the first ``heads`` items rounded up in ``groups``
    groups of equal cardinality. ``tight``: the last place of a configuration, and the room that rounding leaves, go to
    the longest large items that fit, of whatever group; else that room is left to the small items."""
    bins, rooms = np.full(len(lengths), -1, np.int64), []
    after = list(range(heads + 1))  # the next item, itself included, that has no bin yet

    def unplaced(i: int) -> int:
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    def place(i: int, left: int) -> int:
        bins[i], after[i] = len(rooms), i + 1
        return left - int(lengths[i])

    if heads:
        cuts = np.linspace(0, heads, groups + 1).astype(int)
        sizes, where = np.unique(lengths[cuts[:-1]], return_inverse=True)
        members: list[list[int]] = [[] for _ in sizes]
        for g in range(groups):
            members[where[g]] += range(cuts[g], cuts[g + 1])
        members = [m[::-1] for m in members]  # longest last: it is taken first
        for config, times in configurations(sizes, np.array([len(m) for m in members]), room):
            slots = [s for s, c in enumerate(config) for _ in range(c)]
            for _ in range(times):
                left = room
                for s in slots[:-1] if tight else slots:
                    while members[s] and bins[members[s][-1]] >= 0:
                        members[s].pop()
                    if members[s]:
                        left = place(members[s].pop(), left)
                while tight and (i := unplaced(int(np.searchsorted(-lengths[:heads], -left)))) < heads:
                    left = place(i, left)
                if left < room:
                    rooms.append(left)
    best_fit(np.nonzero(bins < 0)[0], lengths, rooms, bins, room)
    return bins, rooms


def repaired(bins: np.ndarray, rooms: list[int], lengths: np.ndarray, room: int) -> tuple[np.ndarray, list[int]]:
    """The packing with the emptier half of its bins taken apart and their items put where they fit best."""
    order = np.argsort(np.array(rooms), kind="stable")
    kept = order[: len(order) - len(order) // 2]
    number = np.full(len(rooms), -1, np.int64)
    number[kept] = np.arange(len(kept))
    out, left = number[bins], [rooms[b] for b in kept]
    best_fit(np.nonzero(out < 0)[0], lengths, left, out, room)
    return out, left


def pack(lengths: np.ndarray, room: int, groups: int = 12, finest: int = 48, large: float = 0.2) -> np.ndarray:
    """The bin of every item (``lengths`` sorted downwards).

    Linear grouping: items above ``large * room`` form ``groups`` groups of equal cardinality (one of each item where
    they are fewer), each rounded up to its longest member; the few sizes left are packed by ``configurations``, actual
    items take the places, and what rounding left over goes with the small items to where it fits best. As
    rounding costs room, a packing above the lower bound is made again: with tight places, and with more groups up to
    ``finest``, each also ``repaired``. The one with the fewest bins counts, the first of equal ones.
    """
    heads = int((lengths > large * room).sum())
    least = -(-int(lengths.sum()) // room)
    best, fewest = None, len(lengths) + 1
    steps = [(groups, False), *((g, True) for g in (groups, 2 * groups, 4 * groups) if g <= max(groups, finest))]
    for g, tight in steps:
        if fewest <= least or (tight and g > groups and g // 2 >= heads):
            break
        made = grouped(lengths, room, heads, min(g, heads), tight)
        for bins, rooms in (made, repaired(*made, lengths, room)):
            if len(rooms) < fewest:
                best, fewest = bins, len(rooms)
    return best


PACKED = "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit_packing(
    docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, unit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Documents are tokenized where they are read and only narrow rows (no ids, no texts) move. The pieces are
    dealt by hash, equal ones too, to units of about ``unit_rows`` pieces, each packed by ``pack`` in one task; the number of
    units grows with the input, a unit doesn't, and what a unit wastes is part of its last sequences. Within a
    sequence pieces follow each other without gaps. Null and empty texts hold the closing id alone; documents
    with one id and equal texts are packed one by one; an empty table gives no rows.
    """
    pieces = saved(token_pieces(docs, tokenizer, length, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    units = max(1, -(-pieces.count() // unit_rows))

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc", "piece", "start"], ascending=[False, True, True, True]).reset_index(drop=True)
        number = int(pdf.pop("unit").iloc[0])
        pdf["sequence_id"] = pack(pdf["length"].to_numpy(), length) + (number << 32)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf

    dealt = pieces.withColumn("unit", F.pmod(F.xxhash64("doc", "piece", "ids_crc32", "row"), F.lit(units))).drop("row")
    return dealt.groupBy("unit").applyInPandas(unit, PACKED).withColumnRenamed("doc", id_col)
