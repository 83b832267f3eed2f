import zlib

import numpy as np
import pytest
from rows import AWKWARD, FOLDER, frame, table_docs

from voxlake.llm import packing
from voxlake.llm.catalog import op8_best_fit_packing
from voxlake.llm.tables import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def pieces(tokenizer, rows, length=4096):
    out = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(d, i, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes())) for i, at in enumerate(range(0, len(ids), length))]
    return sorted(out)


def check(got, want, length=4096):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), sum(r.length for r in got)


def test_query_is_brute_force(spark, tokenizer):
    used, total = check(op8_best_fit_packing(spark, FOLDER).collect(), pieces(tokenizer, table_docs()))
    assert used <= -(-total // 4096) * 1.02 + 1


STRANGE = [(100, "<|endoftext|> a<|startoftext|>b"), (101, "a b c d\x1ce\x85f"), (102, "é ́x İI"), (103, "it's I'll we'd\r\nx\tY"), (104, "the " * 9000), (105, "x" * 30000), (106, "١٢3½ ...!!"), (107, "a\xa0b\u2003c\u2028d!\x1c!\x1fe f\x0bg\x0ch")]


def test_awkward_rows(spark, tokenizer):
    rows = AWKWARD + [(d, t, "s") for d, t in STRANGE] + [AWKWARD[3]]
    got = packing.best_fit_packing(frame(spark, rows), vocabulary("word_bpe_49k.json"), 4096, unit_rows=5).collect()
    check(got, pieces(tokenizer, [(d, t) for d, t, _ in rows]))
    assert packing.best_fit_packing(frame(spark).limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_grouping_packs_tightly():
    rng = np.random.default_rng(4)
    lengths = np.sort(np.concatenate([rng.integers(900, 4096, 3000), rng.integers(1, 400, 6000)]))[::-1]
    bins = packing.pack(lengths, 4096)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 4096 and len(fill) <= np.ceil(lengths.sum() / 4096) * 1.08
    sizes, counts = np.array([2000, 1300, 700]), np.array([100, 200, 300])
    used = sum(c * n for c, n in packing.configurations(sizes, counts, 4096))
    assert (used <= counts).all() and used.sum() > 550
    assert packing.pack(np.array([4096, 4096, 1]), 4096).tolist() == [0, 1, 2]


def test_grouping_counts_on_ties():
    lengths = np.repeat([2000, 1000], [60, 60])
    plain, rooms = np.zeros(len(lengths), np.int64), []
    packing.best_fit(np.arange(len(lengths)), lengths, rooms, plain, 4096)
    bins = packing.pack(lengths, 4096)
    assert bins.max() + 1 == len(rooms) and (bins != plain).any()


def test_equal_rows_are_spread(spark):
    rows = [(7, "one two three", "s")] * 200 + [(None, "four five", "s")] * 200
    got = packing.best_fit_packing(frame(spark, rows), vocabulary("word_bpe_49k.json"), 4096, unit_rows=40).collect()
    sizes = np.bincount([r.sequence_id >> 32 for r in got], minlength=10)
    assert len(got) == 400 and sizes.max() < 100 and (sizes > 0).all()


@pytest.mark.parametrize("name,low,high,n", [("few", 1, 4097, 30), ("even", 1, 4097, 1500), ("thirds", 1200, 1500, 1500), ("halves", 2049, 4097, 200), ("small", 1, 500, 2000), ("full", 4096, 4097, 50), ("one", 7, 8, 1), ("none", 1, 2, 0)])
def test_grouping_against_plain_best_fit(name, low, high, n):
    lengths = np.sort(np.random.default_rng(3).integers(low, high, n))[::-1].copy()
    bins, plain, rooms = packing.pack(lengths, 4096), np.zeros(n, np.int64), []
    packing.best_fit(np.arange(n), lengths, rooms, plain, 4096)
    used = np.bincount(bins, weights=lengths) if n else np.zeros(0)
    assert len(bins) == n and (bins >= 0).all() and (used <= 4096).all() and (used > 0).all()
    assert len(used) <= 1.005 * len(rooms)
