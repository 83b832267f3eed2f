import hashlib
import re

import numpy as np
import pytest
from rows import AWKWARD, frame, table_docs
from voxlake.llm import fuse
from voxlake.llm.snapshots import exact_duplicates, found_in, freeze


def expected(rows):
    """For every row (id, text): id to keep, group size and digest, by plain grouping."""
    squeezed = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), s in zip(rows, squeezed):
        group = [(-len(t or ""), 1 << 63 if j is None else j) for (j, t), other in zip(rows, squeezed) if other == s]
        keep = min(group)[1]
        out.append((i, None if keep == 1 << 63 else keep, len(group), hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 3])
def test_awkward_rows(spark, batches):
    rows = [*AWKWARD, (None, "One two three\tfour five six", "x"), (None, "no id", "x"), (20, "o n e", "y"), (21, "one ", "y"), (21, "one ", "y"), (22, "éñß漢字😀" * 30, "x")]
    out = exact_duplicates(frame(spark, rows), batches)
    assert result(out) == expected([r[:2] for r in rows])
    kept = out.filter("kept").collect()
    assert len(kept) == len({r.text_sha256 for r in kept}) == out.select("text_sha256").distinct().count()
    assert all(r.doc_id == r.keep_id for r in kept)


def test_table(spark):
    rows = table_docs()
    assert result(exact_duplicates(frame(spark, [(i, t, None) for i, t in rows], more=False))) == expected(rows)


def test_one_text_holds_most_rows(spark):
    rows = [(i, "the same" if i % 3 else f"own {i}", None) for i in range(3000)]
    assert result(exact_duplicates(frame(spark, rows, more=False), 2)) == expected_fast(rows)


def expected_fast(rows):
    same = [r[0] for r in rows if r[1] == "the same"]
    digest = lambda t: hashlib.sha256(t.replace(" ", "").encode()).hexdigest()
    return sorted(((i, min(same), len(same), digest(t)) if t == "the same" else (i, i, 1, digest(t)) for i, t, _ in rows), key=repr)


def test_empty(spark):
    assert exact_duplicates(frame(spark).limit(0)).collect() == []


def test_equal_digests_of_different_texts_are_told_apart_by_bytes(spark):
    batch = lambda rows: spark.createDataFrame(rows, "digest long, body string")
    old = freeze(batch([(7, "a"), (7, "b"), (8, "c"), (8, "c")]), 0)
    new = freeze(batch([(7, "b"), (7, "x"), (8, "y"), (9, "c")]), 1)
    assert old.texts.count() == 3
    assert [(r.digest, bytes(r.sha)) for r in found_in(new, old).collect()] == [(7, hashlib.sha256(b"b").digest())]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 70_000])
def test_fuse_filter_has_all_keys_and_few_others(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64))[:n]
    made = fuse.build_filter(keys)
    assert fuse.contains(keys, *made).all()
    others = np.random.default_rng(1).integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
    assert fuse.contains(others, *made).mean() < 0.006
    assert n < 70_000 or len(made[3]) < 1.3 * n


def test_filters_by_shard(spark, monkeypatch):
    monkeypatch.setattr(fuse, "PER_SHARD", 500)
    digests = spark.range(6000).selectExpr("xxhash64(id) AS digest")
    filters, shards = fuse.build_filters(digests.filter("digest % 3 = 0"))
    assert shards >= 4 and filters.count() == shards
    through = {r.digest for r in fuse.let_through(digests, filters, shards).collect()}
    held = {r.digest for r in digests.filter("digest % 3 = 0").collect()}
    assert held <= through and len(through) < len(held) + 80
