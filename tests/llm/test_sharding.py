import zlib

from rows import AWKWARD, frame, table_docs

from voxlake.llm.catalog import op4_byte_shards
from voxlake.llm.sharding import shard_by_bytes


def brute(rows, shards, overhead=16):
    sized = sorted((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + overhead) for d, t in rows)
    total, before, slots, out = sum(s for *_, s in sized), 0, {}, set()
    for d, c, s in sized:
        shard = min(shards - 1, (2 * before + s) * shards // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.add((d, s, c, "bytes", shard, slots[shard], None))
        before += s
    return out


def test_query_is_brute_force(spark):
    got = op4_byte_shards(spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in got} == brute(table_docs(), 40) and len(got) == len(table_docs())


def test_sizes_are_near_equal(spark):
    rows = op4_byte_shards(spark, "/root/testdata/sf0.001").collect()
    sums = {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
    mean, largest = sum(sums.values()) / 40, max(r["size"] for r in rows)
    assert all(abs(s - mean) <= largest for s in sums.values())


def test_awkward_rows(spark):
    rows = AWKWARD + [(None, "no id", "x")]
    got = {tuple(r) for r in shard_by_bytes(frame(spark, AWKWARD), 4).collect()}
    assert got == brute([(d, t) for d, t, _ in AWKWARD], 4)
    twice = shard_by_bytes(frame(spark, rows + rows), 4).collect()
    assert len(twice) == 2 * len(rows) and twice[0].asDict().keys() >= {"doc_id", "slot"}
    for s in {r.shard for r in twice}:
        assert sorted(r.slot for r in twice if r.shard == s) == list(range(sum(r.shard == s for r in twice)))


def test_empty(spark):
    assert shard_by_bytes(frame(spark).limit(0)).count() == 0
