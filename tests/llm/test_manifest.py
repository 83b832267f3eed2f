import hashlib

import pytest
from pyspark.sql import functions as F
from rows import AWKWARD
from voxlake.llm.manifest import merkle_manifest, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, tree string, idx long, node string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[2], row[3], None if row[4] is None else row[4] + more, row[1]]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fanout):
    """The root, and for every node its siblings (before, after) level by level."""
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for way, p in zip(ways, places):
            way.append((runs[p // fanout][: p % fanout], runs[p // fanout][p % fanout + 1 :]))
        places = [p // fanout for p in places]
        nodes = [H(*r) for r in runs]
    return (nodes or [None])[0], ways


def expected(rows, fanout):
    langs = sorted({r[3] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[3] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own], fanout)))
    root, above = climb([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, ways), upper in zip(trees, above):
        for r, way in zip(own, ways):
            steps = way + upper
            wrong = r[0] is not None and r[0] % 2 == 0
            node = leaf(r, 1) if wrong else leaf(r)
            for before, after in steps:
                node = H(*before, node, *after)
            out.append((r[0], leaf(r), subroot, root, H(*[d for b, a in steps for d in b + a]), node, node == root))
    return sorted(out, key=repr)


def got(spark, rows, fanout):
    docs = spark.createDataFrame([(*r, "t", 0, "n") for r in rows], SCHEMA)
    out = merkle_manifest(docs, F.col("doc_id") % 2 == 0, fanout=fanout)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()), key=repr)


def awkward():
    langs = ["en", None, "é", "z"]
    rows = [(i, t, s, langs[i % 4], None if i % 5 == 0 else i) for i, t, s in AWKWARD]
    return [*rows, (None, "no id", "x", "en", 1), (None, None, None, None, None), (6, "twice", "x", "only", 3), (6, "twice", "x", "en", 3), (6, "twice", "x", "en", 3)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_awkward_rows(spark, fanout):
    assert got(spark, awkward(), fanout) == expected(awkward(), fanout)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_one_group(spark, n):
    rows = [(i, f"t{i}", "s", "en", i) for i in range(n)]
    assert got(spark, rows, 2) == expected(rows, 2)


def test_large_group_over_partitions(spark):
    rows = [(i, f"t{i % 50}", "s", "en" if i % 3 else f"l{i % 4}", i) for i in range(700)]
    assert got(spark, rows, 2) == expected(rows, 2)


def test_empty(spark):
    assert got(spark, [], 2) == []


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted((r.k, r.at) for r in numbered(rows, [F.col("k").asc()], "at").collect()) == [(i, i) for i in range(1000)]
