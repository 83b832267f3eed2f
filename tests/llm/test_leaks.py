from rows import AWKWARD, frame, table_docs, FOLDER
import pytest

from voxlake.llm import leaks
from voxlake.llm.catalog import op6_benchmark_leaks


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return w, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(docs, items):
    out = set()
    for i, t in items:
        w, _ = shingles(t, 0)
        if not w or i is None:
            continue
        n = min(5, len(w))
        own = shingles(t, n)[1]
        for d, text in docs:
            if d is not None and 100 * len(own & shingles(text, n)[1]) >= 80 * len(own):
                out.add((d, i, len(own), len(own & shingles(text, n)[1])))
    return out


def of(df):
    rows = [(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_query_is_brute_force(spark, monkeypatch, most):
    import pyarrow.parquet as pq

    monkeypatch.setattr(leaks, "BROADCAST_SKETCH_ROWS", most)
    b = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()
    got = of(op6_benchmark_leaks(spark, FOLDER))
    assert got == brute(table_docs(), list(zip(b["item_id"], b["text"]))) and got


def test_awkward_rows(spark):
    items = [(1, "one two three four five six"), (2, "One"), (3, None), (4, ""), (None, "one"), (5, "lorem ipsum dolor sit amet lorem ipsum"), (6, "not there at all"), (7, "one"), (8, "漢字 😀 é ñ ß 漢字 nope")]
    df = spark.createDataFrame([(i, t, "k", 2) for i, t in items], "item_id long, text string, doc string, hash int")
    rows = AWKWARD + [(None, "one", "s"), (4, "one", "s")]
    docs = [(d, t) for d, t, _ in AWKWARD]
    assert of(leaks.find_leaks(frame(spark, rows), df)) == brute(docs, items)
    assert leaks.find_leaks(frame(spark).limit(0), df).count() == 0
    assert leaks.find_leaks(frame(spark), df.limit(0)).count() == 0
