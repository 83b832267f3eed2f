import numpy as np
from rows import AWKWARD, FOLDER, WORD, frame, table_docs

from voxlake.llm import quality
from voxlake.llm.catalog import op5_quality_trees
from voxlake.llm.trees import fit_trees


def brute(text):
    w, text = WORD.findall(text or ""), text or ""
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_query_is_brute_force(spark):
    got = {r.doc_id: r for r in op5_quality_trees(spark, FOLDER).collect()}
    for d, t in table_docs():
        n, chars, symbols, dup, rep = brute(t)
        r = got[d]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, chars, symbols, dup, rep]
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and (not r.kept or not r.base_failed)
    assert len(got) == len(table_docs())


def test_awkward_rows(spark):
    df = frame(spark)
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(df, no_labels)
    got = {r.doc_id: r for r in quality.rate_quality(df, model).collect()}
    for d, t, _ in AWKWARD:
        r = got[d]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute(t)
    assert quality.rate_quality(df.limit(0), model).count() == 0
    one_label = spark.createDataFrame([(1, 1), (8, 1), (8, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.rate_quality(df, quality.fit_quality(df, one_label)).count() == len(AWKWARD)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.fit_quality(docs, labels.filter(~held))
    scored = quality.rate_quality(docs, model).withColumnRenamed("quality", "score").join(labels.filter(held), "doc_id").select("score", "quality").toPandas()
    right = ((scored.score >= 0.5) == (scored.quality == 1)).mean()
    kept = (scored.score >= 0.5)[scored.quality == 1].mean()
    assert right > 0.97 and kept > 0.99, (right, kept)


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (rng.random(3000) < 0.1)).astype(float)
    model = fit_trees(x, y, np.array([1, -1, 0]))
    assert ((model.score(x) > 0.5) == (x[:, 0] > 0.5)).mean() > 0.97
    for j, sign in ((0, 1), (1, -1)):
        probe = np.repeat(rng.random((20, 3)), 50, axis=0)
        probe[:, j] = np.tile(np.linspace(0, 1, 50), 20)
        s = model.score(probe).reshape(20, 50)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()
    assert fit_trees(np.zeros((0, 3)), np.zeros(0), np.zeros(3)).score(np.ones((2, 3))).shape == (2,)
