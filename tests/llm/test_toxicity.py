import zlib

import numpy as np
import pytest
from rows import AWKWARD, FOLDER, frame, table_docs
from pyspark.sql import functions as F

from voxlake.llm import noisy, toxicity
from voxlake.llm.catalog import op2_noisy_toxicity


@pytest.fixture(scope="module")
def letters():
    counts = np.zeros(noisy.SIZE**3, np.int64)
    text = "the idiot was a stupid loser and a moron told the story of the worthless book to the other people in the town " * 40
    noisy.trigram_counts(text + " ".join(t or "" for _, t in table_docs()), counts)
    return noisy.language_model(counts)


@pytest.mark.parametrize("token,word", [
    ("1d10t", "idiot"), ("id!ot", "idiot"), ("$tup1d", "stupid"), ("stuuuupid", "stupid"), ("l0$er", "loser"), ("m0r0n!!", "moron"),
    ("s.t.u.p.i.d", "stupid"), ("w0rthle$$", "worthless"), ("idiot!!", "idiot"), ("(idiot)", "idiot"), ("mooooron,", "moron"), ("i-d-i-o-t", "idiot"),
])
def test_disguises_are_undone(letters, token, word):
    assert word in noisy.Restorer(letters).words(token)[0]


def test_spaced_letters(letters):
    r = noisy.Restorer(letters)
    assert ["stupid"] in r.spaced("you s t u p i d one") and r.spaced("a a a a a a") == [] and r.spaced("a b c") == []
    assert "".join(r.spaced("b 1 2 i d i o t s " * 60)[0])


def test_plain_words_pass(letters):
    r = noisy.Restorer(letters)
    assert r.words("story,") == (["story"], False) and r.words("...") == ([], False) and r.words("12345") == ([], False)
    assert r.words("x" * 500) == ([], False) or r.words("x" * 500)[0]


def test_long_disguises(letters):
    r = noisy.Restorer(letters)
    sentence = "other people told the idiot that the moron was worthless".replace(" ", "")
    assert "stupid" in r.words("stu" + "u" * 70 + "pid")[0] and r.words("!d" + "i" * 80 + "ot")[0] == ["idiot"]
    assert ["stupid"] in r.spaced("s t " + "u " * 200 + "p i d")
    for sign in ".-":
        for n in (1, 3):
            assert {"moron", "worthless"} <= set(r.words(sign.join(sentence * n))[0])
    reader = toxicity.Reader(letters, {"worthless": 2.0, "moron": 3.0})
    assert reader.features(".".join(sentence))[:4] == [2.0, 3.0, 2.0, 5.0]
    assert reader.features("m" + "o" * 90 + "ron")[:2] == [1.0, 3.0]


@pytest.mark.parametrize("token,word", [
    ("you-1d10t", "idiot"), ("other/1d10t", "idiot"), ("l0ser,1d10t", "idiot"), ("l0ser,1d10t", "loser"), ("you_1d10t", "idiot"), ("you_idiot", "idiot"),
    ("stuupid", "stupid"), ("iidiot,", "idiot"), ("you-moroon", "moron"), ("story-$tup1d!!", "stupid"), ("the:m000r0n", "moron"),
])
def test_joined_and_doubled(letters, token, word):
    assert word in noisy.Restorer(letters).words(token)[0]


def test_joined_words_count_one_by_one(letters):
    reader = toxicity.Reader(letters, {"idiot": 2.0, "loser": 3.0, "worthless": 1.0})
    assert reader.features("l0ser,1d10t")[:4] == [2.0, 3.0, 2.0, 5.0] and reader.features("id-iot")[:2] == [1.0, 2.0]
    assert reader.features("i.i.d.i.i.o.t")[:2] == [1.0, 2.0] and reader.features("w o r t h l e s s")[:4] == [1.0, 1.0, 0.0, 1.0]
    assert reader.features("worthless,")[6] == 0 and reader.features("iidiot")[6] == 1


def test_query_columns(spark):
    got = op2_noisy_toxicity(spark, FOLDER).collect()
    assert len(got) == len(table_docs())
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_accuracy_and_disguised_texts(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn_toxicity(docs, labels)
    held = labels.filter(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score_toxicity(docs.join(held, "doc_id"), model).select("toxic", "toxicity").toPandas()
    hit = got.toxicity >= 0.7
    assert hit[got.toxic == 1].mean() > 0.9 and hit[got.toxic == 0].mean() < 0.005
    clean = " ".join(table_docs()[0][1].split()[:120])
    rows = [(1, f"{clean} stupid {clean} idiot worthless", "s"), (2, f"{clean} $tup1d {clean} 1d10t w0rthle$$", "s"), (3, f"{clean} s t u p i d {clean} iiidiot w.o.r.t.h.l.e.s.s", "s"), (4, clean, "s")]
    score = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(frame(spark, rows), model).collect()}
    assert min(score[1], score[2], score[3]) >= 0.7 > score[4]


def test_awkward_rows(spark):
    df = frame(spark)
    for labels in ([], [(1, 1), (8, 0), (None, 1), (4, None)], [(i, 0) for i in range(14)]):
        model = toxicity.learn_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = toxicity.score_toxicity(df, model)
        assert out.columns == [*df.columns, "toxicity"] and out.count() == len(AWKWARD)
        if not any(y for _, y in labels):  # nothing toxic was learned
            assert all(r.toxicity < 0.7 for r in out.collect())
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
