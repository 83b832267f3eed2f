"""Small awkward inputs that every operator must bear, and helpers for brute-force checks."""

import re
import zlib

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

AWKWARD = [
    (1, None, None), (2, "", "x"), (3, "   \n\t ", "x"), (4, "one", "x"), (5, "one", "x"), (6, "One two three four five six", None),
    (7, "one two three four five six", "x"), (8, "é ñ ß 漢字 😀 " * 30, "x"), (9, "\n\n\nline\nline\nline", "x"), (10, "a" * 5000, "x"),
    (11, ("lorem ipsum dolor sit amet " * 4000), "x"), (12, ("lorem ipsum dolor sit amet " * 4000), "x"), (13, "9" * 3000 + " @ + . -", None),
]


def frame(spark, rows=AWKWARD, more=True):
    """Rows (doc_id, text, source) with extra columns whose names clash with inner ones."""
    df = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], "doc_id long, text string, source string, key string, size int, spans string")
    return df if more else df.select("doc_id", "text", "source")


def table_docs():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


def write_docs(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def crc(data: bytes) -> int:
    return zlib.crc32(data)
