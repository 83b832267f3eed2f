"""Benchmark items inside documents: size-partitioned MinHash candidates, exact containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tables import let, saved, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"
#: Sketches of at most so many rows (16 bytes each) are broadcast; larger ones are joined by shuffling.
BROADCAST_SKETCH_ROWS = 1_000_000


def lower_words(text: str) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.filter(F.split(F.translate(whole(text), UPPER, LOWER), SPACE, -1), lambda w: w != "")


def _windows(words: Column, n: Column | int, make) -> Column:
    """``make(i)`` for the start (from 0) of every window of n words."""
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array())


def _hashes(hashed: Column, n: int) -> Column:
    """Hashes of all windows of ``n`` words, from the hashes of the words."""
    return _windows(hashed, n, lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(n)])).cast("array<long>")


def _texts(words: str, n: Column | int) -> Column:
    """The distinct windows of ``n`` words as texts."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(_windows(F.col(words), size, lambda i: F.array_join(F.slice(F.col(words), i + 1, size), " ")).cast("array<string>"))


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold_pct: int = 80, n: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs of documents and items that they contain: ``id_col, item_id, item_shingles, shared, containment``.

    A document contains an item if it has ``threshold_pct`` percent or more of the item's distinct shingles of
    ``n`` words (A-Z in lower case). An item with fewer than ``n`` words is one shingle of its own length.

    Every item keeps a MinHash sketch, the k smallest hashes of its s shingles. k = s - need + 1, where need is
    the smallest number of shingles that counts as containment: a document that lacks all of the sketch has
    less than need, so no pair is lost whatever the sizes are. Documents are partitioned by the power of two
    of their size, and a partition whose largest document is smaller than need leaves the item out. Candidates
    are verified on the texts of the shingles.

    The shingles of documents only meet the sketches, which are broadcast up to ``BROADCAST_SKETCH_ROWS`` rows
    and else shuffled; an item in very many documents gives as many rows, dealt by document. Null or empty
    texts and items without words match nothing; documents or items without an id can't be named and are left
    out; rows that share an id count as one document (its largest containment counts); empty tables give none.
    """
    doc = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).filter("doc is not null")
    item = (
        items.select(items[item_id].alias("item"), items[item_text].alias("text")).filter("item is not null")
        .select("item", lower_words("text").alias("words")).filter(F.size("words") > 0)
        .withColumn("n", F.least(F.lit(n), F.size("words")))
        .select("item", "n", _texts("words", F.col("n")).alias("shingles"))
        .withColumn("s", F.size("shingles"))
        .withColumn("need", F.ceil(F.col("s") * F.lit(threshold_pct) / 100).cast("int"))
    )
    item = saved(item, "leak-items")
    word_hashes = lambda text: F.transform(F.split(text, " ", -1), lambda w: F.xxhash64(w))
    lengths = [r.n for r in item.select("n").distinct().collect()]  # at most ``n`` values
    hashed = item.withColumn("hashes", F.transform("shingles", lambda x: F.element_at(_as_hash(word_hashes(x), n), 1)))
    sketch = hashed.select(
        "item", "need", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.col("s") - F.col("need") + 1)).alias("hash"))
    small = sketch.count() <= BROADCAST_SKETCH_ROWS
    sketch = F.broadcast(sketch) if small else sketch

    # Documents side: narrow rows (document, size partition, hash), streamed past the sketches.
    # The words are bound inside one expression and exploded by explode_outer: a filter that the optimizer
    # derives from explode would be pushed below and split the text again for every word.
    windows = let(F.transform(lower_words("text"), lambda w: F.xxhash64(w)), lambda wh: F.concat(F.array().cast("array<long>"), *[_hashes(wh, m) for m in sorted(lengths)]))
    rows = doc.select("doc", windows.alias("all")).select(
        "doc", F.floor(F.log2(F.greatest(F.size("all"), F.lit(1)))).cast("int").alias("part"), F.explode_outer("all").alias("hash"))
    fits = F.col("need") <= F.pow(F.lit(2.0), F.col("part") + 1) - 1
    candidates = saved(rows.join(sketch, "hash").filter(fits).select("doc", "item").distinct(), "leak-candidates")

    shared = F.size(F.array_intersect(F.col("shingles"), _texts("words", F.col("n"))))
    pairs = (
        doc.join(candidates, "doc").select("doc", "item", lower_words("text").alias("words")).join(item, "item")
        .select("doc", "item", "s", "need", shared.alias("shared")).filter("shared >= need")
    )
    return pairs.groupBy("doc", "item").agg(F.max("s").alias("s"), F.max("shared").alias("shared")).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_id), F.col("s").cast("long").alias("item_shingles"),
        F.col("shared").cast("long").alias("shared"), (F.col("shared") / F.col("s")).alias("containment"),
    )


def _as_hash(hashes: Column, n: int) -> Column:
    """The window hash (in an array) of an item's shingle, which has 1 to ``n`` words."""
    made = F.array()
    for m in range(1, n + 1):
        value = F.array(F.xxhash64(*[F.get(hashes, F.lit(k)) for k in range(m)]))
        made = F.when(F.size(hashes) == m, value).otherwise(made.cast("array<long>"))
    return made


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark
), ii AS (SELECT item_id, w, least(5, len(w)) AS n FROM i WHERE len(w) > 0
), its AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS sh
  FROM ii, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)
), sizes AS (SELECT item_id, n, count(*) AS s FROM its GROUP BY ALL
), docs AS (
  SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS sh
  FROM d, (SELECT DISTINCT n FROM sizes) m, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)
  WHERE len(w) >= n
)
SELECT doc_id, item_id, s AS item_shingles, count(*) AS shared, count(*) / s::DOUBLE AS containment
FROM docs JOIN its USING (n, sh) JOIN sizes USING (item_id, n)
GROUP BY doc_id, item_id, s HAVING 100 * count(*) >= 80 * s
"""
