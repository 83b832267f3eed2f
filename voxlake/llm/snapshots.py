"""Exact duplicates against immutable snapshots of the texts already taken in."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.fuse import build_filters, let_through
from voxlake.llm.tables import saved, whole
from voxlake.session import checkpoint_dir

NO_ID = (1 << 63) - 1
HEAVY = 1000  # a text of more than 1/HEAVY of all rows is joined by broadcast: there are fewer than HEAVY of them
BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Snapshot:
    """Texts that never change again: ``digest, body, sha`` in buckets of their digest, and filters over the digests."""

    number: int
    name: str
    texts: DataFrame
    filters: DataFrame
    shards: int


def squeezed(text: Column) -> Column:
    """The text without its blanks."""
    return F.regexp_replace(text, BLANKS, "")


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def preference(points: Column, doc: Column) -> Column:
    """One number that is larger for the row to keep: more code points first, then the smaller id. Of fixed width,
    so that its maximum is a plain hash aggregate."""
    return points.cast("decimal(10,0)") * _number(1 << 64) + (_number(NO_ID) - doc.cast("decimal(20,0)"))


def preferred_id(best: Column) -> Column:
    doc = (_number(NO_ID) - best % _number(1 << 64)).cast("long")
    return F.when(doc < NO_ID, doc)


def freeze(batch: DataFrame, number: int) -> Snapshot:
    """A snapshot of a batch (``digest, body``): equal texts once, compared by their bytes, in buckets of the digest
    below spark.checkpoint.dir. Copies are dropped before the shuffle, so a text with very many of them is no hot key;
    joins by digest between snapshots move no text again."""
    spark = batch.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"snapshot_{uuid4().hex}"
    own = batch.groupBy("digest").agg(F.collect_set("body").alias("bodies"))
    texts = own.select("digest", F.explode("bodies").alias("body")).withColumn("sha", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    texts.write.option("compression", "zstd").bucketBy(buckets, "digest").sortBy("digest").option("path", path).saveAsTable(name)
    held = spark.table(name)
    filters, shards = build_filters(held)
    return Snapshot(number, name, held, filters, shards)


def found_in(new: Snapshot, old: Snapshot) -> DataFrame:
    """``digest, sha`` of the texts of ``new`` that ``old`` holds: digests that pass the filters are looked up in
    their exact buckets, and the texts there are compared byte by byte."""
    hopeful = let_through(new.texts, old.filters, old.shards)
    mine = new.texts.join(hopeful, "digest", "left_semi")
    theirs = old.texts.select("digest", F.col("body").alias("held"))
    return mine.join(theirs, "digest").filter(F.col("body") == F.col("held")).select("digest", "sha")


def by_key(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined to their one row of ``table``. Keys with more than 1/HEAVY of the ``total`` rows, by
    ``size``, are under HEAVY and broadcast; the others are shuffled."""
    heavy = F.col(size) * HEAVY > total
    hot, cold = table.filter(heavy), table.filter(~heavy)
    warm = rows.join(F.broadcast(hot), keys)
    return warm.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def exact_duplicates(docs: DataFrame, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256`` and ``first_batch``, the batch in
    which the text was met first.

    Texts are equal when they are without blanks (\\x20, \\x09-\\x0D). The rows come in ``batches`` (by a hash of the
    id), one after the other. Equal texts within a batch are grouped; the batch's distinct digests are screened by
    the binary-fuse filters of every earlier snapshot, and what passes joins that snapshot's exact buckets, where
    bytes decide. Then the batch is frozen to a snapshot itself. Of equal texts that with most code points stays,
    then that with the smallest id.

    A null text counts as empty, and all empty ones are equal; a missing id is the largest and shown as null; of
    repeated rows with the id that stays one stays, whichever comes first; an empty table gives no rows; other columns
    play no part.
    """
    text = whole(docs[text_col])
    source = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.char_length(text).alias("points"), squeezed(text).alias("body")
    ).withColumns({"digest": F.xxhash64("body"), "batch": F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")})
    rows = saved(
        source.select("doc", "points", "digest", "batch", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"))
        .withColumn("row", F.monotonically_increasing_id()), "digests")

    snapshots: list[Snapshot] = []
    homes = []
    for number in range(batches):
        new = freeze(source.filter(F.col("batch") == number).select("digest", "body"), number)
        met = [found_in(new, old).withColumn("home", F.lit(old.number)) for old in snapshots]
        own = new.texts.select("digest", "sha", F.lit(number).alias("home"))
        first = reduce(DataFrame.unionAll, met, own).groupBy("digest", "sha").agg(F.min("home").alias("home"))
        homes.append(saved(first.withColumn("batch", F.lit(number)), "homes"))
        snapshots.append(new)

    key = ["batch", "digest", "sha"]
    text_key = ["home", "digest", "sha"]
    ranked = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(preference(F.col("points"), F.col("doc"))).alias("best"))
    known = saved(ranked.join(reduce(DataFrame.unionAll, homes), key), "batch-groups")
    groups = known.groupBy(*text_key).agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    verdicts = known.select(*key, "home", "n").join(groups, text_key)
    told = saved(
        by_key(rows, verdicts, key, "n", rows.count())
        .withColumn("wins", preference(F.col("points"), F.col("doc")) == F.col("best"))
        .select("row", "doc", "home", "digest", "sha", "group_size", "wins", preferred_id(F.col("best")).alias("keep_id")), "verdicts")

    # Repeated rows of the id that stays: all but the first go.
    twice = told.filter("wins").groupBy(*text_key).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    again = told.filter("wins").join(twice, text_key).filter("row > first").select("row")
    out = told.join(again.withColumn("again", F.lit(True)), "row", "left")
    for snapshot in snapshots:
        docs.sparkSession.sql(f"DROP TABLE {snapshot.name}")  # the name only; the files stay
    return out.select(
        F.when(F.col("doc") < NO_ID, F.col("doc")).alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("wins") & F.col("again").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("home").alias("first_batch"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY points DESC, doc_id)
"""
