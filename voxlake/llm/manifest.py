"""A Merkle manifest of a dataset: every document a leaf, one tree for each group, one tree over the groups.

All levels are tables. A node finds its siblings by equijoins of its level with itself on computed indices (the own
slot moved on by 1, 2, ..., which for two slots is the index with its last bit flipped), and the rows in slot 0 emit
the nodes of the next level. Going down again, every node passes its way to the root on to its children.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.tables import saved

SMALL_LEVEL = 1 << 16  # levels of at most so many nodes (100 bytes each) are sent to all tasks; larger ones are shuffled
SMALL_WAYS = 1 << 12  # the same for ways to the root, which hold two digests a level
SAVE_EVERY = 4
STEP_SQL = "array<struct<before: binary, after: binary>>"


def field(value: str | Column) -> Column:
    """A value as ``<bytes>:<text>``, a missing one as ``-``."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """The sha256 of strings put together, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(digests: str | Column) -> Column:
    """Digests (32 bytes each, put together) as the lowercase hex text that is hashed."""
    return F.lower(F.hex(digests))


def none() -> Column:
    return F.lit("").cast("binary")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 0 in the order, null first. The rows are range-partitioned and counted
    per partition; what is summed in one place is one row a partition."""
    placed = saved(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
        .withColumn("__nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(counts), "__part").withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def with_siblings(level: DataFrame, fanout: int, small: bool) -> DataFrame:
    """A level (``tree, idx, n, node``) with the digests of the siblings before and after each node, put together."""
    slot, run = F.col("idx") % fanout, F.col("idx") - F.col("idx") % fanout
    out, others = level, []
    for shift in range(1, fanout):
        other = level.select("tree", F.col("idx").alias("__sibling"), F.col("node").alias(f"__s{shift}"))
        out = out.withColumn("__sibling", run + (slot + shift) % fanout).join(F.broadcast(other) if small else other, ["tree", "__sibling"], "left").drop("__sibling")
        others.append((shift, F.coalesce(F.col(f"__s{shift}"), none())))
    # By their slots: shifts past the last slot come round to the first ones.
    before = [F.when(slot + shift >= fanout, d).otherwise(none()) for shift, d in others]
    after = [F.when(slot + shift < fanout, d).otherwise(none()) for shift, d in others]
    return out.select("tree", "idx", "n", "node", F.concat(*before).alias("before"), F.concat(*after).alias("after"))


@dataclass(frozen=True)
class Level:
    """Nodes of trees that go on (``tree, idx, n, node, before, after``), saved, and their number; the nodes of
    trees that end here (``tree, node``)."""

    nodes: DataFrame | None
    size: int
    ended: DataFrame


def grow(leaves: DataFrame, fanout: int) -> list[Level]:
    """The levels of all trees, leaves (``tree, idx, n, node``; n: nodes of the tree) first. A tree ends in the level
    in which it has one node; in the last level all do."""
    levels, level = [], leaves
    most, size = leaves.agg(F.max("n"), F.count(F.lit(1))).first()
    while (most or 0) > 1:
        most = -(-most // fanout)
        nodes = saved(with_siblings(level.filter("n > 1"), fanout, size <= SMALL_LEVEL), "manifest-level")
        size = nodes.count()
        levels.append(Level(nodes, size, level.filter("n = 1").select("tree", "node")))
        level = nodes.filter(F.col("idx") % fanout == 0).select(
            "tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            digest(text_of("node"), text_of("after")).alias("node"))
    return [*levels, Level(None, 0, level.select("tree", "node"))]


def roots(levels: list[Level]) -> DataFrame:
    """The last node of every tree (``tree, node, level``: where it ends)."""
    return reduce(DataFrame.unionAll, [level.ended.withColumn("level", F.lit(i)) for i, level in enumerate(levels)])


def ways(levels: list[Level], tops: DataFrame, fanout: int) -> DataFrame:
    """For every leaf (``tree, idx``) its ``steps``: the siblings before and after it on each level, upwards, then those
    of its tree's root (``tops``: ``tree, level, steps``)."""
    known = None
    for i, level in reversed(list(enumerate(levels))):
        ended = tops.filter(F.col("level") == i).select("tree", F.lit(0).cast("long").alias("idx"), "steps")
        if level.nodes is None:
            known = ended
            continue
        parents = known.withColumnRenamed("idx", "__parent")
        inner = level.nodes.withColumn("__parent", F.expr(f"idx div {fanout}")).join(
            F.broadcast(parents) if level.size <= SMALL_WAYS else parents, ["tree", "__parent"])  # not more parents than children
        known = ended.unionByName(inner.select("tree", "idx", F.concat(F.array(F.struct("before", "after")), F.col("steps")).alias("steps")))
        if i and (len(levels) - i) % SAVE_EVERY == 0:
            known = saved(known, "ways")
    return known


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to over its siblings."""
    return F.aggregate(steps, leaf, lambda node, s: digest(text_of(s["before"]), text_of(node), text_of(s["after"])))


def proof(steps: Column) -> Column:
    """The sha256 of all siblings, level by level, left to right."""
    texts = F.transform(steps, lambda s: F.concat(text_of(s["before"]), text_of(s["after"])))
    return F.sha2(F.array_join(texts, "").cast("binary"), 256)


def merkle_manifest(
    docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang", id_col: str = "doc_id", counted: str = "n_chars", fanout: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, group, leaf, subroot, root, proof_sha256, steps, folded_root, verified``.

    A leaf is the sha256 of the ``fields`` (``-`` or byte count, ``:``, value). In every group the leaves ascend by id;
    every ``fanout`` neighbours (the last run may hold fewer) become the sha256 of their digests' hex text until one is
    left, the subroot; the subroots, in the order of the groups' bytes, become the root in the same way. ``steps``
    are a leaf's siblings on each level up to the root. ``tampered`` rows (none by default) are read with ``counted`` one
    larger (a missing number stays): ``folded_root`` is where such a leaf leads over the original siblings.

    Texts are hashed where they are read; what moves is digests. Leaves are numbered over range partitions, and all trees
    grow together, so a large group is spread like the others; levels grow with the logarithm of the largest group.
    A missing id or group comes first; equal ids follow their leaf; repeated rows are a leaf each; an only leaf of an
    only group is the root and has no steps; an empty table gives no rows; other columns play no part.
    """
    leaf = digest(*[field(c) for c in fields])
    changed = digest(*[field(F.col(c) + 1 if c == counted else c) for c in fields])
    wrong = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(group).cast("string").alias("name"), leaf.alias("leaf"), F.when(wrong, changed).alias("wrong"))
    bytewise = F.col("name").cast("binary")
    placed = saved(numbered(rows, [bytewise.asc_nulls_first(), F.col("doc").asc_nulls_first(), F.col("leaf").asc()], "at"), "leaves")
    groups = placed.groupBy("name").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    trees = saved(numbered(groups, [bytewise.asc_nulls_first()], "tree"), "trees")
    # One row a group: sent to all tasks where its saved size allows, else joined by hash, where AQE splits a large group.
    named = placed.join(trees.withColumnRenamed("name", "own"), F.col("name").eqNullSafe(F.col("own"))).drop("own")
    base = saved(named.select("tree", (F.col("at") - F.col("start")).alias("idx"), "n", F.col("leaf").alias("node"), "doc", "name", "wrong"), "manifest-leaves")

    levels = grow(base.select("tree", "idx", "n", "node"), fanout)
    subroots = saved(roots(levels), "subroots")
    groups_n = subroots.count()
    upper = grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(groups_n).alias("n"), "node"), fanout)
    top = roots(upper)
    last = top.first()  # one digest
    root = F.lit(bytes(last["node"]) if last else b"")
    above = ways(upper, top.select("tree", "level", F.array().cast(STEP_SQL).alias("steps")), fanout).select(F.col("idx").alias("tree"), "steps")
    tops = saved(above.join(subroots.withColumnRenamed("node", "subroot"), "tree"), "tops")

    steps = ways(levels, tops.select("tree", "level", "steps"), fanout)
    out = base.join(steps, ["tree", "idx"]).join(tops.select("tree", "subroot"), "tree")
    reached = F.coalesce(F.col("wrong"), F.col("node"))
    out = out.withColumn("folded", folded(reached, F.col("steps")))
    return out.select(
        F.col("doc").alias(id_col), F.col("name").alias(group), text_of("node").alias("leaf"), text_of("subroot").alias("subroot"), text_of(root).alias("root"),
        proof(F.col("steps")).alias("proof_sha256"), "steps", text_of("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def sql(levels: int = 20, upper: int = 8) -> str:
    """The same for DuckDB with two children a node, a level after the other; a finished tree stays as it is."""
    leaf = lambda n: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n, "text")) + ")"
    bits = "list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {bits}), 4294967295)"
    steps = [f"""
d AS MATERIALIZED (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS wrong FROM documents
), langs AS MATERIALIZED (
  SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, n FROM (SELECT lang, count(*) AS n FROM d GROUP BY lang)
), t0 AS MATERIALIZED (
  SELECT doc_id, d.lang, leaf, coalesce(wrong, leaf) AS f, '' AS seen, tree, n,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM d JOIN langs ON d.lang IS NOT DISTINCT FROM langs.lang
), n0 AS MATERIALIZED (SELECT tree, idx, n, leaf AS node FROM t0)"""]
    at = 0
    for k in range(levels + upper):
        if k == levels:  # the subroots become the leaves of the tree of groups
            steps.append(f"sub AS MATERIALIZED (SELECT tree, node FROM n{at})")
            steps.append(f"m{at} AS MATERIALIZED (SELECT 0 AS tree, tree AS idx, (SELECT count(*) FROM langs) AS n, node FROM n{at})")
            steps.append(f"u{at} AS MATERIALIZED (SELECT doc_id, lang, leaf, f, seen, 0 AS tree, (SELECT count(*) FROM langs) AS n, tree AS idx, tree AS lang_no FROM t{at})")
        node, rows, more = (f"n{at}", f"t{at}", "") if k < levels else (f"m{at}", f"u{at}", ", lang_no")
        next_node, next_rows = (f"n{at + 1}", f"t{at + 1}") if k < levels else (f"m{at + 1}", f"u{at + 1}")
        steps.append(f"""{next_rows} AS MATERIALIZED (
  SELECT doc_id, r.lang, leaf, CASE WHEN r.n = 1 THEN f WHEN r.idx % 2 = 0 THEN sha256(f || coalesce(s.node, '')) ELSE sha256(s.node || f) END AS f,
    seen || coalesce(s.node, '') AS seen, r.tree, (r.n + 1) // 2 AS n, r.idx // 2 AS idx{more}
  FROM {rows} r LEFT JOIN {node} s ON r.n > 1 AND s.tree = r.tree AND s.idx = xor(r.idx, 1)
)""")
        steps.append(f"""{next_node} AS MATERIALIZED (
  SELECT a.tree, a.idx // 2 AS idx, (a.n + 1) // 2 AS n, CASE WHEN a.n = 1 THEN a.node ELSE sha256(a.node || coalesce(b.node, '')) END AS node
  FROM {node} a LEFT JOIN {node} b ON b.tree = a.tree AND b.idx = a.idx + 1 WHERE a.idx % 2 = 0
)""")
        at += 1
    return "WITH " + ", ".join(steps) + f"""
SELECT doc_id, leaf, sub.node AS subroot, m{at}.node AS root, sha256(seen) AS proof_sha256, f AS folded_root, f = m{at}.node AS verified
FROM u{at} JOIN sub ON sub.tree = lang_no, m{at}"""
