"""Average-link speaker clustering of recordings too large for one task.

The tree is built in the rounds of ``vectors.average_link``: all pairs that are each other's nearest cluster are
joined. What each cluster's nearest is stays in a table; after a round it is searched again only for clusters that
were joined or whose nearest was. The search runs on pairs of blocks of clusters, one matrix product for
both sides, and keeps one line per cluster; once a recording has few clusters left, one task finishes its tree. The
top of the tree, at most ``max_k`` parts, is then scored like in ``choose_labels``, with the vectors spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.vectors import l2_normalize
from voxlake.operators.vectors import DIGITS, average_link, group_sums
from voxlake.plans.lookup import attach
from voxlake.session import checkpoint_dir

SLICE_ROWS = 50_000


def _save(df: DataFrame) -> DataFrame:
    """Cut the lineage: every round builds on the one before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _blocks(clusters: DataFrame, by: str, block_rows: int, side: str) -> DataFrame:
    """Clusters in blocks of about ``block_rows``: ids, sizes and sums of a block in one row."""
    counts = clusters.groupBy(by).agg(F.ceil(F.count("*") / block_rows).alias("__blocks"))
    placed = attach(clusters, counts, [by]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("__blocks")))
    rows = F.array_sort(F.collect_list(F.struct("cid", "n", "total")))
    return placed.groupBy(by, "__blocks", "block").agg(rows.alias("r")).select(
        by, F.col("__blocks").alias(f"blocks{side}"), F.col("block").alias(f"block{side}"),
        F.transform("r", lambda r: r["cid"]).alias(f"ids{side}"),
        F.transform("r", lambda r: r["n"]).alias(f"ns{side}"),
        F.flatten(F.transform("r", lambda r: r["total"])).alias(f"flat{side}"),
    )


def _nearest(asking: DataFrame, others: DataFrame | None, by: str, kind: str, block_rows: int) -> DataFrame:
    """(by, cid, near, dist): for each of the ``asking`` clusters the nearest other one, among them and ``others``; the
    smallest id among equals. Two blocks of asking clusters meet once, and each side takes its answer from it."""
    left = _blocks(asking, by, block_rows, "")
    own = left.withColumn("block2", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).join(
        left.select(by, *[F.col(c).alias(f"{c}2") for c in ("block", "ids", "ns", "flat")]), [by, "block2"])
    columns = [by, "ids", "ns", "flat", "ids2", "ns2", "flat2"]
    met = own.select(*columns, F.lit(True).alias("both"))
    if others is not None:
        right = _blocks(others, by, block_rows, "2")
        sent = left.join(right.select(by, "blocks2").distinct(), by).withColumn("block2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks2") - 1)))
        met = met.unionByName(sent.drop("blocks2").join(right.drop("blocks2"), [by, "block2"]).select(*columns, F.lit(False).alias("both")))

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, ids2 = np.asarray(row.ids), np.asarray(row.ids2)
                a = np.asarray(row.flat).reshape(len(ids), -1)
                b = np.asarray(row.flat2).reshape(len(ids2), -1)
                dist = np.round(1.0 - (a @ b.T) / np.outer(row.ns, row.ns2), DIGITS)
                dist[np.equal.outer(ids, ids2)] = np.inf
                for mine, theirs, d in [(ids, ids2, dist), (ids2, ids, dist.T)][: 1 + bool(row.both)]:
                    out = pd.DataFrame({by: getattr(row, by), "cid": mine, "near": theirs[d.argmin(axis=1)], "dist": d.min(axis=1)})
                    yield out[np.isfinite(out["dist"])]

    found = met.mapInPandas(tiles, f"{by} {kind}, cid bigint, near bigint, dist double")
    nearest = F.min(F.struct("dist", "near"))
    return found.groupBy(by, "cid").agg(nearest.alias("m")).select(by, "cid", F.col("m.near").alias("near"), F.col("m.dist").alias("dist"))


def _mutual(near: DataFrame, by: str) -> DataFrame:
    """(by, a, b, dist): pairs that are each other's nearest; where rounding left none, the closest pair."""
    back = near.select(by, F.col("cid").alias("near"), F.col("near").alias("cid"))
    pairs = near.where(F.col("cid") < F.col("near")).join(back, [by, "cid", "near"], "left_semi")
    mutual = pairs.select(by, F.col("cid").alias("a"), F.col("near").alias("b"), "dist")
    closest = near.groupBy(by).agg(F.min(F.struct("dist", F.least("cid", "near").alias("a"), F.greatest("cid", "near").alias("b"))).alias("m"))
    forced = closest.join(mutual.select(by).distinct(), by, "left_anti").select(by, "m.a", "m.b", "m.dist")
    return mutual.unionByName(forced)


def _merge(clusters: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """Clusters after joining b into a."""
    gone = pairs.select(by, F.col("b").alias("cid"), F.col("a"))
    moved = clusters.join(gone, [by, "cid"]).select(
        by, F.col("a").alias("cid"), F.col("n").alias("__n"), F.col("total").alias("__total"), F.col("height").alias("__height")
    )
    levels = pairs.select(by, F.col("a").alias("cid"), F.col("dist").alias("__dist"))
    kept = clusters.join(gone.select(by, "cid"), [by, "cid"], "left_anti")
    both = kept.join(moved, [by, "cid"], "left").join(levels, [by, "cid"], "left")
    added = F.zip_with("total", "__total", lambda x, y: x + y)
    return both.select(
        by, "cid",
        (F.col("n") + F.coalesce("__n", F.lit(0.0))).alias("n"),
        F.when(F.col("__total").isNull(), F.col("total")).otherwise(added).alias("total"),
        # A cluster is never lower than what it is made of, whatever rounding says.
        F.greatest("height", "__height", "__dist").alias("height"),
    )


def _tree(unit: DataFrame, by: str, kind: str, local_rows: int, block_rows: int) -> DataFrame:
    """(by, a, b, height, round): all merges of all recordings."""
    clusters = _save(unit.select(
        by, F.col("idx").cast("bigint").alias("cid"), F.lit(1.0).alias("n"), F.col("embedding").alias("total"), F.lit(-1.0).alias("height")
    ))
    rounds: list[DataFrame] = []
    near: DataFrame | None = None
    while True:
        large = clusters.groupBy(by).count().where(F.col("count") > local_rows).select(by)
        active = _save(clusters.join(large, by, "left_semi"))
        if near is None:
            near = _save(_nearest(active, None, by, kind, block_rows))
        else:
            # What was joined, and what had its nearest there, asks again; the others keep what they know.
            touched = pairs.select(by, F.col("a").alias("near")).unionByName(pairs.select(by, F.col("b").alias("near")))
            kept = near.join(active.select(by, "cid"), [by, "cid"], "left_semi").join(touched, [by, "near"], "left_anti")
            kept = _save(kept.join(touched.withColumnRenamed("near", "cid"), [by, "cid"], "left_anti").select(by, "cid", "near", "dist"))
            asking = active.join(kept.select(by, "cid"), [by, "cid"], "left_anti")
            others = active.join(kept.select(by, "cid"), [by, "cid"], "left_semi")
            near = _save(kept.unionByName(_nearest(asking, others, by, kind, block_rows)))
        pairs = _save(_mutual(near, by))
        if pairs.isEmpty():
            break
        clusters = _save(_merge(clusters, pairs, by))
        level = clusters.select(by, F.col("cid").alias("a"), "height")
        rounds.append(pairs.join(level, [by, "a"]).select(by, "a", "b", "height", F.lit(len(rounds)).alias("round")))

    level = len(rounds)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        ids = pdf["cid"].to_numpy()
        rows, heights, turns = average_link(np.stack(pdf["total"].to_numpy()), pdf["n"].to_numpy(), pdf["height"].to_numpy())
        return pd.DataFrame({
            by: [pdf[by].iloc[0]] * len(rows), "a": ids[rows[:, 0]], "b": ids[rows[:, 1]], "height": heights, "round": (level + turns).astype(np.int32),
        })

    # At most local_rows clusters per recording are left.
    last = clusters.groupBy(by).applyInPandas(finish, f"{by} {kind}, a bigint, b bigint, height double, round int")
    for merges in rounds:
        last = last.unionByName(merges)
    return _save(last)


def _roots(links: DataFrame, by: str) -> DataFrame:
    """(by, cid, root) from (by, cid, parent): each step doubles the distance covered."""
    links = _save(links)
    while True:
        up = links.select(by, F.col("cid").alias("parent"), F.col("parent").alias("__up"))
        stepped = _save(links.join(up, [by, "parent"], "left").select(by, "cid", F.coalesce("__up", "parent").alias("parent"), F.col("__up").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            return stepped.select(by, "cid", F.col("parent").alias("root"))
        links = stepped.drop("moved")


def _groupings(roots: list[int], tops: list, max_k: int) -> dict[int, np.ndarray]:
    """Group of each part for every k: the lowest top merges are joined first."""
    place = {root: i for i, root in enumerate(roots)}
    group = np.arange(len(roots))
    out = {len(roots): group.copy()}
    for a, b in tops:
        group[group == group[place[b]]] = group[place[a]]
        out[len(set(group))] = group.copy()
    return {k: np.unique(g, return_inverse=True)[1] for k, g in out.items() if 2 <= k <= max_k}


def _choose(scores: Column, margin: float, floor: float) -> Column:
    """Number of speakers from the mean silhouettes, fewest speakers first; 1 where none is good enough."""
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(1).alias("k"))
    picked = F.aggregate(
        F.array_sort(scores), start,
        lambda s, x: F.when(x["score"] > s["best"] + margin, F.struct(x["score"].alias("best"), x["k"].alias("k"))).otherwise(s),
    )
    return F.when(picked["best"] >= floor, picked["k"]).otherwise(1)


def cluster_large(
    embeddings: DataFrame, by: str, max_k: int, margin: float, floor: float, local_rows: int, block_rows: int = 2048
) -> DataFrame:
    """(by, idx, speaker_id) for recordings above ``local_rows`` vectors."""
    types = dict(embeddings.dtypes)
    kind = types[by]
    unit = _save(embeddings.select(by, "idx", l2_normalize(F.col("embedding")).alias("embedding")))
    tree = _tree(unit, by, kind, local_rows, block_rows)

    from pyspark.sql import Window

    highest = Window.partitionBy(by).orderBy(F.col("height").desc(), F.col("round").desc(), F.col("a").desc())
    tops = _save(tree.withColumn("place", F.row_number().over(highest)).where(F.col("place") < max_k))
    lower = tree.join(tops.select(by, "b"), [by, "b"], "left_anti").select(by, F.col("b").alias("cid"), F.col("a").alias("parent"))
    roots = _roots(lower, by)
    members = _save(
        unit.withColumn("cid", F.col("idx").cast("bigint")).join(roots, [by, "cid"], "left").withColumn("root", F.coalesce("root", "cid")).drop("cid")
    )

    # One line per recording: its parts (at most max_k) and the merges above them.
    parts = group_sums(members, [by, "root"]).join(members.groupBy(by, "root").agg(F.min("idx").alias("first")), [by, "root"])
    parts = parts.groupBy(by).agg(
        F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("root", "n", "first", "total"))).alias("parts")
    )
    ends = tops
    for side in ("a", "b"):
        ends = ends.join(roots.select(by, F.col("cid").alias(side), F.col("root").alias(f"{side}_root")), [by, side], "left").withColumn(
            side, F.coalesce(f"{side}_root", side)
        ).drop(f"{side}_root")
    order = F.struct(-F.col("place"), "a", "b")
    merges = ends.groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("m")).select(
        by, F.transform("m", lambda m: m["a"]).alias("tops_a"), F.transform("m", lambda m: m["b"]).alias("tops_b")
    )
    top = parts.join(merges, by).select(
        by, "size", "tops_a", "tops_b",
        F.transform("parts", lambda p: p["root"]).alias("roots"),
        F.transform("parts", lambda p: p["n"].cast("double")).alias("ns"),
        F.transform("parts", lambda p: p["first"].cast("bigint")).alias("firsts"),
        F.flatten(F.transform("parts", lambda p: p["total"])).alias("flat"),
    )
    top = _save(top)
    slices = F.ceil(F.col("size") / SLICE_ROWS)
    sliced = attach(members, top.select(by, slices.alias("slices")), [by]).withColumn("slice", F.pmod(F.xxhash64("idx"), F.col("slices"))).drop("slices")
    # Other names for the keys: both sides come from the same data.
    spread = top.select(
        F.col(by).alias("__by"), F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("__slice"),
        "roots", "ns", "flat", "tops_a", "tops_b",
    )

    def score(rows: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        columns = [by, "k", "score", "rows"]
        if rows.empty:
            return pd.DataFrame({c: [] for c in columns})
        top = info.iloc[0]
        sums = np.asarray(top["flat"]).reshape(len(top["roots"]), -1)
        ns = np.asarray(top["ns"])
        vectors = np.stack(rows["embedding"].to_numpy())
        own = np.searchsorted(top["roots"], rows["root"].to_numpy())
        away = ns[None, :] - vectors @ sums.T
        out = []
        for k, group in _groupings(list(top["roots"]), list(zip(top["tops_a"], top["tops_b"])), max_k).items():
            member = np.eye(k)[group]
            d, n, mine = away @ member, ns @ member, group[own]
            at = np.arange(len(vectors))
            with np.errstate(divide="ignore", invalid="ignore"):
                inside = d[at, mine] / (n[mine] - 1)
                mean = d / n[None, :]
                mean[at, mine] = np.inf
                outside = mean.min(axis=1)
                value = np.where(n[mine] > 1, np.nan_to_num((outside - inside) / np.maximum(inside, outside)), 0.0)
            out.append((rows[by].iloc[0], k, float(value.sum()), len(value)))
        return pd.DataFrame(out, columns=columns)

    scored = (
        sliced.groupBy(by, "slice").cogroup(spread.groupBy("__by", "__slice"))
        .applyInPandas(score, f"{by} {kind}, k int, score double, rows bigint")
        .groupBy(by, "k").agg(F.round(F.sum("score") / F.sum("rows"), DIGITS).alias("score"))
        .groupBy(by).agg(_choose(F.collect_list(F.struct("k", "score")), margin, floor).alias("k"))
    )

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                groups = _groupings(list(row.roots), list(zip(row.tops_a, row.tops_b)), max_k)
                group = groups[row.k] if row.k > 1 else np.zeros(len(row.roots), dtype=int)
                first = [min(f for f, g in zip(row.firsts, group) if g == i) for i in range(group.max() + 1)]
                rank = np.argsort(np.argsort(first))
                out += [(getattr(row, by), root, int(rank[g])) for root, g in zip(row.roots, group)]
            yield pd.DataFrame(out, columns=[by, "root", "speaker_id"])

    chosen = top.join(scored, by).select(by, "k", "roots", "firsts", "tops_a", "tops_b")
    names = chosen.mapInPandas(name, f"{by} {kind}, root bigint, speaker_id int")
    return attach(members.select(by, "idx", "root"), names, [by, "root"]).select(by, "idx", "speaker_id")
