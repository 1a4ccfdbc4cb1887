"""Traversal and topology of edge tables (src, dst).

Traversals run in rounds of semi- and anti-joins on node ids; each round is cut into the shared folder, so that neither plans nor lineage grow. The driver sees only whether a round found anything.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

UNREACHED = 999


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, n_calls): distinct callers, distinct callees, edges in."""
    i = edges.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"), F.count("*").alias("n_calls"))
    o = edges.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("out_degree"))
    return i.join(o, "node", "full_outer").fillna(0, ["in_degree", "out_degree", "n_calls"])


def first_edges(edges: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One edge for each key, the first in order. A minimum, so a key with many edges is combined before the shuffle."""
    rest = [c for c in edges.columns if c not in key]
    return edges.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def depths(edges: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth) of every node that entries (node) reach, in at most `most` steps where that is given. What is known is written together every 16 rounds."""
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    front = cut(entries.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = [front]
    for d in count(1):
        if most is not None and d > most:
            break
        known = reduce(DataFrame.unionAll, seen).select("node")
        nxt = links.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(known, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen.append(front)
        if len(seen) > 16:
            seen = [cut(reduce(DataFrame.unionAll, seen))]
    return reduce(DataFrame.unionAll, seen)


def with_unreached(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    return nodes.join(reached, "node", "left").withColumn("depth", F.coalesce("depth", F.lit(UNREACHED)))


def execution_chain(edges: DataFrame, entries: DataFrame, most: int = 4) -> DataFrame:
    """(src, dst, depth): every edge of a node that is expanded, also those to nodes known already; each node is expanded once, at most `most` steps out."""
    at = depths(edges, entries, most - 1)
    return edges.select("src", "dst").distinct().join(at.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth")), "src")


def propagate_labels(edges: DataFrame, seeds: DataFrame, most: int = 4) -> DataFrame:
    """(node, label, depth): each node takes the label of a nearest seed (node, label); of several at the same distance the smallest label."""
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    front = cut(seeds.groupBy("node").agg(F.min("label").alias("label")).withColumn("depth", F.lit(0)))
    seen = [front]
    for d in range(1, most + 1):
        known = reduce(DataFrame.unionAll, seen).select("node")
        nxt = links.join(front.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        front = cut(nxt.join(known, "node", "left_anti").withColumn("depth", F.lit(d)).select("node", "label", "depth"))
        if front.isEmpty():
            break
        seen.append(front)
    return reduce(DataFrame.unionAll, seen)


def attach_orphans(nodes: DataFrame, labelled: DataFrame, weighted: DataFrame) -> DataFrame:
    """(node, label, score) for nodes without a label: that with the greatest sum of edge weights (src, dst, weight) to or from its nodes, ties to the smaller label; without any edge
    the label with the most nodes and score 0."""
    lab = labelled.select("node", "label")
    lonely = nodes.join(lab, "node", "left_anti")
    both = weighted.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(weighted.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))
    votes = both.join(lonely, "node", "left_semi").join(lab.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("weight").alias("score"))
    best = votes.groupBy("node").agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), "label")).alias("_b")).select("node", "_b.*")
    largest = lab.groupBy("label").count().agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("_l"))
    return lonely.join(best, "node", "left").join(F.broadcast(largest)).select("node", F.coalesce("label", "_l").alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"))


def rollup_clusters(labelled: DataFrame, deg: DataFrame) -> DataFrame:
    """Of each label its size, nearest and farthest depth, mean in-degree and number of seeds."""
    j = labelled.join(deg.select("node", "in_degree"), "node", "left")
    return j.groupBy("label").agg(
        F.count("*").alias("n_nodes"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.round(F.avg(F.coalesce("in_degree", F.lit(0))), 6).alias("avg_in_degree"), F.count_if(F.col("depth") == 0).alias("n_seeds")
    )


def cluster_links(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """Between labels the number of edges and their density, edges over the product of sizes. Sizes come from the labels, so no pair of nodes is made."""
    lab = labelled.select("node", "label")
    e = edges.select("src", "dst").distinct().join(lab.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    size = lab.groupBy("label").agg(F.count("*").alias("n"))
    pairs = e.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n_edges"))
    return (
        pairs.join(size.select(F.col("label").alias("a"), F.col("n").alias("_na")), "a").join(size.select(F.col("label").alias("b"), F.col("n").alias("_nb")), "b")
        .select("a", "b", "n_edges", F.round(F.col("n_edges") / (F.col("_na") * F.col("_nb")), 6).alias("density"))
    )


def closure(members: DataFrame, start: DataFrame) -> DataFrame:
    """The smallest set of (grp, item) that holds every group of a start item (item), every item of such a group, and so on."""
    m = cut(members.select("grp", "item").distinct())
    items = cut(start.select("item").distinct())
    n = -1
    while True:
        groups = m.join(items, "item", "left_semi").select("grp").distinct()
        items = cut(m.join(groups, "grp", "left_semi").select("item").distinct().unionAll(items).distinct())
        if (now := items.count()) == n:
            break
        n = now
    return m.join(items, "item", "left_semi")


def ancestors(edges: DataFrame, most: int = 5) -> DataFrame:
    """(node, ancestor, distance): everything up to `most` steps up a hierarchy of edges (src child, dst parent), the shortest way; cycles end."""
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    front = cut(links.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), F.lit(1).alias("distance")))
    seen = [front]
    for d in range(2, most + 1):
        known = reduce(DataFrame.unionAll, seen).select("node", "ancestor")
        nxt = front.select("node", F.col("ancestor").alias("src")).join(links, "src").select("node", F.col("dst").alias("ancestor")).where("node <> ancestor").distinct()
        front = cut(nxt.join(known, ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen.append(front)
    return reduce(DataFrame.unionAll, seen)


def foundational(deg: DataFrame, share: float = 0.05, least: int = 3) -> DataFrame:
    """Nodes whose in-degree is at least the greater of `least` and `share` of all nodes."""
    n = deg.agg(F.greatest(F.lit(least), F.floor(F.count("*") * share)).alias("_t"))
    return deg.join(F.broadcast(n)).where(F.col("in_degree") >= F.col("_t")).drop("_t")


def flow_pairs(flows: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of flows (flow, file) whose sets of files have a Jaccard of at least `least`, without all pairs: by prefix filtering, only flows that share one of their rarest files are compared."""
    f = cut(flows.select("flow", "file").where("file is not null").distinct())
    freq = f.groupBy("file").agg(F.count("*").alias("df"))
    ordered = f.join(freq, "file").withColumn("_n", F.row_number().over(Window.partitionBy("flow").orderBy("df", "file"))).withColumn("size", F.count("*").over(Window.partitionBy("flow")))
    ordered = cut(ordered)
    prefix = ordered.where(F.col("_n") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("flow", "file", "size")
    a = prefix.select(F.col("flow").alias("a"), "file", F.col("size").alias("na"))
    b = prefix.select(F.col("flow").alias("b"), "file", F.col("size").alias("nb"))
    cand = a.join(b, "file").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)).select("a", "b", "na", "nb").distinct()
    shared = cand.join(f.select(F.col("flow").alias("a"), "file"), "a").join(f.select(F.col("flow").alias("b"), "file"), ["b", "file"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("s"))
    j = F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))
    return shared.select("a", "b", F.round(j, 6).alias("jaccard")).where(j >= least)
