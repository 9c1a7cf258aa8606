"""Operators on a hierarchy of edges (child, parent): closure, depth, siblings, and pair features from them.

A round of a loop is one join; its table is written to the shared folder, and only a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import first_rows, product, written


class CycleError(ValueError):
    """The hierarchy has a cycle (a self-loop is one)."""


def dag(edges: DataFrame) -> DataFrame:
    """Parallel edges collapse."""
    return edges.select("child", "parent").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()


def ancestors(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """G1: (node, ancestor, hops) with the fewest hops; only for the nodes in seeds(node), if given.

    A frontier moves up one level a round; what is already in the closure doesn't come back, so diamonds don't
    multiply. On a cycle a node becomes its own ancestor, and the loop still ends.
    """
    e = written(dag(edges), "edges")
    start = e if seeds is None else e.join(seeds.select(F.col("node").alias("child")).distinct(), "child", "left_semi")
    frontier = written(start.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops")), "closure")
    closure = frontier
    while True:
        up = frontier.join(e.select(F.col("child").alias("ancestor"), F.col("parent").alias("next")), "ancestor")
        fresh = up.select("node", F.col("next").alias("ancestor"), (F.col("hops") + 1).alias("hops")).distinct()
        frontier = written(fresh.join(closure.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "closure")
        if frontier.limit(1).count() == 0:
            return closure
        closure = closure.unionByName(frontier)


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth), the length of the longest way from a root; raises CycleError where there is none.

    Level by level: a node's depth is final once all its parents are placed, which is when as many of its
    edges have come up as it has. Each edge is followed once.
    """
    e = written(dag(edges), "edges")
    wanted = e.groupBy("child").agg(F.count(F.lit(1)).alias("wanted"))
    level = written(nodes(e).join(wanted.select(F.col("child").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)), "depth")
    placed, arrived, k = level, None, 0
    total = nodes(e).count()
    done = level.count()
    while done < total:
        if level.limit(1).count() == 0:
            raise CycleError(f"{total - done} nodes lie on or behind a cycle")
        k += 1
        came = level.join(e.select(F.col("parent").alias("node"), "child"), "node").groupBy("child").agg(F.count(F.lit(1)).alias("n"))
        sums = came if arrived is None else arrived.unionByName(came).groupBy("child").agg(F.sum("n").alias("n"))
        sums = written(sums.join(wanted, "child"), "arrived")
        level = written(sums.filter("n = wanted").select(F.col("child").alias("node"), F.lit(k).alias("depth")), "depth")
        arrived = sums.filter("n < wanted").select("child", "n")
        placed = placed.unionByName(level)
        done += level.count()
    return placed


def max_depth(concepts: DataFrame, depth: DataFrame) -> int:
    """Of the concepts (column concept); those without a depth count as 0; raises ValueError without concepts."""
    top = concepts.select(F.col("concept").alias("node")).join(depth, "node", "left").agg(F.max(F.coalesce("depth", F.lit(0)))).first()[0]
    if top is None:
        raise ValueError("no concepts")
    return top


def norm_depths(concepts: DataFrame, source: DataFrame, target: DataFrame, depth: DataFrame) -> DataFrame:
    """(concept, depth, norm_depth); the source's greatest depth divides if the concept is one of its, else the target's, else 0."""
    ms, mt = max_depth(source, depth), max_depth(target, depth)
    ins = source.select("concept").distinct().withColumn("in_source", F.lit(True))
    int_ = target.select("concept").distinct().withColumn("in_target", F.lit(True))
    d = F.coalesce("depth", F.lit(0))
    part = lambda m: d / F.lit(float(m)) if m else F.lit(0.0)
    return (
        concepts.select("concept").distinct().join(depth.withColumnRenamed("node", "concept"), "concept", "left").join(ins, "concept", "left").join(int_, "concept", "left")
        .select("concept", d.alias("depth"), F.when(F.col("in_source"), part(ms)).when(F.col("in_target"), part(mt)).otherwise(F.lit(0.0)).alias("norm_depth"))
    )


def _sides(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """pairs(c1, c2) with the sets of ancestors a1 and a2 (empty where there is none)."""
    sets = closure.groupBy("node").agg(F.collect_set("ancestor").alias("a"))
    out = pairs
    for k in ("1", "2"):
        out = out.join(sets.select(F.col("node").alias(f"c{k}"), F.col("a").alias(f"a{k}")), f"c{k}", "left").withColumn(f"a{k}", F.coalesce(f"a{k}", F.array().cast("array<string>")))
    return out


def ancestor_features(pairs: DataFrame, edges: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """pairs(c1, c2) with shared_ancestors, ancestor_jaccard, lca_depth, overlap_ratio, and both depths.

    The closure is taken for the pairs' concepts only.
    """
    ids = pairs.select(F.col("c1").alias("node")).unionByName(pairs.select(F.col("c2").alias("node"))).distinct()
    closure = written(ancestors(edges, ids).select("node", "ancestor"), "ancestors")
    depth = written(depths(edges) if depth is None else depth, "depths")
    distinct = pairs.select("c1", "c2").distinct()
    sets = _sides(distinct, closure)
    common = closure.select(F.col("node").alias("c1"), "ancestor").join(distinct, "c1").join(closure.select(F.col("node").alias("c2"), "ancestor"), ["c2", "ancestor"])
    lca = common.join(depth.select(F.col("node").alias("ancestor"), "depth"), "ancestor").groupBy("c1", "c2").agg(F.max("depth").alias("lca"))
    out = sets.join(lca, ["c1", "c2"], "left")
    for k in ("1", "2"):
        out = out.join(depth.select(F.col("node").alias(f"c{k}"), F.col("depth").alias(f"d{k}")), f"c{k}", "left").withColumn(f"d{k}", F.coalesce(f"d{k}", F.lit(0)))
    shared, every = F.size(F.array_intersect("a1", "a2")), F.size(F.array_union("a1", "a2"))
    deep = F.greatest("d1", "d2")
    return out.select(
        "c1", "c2", "d1", "d2", shared.alias("shared_ancestors"), F.when(every > 0, shared / every).otherwise(F.lit(0.0)).alias("ancestor_jaccard"),
        F.coalesce("lca", F.lit(0)).alias("lca_depth"), F.when(deep > 0, shared / deep).otherwise(F.lit(0.0)).alias("overlap_ratio"),
    )


def shortest_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(c1, c2) with the hops from c1 down to c2; 0 for itself, infinity where there is no way."""
    closure = ancestors(edges, pairs.select(F.col("c2").alias("node")))
    hops = closure.select(F.col("ancestor").alias("c1"), F.col("node").alias("c2"), F.col("hops").cast("double").alias("h"))
    return pairs.join(hops, ["c1", "c2"], "left").select("c1", "c2", F.when(F.col("c1") == F.col("c2"), F.lit(0.0)).otherwise(F.coalesce("h", F.lit(float("inf")))).alias("distance"))


def twins(links: DataFrame, most: int = 32) -> DataFrame:
    """(node, class) of links(node, other), which has no row twice: nodes with the same others, at most `most`, are one class; any other node is one of its own."""
    few = links.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    sets = links.join(few.filter(F.col("n") <= most), "node").groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("others"))
    sets = written(sets, "others")
    names = sets.groupBy("others").agg(F.min("node").alias("class"))
    return sets.join(names, "others").select("node", "class").unionByName(few.filter(F.col("n") > most).select("node", F.col("node").alias("class")))


def siblings(concepts: DataFrame, edges: DataFrame, drop_ancestors: bool = True) -> DataFrame:
    """(concept, sibling) that share a parent; not the concept itself, nor its ancestors; none where it isn't in the hierarchy.

    Classes of nodes with the same parents are paired first, each pair once, so the pairs of nodes needn't be made
    distinct; a concept carries the ancestors that are its siblings.
    """
    e = written(dag(edges).dropna(), "edges")
    kinds = written(twins(e.select(F.col("child").alias("node"), F.col("parent").alias("other"))), "classes")
    parents = written(kinds.join(e.select(F.col("child").alias("node"), "parent"), "node").select("class", "parent").distinct(), "parents")
    seeds = written(concepts.select("concept").distinct().join(kinds.withColumnRenamed("node", "concept"), "concept"), "seeds")
    near = seeds.select("class").distinct().join(parents, "class").join(parents.withColumnRenamed("class", "other"), "parent").select("class", "other").distinct()
    asked = seeds.join(near, "class").select("concept", "other")
    if drop_ancestors:
        above = ancestors(e, seeds.select(F.col("concept").alias("node"))).select(F.col("node").alias("concept"), "ancestor")
        up = e.select(F.col("child").alias("concept"), "parent")
        both = above.join(up, "concept").join(e.withColumnRenamed("child", "ancestor"), ["ancestor", "parent"])
        asked = asked.join(both.groupBy("concept").agg(F.collect_set("ancestor").alias("above")), "concept", "left")
    found = product(asked, kinds.select(F.col("class").alias("other"), F.col("node").alias("sibling")), "other").filter("concept <> sibling")
    if drop_ancestors:
        found = found.filter(~F.coalesce(F.array_contains("above", F.col("sibling")), F.lit(False)))
    return found.select("concept", "sibling")


def shared_neighbours(pairs: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """pairs(c1, c2) with a 0/1 column: whether links(concept, other) give both a common one."""
    sets = links.groupBy("concept").agg(F.collect_set("other").alias("o"))
    out = pairs
    for k in ("1", "2"):
        out = out.join(sets.select(F.col("concept").alias(f"c{k}"), F.col("o").alias(f"o{k}")), f"c{k}", "left")
    empty = F.array().cast("array<string>")
    return out.select(*pairs.columns, F.arrays_overlap(F.coalesce("o1", empty), F.coalesce("o2", empty)).cast("int").alias(name))


def attributed_graph(broader: DataFrame, narrower: DataFrame, related: DataFrame) -> DataFrame:
    """(src, dst, relation) from (concept, other) tables; broader is reversed; of several relations on an ordered pair the last named wins."""
    b = broader.select(F.col("other").alias("src"), F.col("concept").alias("dst"), F.lit("broader").alias("relation"), F.lit(0).alias("rank"))
    n = narrower.select(F.col("concept").alias("src"), F.col("other").alias("dst"), F.lit("narrower").alias("relation"), F.lit(1).alias("rank"))
    r = related.select(F.col("concept").alias("src"), F.col("other").alias("dst"), F.lit("related").alias("relation"), F.lit(2).alias("rank"))
    return b.unionByName(n).unionByName(r).groupBy("src", "dst").agg(F.max_by("relation", "rank").alias("relation"))


def negative_edges(node_ids: DataFrame, edges: DataFrame, seed: int = 42, oversample: int = 8) -> DataFrame:
    """(src, dst), as many as edges(src, dst), adjacent in neither direction.

    Candidates are drawn by hash, oversample for each edge, over numbered nodes, so no cross product is made.
    """
    n = node_ids.count()
    m = edges.select("src", "dst").distinct().count()
    numbered = numbered_nodes(node_ids)
    e = edges.select("src", "dst")
    draw = e.distinct().select(F.explode(F.sequence(F.lit(0), F.lit(oversample - 1))).alias("k"), "src", "dst").select(
        *(F.expr(f"conv(substr(md5(concat_ws('#', src, dst, k, {seed}, '{side}')), 1, 8), 16, 10)").cast("long").alias(side) for side in ("i", "j"))
    )
    at = lambda side, name: numbered.select(F.col("node").alias(name), F.col("idx").alias(side))
    drawn = draw.select(F.pmod("i", F.lit(n)).alias("i"), F.pmod("j", F.lit(n)).alias("j")).filter("i <> j").distinct().join(at("i", "src"), "i").join(at("j", "dst"), "j").select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    free = drawn.join(both, ["src", "dst"], "left_anti").distinct().withColumn("key_", F.md5(F.concat_ws("#", "src", "dst", F.lit(seed))))
    return first_rows(free, m, "key_", "src", "dst").drop("key_")


def numbered_nodes(node_ids: DataFrame) -> DataFrame:
    """(node, idx) from 0 in the order of node; by range partitions, so no task sorts all of them."""
    cut = written(node_ids.select("node").distinct().repartitionByRange("node").withColumn("part", F.spark_partition_id()), "parts")
    sizes = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("node"))
    return cut.join(F.broadcast(base), "part").select("node", (F.col("base") + rank - 1).alias("idx"))


def propagate(node_vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """One symmetric-normalised step over undirected edges with self-loops: (node, vector).

    node_vectors(node, vector array<double>), edges(src, dst). A neighbour's weight is 1 / sqrt(d_u * d_v).
    """
    loops = node_vectors.select(F.col("node").alias("u"), F.col("node").alias("v"))
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).filter("u <> v").distinct().unionByName(loops)
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    weighted = both.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v").join(node_vectors.withColumnRenamed("node", "v"), "v")
    terms = weighted.select("u", F.posexplode("vector").alias("pos", "x"), (1 / F.sqrt(F.col("d") * F.col("dv"))).alias("w"))
    sums = terms.groupBy("u", "pos").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    return sums.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")).withColumnRenamed("u", "node")
