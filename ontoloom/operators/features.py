"""Feature tables of concept pairs: the main set, the ablation set, and the wide set for one taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from .hierarchy import ancestor_features, depths, norm_depths, shared_neighbours, shortest_paths
from .storage import written


def concept_table(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row per concept with what pairs need of it: normalised label, tokens, vector and norm."""
    text = X.normalize(X.join_labels(F.col("labels")))
    named = labels.select("concept", text.alias("l")).withColumn("t", X.tokens(F.col("l")))
    return named.join(embeddings.select("concept", "embedding"), "concept", "full").withColumn("n", V.norm(F.col("embedding")))


def with_sides(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """pairs(src, tgt, ...) with l, t, embedding and n of both; a missing label is ''."""
    out = pairs
    for k, name in (("1", "src"), ("2", "tgt")):
        side = concepts.select(F.col("concept").alias(name), *(F.col(c).alias(f"{c}{k}") for c in ("l", "t", "embedding", "n")))
        out = out.join(side, name, "left").withColumn(f"l{k}", F.coalesce(f"l{k}", F.lit(""))).withColumn(f"t{k}", F.coalesce(f"t{k}", F.array().cast("array<string>")))
    return out


def lexical() -> dict[str, Column]:
    a, b = F.col("t1"), F.col("t2")
    return {
        "shared_tokens": X.shared_tokens(a, b),
        "token_ratio_c1": X.token_ratio(a, b),
        "token_ratio_c2": X.token_ratio(b, a),
        "exact_match": X.exact(F.col("l1"), F.col("l2")),
        "jaccard": X.token_jaccard(a, b),
        "cosine": V.cosine(F.col("embedding1"), F.col("embedding2"), F.col("n1"), F.col("n2")),
        "levenshtein": F.levenshtein("l1", "l2"),
    }


ABLATED = ("shared_tokens", "token_ratio_c1", "token_ratio_c2")


def pair_features(pairs: DataFrame, source: DataFrame, target: DataFrame, labels: DataFrame, embeddings: DataFrame, edges: DataFrame, ablation: bool = False, partial: bool = True) -> DataFrame:
    """A row for each row of pairs(src, tgt, label) whose concepts both have a usable vector.

    Rows without one are dropped before any feature is taken. Structural features are taken once per
    distinct pair, concept features once per concept.
    """
    concepts = written(concept_table(labels, embeddings), "concepts")
    usable = with_sides(pairs, concepts).filter(V.usable(F.col("embedding1")) & V.usable(F.col("embedding2")))
    cols = {k: v for k, v in lexical().items() if not (ablation and k in ABLATED)}
    base = usable.select("src", "tgt", "label", "l1", "l2", *(v.alias(k) for k, v in cols.items()))
    if partial:
        base = base.withColumn("partial_match", X.partial_ratio("l1", "l2") / 100)
    base = written(base.drop("l1", "l2"), "lexical")
    ids = base.select(F.col("src").alias("c1"), F.col("tgt").alias("c2")).distinct()
    depth = written(depths(edges), "depths")
    anc = ancestor_features(ids, edges, depth).select(F.col("c1").alias("src"), F.col("c2").alias("tgt"), F.abs(F.col("d1") - F.col("d2")).alias("depth_diff"), "ancestor_jaccard")
    every = ids.select(F.col("c1").alias("concept")).unionByName(ids.select(F.col("c2").alias("concept"))).distinct()
    norm = written(norm_depths(every, source, target, depth), "norms")
    out = base.join(anc, ["src", "tgt"])
    for k, name in (("1", "src"), ("2", "tgt")):
        out = out.join(norm.select(F.col("concept").alias(name), F.col("norm_depth").alias(f"norm{k}")), name)
    order = ["src", "tgt", *cols, *(["partial_match"] if partial else []), "depth_diff", "norm_depth_diff", "ancestor_jaccard", "label"]
    return out.withColumn("norm_depth_diff", F.abs(F.col("norm1") - F.col("norm2"))).select(*order)


def ordinal_pairs(concepts: DataFrame, most: int | None = 10_000) -> DataFrame:
    """(c1, c2) of concepts(concept, ordinal) with i < j, i <= most and j < most; the bounds reach each side."""
    a = concepts.select(F.col("concept").alias("c1"), F.col("ordinal").alias("i"))
    b = concepts.select(F.col("concept").alias("c2"), F.col("ordinal").alias("j"))
    if most is not None:
        a, b = a.filter(F.col("i") <= most), b.filter(F.col("j") < most)
    return a.join(b, F.col("i") < F.col("j")).select("c1", "c2")


def parent_similarity(pairs: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """pairs(c1, c2) with the greatest cosine of a parent of one with a parent of the other; 0 without parents, or vectors of theirs."""
    up = edges.select("child", "parent").distinct()
    vec = embeddings.select(F.col("concept").alias("parent"), "embedding", V.norm(F.col("embedding")).alias("n"))
    side = lambda k: up.join(vec, "parent", "left").select(F.col("child").alias(f"c{k}"), F.col("embedding").alias(f"e{k}"), F.col("n").alias(f"n{k}"))
    cos = V.cosine(F.col("e1"), F.col("e2"), F.col("n1"), F.col("n2"))
    best = pairs.select("c1", "c2").distinct().join(side(1), "c1").join(side(2), "c2").groupBy("c1", "c2").agg(F.max(cos).alias("parent_similarity"))
    return pairs.join(best, ["c1", "c2"], "left").withColumn("parent_similarity", F.coalesce("parent_similarity", F.lit(0.0)))


def taxonomy_features(pairs: DataFrame, labels: DataFrame, embeddings: DataFrame, edges: DataFrame, xrefs: DataFrame, partial: bool = True) -> DataFrame:
    """The wide table of pairs(c1, c2) within one taxonomy; xrefs(concept, other)."""
    concepts = written(concept_table(labels, embeddings), "concepts")
    sides = with_sides(pairs.select(F.col("c1").alias("src"), F.col("c2").alias("tgt")), concepts).filter("l1 <> '' AND l2 <> ''")
    lex = lexical()
    cols = {k: lex[k] for k in ("exact_match", "levenshtein", "jaccard", "cosine")}
    base = sides.select(F.col("src").alias("c1"), F.col("tgt").alias("c2"), F.col("l1").alias("label1"), F.col("l2").alias("label2"), *(v.alias(k) for k, v in cols.items()))
    if partial:
        base = base.withColumn("partial_match", X.partial_ratio("label1", "label2") / 100)
    base = written(base, "lexical")
    ids = base.select("c1", "c2")
    anc = ancestor_features(ids, edges).select(
        "c1", "c2", F.abs(F.col("d1") - F.col("d2")).alias("depth_diff"), F.col("lca_depth").alias("common_ancestor_depth"), "shared_ancestors", F.col("overlap_ratio").alias("hierarchical_overlap")
    )
    up = edges.select(F.col("child").alias("concept"), F.col("parent").alias("other"))
    down = edges.select(F.col("parent").alias("concept"), F.col("child").alias("other"))
    out = base.join(anc, ["c1", "c2"])
    # a common parent is both what makes siblings and a shared broader concept
    out = out.join(shared_neighbours(ids, up, "shared_broader"), ["c1", "c2"]).withColumn("sibling_score", F.col("shared_broader"))
    for links, name in ((down, "shared_narrower"), (xrefs, "xref_match")):
        out = out.join(shared_neighbours(ids, links, name), ["c1", "c2"])
    out = out.join(parent_similarity(ids, edges, embeddings), ["c1", "c2"])
    return out.join(shortest_paths(ids, edges).withColumnRenamed("distance", "hierarchical_distance"), ["c1", "c2"])
