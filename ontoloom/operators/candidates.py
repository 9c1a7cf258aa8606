"""Candidate pairs: blocking by shared tokens, siblings, nearest vectors; sampling, labelling and thresholds.

Samples are ordered by md5 digests of concepts and a seed, so they are the same on every run and every layout.
Negatives of a positive are the candidates that follow its own place on a ring of digests, so they can be looked
up and needn't be listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from .hierarchy import ancestors, dag, twins
from .storage import first_rows, product, written

RING = 1 << 60


def sample_key(*cols: str, seed: int) -> Column:
    return F.md5(F.concat_ws("#", *cols, F.lit(seed)))


def ring_place(*cols: str, seed: int) -> Column:
    """A place on the ring, from 0 to RING - 1, by the first 15 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *cols, F.lit(seed))), 1, 15), 16, 10).cast("long")


def all_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every pair (src, tgt) of two tables of concepts. Quadratic by its meaning; blocking is the way for large sides."""
    return source.select(F.col("concept").alias("src")).crossJoin(target.select(F.col("concept").alias("tgt")))


def token_index(labels: DataFrame, max_token_df: int | None = None) -> DataFrame:
    """A2: distinct (concept, token) of labels(concept, labels); optionally without tokens of more concepts than max_token_df."""
    words = labels.select("concept", F.explode(X.tokens(X.normalize(X.join_labels(F.col("labels"))))).alias("token"))
    if max_token_df is None:
        return words
    return words.join(words.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > max_token_df), "token", "left_anti")


def shared_token_counts(source: DataFrame, target: DataFrame, max_token_df: int | None = None, often: int = 64) -> DataFrame:
    """(src, tgt, shared) of concepts that share a token; a concept's rows count together, as often as they have a token.

    Tokens of more than `often` rows of the target are counted between classes of concepts with the same ones of them,
    and the classes' pairs are expanded at the end. Other tokens are counted by pair; a source carries these counts.
    """

    def counted(labels: DataFrame, tag: str) -> DataFrame:
        return written(token_index(labels, max_token_df).groupBy("concept", "token").agg(F.count(F.lit(1)).alias("n")), tag)

    s, t = counted(source, "source").withColumnRenamed("concept", "src"), counted(target, "target").withColumnRenamed("concept", "tgt")
    common = written(t.groupBy("token").agg(F.count(F.lit(1)).alias("r")).join(s.select("token").distinct(), "token").select("token", (F.col("r") > often).alias("frequent")), "common")
    rare = s.join(common.filter("NOT frequent"), "token").select("src", "token", F.col("n").alias("m")).join(t, "token").groupBy("src", "tgt").agg(F.sum(F.col("m") * F.col("n")).alias("few"))
    rare = written(rare, "rare")

    def classes(words: DataFrame, name: str, c: str) -> tuple[DataFrame, DataFrame]:
        sets = words.join(common.filter("frequent"), "token").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("token", "n"))).alias("set"))
        sets = written(sets.withColumn(c, F.sha2(F.to_json("set"), 256)), "classes")
        return sets.select(name, c), sets.groupBy(c).agg(F.first("set").alias("set")).select(c, F.inline("set"))

    (ks, cs), (kt, ct) = classes(s, "src", "c1"), classes(t, "tgt", "c2")
    pairs = written(cs.withColumnRenamed("n", "m").join(ct, "token").groupBy("c1", "c2").agg(F.sum(F.col("m") * F.col("n")).alias("many")), "pairs")
    key = F.coalesce(F.concat(F.lit("="), "tgt"), F.lit(""))  # a map has no null keys
    more = rare.groupBy(F.col("src").alias("own")).agg(F.map_from_entries(F.collect_list(F.struct(key, "few"))).alias("more"))
    left = ks.join(pairs, "c1").join(more, F.col("src").eqNullSafe(F.col("own")), "left").select("src", "c2", "many", "more")
    shared = F.when(F.col("more").isNull(), F.col("many")).otherwise(F.col("many") + F.coalesce(F.element_at("more", F.col("key")), F.lit(0)))
    both = product(left, kt.withColumn("key", key), "c2").select("src", "tgt", shared.cast("int").alias("shared"))
    known = rare.join(ks.withColumnRenamed("src", "own"), F.col("src").eqNullSafe(F.col("own")), "left").drop("own").join(kt.withColumnRenamed("tgt", "own"), F.col("tgt").eqNullSafe(F.col("own")), "left")
    return both.unionByName(known.join(pairs, ["c1", "c2"], "left_anti").select("src", "tgt", F.col("few").cast("int").alias("shared")))


def blocked_topk(source: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """(src, tgt, shared, jaccard, rank): of the targets that share a token, the k of greatest Jaccard for each source.

    Tables have a row for each concept. A token carries the size of its set, so each side is read once and only
    counts by pair are shuffled after the join; of these a task keeps k for each source before the ranks are merged.
    """

    def sized(labels: DataFrame, name: str, size: str) -> DataFrame:
        sets = labels.select(F.col("concept").alias(name), X.tokens(X.normalize(X.join_labels(F.col("labels")))).alias("t"))
        return sets.select(name, F.size("t").alias(size), F.explode("t").alias("token"))

    pairs = sized(source, "src", "ns").join(sized(target, "tgt", "nt"), "token").groupBy("src", "tgt", "ns", "nt").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    scored = pairs.select("src", "tgt", "shared", F.round(F.col("shared") / (F.col("ns") + F.col("nt") - F.col("shared")), 6).alias("jaccard"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("jaccard"), "tgt"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def positives(reference: DataFrame) -> DataFrame:
    """(src, tgt, label 1) of the rows whose Score is 1."""
    return reference.filter(F.coalesce(F.col("Score") == 1.0, F.lit(False))).select(F.col("SrcEntity").alias("src"), F.col("TgtEntity").alias("tgt"), F.lit(1).alias("label"))


def _negatives(sampled: DataFrame, reference: DataFrame) -> DataFrame:
    """Sampled pairs that aren't in the reference, whatever their score there; a bag."""
    known = reference.select(F.col("SrcEntity").alias("src"), F.col("TgtEntity").alias("tgt")).distinct()
    return sampled.select("src", "tgt").join(known, ["src", "tgt"], "left_anti").withColumn("label", F.lit(0))


def draw(asked: DataFrame, members: DataFrame, n: int, seed: int) -> DataFrame:
    """(src, true_tgt, tgt): of the members of a positive's groups the n that follow its place on the ring, and more.

    asked(src, true_tgt, group, spare) has a row for each group of a positive; members(group, tgt) may repeat. From
    each group come the first n + spare members, so after spare exclusions the first n of all groups are among the
    rows. No group is listed for a positive: members and positives are sorted together by range partitions, which
    cut large groups; a positive's place among the members is a running count, and what follows is looked up there.
    """
    null = F.lit(None).cast("string")
    ringed = members.distinct().select("group", ring_place("tgt", seed=seed).alias("at"), F.lit(1).alias("member"), "tgt", null.alias("src"), null.alias("true_tgt"), F.lit(0).cast("long").alias("spare"))
    places = asked.select("group", ring_place("src", "true_tgt", seed=seed).alias("at"), F.lit(0).alias("member"), null.alias("tgt"), "src", "true_tgt", F.col("spare").cast("long").alias("spare"))
    order = ("at", "member", "tgt", "src", "true_tgt")
    cut = written(ringed.unionByName(places).repartitionByRange("group", *order).withColumn("part", F.spark_partition_id()), "ring")
    cells = cut.groupBy("group", "part").agg(F.sum("member").alias("c"))
    whole = Window.partitionBy("group")  # a row for each partition that the group lies in
    cells = cells.select("group", "part", (F.sum("c").over(whole.orderBy("part")) - F.col("c")).alias("base"), F.sum("c").over(whole).alias("size"))
    before = F.sum("member").over(Window.partitionBy("group", "part").orderBy(*order)) - F.col("member") + F.col("base")
    placed = written(cut.join(cells, ["group", "part"]).withColumn("idx", before), "placed")
    ahead = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(n) + F.col("spare")) - 1))
    wanted = placed.filter("member = 0 AND size > 0").select("src", "true_tgt", "group", "idx", "size", ahead.alias("k")).select("src", "true_tgt", "group", F.pmod(F.col("idx") + F.col("k"), F.col("size")).alias("idx"))
    return wanted.join(placed.filter("member = 1").select("group", "idx", "tgt"), ["group", "idx"]).select("src", "true_tgt", "tgt").distinct()


def _followers(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n rows of (src, true_tgt, tgt) after each positive's place on the ring."""
    distance = F.pmod(ring_place("tgt", seed=seed) - ring_place("src", "true_tgt", seed=seed), F.lit(RING))
    rank = F.row_number().over(Window.partitionBy("src", "true_tgt").orderBy(distance, "tgt"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= n)


def idf_negatives(reference: DataFrame, source: DataFrame, target: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """For each positive, at most n targets that share a token with its source; fewer only where there are no more."""
    pos = positives(reference).select("src", F.col("tgt").alias("true_tgt")).distinct()
    asked = pos.join(token_index(source).select(F.col("concept").alias("src"), F.col("token").alias("group")), "src").withColumn("spare", F.lit(1))
    members = token_index(target).select(F.col("token").alias("group"), F.col("concept").alias("tgt"))
    return _negatives(_followers(draw(asked, members, n, seed).filter("tgt <> true_tgt"), n, seed), reference)


def neighbour_negatives(reference: DataFrame, edges: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """C4: for each positive, at most n siblings of its target, none of them an ancestor; fewer only where there are no more."""
    e = dag(edges)
    pos = positives(reference).select("src", F.col("tgt").alias("true_tgt")).distinct()
    above = written(ancestors(e, pos.select(F.col("true_tgt").alias("node"))).select(F.col("node").alias("true_tgt"), F.col("ancestor").alias("tgt")), "above")
    spare = above.groupBy("true_tgt").agg((F.count(F.lit(1)) + 1).alias("spare"))
    asked = pos.join(e.select(F.col("child").alias("true_tgt"), F.col("parent").alias("group")), "true_tgt").join(spare, "true_tgt")
    members = e.select(F.col("parent").alias("group"), F.col("child").alias("tgt"))
    others = draw(asked, members, n, seed).filter("tgt <> true_tgt").join(above, ["true_tgt", "tgt"], "left_anti")
    return _negatives(_followers(others, n, seed), reference)


def pairs_with_negatives(reference: DataFrame, source: DataFrame, target: DataFrame, edges: DataFrame, idf: int = 50, neighbour: int = 50, seed: int = 42) -> DataFrame:
    """Positives and both kinds of negatives, as a bag."""
    return positives(reference).unionByName(idf_negatives(reference, source, target, idf, seed)).unionByName(neighbour_negatives(reference, edges, neighbour, seed))


def hop_negatives(reference: DataFrame, edges: DataFrame, max_hops: int = 5, n: int = 50, seed: int = 42) -> DataFrame:
    """S9 (without its tokenizer): for each positive, at most n concepts within max_hops of its target, edges taken either way.

    Neighbourhoods are found among classes of nodes with the same neighbours, and classes that the same targets reach
    are one group, in which the n are looked up; no neighbourhood is listed node by node.
    """
    both = edges.select(F.col("child").alias("node"), F.col("parent").alias("other")).unionByName(edges.select(F.col("parent").alias("node"), F.col("child").alias("other")))
    both = written(both.dropna().distinct(), "links")
    kinds = written(twins(both), "classes")
    to = kinds.select(F.col("node").alias("other"), F.col("class").alias("next"))
    links = written(both.join(kinds, "node").join(to, "other").select("class", "next").distinct(), "links")
    pos = written(positives(reference).select("src", F.col("tgt").alias("true_tgt")).distinct().join(kinds.withColumnRenamed("node", "true_tgt"), "true_tgt"), "positives")
    # the start isn't seen before a way leads back: only then its class has others within reach
    frontier = pos.select(F.col("class").alias("start"), "class").distinct()
    seen = None
    for _ in range(max_hops):
        fresh = frontier.join(links, "class").select("start", F.col("next").alias("class")).distinct()
        frontier = written(fresh if seen is None else fresh.join(seen, ["start", "class"], "left_anti"), "hops")
        seen = frontier if seen is None else seen.unionByName(frontier)
    if seen is None:
        return _negatives(pos.select("src", F.col("true_tgt").alias("tgt")).filter("false"), reference)
    groups = written(seen.groupBy("class").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("start"))), 256).alias("group")), "groups")
    reach = seen.join(groups, "class").select(F.col("start").alias("class"), "group").distinct()
    asked = pos.join(reach, "class").select("src", "true_tgt", "group", F.lit(1).alias("spare"))
    members = kinds.join(groups, "class").select("group", F.col("node").alias("tgt"))
    return _negatives(_followers(draw(asked, members, n, seed).filter("tgt <> true_tgt"), n, seed), reference)


def label_pairs(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """pairs(src, tgt) with label 1 where matches has the pair in either order."""
    a, b = X.unordered(F.col("src"), F.col("tgt"))
    known = matches.select(a.alias("k1"), b.alias("k2")).distinct().withColumn("hit", F.lit(1))
    return pairs.withColumn("k1", a).withColumn("k2", b).join(known, ["k1", "k2"], "left").select("src", "tgt", F.coalesce("hit", F.lit(0)).alias("label"))


def labelled_product(left: DataFrame, right: DataFrame, key: str, matches: DataFrame) -> DataFrame:
    """label_pairs() of all pairs of left(src, key) and right(tgt, key) that agree on the key; a concept carries its matches, so pairs aren't shuffled."""
    both = matches.select("src", F.col("tgt").alias("other")).unionByName(matches.select(F.col("tgt").alias("src"), F.col("src").alias("other")))
    known = both.groupBy("src").agg(F.collect_set("other").alias("known"))
    pairs = product(left.join(known, "src", "left"), right, key)
    return pairs.select("src", "tgt", F.coalesce(F.array_contains("known", F.col("tgt")), F.lit(False)).cast("int").alias("label"))


def downsampled(pairs: DataFrame, max_neg_per_pos: float = 2, seed: int = 42) -> DataFrame:
    """All positives, and at most max_neg_per_pos times as many negatives; pairs come in string order."""
    a, b = X.unordered(F.col("src"), F.col("tgt"))
    p = written(pairs.select(a.alias("src"), b.alias("tgt"), "label"), "pairs")
    n = round(max_neg_per_pos * p.filter("label = 1").count())
    drawn = first_rows(p.filter("label = 0").withColumn("key_", sample_key("src", "tgt", seed=seed)), n, "key_", "src", "tgt")
    return p.filter("label = 1").unionByName(drawn.drop("key_"))


def topk_cosine(source: DataFrame, target: DataFrame, k: int, block: int = 4096, digits: int = 6) -> DataFrame:
    """(src, tgt, cosine, rank) of the k nearest targets of each source, ties by tgt; tables (concept, embedding).

    Sources are the queries, in blocks of `block`; targets are read once for each block and reduced to k within
    a task, so a block and k rows for each of its queries and task are all that is held or shuffled.
    """
    spark = source.sparkSession
    kind = dict(source.dtypes)["concept"]
    q = source.filter(V.usable(F.col("embedding"))).select("concept", V._double(F.col("embedding")).alias("embedding"))
    total = q.count()
    out = None
    for at in range(0, max(total, 1), block):
        n = -(-max(total, 1) // block)
        part = q.filter(F.pmod(F.xxhash64("concept"), F.lit(n)) == at // block) if n > 1 else q
        rows = part.collect()  # about `block` vectors
        ids = [r[0] for r in rows]
        m = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
        norms = np.linalg.norm(m, axis=1, keepdims=True) if len(rows) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast((ids, np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, unit = sent.value
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                t = np.array(b["embedding"].tolist(), float)
                norms = np.linalg.norm(t, axis=1, keepdims=True)
                cos = np.round(unit @ np.divide(t, norms, out=np.zeros_like(t), where=norms > 0).T, digits)
                names = b["concept"].to_numpy()
                order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(names)), cos.shape), -cos))[:, : k + 1]
                src = np.repeat(np.array(ids, dtype=names.dtype), order.shape[1])
                yield pd.DataFrame({"src": src, "tgt": names[order.ravel()], "cosine": np.take_along_axis(cos, order, 1).ravel() + 0.0})

        usable = target.filter(V.usable(F.col("embedding"))).select("concept", V._double(F.col("embedding")).alias("embedding"))
        near = usable.mapInPandas(run, f"src {kind}, tgt {kind}, cosine double").filter("src <> tgt")
        out = near if out is None else out.unionByName(near)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cosine"), "tgt"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def hybrid_candidates(source: DataFrame, target: DataFrame, top_k: int, min_lexical: float, min_cosine: float) -> DataFrame:
    """Distinct (src, tgt) of the top_k by cosine that pass the cosine and then the lexical threshold; tables (concept, labels, embedding)."""
    near = topk_cosine(source, target, top_k).filter(F.col("cosine") >= min_cosine)
    label = lambda df, name, out: df.select(F.col("concept").alias(name), X.join_labels(F.col("labels")).alias(out))
    scored = near.join(label(source, "src", "l1"), "src").join(label(target, "tgt", "l2"), "tgt").withColumn("lexical", X.partial_ratio("l1", "l2"))
    return scored.filter(F.col("lexical") >= min_lexical).select("src", "tgt").distinct()


def select_pairs(pairs: DataFrame, concepts: DataFrame, min_lexical: float, min_cosine: float) -> DataFrame:
    """pairs(src, tgt, label) over both thresholds; unknown concepts drop out; the cheap test comes first.

    The slow ratio is a nondeterministic column behind the cosine's filter, so it is taken once, for what is left.
    """
    c = concepts.select("concept", X.normalize(X.join_labels(F.col("labels"))).alias("l"), "embedding", V.norm(F.col("embedding")).alias("n"))
    side = lambda k, name: c.select(F.col("concept").alias(name), *(F.col(x).alias(f"{x}{k}") for x in ("l", "embedding", "n")))
    near = pairs.join(side(1, "src"), "src").join(side(2, "tgt"), "tgt").filter(V.cosine(F.col("embedding1"), F.col("embedding2"), F.col("n1"), F.col("n2")) >= min_cosine)
    once = X.partial_ratio.asNondeterministic()
    return near.withColumn("lexical", once("l1", "l2")).filter(F.col("lexical") >= min_lexical).select(*pairs.columns)


def merge_labels(source: DataFrame, target: DataFrame) -> DataFrame:
    """U4: labels by concept of both sides; the target's win."""
    t = target.select("concept", F.col("labels").alias("t"))
    return source.select("concept", F.col("labels").alias("s")).join(t, "concept", "full").select("concept", F.coalesce("t", "s").alias("labels"))
