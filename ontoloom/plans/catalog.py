"""Registered queries over the driver tables, and the DuckDB SQL that checks them. Keys follow the operators' names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalizer as N
from ..functions import text as X
from ..functions import vectors as V
from ..operators import candidates as C
from ..operators import features as E
from ..operators import hierarchy as H
from ..operators import learning as L
from ..operators import reports as R
from ..operators import storage
from ..sources import embedder, files, rdf
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
t = B.table


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- labels: every supplier's label with every nation's name


def _label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a = B.source(spark, sf).select(F.col("concept").alias("src"), X.normalize(X.join_labels(F.col("labels"))).alias("l1"))
    b = t(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("tgt"), X.normalize(F.col("n_name")).alias("l2"))
    return a.crossJoin(b).withColumn("t1", X.tokens(F.col("l1"))).withColumn("t2", X.tokens(F.col("l2")))  # J1: all pairs are what is asked for


_PAIRS = f"""WITH {B.SOURCE_SQL}, p AS (SELECT concept AS src, 'N' || n_nationkey AS tgt, {B.norm_sql("label")} AS l1, {B.norm_sql("n_name")} AS l2 FROM source, nation),
 q AS (SELECT *, {B.tokens_sql("l1")} AS t1, {B.tokens_sql("l2")} AS t2 FROM p), s AS (SELECT *, len(list_intersect(t1, t2)) AS n FROM q) """


@query(f"SELECT doc_id, md5({B.norm_sql('text')}) AS norm FROM documents")
def norm_label(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm"))


@query("SELECT doc_id, md5(coalesce(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '')) AS label FROM documents")
def strip_label(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(X.normalize_label(F.col("text"))).alias("label"))


@query(_PAIRS + "SELECT src, tgt, (l1 = l2)::INT AS exact_match FROM s")
def exact_match(spark, sf):
    return _label_pairs(spark, sf).select("src", "tgt", X.exact(F.col("l1"), F.col("l2")).alias("exact_match"))


@query(_PAIRS + "SELECT src, tgt, round(CASE WHEN len(t1) + len(t2) > n THEN n / (len(t1) + len(t2) - n) ELSE 0 END, 6) AS jaccard FROM s")
def token_jaccard(spark, sf):
    return _label_pairs(spark, sf).select("src", "tgt", r6(X.token_jaccard(F.col("t1"), F.col("t2")), "jaccard"))


@query(_PAIRS + "SELECT src, tgt, n::INT AS shared, round(n / len(t1), 6) AS ratio_1, round(n / len(t2), 6) AS ratio_2 FROM s")
def token_ratios(spark, sf):
    a, b = F.col("t1"), F.col("t2")
    return _label_pairs(spark, sf).select("src", "tgt", X.shared_tokens(a, b).alias("shared"), r6(X.token_ratio(a, b), "ratio_1"), r6(X.token_ratio(b, a), "ratio_2"))


@query(_PAIRS + "SELECT src, tgt, levenshtein(l1, l2)::INT AS distance FROM s")
def levenshtein_pairs(spark, sf):
    return _label_pairs(spark, sf).select("src", "tgt", F.levenshtein("l1", "l2").alias("distance"))


@query(_PAIRS + f""", {B.partial_sql("p")} SELECT src, tgt, l1, l2, round(ratio, 6) AS ratio FROM p JOIN partial USING (l1, l2)""")
def partial_ratio(spark, sf):
    return _label_pairs(spark, sf).select("src", "tgt", "l1", "l2").withColumn("ratio", F.round(X.partial_ratio("l1", "l2"), 6))


# --- candidates


@query(f"""WITH s AS (SELECT 'B' || item_id AS src, unnest({B.tokens_sql(B.norm_sql("text"))}) AS token FROM benchmark),
 d AS (SELECT 'D' || doc_id AS tgt, unnest({B.tokens_sql(B.norm_sql("text"))}) AS token FROM documents),
 n AS (SELECT src, tgt, count(*) AS shared FROM s JOIN d USING (token) GROUP BY 1, 2),
 ns AS (SELECT src, count(*) AS c FROM s GROUP BY 1), nt AS (SELECT tgt, count(*) AS c FROM d GROUP BY 1),
 j AS (SELECT src, tgt, shared::INT AS shared, round(shared / (ns.c + nt.c - shared), 6) AS jaccard FROM n JOIN ns USING (src) JOIN nt USING (tgt)),
 k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY jaccard DESC, tgt)::INT AS rank FROM j) SELECT * FROM k WHERE rank <= 5""")
def token_blocking_topk(spark, sf):
    return C.blocked_topk(B.texts(spark, sf, "benchmark", "item_id", "B"), B.texts(spark, sf, "documents", "doc_id", "D"), 5)


@query(f"""WITH {B.SOURCE_SQL}, {B.TARGET_SQL}, s AS (SELECT concept AS src, unnest({B.tokens_sql(B.norm_sql("label"))}) AS token FROM source),
 d AS (SELECT concept AS tgt, unnest({B.tokens_sql(B.norm_sql("label"))}) AS token FROM target)
 SELECT src, tgt, count(*)::INT AS shared FROM s JOIN d USING (token) GROUP BY 1, 2""")
def token_blocking(spark, sf):
    return C.shared_token_counts(B.source(spark, sf), B.target(spark, sf))


_RING = "('0x' || substr(md5(concat_ws('#', {}, '42')), 1, 15))::BIGINT"
_SAMPLED = f"row_number() OVER (PARTITION BY src, true_tgt ORDER BY ({_RING.format('tgt')} - {_RING.format('src, true_tgt')} + {C.RING}) % {C.RING}, tgt) AS k"
_ANTI = "WHERE k <= 50 AND NOT EXISTS (SELECT 1 FROM ref r WHERE r.src = x.src AND r.tgt = x.tgt)"
_IDF = f"""idf AS (SELECT src, tgt, 0 AS label FROM (SELECT *, {_SAMPLED} FROM (SELECT DISTINCT p.src, p.tgt AS true_tgt, d.tgt FROM pos p
 JOIN (SELECT concept AS src, unnest({B.tokens_sql(B.norm_sql("label"))}) AS token FROM source) s ON s.src = p.src
 JOIN (SELECT concept AS tgt, unnest({B.tokens_sql(B.norm_sql("label"))}) AS token FROM target) d ON d.token = s.token WHERE d.tgt <> p.tgt)) x {_ANTI})"""
_SIB = """sib AS (SELECT DISTINCT p.tgt AS concept, b.child AS sibling FROM (SELECT DISTINCT tgt FROM pos) p JOIN edges a ON a.child = p.tgt JOIN edges b ON b.parent = a.parent
 WHERE b.child <> p.tgt AND NOT EXISTS (SELECT 1 FROM closure c WHERE c.node = p.tgt AND c.anc = b.child))"""
_NEAR = f"near AS (SELECT src, tgt, 0 AS label FROM (SELECT *, {_SAMPLED} FROM (SELECT p.src, p.tgt AS true_tgt, s.sibling AS tgt FROM pos p JOIN sib s ON s.concept = p.tgt)) x {_ANTI})"
_CANDIDATES = f"WITH RECURSIVE {B.SOURCE_SQL}, {B.TARGET_SQL}, {B.EDGES_SQL}, {B.REFERENCE_SQL}, {B.CLOSURE_SQL}, {_SIB}, {_IDF}, {_NEAR} "
_LABELED = _CANDIDATES + ", labeled AS (SELECT src, tgt, 1 AS label FROM ref WHERE score = 1 UNION ALL SELECT * FROM idf UNION ALL SELECT * FROM near) "


@query(f"WITH {B.REFERENCE_SQL} SELECT src, tgt, 1 AS label FROM ref WHERE score = 1")
def positives(spark, sf):
    return C.positives(B.reference(spark, sf))


@query(_CANDIDATES + "SELECT * FROM idf")
def idf_negatives(spark, sf):
    return C.idf_negatives(B.reference(spark, sf), B.source(spark, sf), B.target(spark, sf))


@query(_CANDIDATES + "SELECT * FROM sib")
def siblings(spark, sf):
    return H.siblings(C.positives(B.reference(spark, sf)).select(F.col("tgt").alias("concept")), B.edges(spark, sf))


@query(_CANDIDATES + "SELECT * FROM near")
def neighbour_negatives(spark, sf):
    return C.neighbour_negatives(B.reference(spark, sf), B.edges(spark, sf))


def _labeled(spark, sf, seed: int = 42) -> DataFrame:
    return C.pairs_with_negatives(B.reference(spark, sf), B.source(spark, sf), B.target(spark, sf), B.edges(spark, sf), seed=seed)


@query(_LABELED + "SELECT * FROM labeled")
def labeled_pairs(spark, sf):
    return _labeled(spark, sf)


@query(_LABELED + """, d AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, label FROM labeled),
 k AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('#', src, tgt, '42')), src, tgt) AS k FROM d WHERE label = 0)
 SELECT src, tgt, label FROM d WHERE label = 1 UNION ALL SELECT src, tgt, label FROM k WHERE k <= 2 * (SELECT count(*) FROM d WHERE label = 1)""")
def downsample_negatives(spark, sf):
    return C.downsampled(_labeled(spark, sf))


@query(f"""WITH {B.REFERENCE_SQL}, p AS (SELECT 'C' || c_custkey AS src, 'S' || s_suppkey AS tgt FROM customer JOIN supplier ON c_nationkey = s_nationkey)
 SELECT p.src, p.tgt, (pos.src IS NOT NULL)::INT AS label FROM p LEFT JOIN pos ON pos.src = p.tgt AND pos.tgt = p.src""")
def label_unordered_pairs(spark, sf):
    c = t(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.col("c_nationkey").alias("n"))
    s = t(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("tgt"), F.col("s_nationkey").alias("n"))
    return C.labelled_product(c, s, "n", C.positives(B.reference(spark, sf)))


@query("SELECT coalesce(r.k, n.k) AS concept, coalesce(r.name, n.name) AS label FROM (SELECT n_nationkey::VARCHAR AS k, n_name AS name FROM nation) n FULL JOIN (SELECT r_regionkey::VARCHAR AS k, r_name AS name FROM region) r USING (k)")
def map_merge(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("concept"), F.array("n_name").alias("labels"))
    r = t(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("concept"), F.array("r_name").alias("labels"))
    return C.merge_labels(n, r).select("concept", F.array_join("labels", " ").alias("label"))


# --- vectors


@query("""SELECT a.vec_id AS c1, b.vec_id AS c2, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS cosine
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id""")
def cosine_pairs(spark, sf):
    e = t(spark, sf, "embeddings").withColumn("n", V.norm(F.col("embedding")))
    a = e.select("label", F.col("vec_id").alias("c1"), F.col("embedding").alias("e1"), F.col("n").alias("n1"))
    b = e.select("label", F.col("vec_id").alias("c2"), F.col("embedding").alias("e2"), F.col("n").alias("n2"))
    return a.join(b, "label").filter("c1 < c2").select("c1", "c2", r6(V.cosine(F.col("e1"), F.col("e2"), F.col("n1"), F.col("n2")), "cosine"))


@query("""WITH c AS (SELECT a.vec_id AS src, b.vec_id AS tgt, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, tgt)::INT AS rank FROM c) WHERE rank <= 10""")
def topk_cosine(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("concept"), "embedding")
    return C.topk_cosine(e, e, 10)


@query(_LABELED + f""", {B.VECTORS_SQL}, lab AS (SELECT concept, {B.norm_sql("label")} AS l FROM source UNION ALL SELECT concept, {B.norm_sql("label")} FROM target),
 q AS (SELECT l.src, l.tgt, l.label, x.l AS l1, y.l AS l2 FROM labeled l JOIN vec a ON a.concept = l.src JOIN vec b ON b.concept = l.tgt JOIN lab x ON x.concept = l.src JOIN lab y ON y.concept = l.tgt WHERE {B.cosine_sql("a.embedding", "b.embedding")} >= 0.05),
 {B.partial_sql("q")} SELECT src, tgt, label FROM q JOIN partial USING (l1, l2) WHERE ratio >= 75""")
def threshold_select(spark, sf):
    labels = C.merge_labels(B.source(spark, sf), B.target(spark, sf))
    return C.select_pairs(_labeled(spark, sf), labels.join(B.vectors(spark, sf), "concept"), 75.0, 0.05)


@query(f"""WITH {B.SOURCE_SQL}, {B.TARGET_SQL}, {B.VECTORS_SQL}, c AS (SELECT a.concept AS src, b.concept AS tgt, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine FROM vec a, vec b WHERE a.concept IN (SELECT concept FROM source) AND b.concept IN (SELECT concept FROM target)),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, tgt) AS rank FROM c) WHERE rank <= 10 AND cosine >= 0.1),
 h AS (SELECT k.src, k.tgt, s.label AS l1, t.label AS l2 FROM k JOIN source s ON s.concept = k.src JOIN target t ON t.concept = k.tgt), {B.partial_sql("h")} SELECT DISTINCT src, tgt FROM h JOIN partial USING (l1, l2) WHERE ratio >= 30""")
def hybrid_candidates(spark, sf):
    v = B.vectors(spark, sf)
    return C.hybrid_candidates(B.source(spark, sf).join(v, "concept"), B.target(spark, sf).join(v, "concept"), 10, 30.0, 0.1)


@query()
def embed_labels(spark, sf):
    return embedder.embeddings(B.source(spark, sf))


# --- hierarchy


_TREE = f"WITH RECURSIVE {B.EDGES_SQL}, {B.CLOSURE_SQL}, {B.DEPTH_SQL} "
_REF_PAIRS = f"WITH RECURSIVE {B.EDGES_SQL}, {B.CLOSURE_SQL}, {B.DEPTH_SQL}, {B.REFERENCE_SQL}, p AS (SELECT src AS c1, tgt AS c2 FROM ref) "


@query(_TREE + "SELECT node, anc AS ancestor, hops::INT AS hops FROM closure")
def ancestors(spark, sf):
    return H.ancestors(B.edges(spark, sf))


@query(_TREE + "SELECT node, depth::INT AS depth FROM depth")
def depths(spark, sf):
    return H.depths(B.edges(spark, sf))


@query(f"""WITH RECURSIVE {B.EDGES_SQL}, {B.DEPTH_SQL}, {B.SOURCE_SQL}, {B.TARGET_SQL},
 ms AS (SELECT max(coalesce(depth, 0)) AS m FROM source LEFT JOIN depth ON node = concept), mt AS (SELECT max(coalesce(depth, 0)) AS m FROM target LEFT JOIN depth ON node = concept)
 SELECT node AS concept, depth::INT AS depth, round(CASE WHEN node IN (SELECT concept FROM source) THEN depth / (SELECT m FROM ms) WHEN node IN (SELECT concept FROM target) THEN depth / (SELECT m FROM mt) ELSE 0 END, 6) AS norm_depth FROM depth""")
def norm_depth(spark, sf):
    e = B.edges(spark, sf)
    every = H.nodes(e).select(F.col("node").alias("concept"))
    return H.norm_depths(every, B.source(spark, sf), B.target(spark, sf), H.depths(e)).select("concept", "depth", r6(F.col("norm_depth"), "norm_depth"))


def _ref_pairs(spark, sf) -> DataFrame:
    return B.reference(spark, sf).select(F.col("SrcEntity").alias("c1"), F.col("TgtEntity").alias("c2"))


@query(_REF_PAIRS + """SELECT c1, c2, d1.depth::INT AS d1, d2.depth::INT AS d2, len(list_intersect(a, b))::INT AS shared_ancestors,
 round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS ancestor_jaccard, (SELECT max(depth) FROM depth WHERE node IN (SELECT unnest(list_intersect(a, b))))::INT AS lca_depth,
 round(len(list_intersect(a, b)) / greatest(d1.depth, d2.depth), 6) AS overlap_ratio
 FROM p JOIN (SELECT node, list(anc) AS a FROM closure GROUP BY 1) x ON x.node = c1 JOIN (SELECT node, list(anc) AS b FROM closure GROUP BY 1) y ON y.node = c2
 JOIN depth d1 ON d1.node = c1 JOIN depth d2 ON d2.node = c2""")
def ancestor_features(spark, sf):
    f = H.ancestor_features(_ref_pairs(spark, sf), B.edges(spark, sf))
    return f.select("c1", "c2", "d1", "d2", "shared_ancestors", r6(F.col("ancestor_jaccard"), "ancestor_jaccard"), "lca_depth", r6(F.col("overlap_ratio"), "overlap_ratio"))


@query(f"""WITH RECURSIVE {B.EDGES_SQL}, {B.CLOSURE_SQL} SELECT 'R' || r_regionkey AS c1, n.node AS c2, coalesce(hops::DOUBLE, 'inf'::DOUBLE) AS distance
 FROM region CROSS JOIN (SELECT child AS node FROM edges UNION SELECT parent FROM edges) n LEFT JOIN closure c ON c.node = n.node AND c.anc = 'R' || r_regionkey WHERE n.node <> 'R' || r_regionkey""")
def shortest_path(spark, sf):
    e = B.edges(spark, sf)
    r = t(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("c1"))
    pairs = H.nodes(e).select(F.col("node").alias("c2")).crossJoin(F.broadcast(r)).filter("c1 <> c2")  # a few regions
    return H.shortest_paths(pairs, e)


@query(f"""WITH {B.EDGES_SQL}, {B.REFERENCE_SQL}, pv AS (SELECT 'N' || vec_id AS parent, embedding::DOUBLE[] AS e FROM embeddings)
 SELECT r.src AS c1, r.tgt AS c2, round(coalesce(max({B.cosine_sql("x.e", "y.e")}), 0), 6) AS parent_similarity FROM ref r JOIN edges a ON a.child = r.src JOIN edges b ON b.child = r.tgt
 LEFT JOIN pv x ON x.parent = a.parent LEFT JOIN pv y ON y.parent = b.parent GROUP BY 1, 2""")
def parent_similarity(spark, sf):
    v = t(spark, sf, "embeddings").select(F.concat(F.lit("N"), "vec_id").alias("concept"), "embedding")
    return E.parent_similarity(_ref_pairs(spark, sf), B.edges(spark, sf), v).select("c1", "c2", r6(F.col("parent_similarity"), "parent_similarity"))


@query(f"WITH {B.EDGES_SQL}, {B.REFERENCE_SQL} SELECT src AS c1, tgt AS c2, EXISTS (SELECT 1 FROM edges a JOIN edges b ON a.parent = b.parent WHERE a.child = src AND b.child = tgt)::INT AS sibling_score FROM ref")
def sibling_score(spark, sf):
    up = B.edges(spark, sf).select(F.col("child").alias("concept"), F.col("parent").alias("other"))
    return H.shared_neighbours(_ref_pairs(spark, sf), up, "sibling_score")


@query("""WITH g AS (SELECT 'N' || n_nationkey AS x, 'R' || n_regionkey AS y FROM nation), u AS (SELECT y AS src, x AS dst, 'broader' AS relation, 0 AS k FROM g
 UNION ALL SELECT 'R' || r_regionkey, 'N' || r_regionkey, 'narrower', 1 FROM region UNION ALL SELECT 'R' || r_regionkey, 'R' || (r_regionkey + 1) % 5, 'related', 2 FROM region)
 SELECT src, dst, arg_max(relation, k) AS relation FROM u GROUP BY 1, 2""")
def attributed_graph(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    broader = n.select(name("N", F.col("n_nationkey")).alias("concept"), name("R", F.col("n_regionkey")).alias("other"))
    narrower = r.select(name("R", F.col("r_regionkey")).alias("concept"), name("N", F.col("r_regionkey")).alias("other"))
    related = r.select(name("R", F.col("r_regionkey")).alias("concept"), name("R", (F.col("r_regionkey") + 1) % 5).alias("other"))
    return H.attributed_graph(broader, narrower, related)


@query(f"""WITH {B.EDGES_SQL}, e AS (SELECT parent AS src, child AS dst FROM edges), nn AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)), c AS (SELECT count(*) AS n FROM nn),
 d AS (SELECT DISTINCT ('0x' || substr(md5(concat_ws('#', src, dst, k, 42, 'i')), 1, 8))::BIGINT % n AS i, ('0x' || substr(md5(concat_ws('#', src, dst, k, 42, 'j')), 1, 8))::BIGINT % n AS j FROM e, c, range(8) r(k)),
 f AS (SELECT a.node AS src, b.node AS dst FROM d JOIN nn a ON a.idx = i JOIN nn b ON b.idx = j WHERE i <> j AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.node AND e.dst = b.node) AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = b.node AND e.dst = a.node))
 SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('#', src, dst, 42)), src, dst) AS k FROM f) WHERE k <= (SELECT count(*) FROM e)""")
def negative_edges(spark, sf):
    e = B.edges(spark, sf)
    return H.negative_edges(H.nodes(e), e.select(F.col("parent").alias("src"), F.col("child").alias("dst")))


@query(f"""WITH RECURSIVE {B.EDGES_SQL}, {B.REFERENCE_SQL}, b AS (SELECT child AS u, parent AS v FROM edges UNION SELECT parent, child FROM edges),
 hop AS (SELECT DISTINCT tgt AS t, tgt AS node, 0 AS k FROM pos UNION SELECT t, v, k + 1 FROM hop JOIN b ON u = node WHERE k < 5), y AS (SELECT DISTINCT t, node FROM hop WHERE node <> t)
 SELECT src, tgt, 0 AS label FROM (SELECT *, {_SAMPLED} FROM (SELECT p.src, p.tgt AS true_tgt, y.node AS tgt FROM pos p JOIN y ON y.t = p.tgt)) x {_ANTI}""")
def hop_negatives(spark, sf):
    return C.hop_negatives(B.reference(spark, sf), B.edges(spark, sf))


@query("""WITH e AS (SELECT vec_id // 2 AS a, vec_id AS b FROM embeddings), u AS (SELECT a AS u, b AS v FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b UNION SELECT vec_id, vec_id FROM embeddings),
 d AS (SELECT u, count(*) AS d FROM u GROUP BY 1), x AS (SELECT vec_id AS v, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
 SELECT u.u AS node, pos::INT AS pos, round(sum(x / sqrt(du.d * dv.d)), 5) + 0 AS x FROM u JOIN d du ON du.u = u.u JOIN d dv ON dv.u = u.v JOIN x ON x.v = u.v GROUP BY 1, 2""")
def gcn_propagate(spark, sf):
    e = t(spark, sf, "embeddings")
    edges = e.select(F.expr("vec_id div 2").alias("src"), F.col("vec_id").alias("dst"))
    v = H.propagate(e.select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vector")), edges)
    return v.select("node", F.posexplode("vector").alias("pos", "x")).select("node", (F.col("pos") + 1).alias("pos"), (F.round("x", 5) + 0).alias("x"))


# --- features


_FEATURES = _LABELED + f""", {B.VECTORS_SQL}, {B.DEPTH_SQL}, lab AS (SELECT concept, {B.norm_sql("label")} AS l FROM source UNION ALL SELECT concept, {B.norm_sql("label")} FROM target),
 tok AS (SELECT concept, l, {B.tokens_sql("l")} AS t FROM lab), a AS (SELECT node, list(anc) AS a FROM closure GROUP BY 1),
 f AS (SELECT q.src, q.tgt, q.label, x.l AS l1, y.l AS l2, x.t AS t1, y.t AS t2, len(list_intersect(x.t, y.t)) AS n, u.embedding AS e1, v.embedding AS e2, g.depth AS d1, h.depth AS d2, i.a AS a1, j.a AS a2
 FROM labeled q JOIN vec u ON u.concept = q.src JOIN vec v ON v.concept = q.tgt JOIN tok x ON x.concept = q.src JOIN tok y ON y.concept = q.tgt
 JOIN depth g ON g.node = q.src JOIN depth h ON h.node = q.tgt JOIN a i ON i.node = q.src JOIN a j ON j.node = q.tgt),
 m AS (SELECT (SELECT max(depth) FROM depth WHERE node IN (SELECT concept FROM source)) AS s, (SELECT max(depth) FROM depth WHERE node IN (SELECT concept FROM target)) AS t), {B.partial_sql("f")} """
_ABLATED = f"""(l1 = l2)::INT AS exact_match, round(n / (len(t1) + len(t2) - n), 6) AS jaccard, round({B.cosine_sql("e1", "e2")}, 6) AS cosine, levenshtein(l1, l2)::INT AS levenshtein, round(ratio / 100, 6) AS partial_match,
 abs(d1 - d2)::INT AS depth_diff, round(abs(d1 / m.s - d2 / m.t), 6) AS norm_depth_diff, round(len(list_intersect(a1, a2)) / len(list_distinct(a1 || a2)), 6) AS ancestor_jaccard, label FROM f JOIN partial USING (l1, l2), m"""


def _features(spark, sf, seed: int = 42, **options) -> DataFrame:
    s, g = B.source(spark, sf), B.target(spark, sf)
    return E.pair_features(_labeled(spark, sf, seed), s, g, C.merge_labels(s, g), B.vectors(spark, sf), B.edges(spark, sf), **options)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(F.col(c), c) if k == "double" else F.col(c) for c, k in df.dtypes))


@query(_FEATURES + "SELECT src, tgt, n::INT AS shared_tokens, round(n / len(t1), 6) AS token_ratio_c1, round(n / len(t2), 6) AS token_ratio_c2, " + _ABLATED)
def features_main(spark, sf):
    return _rounded(_features(spark, sf))


@query(_FEATURES + "SELECT src, tgt, " + _ABLATED)
def features_ablation(spark, sf):
    return _rounded(_features(spark, sf, ablation=True))


@query()
def features_taxonomy(spark, sf):
    n = t(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("concept"), F.array("n_name").alias("labels"))
    ordinals = n.select("concept").withColumn("ordinal", F.row_number().over(Window.orderBy("concept")) - 1)  # the nations
    v = t(spark, sf, "embeddings").select(F.concat(F.lit("N"), "vec_id").alias("concept"), "embedding")
    xref = t(spark, sf, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("concept"), F.col("s_suppkey").cast("string").alias("other"))
    return E.taxonomy_features(E.ordinal_pairs(ordinals), n, v, B.edges(spark, sf), xref)


@query("SELECT a.n_name AS c1, b.n_name AS c2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def all_pairs_theta(spark, sf):
    return E.ordinal_pairs(t(spark, sf, "nation").select(F.col("n_name").alias("concept"), F.col("n_nationkey").alias("ordinal")))


@query("SELECT a.n_name AS c1, b.n_name AS c2, (a.n_regionkey = 1)::INT AS label FROM nation a JOIN nation b ON a.n_name <> b.n_name")
def ordered_pairs(spark, sf):
    return L.ordered_pairs(t(spark, sf, "nation").select(F.col("n_name").alias("concept"), "n_regionkey"), "n_regionkey")


# --- reports and models


_REPORT = """WITH q AS (SELECT {by} AS run, quality AS y, 1 - toxic AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT DISTINCT run, unnest([y, p]) AS c FROM q),
 k AS (SELECT c.run, c, sum((y = c AND p = c)::INT)::DOUBLE AS tp, sum((p = c)::INT)::DOUBLE AS np, sum((y = c)::INT)::DOUBLE AS support FROM c JOIN q ON q.run = c.run GROUP BY 1, 2),
 e AS (SELECT run, c::VARCHAR AS label, tp, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re, support FROM k),
 f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM e),
 w AS (SELECT run, label, pr, re, f1, support FROM f UNION ALL SELECT run, 'macro avg', avg(pr), avg(re), avg(f1), sum(support) FROM f GROUP BY 1
 UNION ALL SELECT run, 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f GROUP BY 1),
 l AS (SELECT run, label, 'precision' AS metric, pr AS value FROM w UNION ALL SELECT run, label, 'recall', re FROM w UNION ALL SELECT run, label, 'f1-score', f1 FROM w UNION ALL SELECT run, label, 'support', support FROM w
 UNION ALL SELECT run, 'accuracy', 'accuracy', sum(tp) / sum(support) FROM f GROUP BY 1) """


def _predictions(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", "lang")
    return t(spark, sf, "labels").join(d, "doc_id").select(F.col("lang").alias("run"), F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))


@query(_REPORT.format(by="0") + "SELECT label, metric, round(value, 6) AS value FROM l")
def classification_report(spark, sf):
    return R.classification_report(_predictions(spark, sf)).select("label", "metric", r6(F.col("value"), "value"))


@query(_REPORT.format(by="lang") + "SELECT label, metric, round(avg(value), 6) AS value FROM l GROUP BY 1, 2")
def seed_average(spark, sf):
    return R.mean_report(R.classification_report(_predictions(spark, sf), ("run",))).select("label", "metric", r6(F.col("value"), "value"))


@query("""WITH q AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM q GROUP BY 1),
 b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b""")
def roc_auc(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return R.roc_auc(t(spark, sf, "labels").join(d, "doc_id").select(F.col("quality").alias("label"), "score")).select(r6(F.col("auc"), "auc"))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0 AS corr FROM lineitem" for a in _NUMERIC for b in _NUMERIC))
def correlation(spark, sf):
    return R.correlations(t(spark, sf, "lineitem"), _NUMERIC).select("a", "b", (F.round("corr", 6) + 0).alias("corr"))


@query("SELECT DISTINCT quality AS label, round(sum(1) OVER () / (2 * sum(1) OVER (PARTITION BY quality)), 6) AS weight FROM labels")
def class_weights(spark, sf):
    return L.class_weights(t(spark, sf, "labels"), "quality").select(F.col("quality").alias("label"), r6(F.col("weight"), "weight")).distinct()


@query("""SELECT l_orderkey, l_linenumber, round((l_discount * 10 + 2 * (l_tax * 10) + l_quantity / 50) / 4, 6) AS score, (round((l_discount * 10 + 2 * (l_tax * 10) + l_quantity / 50) / 4, 9) > 0.5)::INT AS prediction FROM lineitem""")
def soft_vote(spark, sf):
    score, _ = L.soft_vote([F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50], (1, 2, 1))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(score, "score"), (F.round(score, 9) > 0.5).cast("int").alias("prediction"))


def _splits(spark, sf, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The seed draws the negatives; a pair is on the same side for every seed."""
    from ..operators.storage import written

    return L.hash_split(written(_features(spark, sf, seed), "features"), "src", "tgt")


FEATURES = ["shared_tokens", "token_ratio_c1", "token_ratio_c2", "exact_match", "jaccard", "cosine", "levenshtein", "partial_match", "depth_diff", "norm_depth_diff", "ancestor_jaccard"]


@query()
def ensemble_sweep(spark, sf):
    return L.sweep([(seed, *_splits(spark, sf, seed)) for seed in L.SEEDS], FEATURES, L.WEIGHTS)


@query()
def mlp(spark, sf):
    train, test = _splits(spark, sf)
    return L.fit_mlp(train, FEATURES).transform(test).select("src", "tgt", "label", F.col("prediction").cast("int").alias("prediction"))


@query()
def link_prediction(spark, sf):
    e = t(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").cast("string").alias("node"), F.col("embedding").cast("array<double>").alias("vector"))
    edges = e.select(F.expr("vec_id div 2").cast("string").alias("src"), F.col("vec_id").cast("string").alias("dst")).filter("src <> dst")
    every = edges.withColumn("label", F.lit(1)).unionByName(H.negative_edges(v.select("node"), edges).withColumn("label", F.lit(0)))
    train, test = L.hash_split(every, "src", "dst")
    return L.link_scores(v, edges, train, test)


def _items(spark, sf) -> DataFrame:
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


_STOPS = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
_TFIDF = f"""WITH w AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark), tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term NOT IN ({_STOPS}) GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
 x AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM r) """


@query(_TFIDF + "SELECT id, term, round(weight, 6) AS weight FROM x")
def tfidf(spark, sf):
    return L.tf_idf(_items(spark, sf)).select("id", "term", r6(F.col("weight"), "weight"))


@query(_TFIDF + """, c AS (SELECT item_id AS id, length(text) // 100 AS cluster FROM benchmark), s AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1),
 m AS (SELECT cluster::INT AS cluster, term, round(sum(weight) / any_value(n), 6) AS mean_weight FROM x JOIN c USING (id) JOIN s USING (cluster) GROUP BY 1, 2)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean_weight DESC, term)::INT AS rank FROM m) WHERE rank <= 10""")
def cluster_top_terms(spark, sf):
    items = _items(spark, sf)
    return L.top_terms(L.tf_idf(items), items.select("id", F.floor(F.length("text") / 100).cast("int").alias("cluster")))


@query()
def kmeans(spark, sf):
    items = _items(spark, sf)
    return L.cluster(L.tf_idf(items), ids=items)[0]


@query("""WITH d AS (SELECT a.vec_id AS i, a.label AS ci, b.label AS cj, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
 p AS (SELECT i, max(d) FILTER (ci = cj) AS own, min(d) FILTER (ci <> cj) AS other FROM d GROUP BY 1) SELECT round(avg(coalesce((other - own) / greatest(own, other), 0)), 6) AS silhouette FROM p""")
def silhouette(spark, sf):
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vector"))
    return L.silhouette(v).select(r6(F.col("silhouette"), "silhouette"))


@query()
def pca_points(spark, sf):
    return L.project_2d(t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


# --- label transformations


_GREEK_TERMS = ["α-synuclein", "TGF-β1", "Ω-3 ς σ", "plain", "ΨΥ"]


def _nested(x: str) -> str:
    for c, name in N.GREEK.items():
        x = f"replace({x}, '{c}', '{name}')"
    return x


@query(f"SELECT term, {_nested('term')} AS transformed FROM (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in _GREEK_TERMS)}) v(term)")
def greek(spark, sf):
    df = spark.createDataFrame([(w,) for w in _GREEK_TERMS], "term string")
    return N.normalize_terms(df, ["greekchars"]).select("term", "transformed")


def _transformed(spark, sf, name: str, key: str, col: str, *ops: str, **options) -> DataFrame:
    df = t(spark, sf, name).select(F.col(key), F.col(col).alias("term"))
    return N.normalize_terms(df, list(ops), **options).select(key, F.md5("transformed").alias("transformed"))


@query("SELECT doc_id, md5(translate(text, '−–—“”‘’', '---\"\"''''')) AS transformed FROM documents")
def typographic(spark, sf):
    return _transformed(spark, sf, "documents", "doc_id", "text", "typographicforms")


@query(r"SELECT doc_id, md5(regexp_replace(text, '\s*?\(.*?\)\s*?', '', 'g')) AS transformed FROM documents")
def qualifiers(spark, sf):
    return _transformed(spark, sf, "documents", "doc_id", "text", "removequalifiers")


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '^\s+|\s+$', '', 'g'), '\s{2,}', ' ', 'g')) AS transformed FROM pages")
def whitespace(spark, sf):
    return _transformed(spark, sf, "pages", "page_id", "html", "trimwhitespaces")


@query("SELECT page_id, md5(regexp_replace(html, '" + N.PUNCTUATION.replace("'", "''") + "', '', 'g')) AS transformed FROM pages")
def punctuation(spark, sf):
    return _transformed(spark, sf, "pages", "page_id", "html", "removepunctuation")


@query(r"SELECT item_id, md5(array_to_string(list_reverse(string_split_regex(text, '\s?,\s?')), ' ')) AS transformed FROM benchmark")
def word_order(spark, sf):
    return _transformed(spark, sf, "benchmark", "item_id", "text", "naturalwordorder")


@query("SELECT doc_id, md5(replace(strip_accents(text), 'ß', 'ss')) AS transformed FROM documents")
def accents(spark, sf):
    return _transformed(spark, sf, "documents", "doc_id", "text", "replaceaccents")


@query("""SELECT item_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '−–—“”‘’', '---""'''''), '^\\s+|\\s+$', '', 'g'), '\\s{2,}', ' ', 'g'), '\\s*?\\(.*?\\)\\s*?', '', 'g'), '""" + N.PUNCTUATION.replace("'", "''") + "', '', 'g')) AS transformed FROM benchmark")
def normalize_pipeline(spark, sf):
    return _transformed(spark, sf, "benchmark", "item_id", "text", "removepunctuation", "TypographicForms", "trimwhitespaces", "removequalifiers")


@query()
def stem(spark, sf):
    return _transformed(spark, sf, "part", "p_partkey", "p_name", "stem")


@query()
def lemmatize(spark, sf):
    return _transformed(spark, sf, "part", "p_partkey", "p_name", "lemmatize")


@query()
def tokenize(spark, sf):
    df = t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("term"))
    return N.normalize_terms(df, ["tokenize", "trimwhitespaces"]).select("conv_id", "turn", "tokens")


def _terms(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = t(spark, sf, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("concept_uri"), F.concat(F.lit("l:"), "c_custkey").alias("source_uri"), F.col("c_name").alias("source_term"), F.regexp_replace("c_name", "Customer", "Supplier").alias("transformed_term"), F.lit("en").alias("language_tag"))
    return c, t(spark, sf, "supplier").select(F.col("s_name").alias("term"), F.lit("en").alias("language_tag"))


@query("SELECT 'c:' || c_custkey AS concept_uri, replace(c_name, 'Customer', 'Supplier') AS transformed_term FROM customer WHERE replace(c_name, 'Customer', 'Supplier') NOT IN (SELECT s_name FROM supplier)")
def anti_existing_terms(spark, sf):
    return files.new_terms(*_terms(spark, sf)).select("concept_uri", "transformed_term")


@query("""WITH n AS (SELECT 'c:' || c_custkey AS c, replace(c_name, 'Customer', 'Supplier') AS t, 'label:' || substr(sha1(concat_ws('|', 'label', 'c:' || c_custkey, 'l:' || c_custkey, c_name, replace(c_name, 'Customer', 'Supplier'), 'en')), 1, 30) AS u FROM customer
 WHERE replace(c_name, 'Customer', 'Supplier') NOT IN (SELECT s_name FROM supplier))
 SELECT u AS label_uri, c AS concept_uri, t AS literal_form, 'en' AS language_tag, 'editor:1' AS editor, '"2024-01-01"' AS created,
 u || ' skosxl:literalForm "' || t || '"@en; a skosxl:Label ; pav:createdOn "2024-01-01" ; pav:lastUpdatedOn "2024-01-01" ; pav:createdBy editor:1 ; pav:curatedBy editor:1 . ' || c || ' skosxl:altLabel ' || u || ' .' AS turtle FROM n""")
def provenance(spark, sf):
    return files.provenance(*_terms(spark, sf), ["greekchars"], "editor:1", '"2024-01-01"')[0]


@query("""WITH o AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS k, n_regionkey FROM nation)
 SELECT n_name AS concept, n_regionkey::VARCHAR AS label FROM o UNION ALL SELECT n_name || '2', n_regionkey::VARCHAR FROM o WHERE k % 3 = 0""")
def taxonomy_clone(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_name").alias("concept"), F.col("n_regionkey").cast("string").alias("label"))
    empty = spark.createDataFrame([], "concept string, relation string, other string")
    return rdf.taxonomy_clones(n, n, empty)[0]


# --- files read and written


_OWL = (
    '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:o="http://www.geneontology.org/formats/oboInOwl#">'
    '<owl:Class rdf:about="N%d"><rdfs:label>%s</rdfs:label><rdfs:subClassOf rdf:resource="R%d"/><o:hasExactSynonym> Synonym %d </o:hasExactSynonym></owl:Class></rdf:RDF>'
)


def _triples(spark, sf) -> DataFrame:
    """Every nation as an ontology document."""
    return rdf.triples_of(t(spark, sf, "nation").select(F.col("n_name").alias("path"), F.format_string(_OWL, "n_nationkey", "n_name", "n_regionkey", "n_nationkey").alias("content")))


@query("SELECT 'N' || n_nationkey AS concept, lower(n_name) || '|synonym ' || n_nationkey AS labels FROM nation")
def rdf_labels(spark, sf):
    return rdf.labels(_triples(spark, sf)).select("concept", F.array_join("labels", "|").alias("labels"))


@query("SELECT 'N' || n_nationkey AS child, 'broader' AS predicate, 'R' || n_regionkey AS parent FROM nation")
def rdf_hierarchy(spark, sf):
    return rdf.hierarchy(_triples(spark, sf))


def _tables(spark, sf) -> DataFrame:
    """The report of _predictions, written as LaTeX."""
    report = R.report_dict(R.classification_report(_predictions(spark, sf)))
    return R.parse_tables(spark.createDataFrame([("report", R.latex_table(report, "max negatives = 2, cosine similarity > 0.3"))], "path string, value string"))


@query(_REPORT.format(by="0") + """SELECT 2 AS max_negatives, 0.3::DOUBLE AS cosine_similarity, replace(label, 'macro avg', 'macro-avg') AS label, round(pr, 2) AS precision, round(re, 2) AS recall, round(f1, 2) AS f1_score, support FROM w
 UNION ALL SELECT 2, 0.3, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 2), sum(support) FROM f""")
def report_parse(spark, sf):
    return _tables(spark, sf).select("max_negatives", "cosine_similarity", F.inline("rows"))


_CELLS = """, r AS (SELECT replace(label, 'macro avg', 'macro-avg') AS label, round(pr, 2) AS precision, round(re, 2) AS recall, round(f1, 2) AS f1_score, support FROM w
 UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 2), sum(support) FROM f),
 cells AS (SELECT label, 'precision' AS metric, precision AS value, support FROM r UNION ALL SELECT label, 'recall', recall, support FROM r UNION ALL SELECT label, 'f1_score', f1_score, support FROM r) """


@query(_REPORT.format(by="0") + _CELLS + "SELECT label, metric, value, round(value / max(value) OVER (PARTITION BY metric), 6) AS share, support / 2 AS size FROM cells")
def report_metrics(spark, sf):
    return R.long_metrics(_tables(spark, sf)).select("label", "metric", "value", r6(F.col("share"), "share"), "size")


@query(_REPORT.format(by="0") + _CELLS + "SELECT 0.3::DOUBLE AS cosine, f1_score AS metric, support, 300.0::DOUBLE AS size FROM r WHERE label = 'macro-avg'")
def report_points(spark, sf):
    return R.metric_points(_tables(spark, sf)).select("cosine", "metric", "support", "size")


@query(_REPORT.format(by="0") + _CELLS + "SELECT precision, recall, f1_score, support, 1.0::DOUBLE AS share FROM r WHERE label = 'weighted avg'")
def report_last_tables(spark, sf):
    return R.last_tables(_tables(spark, sf), "weighted avg").select("precision", "recall", "f1_score", "support", "share")


@query(_REPORT.format(by="0") + _CELLS + "SELECT 0.3::DOUBLE AS cosine_similarity, precision, recall, f1_score, support FROM r WHERE label = '1'")
def report_sampled_tables(spark, sf):
    return R.sampled_tables(_tables(spark, sf), "1").select("cosine_similarity", "precision", "recall", "f1_score", "support")


@query("SELECT o_orderkey, CAST('0x' || substr(md5(concat_ws('#', o_orderkey, 42)), 1, 8) AS BIGINT) % 100 < 80 AS train FROM orders")
def train_test_split(spark, sf):
    train, test = L.hash_split(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))


# --- rows, vectors and orders


@query(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, {k} AS pos, {c} AS x FROM lineitem" for k, c in enumerate(_NUMERIC)))
def row_vectors(spark, sf):
    return L.row_vector(t(spark, sf, "lineitem"), _NUMERIC).select("l_orderkey", "l_linenumber", F.posexplode("vector").alias("pos", "x"))


@query("""WITH v AS (SELECT 'N' || vec_id AS c, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.c AS c1, b.c AS c2, (n.n_regionkey = 1)::INT AS label, len(a.e || b.e) AS size, round(list_sum(a.e), 4) AS left_sum, round(list_sum(b.e), 4) AS right_sum
 FROM v a JOIN v b ON a.c <> b.c JOIN nation n ON 'N' || n.n_nationkey = a.c JOIN nation o ON 'N' || o.n_nationkey = b.c""")
def pair_vectors(spark, sf):
    n = t(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("concept"), "n_regionkey")
    v = t(spark, sf, "embeddings").select(F.concat(F.lit("N"), "vec_id").alias("concept"), F.col("embedding").alias("vector"))
    x = L.pair_vectors(L.ordered_pairs(n, "n_regionkey"), v)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, y: s + y), 4)
    half = (F.size("vector") / 2).cast("int")
    return x.select("c1", "c2", "label", F.size("vector").cast("long").alias("size"), total(F.slice("vector", F.lit(1), half)).alias("left_sum"), total(F.slice("vector", half + 1, half)).alias("right_sum"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('#', o_orderkey, 42)), o_orderkey) AS position FROM orders")
def shuffle(spark, sf):
    return storage.shuffled(t(spark, sf, "orders").select("o_orderkey"), 42, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def head(spark, sf):
    return storage.first_rows(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 5, "o_orderkey")


# --- tables through files


@query(f"WITH {B.REFERENCE_SQL} SELECT src AS \"SrcEntity\", tgt AS \"TgtEntity\", score::DOUBLE AS \"Score\", (score = 1)::INT AS \"Label\" FROM ref")
def alignment_file(spark, sf):
    path = f"{storage.shared_folder(spark)}/alignment"
    B.reference(spark, sf).write.option("sep", "\t").option("header", True).csv(path)
    return files.read_alignment(spark, path)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_file(spark, sf):
    path = f"{storage.shared_folder(spark)}/csv"
    files.write_csv(t(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return files.read_csv(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@query("SELECT md5(n_name || chr(10)) AS content FROM nation")
def text_files(spark, sf):
    path = f"{storage.shared_folder(spark)}/texts"
    t(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1).write.partitionBy("n_nationkey").text(path)
    return files.read_texts(spark, path).select(F.md5("value").alias("content"))


def _owl_files(spark, sf) -> str:
    """A folder with an RDF/XML file for each nation."""
    path = f"{storage.shared_folder(spark)}/owl"
    t(spark, sf, "nation").select("n_nationkey", F.format_string(_OWL, "n_nationkey", "n_name", "n_regionkey", "n_nationkey").alias("value")).coalesce(1).write.partitionBy("n_nationkey").text(path)
    return path


@query("SELECT 'N' || n_nationkey AS concept, lower(n_name) || '|synonym ' || n_nationkey AS labels, 'R' || n_regionkey AS parent FROM nation")
def rdf_files(spark, sf):
    x = rdf.read_rdf_xml(spark, _owl_files(spark, sf))
    return rdf.labels(x).select("concept", F.array_join("labels", "|").alias("labels")).join(rdf.hierarchy(x).select(F.col("child").alias("concept"), "parent"), "concept")


@query("""SELECT '<N' || n_nationkey || '> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <R' || n_regionkey || '> .' AS line FROM nation
 UNION ALL SELECT '<N' || n_nationkey || '> <http://www.w3.org/2000/01/rdf-schema#label> "' || n_name || '" .' FROM nation""")
def graph_file(spark, sf):
    path = f"{storage.shared_folder(spark)}/graph"
    x = _triples(spark, sf)
    files.write_graph(x.filter(F.col("p").isin(rdf.iri.SUBCLASS, rdf.iri.LABEL)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT 'N' || n_nationkey AS s, min(n_name) AS o FROM nation GROUP BY 1")
def triple_value(spark, sf):
    return rdf.value(_triples(spark, sf), rdf.iri.LABEL)


@query(f"WITH {B.EDGES_SQL} SELECT (SELECT count(*) FROM (SELECT child FROM edges UNION SELECT parent FROM edges))::BIGINT AS nodes, (SELECT count(*) FROM edges)::BIGINT AS edges")
def graph_counts(spark, sf):
    e = B.edges(spark, sf)
    return H.nodes(e).agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.distinct().agg(F.count(F.lit(1)).alias("edges")))  # one row each
