import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.operators import candidates as C
from ontoloom.operators import features as E
from ontoloom.operators import hierarchy as H
from ontoloom.operators import learning as L

from .conftest import rows

DAG = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "b")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([*DAG, DAG[0]], "child string, parent string")


def _pairs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "c1 string, c2 string")


def test_closure_and_depths(spark, edges):
    got = {}
    for n, a, h in rows(H.ancestors(edges)):
        got.setdefault(n, {})[a] = h
    assert got == {"b": {"a": 1}, "c": {"a": 1}, "d": {"b": 1, "c": 1, "a": 2}, "e": {"d": 1, "b": 1, "a": 2, "c": 2}}
    assert dict(rows(H.depths(edges))) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert set(rows(H.ancestors(edges, spark.createDataFrame([("b",)], "node string")))) == {("b", "a", 1)}


def test_cycles_raise_in_depths_and_end_in_closures(spark):
    for loop in ([("x", "y"), ("y", "x")], [("x", "x")], [("r", "q"), ("x", "y"), ("y", "x")]):
        df = spark.createDataFrame(loop, "child string, parent string")
        with pytest.raises(H.CycleError):
            H.depths(df)
        assert H.ancestors(df).count() > 0


def test_ancestor_features(spark, edges):
    got = {(r.c1, r.c2): r for r in H.ancestor_features(_pairs(spark, ("d", "e"), ("b", "c"), ("a", "zz")), edges).collect()}
    assert got["d", "e"].ancestor_jaccard == 0.75 and got["d", "e"].lca_depth == 1 and got["d", "e"].overlap_ratio == 1
    assert got["b", "c"].shared_ancestors == 1 and got["b", "c"].lca_depth == 0
    assert got["a", "zz"].ancestor_jaccard == 0 and got["a", "zz"].overlap_ratio == 0


def test_paths_and_siblings(spark, edges):
    got = {(r.c1, r.c2): r.distance for r in H.shortest_paths(_pairs(spark, ("a", "e"), ("e", "a"), ("c", "c"), ("a", "zz")), edges).collect()}
    assert got == {("a", "e"): 2, ("e", "a"): math.inf, ("c", "c"): 0, ("a", "zz"): math.inf}
    assert rows(H.siblings(spark.createDataFrame([("d",), ("e",), ("zz",)], "concept string"), edges)) == [("d", "e")]  # d is above e


def test_norm_depths(spark, edges):
    side = lambda *c: spark.createDataFrame([(x,) for x in c], "concept string")
    got = {r.concept: r.norm_depth for r in H.norm_depths(side("b", "e", "d", "a"), side("b", "d"), side("d", "e"), H.depths(edges)).collect()}
    assert got == {"b": 0.5, "d": 1, "e": 1, "a": 0}
    with pytest.raises(ValueError):
        H.max_depth(side("x").filter("false"), H.depths(edges))


def test_negative_edges_are_no_edges(spark, edges):
    e = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")).distinct()
    n = spark.createDataFrame([(f"n{i}",) for i in range(20)], "node string").unionByName(H.nodes(edges))
    got = rows(H.negative_edges(n, e))
    have = {(a, b) for a, b in rows(e)}
    assert len(got) == len(have) and not any((a, b) in have or (b, a) in have or a == b for a, b in got)


def test_propagation_matches_matrices(spark):
    v = {"x": [1.0, 0.0], "y": [0.0, 2.0], "z": [3.0, 1.0]}
    df = spark.createDataFrame(list(v.items()), "node string, vector array<double>")
    got = {r.node: list(r.vector) for r in H.propagate(df, spark.createDataFrame([("x", "y")], "src string, dst string")).collect()}
    a = np.eye(3)
    a[0, 1] = a[1, 0] = 1
    d = np.diag(a.sum(1) ** -0.5)
    want = d @ a @ d @ np.array(list(v.values()))
    assert np.allclose([got[k] for k in v], want)


REF = [("s1", "t1", 1.0), ("s1", "t2", 0.5), ("s2", "t2", 1.0), ("s3", "t9", None)]


def _world(spark):
    ref = spark.createDataFrame(REF, "SrcEntity string, TgtEntity string, Score double")
    source = spark.createDataFrame([("s1", ["red bolt"]), ("s2", ["blue nut"]), ("s3", [])], "concept string, labels array<string>")
    target = spark.createDataFrame([(f"t{i}", [x]) for i, x in enumerate(["red", "Red bolt", "bolt blue", "nut", "zinc"])], "concept string, labels array<string>")
    edges = spark.createDataFrame([(f"t{i}", "p") for i in range(5)] + [("p", "q")], "child string, parent string")
    return ref, source, target, edges


def test_negatives_keep_their_promises(spark):
    ref, source, target, edges = _world(spark)
    idf = rows(C.idf_negatives(ref, source, target, n=50))
    assert idf == [("s1", "t0", 0), ("s2", "t3", 0)]  # s1-t2 is in the reference
    near = rows(C.neighbour_negatives(ref, edges, n=2))
    known = {(a, b) for a, b, _ in REF}
    assert not {(a, b) for a, b, _ in near} & known and all(sum(x[0] == s for x in near) <= 2 for s in ("s1", "s2"))
    assert C.pairs_with_negatives(ref, source, target, edges).count() == 2 + len(idf) + C.neighbour_negatives(ref, edges).count()
    assert rows(C.idf_negatives(ref.filter("false"), source, target)) == []


@pytest.mark.parametrize("n, seed", [(1, 1), (5, 2), (40, 3), (500, 4)])
def test_draw_finds_what_listing_all_members_finds(spark, n, seed):
    """Overlapping groups, one of them with most members; members are more and fewer than n."""
    member_rows = [("hot", f"m{i}") for i in range(300)] + [("mid", f"m{i}") for i in range(290, 330)] + [("one", "x")] + [("hot", "m0")]
    asked_rows = [(f"s{i}", f"m{i}", g, 1) for i in range(60) for g in ("hot", "mid", "one", "none")[i % 3 :]]
    members, asked = spark.createDataFrame(member_rows, "group string, tgt string"), spark.createDataFrame(asked_rows, "src string, true_tgt string, group string, spare int")
    listed = asked.join(members, "group").select("src", "true_tgt", "tgt").distinct().filter("tgt <> true_tgt")
    drawn = C.draw(asked, members, n, seed).filter("tgt <> true_tgt")
    want = rows(C._followers(listed, n, seed).drop("rank"))
    assert rows(C._followers(drawn, n, seed).drop("rank")) == want and drawn.exceptAll(listed).isEmpty()
    assert C.draw(asked.filter("false"), members, n, seed).isEmpty() and C.draw(asked, members.filter("false"), n, seed).isEmpty()


def test_labelling_and_sampling(spark):
    pairs = spark.createDataFrame([("b", "a"), ("a", "c"), ("x", "y"), ("y", "z"), ("z", "w")], "src string, tgt string")
    lab = C.label_pairs(pairs, spark.createDataFrame([("a", "b")], "src string, tgt string"))
    assert rows(lab)[1] == ("b", "a", 1) and sum(r[2] for r in rows(lab)) == 1
    assert [r for r in rows(C.downsampled(lab, 2)) if r[2] == 1] == [("a", "b", 1)] and C.downsampled(lab, 2).count() == 3


def test_topk_cosine_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((40, 5))
    m[3] = 0
    m[7] = m[8]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(99, [float("nan")] * 5), (98, None)], "concept long, embedding array<double>")
    got = rows(C.topk_cosine(df, df, 4, block=16).select("src", "rank", "tgt", "cosine"))
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cos = np.round(u @ u.T, 6)
    want = []
    for i in range(40):
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-cos[i, j], j))[:4]
        want += [(i, k + 1, j, pytest.approx(cos[i, j], abs=1e-9)) for k, j in enumerate(order)]
    assert got == want


def test_features_drop_rows_without_vectors(spark):
    ref, source, target, edges = _world(spark)
    vec = spark.createDataFrame([("s1", [1.0, 0.0]), ("t1", [1.0, 0.0]), ("t2", [float("nan"), 1.0])], "concept string, embedding array<double>")
    pairs = spark.createDataFrame([("s1", "t1", 1), ("s1", "t1", 1), ("s1", "t2", 0), ("s2", "t1", 0)], "src string, tgt string, label int")
    got = E.pair_features(pairs, source, target, C.merge_labels(source, target), vec, edges)
    assert got.count() == 2  # a bag
    r = got.first()
    assert (r.exact_match, r.partial_match, r.jaccard, r.cosine, r.levenshtein) == (1, 1, 1, 1, 0)
    assert set(E.pair_features(pairs, source, target, C.merge_labels(source, target), vec, edges, ablation=True).columns) == set(got.columns) - set(E.ABLATED)


def test_thresholds(spark):
    c = spark.createDataFrame([("a", ["red bolt"], [1.0, 0.0]), ("b", ["red bolts"], [1.0, 0.1]), ("c", ["zinc"], [0.0, 1.0])], "concept string, labels array<string>, embedding array<double>")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("a", "nowhere", 0)], "src string, tgt string, label int")
    assert rows(C.select_pairs(pairs, c, 60, 0.5)) == [("a", "b", 1)]
    assert rows(C.select_pairs(pairs, c, 0, 0.0).select("tgt")) == [("b",), ("c",)]
    assert rows(C.hybrid_candidates(c, c, 1, 60, 0.5)) == [("a", "b"), ("b", "a")]


def test_silhouette_by_blocks_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    data = [(k, k % 4, (rng.normal(size=3) + k % 4).tolist()) for k in range(90)]
    data += [(100 + k, 4, [1e4, 0.1, 0.1]) for k in range(5)] + [(110, 5, [1e4, 0.1, 0.1]), (7, 2, [0.0, 1.0, 2.0])]  # copies, of a lone member too, and an id again
    data += [(120, None, [0.0, 0.0, 0.0]), (121, 1, None), (122, 1, [0.0, None, 1.0]), (None, 1, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "id int, cluster int, vector array<double>")
    whole = [r for r in data if None not in (r[0], r[1], r[2]) and None not in r[2]]
    sums: dict = {}
    for i, ci, u in whole:
        for j, cj, v in whole:
            if i != j:
                sums.setdefault((i, ci, cj), []).append(math.dist(u, v))
    side = lambda i, same: [math.fsum(x) / len(x) for (a, ci, cj), x in sums.items() if a == i and (ci == cj) == same]
    values = []
    for i in {r[0] for r in data} - {None}:
        own, other = max(side(i, True), default=None), min(side(i, False), default=None)
        values.append((other - own) / max(own, other) if own is not None and other is not None and max(own, other) else 0)
    got = L.silhouette(df)
    assert "zip_with" not in got._jdf.queryExecution().toString()  # no row is made for each pair
    assert got.first()[0] == pytest.approx(sum(values) / len(values), abs=1e-12)
