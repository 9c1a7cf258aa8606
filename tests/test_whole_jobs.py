"""Queries do the operators' whole job: no fewer seeds, hops or rows than asked for."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from ontoloom.operators import candidates as C
from ontoloom.operators import hierarchy as H
from ontoloom.operators import learning as L
from ontoloom.operators import storage
from ontoloom.plans import bindings as B
from ontoloom.plans import catalog


def test_ensemble_sweep_takes_all_seeds_weights_and_trees(spark, sf, monkeypatch):
    asked = {}
    monkeypatch.setattr(catalog, "_splits", lambda spark, sf, seed=42: (("train", seed), ("test", seed)))
    monkeypatch.setattr(L, "sweep", lambda splits, features, weights=L.WEIGHTS, trees=100: asked.update(splits=list(splits), weights=tuple(weights), trees=trees))
    catalog.QUERIES["ensemble_sweep"](spark, sf)
    assert asked == {"splits": [(s, ("train", s), ("test", s)) for s in (42, 56, 25, 111, 4)], "weights": L.WEIGHTS, "trees": 100} and len(set(L.WEIGHTS)) == 7


def test_sweep_is_the_mean_over_seeds(spark):
    data = [(k, float(k * 7 % 11), float(k * 5 % 13), int(k * 7 % 11 + k % 3 > 6)) for k in range(60)]
    df = spark.createDataFrame(data, "row int, a double, b double, label int")
    splits = [(42, df.filter("row < 40"), df.filter("row >= 40")), (56, df.filter("row >= 20"), df.filter("row < 20"))]
    report = lambda s: {(r.weights, r.label, r.metric): r.value for r in L.sweep(s, ["a", "b"], ((1, 1, 1), (2, 1, 2)), trees=3).collect()}
    both, one, two = report(splits), report(splits[:1]), report(splits[1:])
    assert len(both) == 2 * 17 and both == pytest.approx({k: (one[k] + two[k]) / 2 for k in both})


def test_deduplicating_stages_decide_on_rows(spark, sf):
    word = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    data = [
        (None, word(1)), (None, word(1)), (None, word(2)), (None, None), (None, ""),  # nulls: one of each text stays
        (7, word(3)), (7, word(3)), (7, word(4)),  # a repeated row, and its id under another text
        (3, word(4) + " end"), (9, word(5)), (None, word(5)), (8, word(5)),  # 7's second text is near to 3's; 9 wins over a null and 8
        (None, word(1) + " end"),  # near to another null's
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows = lambda df: sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    once = cp.common.materialize(cp.exact(spark, docs, sf), "exact")
    want = [(None, word(1)), (None, word(2)), (None, ""), (7, word(3)), (7, word(4)), (3, word(4) + " end"), (9, word(5)), (None, word(1) + " end")]
    assert once.columns == docs.columns and rows(once) == sorted(want, key=str)
    got = rows(cp.near(spark, once, sf))
    assert len(got) == 6 and {(None, word(2)), (None, ""), (7, word(3)), (3, word(4) + " end"), (9, word(5))} < set(got) and len({(None, word(1)), (None, word(1) + " end")} & set(got)) == 1


def test_hop_negatives_reach_beyond_three_hops(spark, sf):
    near = C.hop_negatives(B.reference(spark, sf), B.edges(spark, sf), max_hops=3, n=1 << 30).select("src", "tgt")
    assert catalog.QUERIES["hop_negatives"](spark, sf).select("src", "tgt").exceptAll(near).count() > 0


def test_kmeans_labels_rows_without_terms(spark, monkeypatch):
    texts = ["heart disease", "heart valve", "lung cancer", "lung tumour", "rib bone", "skin rash", None, "", "of the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    monkeypatch.setattr(catalog, "_items", lambda spark, sf: docs)
    got = {r.id: r.cluster for r in catalog.QUERIES["kmeans"](spark, "").collect()}
    assert set(got) == set(range(9)) and len({got[6], got[7], got[8]}) == 1


def test_product_of_cut_groups_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(storage, "CELL", (2, 3))
    a = spark.createDataFrame([(k, None if k == 9 else "xyz"[k % 3 // 2], {"m": k}) for k in range(20)], "a int, key string, more map<string,int>")
    b = spark.createDataFrame([(k, None if k == 8 else "xyz"[k % 5 // 2]) for k in range(40)] + [(1, "x")], "b int, key string")
    rows = lambda df: sorted((r.a, r.b, r.key, r.more["m"]) for r in df.collect())
    assert rows(storage.product(a, b, "key")) == rows(a.join(b, "key")) != []


def test_shared_tokens_are_counted_by_classes(spark, monkeypatch):
    monkeypatch.setattr(storage, "CELL", (2, 3))
    side = lambda p, n, extra: [(f"{p}{k}", [f"{p}{k % 7} n{k}", f"all k{k % 4}"]) for k in range(n)] + extra
    a = side("s", 12, [(None, ["all x"]), ("s1", ["n1 all"]), ("s99", ["n2"]), ("s98", ["nowhere"])])
    b = side("t", 30, [(None, ["n3 x"]), ("t5", ["n5 k1"]), ("t99", ["n2 n4"])])
    want = Counter()
    for s, x in a:
        for t, y in b:
            if n := len(set(" ".join(x).split()) & set(" ".join(y).split())):
                want[s, t] += n
    df = lambda data: spark.createDataFrame(data, "concept string, labels array<string>")
    for often in (0, 2, 5, 1000):
        got = C.shared_token_counts(df(a), df(b), often=often).collect()
        assert len(got) == len(want) and {(r.src, r.tgt): r.shared for r in got} == want


@pytest.mark.parametrize("hops", [1, 2, 3, 5])
def test_hop_negatives_list_no_neighbourhood(spark, monkeypatch, hops):
    edges = [(f"c{k}", f"n{k % 3}") for k in range(90)] + [(f"n{k}", "root") for k in range(3)] + [("c0", "m"), ("m", "end"), ("c1", "c1"), (None, "n1"), ("c2", None)]
    near: dict = {}
    for a, b in edges:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ref = [(f"s{k}", f"c{k}", 1.0 if k % 4 else 0.5) for k in range(90)] + [("s1", "c4", 0.5), ("s5", "gone", 1.0)]
    want = set()
    for s, t, score in ref:
        if score == 1:
            ball = {t}
            for _ in range(hops):
                ball |= {y for x in ball for y in near.get(x, ())}
            want |= {(s, x) for x in ball - {t}} - {(s, x) for r, x, _ in ref if r == s}
    sizes = []
    written = C.written
    monkeypatch.setattr(C, "written", lambda df, tag: (out := written(df, tag), sizes.append(out.count()))[0])
    e, r = spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame(ref, "SrcEntity string, TgtEntity string, Score double")
    got = [(x.src, x.tgt) for x in C.hop_negatives(r, e, hops, 1 << 30).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sizes.clear()
    few = [(x.src, x.tgt) for x in C.hop_negatives(r, e, hops, 2).collect()]
    assert set(few) <= want and max(sizes) < 1500  # 67 positives with up to 95 concepts each


def test_labels_of_a_product_need_no_shuffle_of_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(storage, "CELL", (2, 3))
    a = spark.createDataFrame([(None if k == 5 else f"a{k}", k % 2) for k in range(12)] + [("a1", 1)], "src string, key int")
    b = spark.createDataFrame([(None if k == 6 else f"b{k}", None if k == 7 else k % 2) for k in range(10)], "tgt string, key int")
    m = spark.createDataFrame([("a1", "b3", 1), ("b2", "a4", 1), ("a2", "b3", 1), ("a1", "b9", 1), ("b9", "a1", 1), (None, "a1", 1)], "src string, tgt string, label int")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(C.labelled_product(a, b, "key", m)) == rows(C.label_pairs(a.join(b, "key").select("src", "tgt"), m))
    assert "k1" not in catalog.QUERIES["label_unordered_pairs"](spark, sf)._jdf.queryExecution().toString()


def test_siblings_are_distinct_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(storage, "CELL", (2, 3))
    edges = [(f"c{k}", f"n{k % 3}") for k in range(20)] + [(f"c{k}", f"m{k % 2}") for k in range(20)] + [("c3", "c9"), ("n0", "m1"), ("c1", None), (None, "n1")] + [("c5", f"p{k}") for k in range(40)] + [("c6", "p7")]
    above: dict = {}
    for _ in range(4):
        for a, b in edges:
            if a and b:
                above.setdefault(a, set()).update({b} | above.get(b, set()))
    up = lambda x: {b for a, b in edges if a == x and b}
    want = {(c, s) for c in ("c0", "c3", "c5") for s in above if s != c and up(c) & up(s)}
    e, c = spark.createDataFrame(edges * 2, "child string, parent string"), spark.createDataFrame([(x,) for x in ("c0", "c3", "c5", "c3", "zz", None)], "concept string")
    for drop, expected in ((False, want), (True, {(c, s) for c, s in want if s not in above[c]})):
        df = H.siblings(c, e, drop)
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
        assert not df._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    assert len(want) > len(expected)
