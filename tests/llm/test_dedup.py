import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.llm import common, exact_dedup, near_dedup


def _groups(rows):
    out = {}
    for d, t in rows:
        out.setdefault(t or "", []).append(d)
    return out


def test_op8(spark, docs, empty):
    got = {r.doc_id: r for r in exact_dedup.dedup(docs).collect()}
    groups = _groups([(r.doc_id, r.text) for r in docs.collect()])
    for t, ids in groups.items():
        for d in ids:
            assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == (max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.dedup(empty).count() == 0


def test_hot_digests_and_repeated_ids(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.dedup(df.unionByName(df.filter("doc_id = 0")))
    assert got.count() == 3001 and got.filter("kept").count() == 2001
    assert got.filter("keep_id = 2997").count() == got.filter("keep_id = 2997").first()["group_size"] == 1001
    null = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.keep_id or 0, r.kept) for r in exact_dedup.dedup(null).collect()) == [(0, True), (1, False), (1, True)]


def test_three_batches_against_brute_force(spark):
    """Every column after each batch: later copies raise the size and take the place of smaller ids."""
    index = exact_dedup.DigestIndex(spark, "index_of_test", buckets=3)
    seen = []
    try:
        for batch in ([(1, "x"), (2, "x"), (3, "y"), (4, None)], [(9, "x"), (10, "z"), (11, "z"), (0, ""), (5, "new")], [(6, "x"), (12, "y"), (None, "y"), (20, "only")]):
            seen += batch
            got = exact_dedup.dedup(spark.createDataFrame(batch, "doc_id long, text string"), index).collect()
            want = []
            for d, t in batch:
                ids = [i for i, u in seen if (u or "") == (t or "")]
                keep = max((i for i in ids if i is not None), default=None)
                want.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
            assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
        assert index.known().count() == index.known().distinct().count() == index.read().count() == len({t or "" for _, t in seen})
    finally:
        index.drop()


def test_the_query_ingests_by_anti_join(spark, docs, monkeypatch):
    """All batches meet the index by a sort-merge anti-join that doesn't shuffle the index, and no table is left."""
    plans, append = [], exact_dedup.DigestIndex.append

    def spy(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        append(self, rows)

    monkeypatch.setattr(exact_dedup.DigestIndex, "append", spy)
    exact_dedup.dedup(docs)
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert len(joins) == exact_dedup.BATCHES and all("LeftAnti" in p and "Bucketed: true" in p for p in joins)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def brute(texts, size, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for d, t in texts.items():
        w = [x for x in (t or "").translate(low).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_op5_on_awkward_rows(spark, docs, empty, size):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.dedup(docs, size).collect()}
    assert got == brute({r.doc_id: r.text for r in docs.collect()}, size, 80)
    assert near_dedup.dedup(empty).count() == 0


def test_op5_against_all_pairs(spark):
    """A dense region of edited copies, chains, short texts and texts that share a passage."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = {}
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(300, 320):
        chain = chain[3:] + [f"c{rng.randrange(10**6)}" for _ in range(3)]
        texts[i] = "\n".join(chain)
    for i in range(400, 520):
        texts[i] = " ".join([rng.choice(words) for _ in range(40)] + passage)
    texts |= {600 + i: t for i, t in enumerate(["a b", "A B", "a", "a b c d", "a b c d e", "", None, "b a"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.dedup(df, 4, 80).collect()}
    assert got == brute(texts, 4, 80)


def test_op5_on_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(None, "only here one two three"), (None, "shared by two rows"), (5, "shared by two rows"), (7, long), (7, "another text of seven here"), (8, long + " more"), (9, "another text of seven here"), (9, "another text of seven here"), (None, None)]
    got = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (0, 5, False), (5, 5, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (9, 7, False)]


def test_regions_do_not_depend_on_blocks(spark, monkeypatch):
    """Groups and dense regions of orders that are cut every 128 places are those of the whole orders, and those of a plain search."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for i in range(700):
        w = list(base) if i % 3 else [rng.choice(words) for _ in range(80)]
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    classes = common.materialize(near_dedup.sets(df, 4).withColumnRenamed("doc_id", "id"), "classes")

    def found():
        groups, dense = Counter(), set()
        for r in near_dedup._neighbours(classes).collect():
            if r.region is None:
                groups[tuple(r.ids), r.asking and tuple(r.asking)] += 1
            else:
                dense |= {(r.region, i) for i in r.ids}
        return groups, dense

    whole = found()
    monkeypatch.setattr(near_dedup, "BLOCK", 128)
    assert found() == whole
    # plainly: in each order, the shallowest prefix that a class shares with at most CLOSED classes, itself among them
    want = set()
    rows = [(r.id, bytes(r.sketch), bytes(r.bits) * 2) for r in classes.collect()]
    for t in range(near_dedup.TREES):
        key = {}
        for i, sketch, bits in rows:
            first = (t + 1) * near_dedup.DEPTH
            key[i] = [sketch[4 * k : 4 * k + 4] for k in range(t * near_dedup.DEPTH, first)] + [bits[k : k + 1] for k in range(first, first + near_dedup.TAIL)]
        for i in key:
            for depth in range(near_dedup.FIRST, near_dedup.DEPTH + near_dedup.TAIL + 1):
                near = sorted(j for j in key if key[j][:depth] == key[i][:depth])
                if len(near) <= near_dedup.CLOSED:
                    if len(near) > 1:
                        want.add(tuple(near))
                    break
    assert want <= {ids for ids, _ in whole[0]} and any(len(g) > 2 for g in want) and whole[1]


def test_shingles_ignore_white_space_and_case():
    a = near_dedup.shingles("One two\tTHREE  four\x0bfive", 4)
    assert (a == near_dedup.shingles("one TWO three four five", 4)).all() and len(a) == 2
    assert len(near_dedup.shingles("one two three fo ur", 4)) == 1 and len(near_dedup.shingles("É é", 1)) == 2


def test_components(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for p in e for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dict(tuple(r) for r in near_dedup.components(spark.createDataFrame(e, "a long, b long")).collect())
    assert got == {x: find(x) for p in e if p[0] != p[1] for x in p}


def test_id_filter(spark):
    ids = spark.range(0, 1000, 7)
    got = spark.range(1000).select(F.col("id").alias("doc_id")).filter(common.id_filter(ids))
    assert {r.doc_id for r in got.collect()} == set(range(0, 1000, 7))
