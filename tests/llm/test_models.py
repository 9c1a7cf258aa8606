import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.llm import decontaminate, language_id, line_crf, queries, secret_scan, toxicity
from ontoloom.llm.boosting import Boosted
from ontoloom.llm.labelled import Isotonic

SF = "/root/testdata/sf0.01"


def _held_out(df, spark, label):
    y = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return [(r.y, r.score, r.predicted) for r in df.filter("held_out").join(y, "doc_id").collect()]


def _auc(rows):
    pos, neg = [s for y, s, _ in rows if y == 1], [s for y, s, _ in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_op2_held_out(spark):
    got = queries.QUERIES["op2_line_crf"](spark, SF)
    assert got.count() == 1000 and _auc(_held_out(got, spark, "quality")) > 0.97


def test_op4_held_out(spark):
    got = queries.QUERIES["op4_toxicity"](spark, SF)
    assert got.count() == 1000 and _auc(_held_out(got, spark, "toxic")) > 0.85


def test_op10_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op10_language_id"](spark, SF).join(d, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_scores_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (9, None, None), (6, 5, 5)], "doc_id long, quality int, toxic int")
    for train, score in ((line_crf.train, line_crf.score), (toxicity.train, toxicity.score)):
        for lab in (labels, labels.filter("false"), labels.filter("doc_id = 1")):
            m = train(docs, lab, F.lit(True))
            got = score(docs, m).collect()
            assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
        assert score(empty, m).count() == 0
    m = line_crf.train(docs, labels, F.lit(True))
    assert set(line_crf.keep(docs, m).columns) == set(docs.columns)
    lang = language_id.train(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, lang).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "en"
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(empty, F.lit(True))).collect()} == {"und"}


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    u, trans = rng.standard_normal(6), rng.standard_normal((2, 2))
    doc = np.array([0, 0, 0, 0, 1, 1])
    p, pair = line_crf.marginals(u, doc, trans)
    for at in (np.arange(4), np.arange(4, 6)):
        weights = {}
        for ys in itertools.product((0, 1), repeat=len(at)):
            weights[ys] = np.exp(sum(u[i] * y for i, y in zip(at, ys, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(ys)))
        z = sum(weights.values())
        for k, i in enumerate(at):
            assert p[i] == pytest.approx(sum(w for ys, w in weights.items() if ys[k]) / z)
    assert pair.sum((1, 2)) == pytest.approx(np.ones(4))


def test_line_features():
    lines = line_crf.featurise(["Good words here.\nThe The The The\nThe The The The\n\nlast", "", "x"])
    assert lines.doc.tolist() == [0, 0, 0, 0, 2] and lines.n_docs == 3
    again, seen = lines.x[:, line_crf._N_CLASSES + 3], lines.x[:, line_crf._N_CLASSES + 6]
    assert again.tolist() == [0, 0.75, 0.75, 0, 0] and seen.tolist() == [0, 0, 1, 0, 0]
    assert line_crf.featurise([""]).n_docs == 1 and len(line_crf.featurise([""]).x) == 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = Boosted(x, y, np.ones(600), trees=60)
    assert (((m.raw(x) > 0) == y).mean()) > 0.95
    iso = Isotonic(m.raw(x), y, np.ones(600))
    grid = iso(np.linspace(-5, 5, 50))
    assert (np.diff(grid) >= 0).all() and 0 <= grid.min() and grid.max() <= 1
    assert Isotonic(np.array([1.0, 2, 3]), np.array([1.0, 0, 1]), np.ones(3)).y.tolist() == [0.5, 1.0]


def test_base_secrets():
    text = "é API_KEY: \"abc123\" token=short access AKIA" + "A1" * 9 + " pw password='x' " + "ab" * 12 + " aB" + "f" * 23
    spans = secret_scan.base_spans(text)
    assert [(k, text[a:b]) for a, b, k in spans] == [("assign", 'API_KEY: "abc123'), ("access", "AKIA" + "A1" * 9), ("hex", "ab" * 12)]
    assert secret_scan.base_spans("token=abcdef0123456789abcdef0123")[0][2] == "assign" and len(secret_scan.base_spans("token=abcdef0123456789abcdef0123")) == 2
    assert secret_scan.base_spans("") == []


def test_inferred_formats_add_spans(spark, docs):
    rng = random.Random(3)
    key = lambda: "tk_" + "".join(rng.choice("ABCDEF0123456789") for _ in range(32))
    rows = [(i, f"say secret = {key()} and the ordinary-word{i} 20240101-120000-77 mail{i}@host.example.com 4111111111111111") for i in range(60)] + [(100, f"lost {key()} here"), (101, "an ordinary-sentence 20240101-120000-77 with 4111111111111111"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    formats = secret_scan.learn(df)
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(df, formats)).collect()}
    assert got[100].n_format == 1 and got[101].n_format == 0 and got[102].spans == "" and got[0].n_assign == 1
    assert got[100].spans == f"format:5:{5 + 35}"
    scanned = secret_scan.scan(docs, secret_scan.learn(docs))
    assert scanned.count() == 9 and secret_scan.scan(docs.filter("false"), formats).count() == 0


def _reached(a):
    seen, todo = {0}, [0]
    while todo:
        for t in a.following[todo.pop()].values():
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return seen


def test_merged_automaton_keeps_beginnings_and_lengths():
    """Random characters fold into a state for each place; fixed beginnings and lengths stay apart."""
    rng = random.Random(8)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes, keys = [draw("0123456789abcdef", 24) for _ in range(150)], ["ghk_" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20) for _ in range(150)]
    a = secret_scan.infer(hexes)
    assert len(_reached(a)) == len(a.counts) < 30  # a state for each length, few more
    both = secret_scan.infer(hexes + keys)
    assert 25 < len(_reached(both)) < 100
    new = draw("0123456789abcdef", 24)
    assert a.fit(new)[0] > -0.3 > a.fit(new[1:])[0] and a.fit(new)[0] > a.fit(new + "0")[0] + 0.1
    assert both.fit("ghk_" + draw("XYZxyz019", 20))[0] > both.fit("gha_" + draw("XYZxyz019", 20))[0] + 0.1
    assert a.fit("zz" * 12, -0.5) == (-math.inf, -math.inf) and a.fit("0" * 500)[0] < -3
    assert all(a.fit(w, a.fit(w)[0]) == a.fit(w) for w in (*hexes[:20], "abc", "zz"))
    assert sum(math.exp(v) for v in a.known[3].values()) < 1


def test_formats_on_planted_credentials(spark):
    """Bare credentials, which the base patterns miss, in formats that are labelled elsewhere: precision and recall of format spans."""
    rng = random.Random(9)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sorts = [lambda: "ghk_" + draw(mixed, 36), lambda: "sk-live-" + draw("abcdefghijklmnopqrstuvwxyz0123456789", 24), lambda: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32)]
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows, planted = [], {}
    for i, (d, t) in enumerate(docs):
        if i % 10 == 0:
            t += f" secret = {sorts[i // 10 % 3]()}"
        elif i % 10 == 1:
            key = sorts[i // 10 % 3]()
            t += f" lost {key} here"
            planted[d] = (len(t) - len(key) - 5, len(t) - 5)
        rows.append((d, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end) for r in secret_scan.scan(df, secret_scan.learn(df)).collect() for s in r.spans if s.kind == "format"}
    want = {(d, a, e) for d, (a, e) in planted.items()}
    print("format spans: precision", len(got & want) / max(1, len(got)), "recall", len(got & want) / len(want), sorted(got - want)[:5])
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def _brute_base(text):
    """Spans of each kind by a walk over the text, character by character."""
    low, word, out = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), []

    def assign(i):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, i):
                j = i + len(name)
                j += text[j : j + 1] in ("'", '"')
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"')
                k = j
                while text[k : k + 1] and text[k] in word:
                    k += 1
                # the optional quote or blanks may also be given up, which never helps: neither is a character of group 2
                if k > j:
                    return k, k - j >= 6
        return None

    def run(chars, begin, least):
        def at(i):
            if not text.startswith(begin, i):
                return None
            j = i + len(begin)
            while text[j : j + 1] and text[j] in chars:
                j += 1
            return (j, j - i >= least) if j > i + len(begin) else None

        return at

    for order, (kind, at) in enumerate((("assign", assign), ("access", run(set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 20)), ("hex", run(set("0123456789abcdef"), "", 24)))):
        i = 0
        while i < len(text):
            m = at(i)
            if m is None:
                i += 1
            else:
                if m[1]:
                    out.append((i, order, m[0], kind))
                i = m[0]
    return [(kind, a, e) for a, _, e, kind in sorted(out)]


def test_op3_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op3_secret_scan"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        base = _brute_base(r.text or "")
        n = Counter(k for k, _, _ in base)
        line = ",".join(f"{k}:{a}:{e}" for k, a, e in base)
        row = got[r.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256) == (n["assign"], n["access"], n["hex"], hashlib.sha256(line.encode()).hexdigest())
        assert [x for x in row.spans.split(",") if x and not x.startswith("format")] == [x for x in line.split(",") if x]


@pytest.mark.parametrize("text", ["token='abcdef'", "TOKEN  =  \"abcdefg\" secret:short", "passwordpassword=abcdef", "api_key=token=abcdef", "secret=a'b token==abcdef", "AKIAAKIA" + "A" * 14, "password: passwd: secretsecret=aaaaaa.", "ſecret=abcdefg ſtoken=abcdefg"])
def test_base_spans_of_awkward_texts(text):
    assert [(k, a, e) for a, e, k in secret_scan.base_spans(text)] == _brute_base(text)


def test_wand_finds_all(spark):
    rng = random.Random(4)
    words = [f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(20_000)]
    index = decontaminate.Index([(i, " ".join(words[i * 40 : i * 40 + rng.randint(3, 40)])) for i in range(400)])
    vocab = sorted(index.terms)
    for _ in range(150):
        terms = sorted({index.terms[w] for w in rng.choices(vocab, k=rng.randint(1, 25))})
        threshold = rng.choice([0.02, 0.1, 0.3])
        scores = Counter()
        for t in terms:
            for o, v in zip(index.ordinals[t], index.impacts[t], strict=True):
                scores[o] += v
        got = dict(index.search(terms, threshold))
        assert set(got) == {o for o, v in scores.items() if v >= threshold}
        assert all(got[o] == pytest.approx(scores[o]) for o in got)


def test_op1(spark, docs, empty):
    items = spark.createDataFrame([(1, "What is the capital of the far land? It is the town of many bridges."), (2, None), (3, ""), (4, "one " * 3 + "long item " * 100)], "item_id long, text string")
    rng = random.Random(1)
    noise = lambda n: " ".join(f"n{rng.randrange(5000)}" for _ in range(n))
    hit = "WHAT is the capital, of the far land?\nIt is the town of many bridges."
    rows = [(1, f"{noise(k)} {hit} {noise(k)}", "c") for k in (0, 13, 31, 200)] + [(2, "What is the capital of the far land? " + noise(40), "c"), (3, noise(300), "c"), (4, None, "c"), (5, "one " * 3 + "long item " * 100, "c")]
    df = spark.createDataFrame([(i, t, c) for i, (_, t, c) in enumerate(rows)], "doc_id long, text string, score string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(df, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (7, 4)}
    assert {r.doc_id for r in decontaminate.clean(df, items).collect()} == {4, 5, 6} and decontaminate.clean(df, items).columns == df.columns
    assert decontaminate.find(docs, items.filter("false")).count() == 0 and decontaminate.find(empty, items).count() == 0


def test_op1_ids_of_any_type(spark):
    """Items and documents are named by strings here; a repeated and a null id are reported too."""
    text = "The old mill by the river grinds corn every single autumn day. Its miller is called Tobias Green."
    items = spark.createDataFrame([("i-1", text), ("i-2", text), (None, "another question about seven distant lakes? the answer names all of them")], "item_id string, text string")
    docs = spark.createDataFrame([("d", f"before {text} after"), ("d", f"before {text} after"), (None, "x another question about seven distant lakes? the answer names all of them y"), ("clean", "nothing")], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.item_id or "") for r in decontaminate.find(docs, items).collect())
    assert got == [("", ""), ("d", "i-1"), ("d", "i-1"), ("d", "i-2"), ("d", "i-2")]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == ["clean"]


def test_op1_shards(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}. eta{i} theta{i}") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}. eta{i} theta{i} y") for i in range(0, 60, 7)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_INDEX_BYTES", 500)
    assert sum(1 for _ in decontaminate.shards(items)) > 2
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()} == {(i, i) for i in range(0, 40, 7)}


def test_op1_against_containment(spark):
    items = {r.item_id: decontaminate.WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = f" {' '.join(decontaminate.WORD.findall(r.text.lower()))} "
        want |= {(r.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in text}
    assert {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontaminate"](spark, SF).collect()} == want
