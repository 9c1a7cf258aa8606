import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoloom.functions import normalizer as N
from ontoloom.functions import text as X
from ontoloom.functions import vectors as V
from ontoloom.functions.stemming import lemma, stem_english, treebank

from .conftest import rows


@pytest.mark.parametrize(
    ("a", "b", "shared", "r1", "r2", "exact", "jaccard", "distance"),
    [("heart disease", "heart disease", 2, 1, 1, 1, 1, 0), ("heart disease", "disease of heart", 2, 1, 2 / 3, 0, 2 / 3, 11), ("kitten", "sitting", 0, 0, 0, 0, 0, 3), ("", "", 0, 0, 0, 1, 0, 0)],
)
def test_lexical_features(spark, a, b, shared, r1, r2, exact, jaccard, distance):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = X.tokens(F.col("a")), X.tokens(F.col("b"))
    got = df.select(X.shared_tokens(x, y), X.token_ratio(x, y), X.token_ratio(y, x), X.exact(F.col("a"), F.col("b")), X.token_jaccard(x, y), F.levenshtein("a", "b")).first()
    assert tuple(got) == pytest.approx((shared, r1, r2, exact, jaccard, distance))


def test_normalize(spark):
    df = spark.createDataFrame([("  Ménière's  Disease ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(X.normalize(F.col("x"))).collect()] == ["m ni re s disease", "", None]
    assert [r[0] for r in df.select(X.normalize_label(F.col("x"))).collect()] == ["ménière's  disease", "", ""]


def _brute_ratio(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    def best(short, long):
        n, m = len(short), len(long)
        return max(200 * lcs(short, w) / (n + len(w)) for k in range(-n + 1, m) if (w := long[max(0, k) : k + n]))

    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(*sorted((a, b), key=len))


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=9), st.text("abc ", max_size=14))
def test_partial_ratio_is_the_best_window(a, b):
    assert X.partial_ratio_of(a, b) == pytest.approx(_brute_ratio(a, b))


def test_partial_ratio_examples():
    assert X.partial_ratio_of("this is a test", "this is a test!") == 100
    assert X.partial_ratio_of("", "") == 100 and X.partial_ratio_of("a", "") == 0
    assert all(X.partial_ratio_of("abcdef"[i:j], "abcdef") == 100 for i, j in itertools.combinations(range(7), 2))


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0, 1, 0, 0])


def _ops(spark, terms, ops, **options):
    return [(r.transformed, r.tokens) for r in N.normalize_terms(spark.createDataFrame([(t,) for t in terms], "term string"), ops, **options).collect()]


def test_normalizer_operations(spark):
    one = lambda t, *ops, **o: _ops(spark, [t], list(ops), **o)[0][0]
    assert one("α-synuclein Ω ς", "greekchars") == "alpha-synuclein Omega sigma"
    assert one("“a” – b—c ‘d’", "typographicforms") == "\"a\" - b-c 'd'"
    assert one("a (b) c (d)", "removequalifiers") == "a c" and one("a (b) c (d)", "removequalifiers", end_only=True) == "a"
    assert one(" a  b\tc ", "trimwhitespaces") == "a b\tc"
    assert one("a.b-c", "removepunctuation") == "abc" and one("a.b", "removepunctuation", replace_with_whitespace=True) == "a b"
    assert one("a, b ,c", "naturalwordorder") == "c b a" and one("a, ,b", "naturalwordorder") == "b  a"
    assert one("Ménière ß", "replaceaccents") == "Meniere ss"
    assert one("Running", "stem") == "run" and one("arteries", "lemmatize") == "artery"
    assert one(None, "stem", "greekchars") is None


def test_tokenize_freezes_the_value(spark):
    [(value, tokens)] = _ops(spark, ["Diseases, of the heart"], ["tokenize", "stem", "trimwhitespaces"])
    assert value == "Diseases, of the heart" and tokens == ["Diseases", ",", "of", "the", "heart"]


def test_normalizer_rejects_unknown_operations(spark):
    df = spark.createDataFrame([("a",)], "term string")
    for bad in (["nothing"], [1]):
        with pytest.raises(ValueError):
            N.normalize_terms(df, bad)


def test_equal_terms_keep_their_rows(spark):
    df = spark.createDataFrame([("u1", "a"), ("u2", "a")], "uri string, term string")
    assert rows(N.normalize_terms(df, ["TrimWhitespaces"]).select("uri", "transformed")) == [("u1", "a"), ("u2", "a")]


def test_stems_of_published_examples():
    for word, stem in {"caresses": "caress", "ponies": "poni", "generalization": "general", "relational": "relat", "hopeful": "hope", "agreed": "agre", "dying": "die", "consistency": "consist", "hoping": "hope"}.items():
        assert stem_english(word) == stem
    assert lemma("boxes") == "box" and lemma("crisis") == "crisis"
    assert treebank("They'll (cannot) wait.") == ["They", "'ll", "(", "can", "not", ")", "wait", "."]
