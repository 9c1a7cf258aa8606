import pytest
from pyspark.sql import functions as F

from ontoloom.operators import learning as L
from ontoloom.operators import reports as R
from ontoloom.sources import embedder, files, iri, rdf
from ontoloom.streaming.matching import match_arrivals

from .conftest import rows

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="{rdf}" xmlns:rdfs="{rdfs}" xmlns:owl="{owl}" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#" xml:base="http://x.org/o">
 <owl:Class rdf:about="http://x.org/A"><rdfs:label xml:lang="en">First</rdfs:label><oboInOwl:hasExactSynonym> Syn One </oboInOwl:hasExactSynonym><rdfs:label>Second </rdfs:label></owl:Class>
 <owl:Class rdf:about="http://x.org/B"><rdfs:subClassOf rdf:resource="http://x.org/A"/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#p"/></owl:Restriction></rdfs:subClassOf><oboInOwl:hasExactSynonym>only synonym</oboInOwl:hasExactSynonym></owl:Class>
 <rdf:Description rdf:about="#C"><rdf:type rdf:resource="http://x.org/A"/></rdf:Description>
</rdf:RDF>""".format(rdf=iri.RDF, rdfs=iri.RDFS, owl=iri.OWL)


@pytest.fixture(scope="module")
def triples(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("owl") / "a.owl"
    p.write_text(OWL)
    return rdf.read_rdf_xml(spark, str(p)), str(p)


def test_rdf_labels_and_hierarchy(spark, triples):
    t, path = triples
    assert dict(rows(rdf.labels(t))) == {"http://x.org/A": ["second", "syn one"], "http://x.org/B": ["only synonym"]}
    h = rows(rdf.hierarchy(t).select("child", "parent"))
    assert len(h) == 2 and ("http://x.org/B", "http://x.org/A") in h
    assert rdf.hierarchy(t, blank_nodes=False).count() == 1
    assert rows(rdf.match(t, s="http://x.org/o#C").select("o")) == [("http://x.org/A",)]
    flat = rdf.read_owl_classes(spark, path)
    assert rows(rdf.labels(flat)) == rows(rdf.labels(t)) and rdf.hierarchy(flat).count() == 1


def test_taxonomy_clones(spark):
    c = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "concept string, label string")
    alt = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "w")], "concept string, label string")
    links = spark.createDataFrame([("b", "broader", "c"), ("b", "broader", "a")], "concept string, relation string, other string")
    concepts, alts, kept, same = rdf.taxonomy_clones(c, alt, links)
    assert rows(concepts) == [("a", "A"), ("a2", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("d2", "D")]
    assert rows(alts) == [("a", "x"), ("a", "z"), ("a2", "y"), ("b", "w")]
    assert rows(kept) == [("b", "broader", "c")] and ("a2", "a") in rows(same)
    assert rdf.taxonomy_clones(c, alt, links, relink_clones=True)[2].count() == 2


def test_alignment_and_csv(spark, tmp_path):
    p = tmp_path / "r.tsv"
    p.write_text("SrcEntity\tTgtEntity\tScore\na\tb\t1.0\na\tc\t0.5\na\td\t\n")
    df = files.read_alignment(spark, str(p))
    assert rows(df.select("TgtEntity", "Label")) == [("b", 1), ("c", 0), ("d", 0)]
    files.write_csv(df, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_report_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0, 0)] * 90 + [(0, 1)] * 5 + [(1, 1)] * 4 + [(1, 0)], "label int, prediction int")
    report = R.report_dict(R.classification_report(p))
    assert report["1"] == pytest.approx({"precision": 4 / 9, "recall": 0.8, "f1-score": 2 * (4 / 9) * 0.8 / (4 / 9 + 0.8), "support": 5})
    assert report["accuracy"]["accuracy"] == 0.94 and report["macro avg"]["support"] == 100
    path = tmp_path / "report.txt"
    files.append_text(str(path), R.latex_table(report, "max negatives = 2, fuzz partial ratio > 30, cosine similarity > 0.3"))
    files.append_text(str(path), R.latex_table(report, "plain [1, 1, 1]"))
    tables = R.parse_tables(files.read_texts(spark, str(path))).orderBy("table_no").collect()
    assert [(t.max_negatives, t.fuzz_partial_ratio, t.cosine_similarity) for t in tables] == [(2, 30.0, 0.3), (None, None, None)]
    assert [r.label for r in tables[0].rows] == ["0", "1", "accuracy", "macro-avg", "weighted avg"]
    assert tables[0].rows[1].precision == 0.44 and tables[0].rows[2].precision is None
    parsed = R.parse_tables(files.read_texts(spark, str(path)))
    assert R.metric_points(parsed).count() == 2 and R.long_metrics(parsed).count() == 30
    assert [r.table_no for r in R.last_tables(parsed, "missing", 1).collect()] == [1] and R.sampled_tables(parsed, "1").count() == 2


def test_report_of_one_class_and_auc(spark):
    p = spark.createDataFrame([(1, 1, 0.9)], "label int, prediction int, score double")
    assert R.report_dict(R.classification_report(p))["1"]["f1-score"] == 1
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "label int, score double")
    assert R.roc_auc(s).first()[0] == pytest.approx(0.625)


def test_provenance(spark, tmp_path):
    new = spark.createDataFrame([("c:1", "l:1", "a", 'b"q', "en"), ("c:2", "l:2", "x", "known", "en"), ("c:3", "l:3", "x", "known", "de")], "concept_uri string, source_uri string, source_term string, transformed_term string, language_tag string")
    pool = spark.createDataFrame([("known", "en"), ("B", "en")], "term string, language_tag string")
    labels, events = files.provenance(new, pool, ["greekchars"], "e:1", '"d"')
    got = labels.collect()
    assert len(got) == 2 and events.count() == 2 and all(len(r.label_uri) == len("label:") + 30 for r in got)
    assert any('"b\\"q"@en' in r.turtle for r in got)
    assert files.store_normalization(new, pool, ["greekchars"], "e:1", '"d"', str(tmp_path)) == "stored"
    assert files.store_normalization(new.filter("language_tag = 'en' AND transformed_term = 'known'"), pool, [], "e", "d", str(tmp_path)) == "No new terms to be transformed."


def test_models(spark):
    import random

    random.seed(1)
    data = [(i, float(y) + random.gauss(0, 0.3), random.random(), y) for i in range(120) for y in [i % 2]]
    df = spark.createDataFrame(data, "row int, a double, b double, label int")
    m = L.fit_members(df, ["a", "b"], trees=5)
    scored = L.member_probabilities(m, df)
    assert all(0 <= p <= 1 for r in scored.select("p_lr", "p_gb", "p_rf").collect() for p in r)
    voted = L.vote(scored, (1, 0, 0))
    assert voted.filter(F.abs(F.col("score") - F.col("p_lr")) > 1e-9).count() == 0
    assert L.importances(m, ["a", "b"], 3).first()["feature"] == "a"
    imp = L.permutation_importance(lambda d: L.member_probabilities(m, d.withColumn("label", F.lit(0))).withColumn("score", F.col("p_lr")), df.drop("label"), ["a", "b"])
    assert imp.first()["feature"] == "a"
    assert L.sweep([(1, df, df)], ["a", "b"], ((1, 1, 1),), trees=3).filter("label = 'accuracy'").first()["value"] > 0.8


def test_soft_vote_tie_is_class_0(spark):
    s, c = L.soft_vote([F.lit(0.25), F.lit(0.75)], (1, 1))
    assert tuple(spark.range(1).select(s, c).first()) == (0.5, 0)


def test_clusters_and_embeddings(spark):
    docs = spark.createDataFrame([(i, "heart disease heart" if i % 2 else "lung cancer lung") for i in range(10)], "id int, text string")
    w = L.tf_idf(docs)
    assert w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).filter(F.abs(F.col("n") - 1) > 1e-9).count() == 0
    assigned, _, vocab = L.cluster(w, k=2)
    groups = dict(rows(assigned))
    assert len({groups[i] for i in range(0, 10, 2)}) == 1 and groups[0] != groups[1] and set(vocab) == {"heart", "disease", "lung", "cancer"}
    e = embedder.embeddings(spark.createDataFrame([("a", ["x y"]), ("b", [])], "concept string, labels array<string>")).collect()
    assert len(e[0].embedding) == 300 and not any(e[1].embedding)


def test_matching_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("s1", ["red bolt"])], "concept string, labels array<string>").write.parquet(str(src))
    arrivals = spark.readStream.schema("concept string, labels array<string>").parquet(str(src))
    targets = spark.createDataFrame([("t1", ["red bolt"]), ("t2", ["red nut"]), ("t3", ["zinc"])], "concept string, labels array<string>")
    match_arrivals(arrivals, targets, str(tmp_path / "out"), str(tmp_path / "cp"), k=1).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("src", "tgt", "jaccard")) == [("s1", "t1", 1.0)]
