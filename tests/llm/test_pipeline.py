import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ontoloom.llm import byte_bpe, common, decontaminate, line_crf

from .test_dedup import brute


def test_pipeline_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = line_crf.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.coalesce(common.fold(3) != 1, F.lit(False)))
    texts = {}
    for r in docs.collect():
        if model.score(line_crf.featurise([r.text or ""]))[0] >= 0.5:
            texts[r.doc_id] = r.text
    last = {}
    for d, t in texts.items():
        last[t or ""] = max(d, last.get(t or "", d))
    texts = {d: texts[d] for d in last.values()}
    near = brute(texts, 5, 80)
    texts = {d: t for d, t in texts.items() if near[d][1] == d}
    items = [decontaminate.WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    flat = {d: f" {' '.join(decontaminate.WORD.findall((t or '').lower()))} " for d, t in texts.items()}
    texts = {d: t for d, t in texts.items() if not any(f" {' '.join(w)} " in flat[d] for w in items)}
    assert set(got) == set(texts)
    enc = tiktoken.Encoding("own", pat_str=byte_bpe.DEFAULT_PATTERN, mergeable_ranks=byte_bpe.codec().ranks, special_tokens={})
    for d, t in texts.items():
        assert np.frombuffer(got[d].ids, "<u4").tolist() == enc.encode_ordinary(t or "") and got[d].round_trip


def test_stages_keep_the_columns_and_take_awkward_rows(spark, sf, docs, empty):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, empty.select(docs.columns), sf).count() == 0, name
    assert cp.encoded(spark, docs, sf).count() == 9
