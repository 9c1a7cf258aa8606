"""Language identification by words first, and by ever shorter character n-grams for words never seen.

Training counts words per language on a bounded sample, natively; n-gram counts derive from the word counts.
A known word adds its log frequency under each language. An unknown word is read from the left: at each place
the longest n-gram that training knows adds its log frequency, and reading goes on behind it.

Letters are those of Unicode's categories L, in training and in prediction; other signs end a word.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the language that sorts
first; languages that are null are no training rows; without any training row every text is `und`; repeated
rows and null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Cache
from .common import materialize

#: Bounds of training: documents of a language (expected; a hash of the id decides), words of a language.
MAX_DOCS, MAX_WORDS = 1500, 30_000
MAX_N = 5
#: How much an n-gram counts against a known word: a backed-off score is discounted.
DISCOUNT = 0.5
#: Letters and numbers other than decimal digits; letters() leaves the letters of these.
_RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letters(text: str) -> Counter:
    """The words of a lower-case text with their frequencies: runs of letters (isalpha is Unicode's L)."""
    runs = Counter(_RUN.findall(text))
    for w in [w for w in runs if not w.isalpha()]:
        n = runs.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            runs[part] += n
    return runs


class Model:
    """Log frequencies as a tuple per word or n-gram, one value per language, in the order of langs."""

    def __init__(self, langs: list[str], prior: list[float], counts: dict[str, dict[str, int]]):
        self.langs, self.prior = langs, prior
        self.words = self._table({k: counts.get(k, {}) for k in langs})
        grams: dict[str, Counter] = {k: Counter() for k in langs}
        for k in langs:
            c = grams[k]
            for w, n in counts.get(k, {}).items():
                for size in range(1, MAX_N + 1):
                    for i in range(len(w) - size + 1):
                        c[w[i : i + size]] += n
        self.grams = self._table(grams)
        self.zero = (0.0,) * len(langs)

    def _table(self, counts: dict[str, dict[str, int]]) -> dict[str, tuple[float, ...]]:
        """Add-a-half frequencies, relative to the mean over the languages: a unit that tells nothing adds nothing."""
        units = sorted(set().union(*counts.values())) if counts else []
        m = np.array([[counts[k].get(u, 0) for k in self.langs] for u in units], float).reshape(len(units), len(self.langs)) + 0.5
        if units:
            m = np.log(m / m.sum(0))
            m -= m.mean(1, keepdims=True)
        return dict(zip(units, map(tuple, m.tolist()), strict=True))

    def unseen(self, word: str) -> tuple[float, ...]:
        grams, i, n, out = self.grams, 0, len(word), self.zero
        while i < n:
            for size in range(min(MAX_N, n - i), 0, -1):
                v = grams.get(word[i : i + size])
                if v is not None:
                    out = tuple(a + DISCOUNT * b for a, b in zip(out, v, strict=True))
                    i += size
                    break
            else:
                i += 1
        return out


class Scorer:
    def __init__(self, model: Model):
        self.model, self.unseen = model, Cache(300_000)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letters(text.lower()) if text else None
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        known, totals = self.model.words, list(self.model.prior)
        k = range(len(totals))
        for w, n in words.items():
            v = known.get(w)
            if v is None and (v := self.unseen.get(w)) is None:
                v = self.model.unseen(w)
                if len(w) <= 48:
                    self.unseen.put(w, v)
            for i in k:
                totals[i] += n * v[i]
        best = max(k, key=lambda i: (totals[i], -i))
        return self.model.langs[best], 1 / sum(math.exp(t - totals[best]) for t in totals)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Model:
    """Fit on a sample of the rows where learn holds: about max_docs of each language, whole texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn")).filter("learn AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], {})
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, max_docs / n))) for k, n in sizes.items()))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts: dict[str, dict[str, int]] = {k: {} for k in langs}
    n = materialize(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    for k in langs:  # at most max_words rows of each language reach the driver
        for r in n.filter(F.col("lang") == k).orderBy(F.desc("n"), "word").limit(max_words).collect():
            counts[k][r.word] = r.n
    total = sum(sizes.values())
    return Model(langs, [math.log(sizes[k] / total) for k in langs], counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_words words and their n-grams for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            out = [scorer.predict(t.as_py()) for t in b["text"]]
            yield pa.record_batch([b["doc_id"], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
