"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from a bounded sample of labelled rows: words, and beginnings of words, that are far
more frequent in toxic documents. Features are densities of lexicon words and stems, their nearness to the
second person, and rates of capitals, punctuation, digits and obfuscation. The lexicon is mined and the trees are
grown on two thirds of the sample, by a hash of the id; the rest calibrates their scores.

Defined results: a null text counts as empty; an empty text is scored from its features, which are all 0; a
sample with one class only gives that class's share as every score; repeated rows and null ids pass through;
other columns are ignored; labels that are null or neither 0 nor 1 are ignored, of several labels of an id the
greatest counts; a sample whose two thirds or whose rest lack a class is used for both. Of words with equal odds
those that sort first enter the lexicon; a row goes right in a tree only where it exceeds the node's value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .byte_bpe import Cache
from .common import id_text
from .labelled import Isotonic, sample

#: Bounds of training: documents of a class (expected), entries of the lexicon, lengths of stems.
PER_CLASS, LEXICON, STEMS = 2500, 300, (4, 5, 6, 7)
#: How far from a word of the second person a lexicon word counts as near to it, in words.
REACH = 4
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te ti vous vos votre toi ton tes usted ustedes tú tus vosotros".split())
WORD = re.compile(r"[^\W\d_]+")
#: A letter, one or more signs or digits that stand for letters, and a letter again.
OBFUSCATED = re.compile(r"[^\W\d_][0-9@$*!+][0-9@$*!+]?[^\W\d_]")
LEET = str.maketrans("013457@$!+", "oleastasit")
FEATURES = ["word_sum", "word_density", "word_count", "stem_sum", "stem_density", "stem_count", "stem_top", "near", "near_density", "leet", "obfuscated", "capitals", "shouting", "marks", "signs", "digits", "words", "word_length", "non_ascii"]


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]

    def weigh(self, word: str) -> tuple[float, float]:
        return self.words.get(word, 0.0), max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0)


class Featurizer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, Cache(300_000)

    def _weights(self, word: str) -> tuple[float, float]:
        v = self.known.get(word)
        if v is None:
            v = self.lexicon.weigh(word)
            if len(word) <= 48:
                self.known.put(word, v)
        return v

    def __call__(self, text: str) -> list[float]:
        low = text.lower()
        words = WORD.findall(low)
        n = len(words)
        if not text:
            return [0.0] * len(FEATURES)
        weights = np.array(list(map(self._weights, words)) or [(0.0, 0.0)])
        on, stem = weights[:, 0] > 0, weights[:, 1] > 0
        near = 0
        for i in np.flatnonzero(on | stem).tolist():
            near += not SECOND_PERSON.isdisjoint(words[max(0, i - REACH) : i + REACH + 1])
        odd = OBFUSCATED.findall(low)
        leet = sum(self.lexicon.words.get(w, 0.0) > 0 for w in WORD.findall(low.translate(LEET))) - int(on.sum()) if odd else 0
        count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        upper, lower, size = count[65:91].sum(), count[97:123].sum(), count.sum()
        m = max(n, 1)
        tops = nlargest(3, weights[:, 1].tolist())
        return [
            float(weights[:, 0].sum()), float(weights[:, 0].sum() / m), float(on.sum()), float(weights[:, 1].sum()), float(weights[:, 1].sum() / m), float(stem.sum()), float(sum(tops)),
            float(near), near / m, float(max(leet, 0)), len(odd) / m, float(upper / max(1, upper + lower)), float(count[33] / m), float(count[[33, 63]].sum() / size),
            float((count[33:48].sum() + count[58:65].sum() + count[91:97].sum()) / size), float(count[48:58].sum() / size), float(np.log1p(n)), sum(map(len, words)) / m, float(count[128:].sum() / size),
        ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.trees.raw(x)), 0.0, 1.0) if len(x) else np.zeros(0)


def mine(rows: DataFrame, weights: dict[int, float]) -> Lexicon:
    """Words and stems by their log odds between toxic and other documents, from counts of documents."""
    words = rows.select("doc_id", "y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("unit"))
    n1 = max(1, rows.filter("y = 1").count())
    n0 = max(1, rows.filter("y = 0").count())

    def top(units: DataFrame, least: int) -> dict[str, float]:
        counted = units.groupBy("unit").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).filter(F.col("a") >= least)
        odds = F.log((F.col("a") + 0.1) / (n1 + 1.0)) - F.log((F.col("b") + 1.0) / (n0 + 1.0))
        best = counted.withColumn("odds", odds).filter("odds > 1.0").orderBy(F.desc(F.col("odds") * F.sqrt("a")), "unit").limit(LEXICON)
        return {r.unit: float(r.odds) for r in best.collect()}

    stems = words.filter(F.length("unit") >= STEMS[0]).select("doc_id", "y", F.explode(F.array(*(F.when(F.length("unit") >= k, F.substring("unit", 1, k)) for k in STEMS))).alias("unit")).filter("unit IS NOT NULL").distinct()
    least = max(3, n1 // 200)
    return Lexicon(top(words, least), top(stems, least))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows, weights = sample(docs, labels, label_col, learn, per_class, id_col, text_col)
    rows = rows.withColumn("held", (F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(3)) == 0).cast("int"))
    sizes = {(r.held, r.y): r.n for r in rows.groupBy("held", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = len(sizes) == 4  # both classes on both sides
    lexicon = mine(rows.filter("held = 0") if split else rows, weights)
    kind = rows.schema["doc_id"].dataType.simpleString()
    data = sorted(tuple(r) for r in _features(rows, lexicon, ["y", "held"], kind).collect())  # about 2 * per_class rows of numbers
    if not data:
        return Model(lexicon, Boosted(np.zeros((1, len(FEATURES))), np.zeros(1), np.ones(1), trees=0), Isotonic(np.zeros(0), np.zeros(0), np.zeros(0)))
    x, y, held = np.array([r[3] for r in data], float), np.array([r[1] for r in data], float), np.array([r[2] for r in data], bool)
    w = np.array([weights[int(v)] for v in y])
    grow, rest = (~held, held) if split else (np.ones(len(y), bool), np.ones(len(y), bool))
    trees = Boosted(x[grow], y[grow], w[grow])
    return Model(lexicon, trees, Isotonic(trees.raw(x[rest]), y[rest], w[rest]))


def _features(rows: DataFrame, lexicon: Lexicon, keep: list[str], id_kind: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)  # twice LEXICON entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer(sent.value)
        for b in batches:
            yield pa.record_batch([b["doc_id"], *(b[c] for c in keep), pa.array([f(t.as_py()) for t in b["text"]], pa.list_(pa.float64()))], ["doc_id", *keep, "x"])

    return rows.select("doc_id", *keep, "text").mapInArrow(run, f"doc_id {id_kind}, {''.join(f'{c} int, ' for c in keep)}x array<double>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        f = Featurizer(m.lexicon)
        for b in batches:
            x = np.array([f(t.as_py()) for t in b["text"]], float).reshape(len(b), len(FEATURES))
            yield pa.record_batch([b["doc_id"], pa.array(m.score(x), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
