"""Bounded samples of labelled documents, and calibration, for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, y) of about per_class documents of each class, and the weight of a row of each class.

    Only labels of rows where learn holds count; of several labels of an id the greatest. The picked ids number about 2 * per_class, so they are
    broadcast: the documents are filtered where they lie, and no text is shuffled.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1)).filter(learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = materialize(texts.join(F.broadcast(picked), "doc_id"), "labelled")
    return out, {y: max(1.0, n / per_class) for y, n in sizes.items()}


class Isotonic:
    """Non-decreasing fit by pooling adjacent violators, read off linearly between the means of its blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        blocks: list[list[float]] = []  # weight, mean of y, mean of x
        for i in np.argsort(x, kind="stable"):
            blocks.append([float(w[i]), float(y[i]), float(x[i])])
            while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
                (a, p, u), (b, q, v) = blocks[-2:]
                blocks[-2:] = [[a + b, (a * p + b * q) / (a + b), (a * u + b * v) / (a + b)]]
        self.x = np.array([b[2] for b in blocks])
        self.y = np.array([b[1] for b in blocks])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else np.full(len(x), 0.5)
