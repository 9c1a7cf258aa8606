"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are rates of character classes, repetition within the line and
of the line in its document, and the same features of the lines before and after. Forward-backward marginals
of `bad`, weighted by the lines' lengths, are averaged, and that mean, with the share of the length that is
probably bad, is calibrated to the document's quality.

Training has labels of documents only. Lines of good documents are good; lines of bad ones start as bad and
are relabelled by the model's marginals between rounds, while a bad document keeps its worst line. The field is
fitted on two thirds of the sample, by a hash of the text; the rest calibrates the scores.

A long text is featurised in pieces of whole lines of about GROUP_BYTES, so what a worker holds at a time grows
with its number of lines and its longest line (about a hundred bytes for each byte of that), not with the text.

Defined results: a null text counts as empty; a line is what lies between line feeds, empty lines are left out,
and a line of blanks is a line; a text without lines has nothing against it and gets the score of a text that is
good throughout; repeated rows and null ids pass through; other columns are ignored; labels that are null or
neither 0 nor 1 are ignored, of several labels of an id the greatest counts; texts that alone exceed max_bytes are
no training rows; a sample whose two thirds or whose rest lack a class is used for both; without labelled rows
every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .labelled import Isotonic, sample

#: Bounds of training: documents of a class (expected), rounds of relabelling, steps of the optimiser in a round.
PER_CLASS, ROUNDS, STEPS = 1500, 3, 120
#: Texts are featurised together up to so many bytes (or one text alone).
GROUP_BYTES = 1 << 20
#: Standardised features are held within this range; good bytes that every document is given.
RANGE, PRIOR_BYTES = 4.0, 16
_CLASSES = np.zeros(256, np.int64)  # others: control and rare signs
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t", b".,;:", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()=+/\\_", b"'\"-"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 12
_N_CLASSES = 13
_BYTE = np.random.default_rng(3).integers(0, 1 << 64, 256, dtype=np.uint64)
N_FEATURES, _SEEN = _N_CLASSES + 8, _N_CLASSES + 6


def _run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each slice: sums of byte values times their place from the slice's begin, and of the values themselves."""
    v = _BYTE[data]
    s1, s2 = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v, out=s1[1:])
    np.cumsum(v * np.arange(len(data), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), out=s2[1:])
    a, b = s1[stops] - s1[starts], s2[stops] - s2[starts]
    place = starts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = b - a * place
    h ^= h >> np.uint64(31)
    return (h + a) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Lines:
    """Lines of several documents, in order: features, lengths, and each one's document."""

    x: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    n_docs: int
    hash: np.ndarray


def featurise(texts: list[str]) -> Lines:
    """All lines of the texts; one long text goes in pieces, whose repeated lines are found over all of it."""
    if len(texts) != 1 or len(texts[0]) <= GROUP_BYTES:
        return _featurise(texts)
    text, pieces, at = texts[0], [], 0
    while at < len(text):
        end = text.find("\n", min(at + GROUP_BYTES, len(text)))
        end = len(text) if end < 0 else end
        pieces.append(_featurise([text[at:end]]))
        at = end + 1
    out = joined(pieces)
    out.doc[:] = 0
    out.n_docs = 1
    out.x[:, _SEEN] = _repeated(out.hash, out.doc)
    return out


def _repeated(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a line came before in its document."""
    order = np.lexsort((hashes, doc))
    seen = np.zeros(len(hashes), bool)
    seen[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return seen


def _featurise(texts: list[str]) -> Lines:
    """All lines of the texts at once, without a loop over lines or words."""
    parts = [t.encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    doc = np.searchsorted(np.cumsum([len(p) for p in parts]), ends, "right") if len(ends) else ends
    keep = ends > begins
    line_of = np.repeat(np.arange(len(ends)), ends - begins + 1)
    n = len(ends)
    kinds = np.bincount(line_of * _N_CLASSES + _CLASSES[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(float)
    size = np.maximum(ends - begins, 1).astype(float)
    # words, as runs of bytes over 32
    inside = data > 32
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    wl = line_of[ws] if len(ws) else ws
    wh = _run_hashes(data, ws, we)
    m = np.maximum(np.bincount(wl, minlength=n), 1).astype(float)
    again = np.concatenate([[False], (wh[1:] == wh[:-1]) & (wl[1:] == wl[:-1])]) if len(ws) else np.zeros(0, bool)
    order = np.lexsort((wh, wl))
    distinct = np.ones(len(ws), bool)
    distinct[order[1:]] = (wh[order][1:] != wh[order][:-1]) | (wl[order][1:] != wl[order][:-1])
    last = data[np.maximum(we - 1, 0)] if len(we) else data[:0]
    odd_end = np.isin(_CLASSES[last], (6, 8))  # stops and bars
    lh = _run_hashes(data, begins, ends)
    seen = _repeated(lh, doc)
    rates = kinds / size[:, None]
    x = np.column_stack([
        rates, np.log1p(size) / 5, np.log1p(m) / 4, size / m / 10,
        np.bincount(wl, again, n) / m, np.bincount(wl, distinct, n) / m, np.bincount(wl, odd_end, n) / m,
        seen, kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1),
    ])
    return Lines(x[keep], size[keep], doc[keep], len(texts), lh[keep])


def joined(parts: list[Lines]) -> Lines:
    """Lines of several groups of documents as those of one."""
    first = np.cumsum([0, *(p.n_docs for p in parts)])
    doc = np.concatenate([p.doc + k for p, k in zip(parts, first, strict=False)])
    return Lines(np.concatenate([p.x for p in parts]), np.concatenate([p.length for p in parts]), doc, int(first[-1]), np.concatenate([p.hash for p in parts]))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Features of a line, of the lines before and after it in its document (0 beyond its ends), and 1."""
    x, same = lines.x.astype(np.float32), lines.doc[1:] == lines.doc[:-1]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    return np.hstack([x, before, after, np.ones((len(x), 1), np.float32)])


def marginals(u: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains with the potentials exp(u) for `bad` and 1 for `good`: P(bad) of each line, P(pair) of each with the next.

    Documents advance together, line by line; those with more lines go on longer.
    """
    n = len(u)
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begins, [n]])).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    longest = int(sizes[0]) if n else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # documents with more than t lines
    pot = np.stack([np.ones(n), np.exp(np.clip(u, -30, 30))], 1)
    t = np.exp(trans)
    fwd, bwd = np.empty((n, 2)), np.empty((n, 2))
    for k in range(longest):
        at = begins[: active[k]] + k
        v = pot[at] if k == 0 else (fwd[at - 1] @ t) * pot[at]
        fwd[at] = v / v.sum(1, keepdims=True)
    for k in range(longest - 1, -1, -1):
        at = begins[: active[k]] + k
        end = sizes[: active[k]] == k + 1
        v = np.ones((len(at), 2))
        nxt = at[~end] + 1
        v[~end] = (bwd[nxt] * pot[nxt]) @ t.T
        bwd[at] = v / v.sum(1, keepdims=True)
    both = fwd * bwd
    p = both[:, 1] / both.sum(1) if n else np.zeros(0)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pair = fwd[inner][:, :, None] * t[None] * (pot[inner + 1] * bwd[inner + 1])[:, None, :]
    return p, pair / pair.sum((1, 2), keepdims=True)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    mix: np.ndarray
    calibration: Isotonic

    def line_marginals(self, lines: Lines) -> np.ndarray:
        """P(bad) of every line."""
        x = np.clip((with_neighbours(lines) - self.mean) / self.scale, -RANGE, RANGE)
        return marginals(x @ self.weights, lines.doc, self.trans)[0]

    def documents(self, lines: Lines) -> np.ndarray:
        return aggregate(self.line_marginals(lines), lines)

    def score(self, lines: Lines) -> np.ndarray:
        """P(quality 1) of every document."""
        return np.clip(self.calibration(-(self.documents(lines) @ self.mix)), 0.0, 1.0)


def aggregate(p: np.ndarray, lines: Lines) -> np.ndarray:
    """[length-weighted mean of P(bad), share of the length that is probably bad] of each document.

    Each has PRIOR_BYTES good bytes more, so a few bytes are no evidence against a document.
    """
    total = np.bincount(lines.doc, lines.length, lines.n_docs) + PRIOR_BYTES
    weighted = [np.bincount(lines.doc, lines.length * v, lines.n_docs) / total for v in (p, p > 0.5)]
    return np.stack(weighted, 1)


def fit(texts: list[str], y: np.ndarray, w: np.ndarray) -> Model:
    """y: 1 for good documents; w: weights of documents. A third, by a hash of the text, is for calibration alone."""
    held = np.array([zlib.crc32(t.encode()) % 3 == 0 for t in texts])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        grow = rest = np.ones(len(texts), bool)
    else:
        grow, rest = ~held, held
    model = _fit([t for t, on in zip(texts, grow, strict=True) if on], y[grow])
    lines = joined([featurise(g) for g in _groups([t for t, on in zip(texts, rest, strict=True) if on])])
    model.calibration = Isotonic(-(model.documents(lines) @ model.mix), y[rest], w[rest])
    return model


def _fit(texts: list[str], y: np.ndarray) -> Model:
    """The field, not calibrated yet."""
    lines = joined([featurise(g) for g in _groups(texts)])
    x = with_neighbours(lines)
    mean, scale = x.mean(0, dtype=float).astype(np.float32), x.std(0, dtype=float).astype(np.float32)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    x = np.clip((x - mean) / scale, -RANGE, RANGE)
    bad_doc = y[lines.doc] == 0
    label = bad_doc.astype(float)
    per_doc = np.maximum(np.bincount(lines.doc, minlength=lines.n_docs), 1)
    wl = (1 / per_doc**0.5)[lines.doc]  # a long document counts for more than a short one, but not by its lines
    wl = wl * np.where(bad_doc, 1 / max(wl[bad_doc].sum(), 1e-9), 1 / max(wl[~bad_doc].sum(), 1e-9))
    inner = np.flatnonzero(lines.doc[1:] == lines.doc[:-1])
    wp = wl[inner]
    theta, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2, s = [np.zeros(x.shape[1]), np.zeros((2, 2))], [np.zeros(x.shape[1]), np.zeros((2, 2))], 0
    for r in range(ROUNDS):
        for _ in range(STEPS):
            p, pair = marginals(x @ theta, lines.doc, trans)
            seen = np.zeros((len(inner), 2, 2))
            seen[np.arange(len(inner)), label[inner].astype(int), label[inner + 1].astype(int)] = 1
            grads = [x.T @ (wl * (label - p)) - 1e-3 * theta, np.einsum("i,iab->ab", wp, seen - pair) - 1e-3 * trans]
            s += 1
            for j, (value, g) in enumerate(zip((theta, trans), grads, strict=True)):  # Adam, upwards
                m1[j] = 0.9 * m1[j] + 0.1 * g
                m2[j] = 0.99 * m2[j] + 0.01 * g * g
                value += 0.05 * (m1[j] / (1 - 0.9**s)) / (np.sqrt(m2[j] / (1 - 0.99**s)) + 1e-8)
        if r + 1 < ROUNDS:
            p, _ = marginals(x @ theta, lines.doc, trans)
            worst = np.zeros(lines.n_docs)
            np.maximum.at(worst, lines.doc, p)
            label = (bad_doc & ((p > 0.5) | (p >= worst[lines.doc]))).astype(float)
    return Model(mean, scale, theta, trans, np.array([0.7, 0.3]), Isotonic(np.zeros(0), np.zeros(0), np.zeros(0)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 8 << 20) -> Model:
    """Fit on a bounded sample; the driver holds about max_bytes of texts: whole ones, picked by a hash of the id, none of which alone exceeds max_bytes."""
    rows, weights = sample(docs, labels, label_col, learn, per_class, id_col, text_col)
    rows = rows.filter(F.octet_length("text") <= max_bytes)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, max_bytes / max(size, 1))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(1_000_000)) < share * 1_000_000)
    got = sorted((r.doc_id, r.y, r.text) for r in picked.toLocalIterator())
    if not got:
        z = np.zeros(3 * N_FEATURES + 1)
        return Model(z, z + 1, z, np.zeros((2, 2)), np.array([0.7, 0.3]), Isotonic(np.zeros(0), np.zeros(0), np.zeros(0)))
    y = np.array([r[1] for r in got], float)
    return fit([r[2] for r in got], y, np.array([weights[int(v)] for v in y]))


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, bad_share) for every row of docs; bad_share is the length-weighted mean of the lines' marginals."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            scores, shares = [np.zeros(0)], [np.zeros(0)]
            for group in _groups(b["text"].to_pylist()):
                lines = featurise(group)
                per_doc = m.documents(lines)
                shares.append(per_doc[:, 0])
                scores.append(np.clip(m.calibration(-(per_doc @ m.mix)), 0.0, 1.0))
            yield pa.record_batch([b["doc_id"], pa.array(np.concatenate(scores)), pa.array(np.concatenate(shares))], ["doc_id", "score", "bad_share"])

    kind = docs.schema[id_col].dataType.simpleString()
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, bad_share double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold; they are filtered where they lie."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b[text_col].to_pylist()]
            on = [np.zeros(0, bool)] + [sent.value.score(featurise(group)) >= threshold for group in _groups(texts)]
            yield b.filter(pa.array(np.concatenate(on)))

    return docs.mapInArrow(run, docs.schema)
