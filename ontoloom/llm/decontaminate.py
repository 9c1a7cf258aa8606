"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Items are indexed in segments. Every passage of every document (PASSAGE words, at strides of half that) is a
query; an impact is a BM25 term score divided by the segment's score for itself, so 1 is a passage with the whole
segment and one threshold fits all. Block maxima work twice: the sums of the greatest impacts of a passage's
distinct terms within each of GROUPS groups of segments bound its scores, and vectorised sums of these leave only
passages, each with the groups in which it can reach the threshold; there they are searched by WAND: a pivot, a test
of the blocks' maxima at the pivot, then full scores. Hits are verified on words: the shares of the distinct
SHINGLE-word shingles of the item's question and of its answer that the document has around the passage.

The index is sent to the workers in shards of about MAX_INDEX_BYTES of item text, one after the other, so what is
broadcast is bounded whatever the benchmark's size: postings take 12 bytes each in arrays, a term about 500, so a
shard of short words that are all different (0.7 million) holds most, by this arithmetic 350 MB. An item is never
split over shards.

Defined results: null texts count as empty; an item or document without words gives no pair; the last sentence
of an item is its answer and the rest its question, an item of one sentence has its last third as the answer;
parts with fewer words than a shingle are one shingle; repeated items and documents are reported each; ids of items
and documents may be of any type, null ids pass through; other columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import id_text

#: Words of a passage, of a segment at most, and of a shingle. A segment is half a passage, as is the stride, so
#: some passage holds a segment as a whole.
PASSAGE, SEGMENT, SHINGLE = 64, 32, 5
#: Least BM25 score, as a share of the segment's own, and least share of shingles of either part.
THRESHOLD, OVERLAP = 0.5, 0.8
#: Postings of a block; groups of segments whose greatest impacts are held by term for the vectorised bound.
K1, B, BLOCK, GROUPS = 1.2, 0.75, 16, 64
MAX_INDEX_BYTES = 4 << 20
WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    parts = [w for s in _SENTENCE.split(text.lower()) if (w := WORD.findall(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


class Index:
    """Postings by term, in blocks with their greatest impact, over segments of items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items = []  # (item_id, words of question, words of answer)
        segments: list[tuple[int, list[str]]] = []
        for item_id, text in items:
            question, answer = split_item(text)
            words = question + answer
            if not words:
                continue
            n = math.ceil(len(words) / SEGMENT)
            segments += [(len(self.items), words[len(words) * k // n : len(words) * (k + 1) // n]) for k in range(n)]
            self.items.append((item_id, question, answer))
        self.segment_item = [s[0] for s in segments]
        self.terms: dict[str, int] = {}
        df = Counter(t for _, w in segments for t in set(w))
        mean = sum(len(w) for _, w in segments) / max(1, len(segments))
        lists: list[list[tuple[int, float]]] = []
        for ordinal, (_, words) in enumerate(segments):
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {t: math.log(1 + (len(segments) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(words).items()}
            own = sum(impact.values())
            for t, v in impact.items():
                k = self.terms.setdefault(t, len(lists))
                if k == len(lists):
                    lists.append([])
                lists[k].append((ordinal, v / own))
        self.ordinals = [array("i", (o for o, _ in p)) for p in lists]
        self.impacts = [array("d", (v for _, v in p)) for p in lists]
        self.block_max = [array("d", (max(p[i : i + BLOCK]) for i in range(0, len(p), BLOCK))) for p in self.impacts]
        self.bound = [max(p) for p in self.impacts]
        self.group_max = np.zeros((len(lists) + 1, GROUPS), np.float32)  # the last row is for words of no item
        self.group_size = max(1, -(-len(segments) // GROUPS))
        for k, p in enumerate(lists):
            for o, v in p:
                g = o // self.group_size
                self.group_max[k, g] = max(self.group_max[k, g], v)

    def search(self, terms: list[int], threshold: float, first: int = 0, end: int = 1 << 60) -> list[tuple[int, float]]:
        """All segments with ordinals in [first, end) whose score for the distinct terms is at least the threshold, with the score."""
        least, found, bound = threshold - 1e-9, [], self.bound
        cursors = [[p[k], k, t] for t in terms if (k := bisect_left(p := self.ordinals[t], first)) < len(p) and p[k] < end]

        def move(c: list[int], to: int) -> None:
            """To the first posting at or behind `to`; whole blocks before it are skipped."""
            places, at = self.ordinals[c[2]], c[1]
            while at < len(places) and places[at] < to:
                stop = min(at - at % BLOCK + BLOCK, len(places))
                at = stop if places[stop - 1] < to else at + 1
            c[1] = at
            c[0] = places[at] if at < len(places) and places[at] < end else -1

        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += bound[c[2]]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            most, block_end = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in cursors[: pivot + 1]:
                places, b = self.ordinals[c[2]], c[1] // BLOCK
                while b < len(self.block_max[c[2]]) and places[min(b * BLOCK + BLOCK, len(places)) - 1] < at:
                    b += 1
                if b < len(self.block_max[c[2]]):
                    most += self.block_max[c[2]][b]
                    block_end = min(block_end, places[min(b * BLOCK + BLOCK, len(places)) - 1] + 1)
            if most < least:
                to = max(block_end, at + 1)
                for c in cursors[: pivot + 1]:
                    move(c, to)
            elif cursors[0][0] == at:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((at, score))
                for c in cursors[: pivot + 1]:
                    move(c, at + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < at:
                        move(c, at)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def _promising(self, ids: np.ndarray, threshold: float) -> list[list[int]]:
        """[passage, group] where the bound reaches the threshold; passage k begins at word k * SEGMENT.

        A term counts once in a passage: where its last occurrence lies before the passage's begin.
        """
        at = np.flatnonzero(ids < len(self.terms))
        if not len(at):
            return []
        known = ids[at]
        order = np.argsort(known, kind="stable")
        last = np.full(len(at), -1)
        same = known[order][1:] == known[order][:-1]
        last[order[1:][same]] = at[order[:-1][same]]
        part = at // SEGMENT
        n = int(part[-1]) + 1
        sums = []
        for back in (0, 1):  # as the first half of a passage, and as the second
            on = last < (part - back) * SEGMENT
            rows = np.zeros((n, GROUPS), np.float32)
            p = part[on]
            if len(p):
                firsts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                rows[p[firsts]] = np.add.reduceat(self.group_max[known[on]], firsts, axis=0)
            sums.append(rows)
        bound = sums[0]
        bound[:-1] += sums[1][1:]
        return np.argwhere(bound >= threshold - 1e-4).tolist()

    def hits(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question_overlap, answer_overlap) of the items that a document holds."""
        words = WORD.findall(text.lower())
        n = len(words)
        if not n or not self.items:
            return []
        get, none = self.terms.get, len(self.terms)
        ids = np.fromiter((get(w, none) for w in words), np.int64, n)
        best: dict[int, tuple[float, float, float]] = {}
        for k, g in self._promising(ids, threshold):
            a, b = k * SEGMENT, min(k * SEGMENT + PASSAGE, n)
            terms = sorted({*ids[a:b].tolist()} - {none})
            for ordinal, score in self.search(terms, threshold, g * self.group_size, (g + 1) * self.group_size):
                i = self.segment_item[ordinal]
                if i in best and best[i][0] >= score:
                    continue
                _, question, answer = self.items[i]
                reach = len(question) + len(answer)
                around = words[max(0, a - reach) : b + reach]
                q, s = _share(question, around), _share(answer, around)
                if q >= overlap and s >= overlap:
                    best[i] = (score, q, s)
        return [(self.items[i][0], *v) for i, v in sorted(best.items())]


def _share(part: list[str], words: list[str]) -> float:
    """The share of the distinct shingles of a part that occur in the words; 1 of none."""
    wanted = _shingles(part)
    if not wanted:
        return 1.0
    n = min(SHINGLE, len(part))
    have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(wanted & have) / len(wanted)


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes over all items, each of about MAX_INDEX_BYTES of text at most."""
    rows = id_text(items, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(size / MAX_INDEX_BYTES) or 1
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Index(sorted(((r.doc_id, r.text) for r in part.collect()), key=lambda x: (x[0] is not None, x)))


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each item that a document holds."""
    out, spark = None, docs.sparkSession
    kind, item_type = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType
    item_kind = to_arrow_type(item_type)
    for index in shards(items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b["doc_id"].to_pylist(), b["text"], strict=True) for hit in sent.value.hits(t.as_py(), threshold, overlap)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (b["doc_id"].type, item_kind, pa.float64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, item_id {item_type.simpleString()}, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; they are filtered where they lie."""
    for index in shards(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.hits(t or "", threshold, overlap) for t in b[text_col].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
