"""Secret scan: fixed base patterns, and formats inferred from the credentials that they find.

The labelled credentials of a bounded sample go into a prefix tree for each kind. States of a tree at equal depth
whose outgoing frequencies are compatible (Hoeffding's bound, recursively, as far as both have been seen often
enough to tell) are merged, layer by layer. So fixed beginnings, separators and lengths stay apart, while
random characters fold into one state of a layer. One more automaton is learned from ordinary tokens
in lower case, plain numbers and words and whatever else fits no kind. Every candidate token of every text is scored, credentials of base spans too: by its log-likelihood per character under
each kind against what the visited states expect, which must reach that of credentials that were held out, and
by the likelihood ratio per character to the ordinary automaton. Candidates that pass both are added as spans of the kind `format`, unless they overlap a base span.

Defined results: a null text counts as empty and has no spans; spans are in code points, end exclusive; base
matches are leftmost and non-overlapping within a kind, while kinds may overlap; kinds without enough labelled
credentials aren't learned, and without any nothing is added and no score is given; repeated rows and null ids
pass through; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Cache
from .common import id_text, materialize

# The base patterns with their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "format")

#: Candidates of the method: unbroken tokens of the characters that a credential may have, without dots or hyphens at their ends.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=]")
DIGIT = re.compile(r"[0-9]")
#: Bounds of training: documents read for examples, examples of a sort (of ordinary tokens: with a digit, and
#: without), length of an example, fewest credentials to learn from, one in how many distinct ordinary tokens
#: without a digit is an example.
MAX_DOCS, MAX_EXAMPLES, MAX_LENGTH, FEWEST, ORDINARY_SHARE = 40_000, 1000, 128, 20, 16
#: Merging: significance of the test that keeps two states apart, and how often a state must be seen to be tested.
ALPHA, EVIDENCE = 0.3, 10
#: Mean log-likelihood under which a rare state is kept apart from the likeliest one.
PLAUSIBLE = math.log(0.1)
#: How much the classes of characters count beside the characters themselves, and a class never seen.
KAPPA, UNSEEN = 8.0, 0.02
#: Least log-likelihood ratio to ordinary tokens (natural, per character); how far a candidate's fit may lie below the
#: median of held-out credentials, in median deviations and at least.
THRESHOLD, SPREADS, SLACK = 0.5, 4.0, 0.3
#: A kind that more than this share of ordinary words fits can't tell suspects among the ordinary examples.
AMBIGUOUS = 0.1
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_.-", "=")
_CLASS = {c: k for k, chars in enumerate(_CLASSES) for c in chars}
_SIZES = [len(c) for c in _CLASSES]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


class Automaton:
    """A probabilistic automaton: counts[state][character], following[state][character]; '' ends a string.

    Characters that a state has not seen get a share of their class's frequency, and lead where most of their class lead.
    """

    def __init__(self) -> None:
        self.counts: list[dict[str, int]] = [{}]
        self.following: list[dict[str, int]] = [{}]

    def add(self, word: str) -> None:
        s = 0
        for c in word:
            self.counts[s][c] = self.counts[s].get(c, 0) + 1
            if c not in self.following[s]:
                self.following[s][c] = len(self.counts)
                self.counts.append({})
                self.following.append({})
            s = self.following[s][c]
        self.counts[s][""] = self.counts[s].get("", 0) + 1

    def _classes(self, s: int) -> dict[int, int]:
        """How often a state goes on with each class of characters; -1 is the end."""
        out: dict[int, int] = {}
        for c, n in self.counts[s].items():
            k = _CLASS[c] if c else -1
            out[k] = out.get(k, 0) + n
        return out

    def _alike(self, a: int, b: int) -> bool:
        """Hoeffding's test of two states, and of those behind them while both sides have EVIDENCE."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            x, y = self.counts[a], self.counts[b]
            n, m = sum(x.values()), sum(y.values())
            if n < EVIDENCE or m < EVIDENCE:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for p, q in ((x, y), (self._classes(a), self._classes(b))):
                if any(abs(p.get(c, 0) / n - q.get(c, 0) / m) > bound for c in p.keys() | q.keys()):
                    return False
            pairs += [(self.following[a][c], self.following[b][c]) for c in self.following[a].keys() & self.following[b].keys()]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree to a state, along equal characters."""
        pairs = [(into, tree)]
        while pairs:
            a, b = pairs.pop()
            for c, n in self.counts[b].items():
                self.counts[a][c] = self.counts[a].get(c, 0) + n
            for c, t in self.following[b].items():
                if c in self.following[a]:
                    pairs.append((self.following[a][c], t))
                else:
                    self.following[a][c] = t

    def _closeness(self, kept: int, s: int) -> float:
        """How well a kept state explains, by classes, what little was seen of s."""
        p = self._classes(kept)
        total = sum(p.values()) + UNSEEN * (len(_CLASSES) + 1)
        return sum(n * math.log((p.get(k, 0) + UNSEEN) / total) for k, n in self._classes(s).items())

    def generalise(self) -> None:
        """Merge the states of each layer, from the first down.

        Rare siblings of a class, as random characters give, are pooled first. What was seen often then joins the first
        compatible state of its layer, and what is still rare the likeliest one, unless that is unlikely.
        """
        layer, parents = [0], []
        while layer:
            seen = {s: sum(self.counts[s].values()) for s in layer}
            becomes: dict[int, int] = {}
            for p in parents:
                pools: dict[int, int] = {}
                for c, t in sorted(self.following[p].items(), key=lambda x: (-seen[x[1]], x)):
                    if t in becomes or seen[t] >= EVIDENCE or t in pools.values():
                        continue
                    to = pools.setdefault(_CLASS[c], t)
                    if to != t:
                        self._fold(to, t)
                        becomes[t] = to
                        seen[to] += seen[t]
            kept: list[int] = []
            for s in sorted((s for s in layer if s not in becomes), key=lambda s: (-seen[s], s)):
                if seen[s] >= EVIDENCE or not kept:
                    to = next((k for k in kept if self._alike(k, s)), s)
                else:
                    to = max(kept, key=lambda k: (self._closeness(k, s), -k))
                    if self._closeness(to, s) < seen[s] * PLAUSIBLE:
                        to = s
                if to == s:
                    kept.append(s)
                else:
                    self._fold(to, s)
                    becomes[s] = to
            for p in parents:
                for c, t in self.following[p].items():
                    while t in becomes:
                        t = becomes[t]
                    self.following[p][c] = t
            parents, layer = kept, sorted({t for s in kept for t in self.following[s].values()})

    def finish(self) -> None:
        """Number the states that are reached anew and turn counts into log-likelihoods."""
        order, number = [0], {0: 0}
        for s in order:
            for c in sorted(self.following[s]):
                t = self.following[s][c]
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        self.counts = [self.counts[s] for s in order]
        self.following = [{c: number[t] for c, t in self.following[s].items()} for s in order]
        self.known, self.other, self.lead, self.expected = [], [], [], []
        for s, counts in enumerate(self.counts):
            n, classes = sum(counts.values()), self._classes(s)
            by_class = [(classes.get(k, 0) + UNSEEN) / (n + UNSEEN * (len(_CLASSES) + 1)) / (_SIZES[k] if k >= 0 else 1) for k in range(-1, len(_CLASSES))]
            share = lambda c: by_class[(_CLASS[c] if c else -1) + 1]  # noqa: E731, B023
            known = {c: math.log((v + KAPPA * share(c)) / (n + KAPPA)) for c, v in counts.items()}
            self.known.append(known)
            self.other.append([math.log(KAPPA * p / (n + KAPPA)) for p in by_class])
            total = sum(math.exp(v) for v in known.values())
            self.expected.append(sum(math.exp(v) * v for v in known.values()) / total)
            # where a character goes that the state hasn't seen: where most of its class go, or most of all
            to = self.following[s]
            ways = {t: sum(u == t for u in to.values()) for t in to.values()}  # how many characters lead to each
            by = lambda chars: max((to[c] for c in chars), key=lambda t: (ways[t], -t), default=-1)  # noqa: E731, B023
            self.lead.append([by([c for c in to if _CLASS[c] == k] or to) for k in range(len(_CLASSES))])
        self.gain = max(max(k.values()) - e for k, e in zip(self.known, self.expected, strict=True))

    def fit(self, word: str, floor: float = -math.inf) -> tuple[float, float]:
        """Means over the characters and the end: of how likely each is against what its state expects, and of the natural log-likelihood.

        The first says whether a word follows the format, whatever the format leaves open. It is -inf as soon as
        it must fall below the floor.
        """
        s, out, like, n = 0, 0.0, 0.0, len(word) + 1
        known, other, lead, expected, following = self.known, self.other, self.lead, self.expected, self.following
        slack, gain = floor * n, self.gain
        for i, c in enumerate(word):
            if s < 0:  # beyond the longest example: any character, at the cost of one never seen
                p, e = FAR, 0.0
            else:
                p, e = known[s].get(c), expected[s]
                if p is None:
                    k = _CLASS[c]
                    p, s = other[s][k + 1], lead[s][k]
                else:
                    s = following[s][c]
            like += p
            out += p - e
            if out + gain * (n - i - 1) < slack:
                return -math.inf, -math.inf
        p, e = (FAR, 0.0) if s < 0 else (known[s].get("", other[s][0]), expected[s])
        out, like = (out + p - e) / n, (like + p) / n
        return (out, like) if out >= floor else (-math.inf, -math.inf)


#: What a character beyond the longest example costs.
FAR = math.log(0.001)


def infer(words: list[str]) -> Automaton:
    a = Automaton()
    for w in words:
        a.add(w)
    a.generalise()
    a.finish()
    return a


class Ordinary:
    """How likely a token is as ordinary text: an automaton over its lower-case form, and its pattern of case."""

    def __init__(self, words: list[str]):
        self.automaton = infer([w.lower() for w in words])
        self.cases = dict.fromkeys(("lower", "title", "upper", "mixed"), 1)
        for w in words:
            self.cases[self._case(w)] += 1

    @staticmethod
    def _case(word: str) -> str:
        return "lower" if word == word.lower() else "title" if word[1:] == word[1:].lower() else "upper" if word == word.upper() else "mixed"

    def score(self, word: str) -> float:
        """Mean natural log-likelihood of the characters and the end; in a mixed token every letter's case is free."""
        case = self._case(word)
        free = sum(c.isalpha() for c in word) if case == "mixed" else 0
        return self.automaton.fit(word.lower())[1] + (math.log(self.cases[case] / sum(self.cases.values())) - free * math.log(2)) / (len(word) + 1)


class Formats:
    """Automata of the credentials by kind, with the least fit to each, and what is ordinary."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        self.automata: list[tuple[str, Automaton, float]] = []
        for kind, words in sorted(credentials.items()):
            if len(words) >= FEWEST:
                held = infer([w for i, w in enumerate(words) if i % 3])
                fits = np.array([held.fit(w)[0] for w in words[::3]])
                spread = float(np.median(np.abs(fits - np.median(fits))))
                self.automata.append((kind, infer(words), float(np.median(fits)) - max(SLACK, SPREADS * spread)))
        self.ordinary = Ordinary(self._without_suspects(ordinary)) if self.automata else None
        self.cache = Cache(300_000)

    def _without_suspects(self, ordinary: list[str]) -> list[str]:
        """Tokens that fit a kind of credential aren't evidence of what is ordinary.

        Plain numbers and words are, whatever they fit, and so is everything for a kind that many words of letters fit.
        """
        plain = [w for w in ordinary if w.isalpha() or w.isdigit()]
        letters = [w for w in plain if w.isalpha()]
        telling = [(a, floor) for _, a, floor in self.automata if sum(a.fit(w, floor)[0] > -math.inf for w in letters) <= AMBIGUOUS * len(letters)]
        return plain + [w for w in ordinary if not (w.isalpha() or w.isdigit()) and not any(a.fit(w, floor)[0] > -math.inf for a, floor in telling)]

    def score(self, word: str) -> float | None:
        """The greatest log-likelihood ratio per character of the kinds that the word fits; None if it fits none."""
        out = self.cache.get(word)
        if out is None:
            likely = max((a.fit(word, floor)[1] for _, a, floor in self.automata), default=-math.inf)
            out = likely - self.ordinary.score(word) if likely > -math.inf else -math.inf
            if len(word) <= MAX_LENGTH:
                self.cache.put(word, out)
        return None if out == -math.inf else out

    def spans(self, text: str) -> list[tuple[int, int, str, float | None]]:
        """(start, end, kind, score) of base spans and added ones, by start, then kind as in KINDS."""
        base = base_spans(text)
        if not self.automata:
            return [(*x, None) for x in base]
        out = [(a, e, k, self.score(credential(text[a:e], k))) for a, e, k in base]
        fitting = {w for w in set(CANDIDATE.findall(text)) if (v := self.score(w)) is not None and v >= THRESHOLD}
        if fitting:
            for m in CANDIDATE.finditer(text):
                if m[0] in fitting and not any(a < m.end() and m.start() < e for a, e, _ in base):
                    out.append((*m.span(), KINDS[3], self.score(m[0])))
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def credential(match: str, kind: str) -> str:
    """The credential in a base match."""
    return ASSIGN.match(match)[2] if kind == "assign" else match


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_examples: int = MAX_EXAMPLES) -> Formats:
    """Fit on about max_docs documents that a hash of the id picks, and at most max_examples distinct tokens of each sort, picked by a hash; those over MAX_LENGTH are no examples."""
    rows = id_text(docs, id_col, text_col)
    n = max(1, rows.count())
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < min(1.0, max_docs / n) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, str]] = set()
            for t in b["text"]:
                t = t.as_py()
                base = base_spans(t)
                found |= {(k, credential(t[a:e], k)) for a, e, k in base}
                taken = {t[a:e] for a, e, _ in base} | {credential(t[a:e], k) for a, e, k in base}
                for w in set(CANDIDATE.findall(t)) - taken:
                    if DIGIT.search(w):
                        if not any(x in w for x in taken):
                            found.add(("digits", w))
                    elif zlib.crc32(w.encode()) % ORDINARY_SHARE == 0:
                        found.add(("letters", w))
            short = sorted(x for x in found if len(x[1]) <= MAX_LENGTH)
            yield pa.record_batch([pa.array([k for k, _ in short], pa.string()), pa.array([w for _, w in short], pa.string())], ["kind", "word"])

    ranked = sample.mapInArrow(run, "kind string, word string").distinct().withColumn("h", F.xxhash64("word", F.lit(5)))
    ranked = materialize(ranked, "examples")
    found = {k: [r.word for r in ranked.filter(F.col("kind") == k).orderBy("h", "word").limit(max_examples).collect()] for k in ("access", "assign", "hex", "digits", "letters")}
    return Formats({k: found[k] for k in KINDS[:3]}, found["digits"] + found["letters"])


def scan(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind, score>>) for every row of docs, by start, then kind as in KINDS.

    score: log-likelihood ratio per character, null for a credential that fits no learned format.
    """
    sent = docs.sparkSession.sparkContext.broadcast(formats)  # automata of a bounded number of examples
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for b in batches:
            out = [[{"start": a, "end": e, "kind": k, "score": v} for a, e, k, v in f.spans(t.as_py())] for t in b["text"]]
            yield pa.record_batch([b["doc_id"], pa.array(out, spans)], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, spans array<struct<start: long, end: long, kind: string, score: double>>")


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of what scan() returns."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), number(KINDS[3]).alias("n_format")
    )
