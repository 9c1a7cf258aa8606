"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text becomes the set of its shingles (64-bit hashes). Texts with equal sets are one class from here on,
   so a group of copies costs one row in what follows.
2. A class has a signature of TREES * DEPTH minima. Each tree of the forest is one sorted order of all classes: by
   DEPTH minima of its own, 32 bits each, then by a byte of each of the TAIL minima that follow. Each order is cut
   into blocks of BLOCK places, whatever the keys, with the neighbours of a block's ends added.
3. Within an order, a region is a run of places that share a prefix. Each class is compared with the region that
   shares the longest prefix with it, found from the lengths of common prefixes of neighbouring places: the
   shallowest region, from depth FIRST on, that has at most CLOSED classes. So depth follows density. Where that
   is deeper than FIRST, each class proposes its NEAREST in the region; one that stands alone there, or that the
   whole key doesn't tell from more, its NEAREST among at least CLOSED / 2 next places on either side.
4. Proposed pairs are confirmed on the full sets: first each class's nearest partners, then those pairs that
   still lie between components, until none is left. Components are computed by alternating stars.
5. In a region that is dense at depth FIRST, proposed classes that are not in its largest component are queries
   against all proposed classes of the region, block by block on full sets.

Pairs whose signatures agree in under NEAR of the positions are not proposed: for a similarity of 0.8 or more
that happens with a probability below 1e-7. Two sets of similarity s share a region of a sparse part of an order
with probability s ** FIRST; over all TREES orders a pair at 0.8 is missed with one below 2e-5. In dense parts
step 5 stands behind this; only a class that resembles none of its neighbours in any of the orders takes no part.

Defined results: ids are numbers, cast to long (a text that is no number fails the query); a null text counts as
empty; a text without words has an empty set and is linked with nothing, not even with other such texts; with fewer
words than a shingle the whole sequence is the one shingle; rows that repeat an id under several texts are one node;
a row with a null id belongs to the component of the rows that share its set, and without such rows has a null
component and is kept; repeated texts are one class; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, discard, id_filter, id_text, lookup, materialize

TREES, DEPTH, FIRST, TAIL = 16, 6, 3, 26
CLOSED, BLOCK = 32, 16384
NEAR = 0.55
NEAREST = 2
QUERIES = 256
_K = TREES * DEPTH
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = _RNG.integers(0, 1 << 64, _K, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text, A-Z in lower case.

    A polynomial over random byte values, from prefix sums: no Python loop over words.
    """
    words = text.encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    stops = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], stops[:-1] + 1])
    size = min(size, len(words))
    a, b = starts[: len(starts) - size + 1], stops[size - 1 :]
    h = (sums[b] - sums[a]) * down[a]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """DEPTH minima for each of the trees, as 32-bit integers."""
    out = np.empty(_K, np.uint64)
    step = max(1, (1 << 18) // max(1, len(hashes)))
    for k in range(0, _K, step):
        out[k : k + step] = (hashes[:, None] * _MULTIPLIERS[k : k + step]).min(0)
    return (out >> np.uint64(32)).astype(np.uint32)


def sets(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, bits): digest names the set, sketch has its minima, bits a byte of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, sketches, bits = [], [], [], []
            for t in b["text"]:
                h = shingles(t.as_py(), size)
                n.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                s = signature(h) if len(h) else None
                sketches.append(None if s is None else s.astype(">u4").tobytes())
                bits.append(None if s is None else (s >> np.uint32(8)).astype(np.uint8).tobytes())
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch", "bits"])

    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary, bits binary")


def _ordered(classes: DataFrame) -> tuple[DataFrame, int]:
    """(tree, key, id, place): all classes in each of the orders, numbered through, and their number."""
    head = F.expr(f"substring(sketch, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    tail = F.expr(f"substring(concat(bits, bits), (tree + 1) * {DEPTH} + 1, {TAIL})")
    rows = classes.select("id", "sketch", "bits", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", F.concat(head, tail).alias("key"), "id")
    by = ("tree", "key", "id")
    dealt = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "orders")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())  # one row for each partition
    bases = [(p, int(n)) for (p, _), n in zip(sizes, np.cumsum([0, *(n for _, n in sizes)]), strict=False)]
    known = dealt.sparkSession.createDataFrame(bases, "part long, base long")
    placed = dealt.withColumn("part", part).join(F.broadcast(known), "part")
    return placed.select(*by, (F.col("base") + within).alias("place")), sum(n for _, n in sizes)


def _depths(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many minima each place's key shares with the one before it: 32-bit ones first, then those of one byte."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        byte = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
        out[1:] = np.where(byte < 4 * DEPTH, byte // 4, byte - 3 * DEPTH)
        out[1:][tree[1:] != tree[:-1]] = -1  # another order
    out[:1] = -1
    return out


def regions(tree: np.ndarray, keys: np.ndarray, own: np.ndarray, place: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray | None]], np.ndarray, np.ndarray]:
    """Of a block with the neighbours of its ends: groups, as index arrays; the run at depth FIRST of each place, and its size as far as seen.

    A group comes with the places in it that ask for their nearest, or with None where all its pairs are wanted.
    It belongs to the block that owns its first place, so no two blocks give the same one.
    """
    shared, n = _depths(tree, keys), len(keys)
    groups, closed, alone = [], np.zeros(n, bool), np.ones(n, bool)
    first_run = first_size = None
    for depth in range(FIRST, DEPTH + TAIL + 1):
        run = np.cumsum(shared < depth) - 1
        starts = np.flatnonzero(shared < depth)
        sizes = np.diff(np.concatenate([starts, [n]]))
        if first_run is None:
            first_run, first_size = run, sizes[run]
        for k in np.flatnonzero((sizes <= CLOSED) & (sizes > 1) & ~closed[starts]).tolist():
            group = np.arange(starts[k], starts[k] + sizes[k])
            alone[group] = False
            if own[group[0]]:
                groups.append((group, None if depth == FIRST else group))
        closed |= sizes[run] <= CLOSED
        if closed.all():
            break
    # places of dense runs that no region holds: windows of CLOSED places, each half over the next
    alone &= first_size > CLOSED
    heads = first_run != np.concatenate([[-1], first_run[:-1]])
    for at in np.flatnonzero((first_size > CLOSED) & own & ((place % (CLOSED // 2) == 0) | heads)).tolist():
        group = np.arange(at, at + np.searchsorted(first_run[at : at + CLOSED], first_run[at], "right"))
        if len(group) > 1 and alone[group].any():
            groups.append((group, group[alone[group]]))
    return groups, first_run, first_size


def _neighbours(classes: DataFrame) -> DataFrame:
    """(region, ids, asking): groups to compare (region is null; of asking ones, if any, the nearest are wanted), and classes of regions that are dense at depth FIRST."""
    rows, _ = _ordered(classes)
    reach = 2 * CLOSED + 1  # a window may end CLOSED places on, where as many more must be seen
    block, within = F.floor(F.col("place") / BLOCK), F.col("place") % BLOCK
    also = F.array(block, F.when(within < reach, block - 1), F.when(within >= BLOCK - reach, block + 1))
    dealt = rows.withColumn("home", block).withColumn("block", F.explode(F.filter(also, lambda x: x.isNotNull() & (x >= 0))))
    dealt = dealt.select("block", "place", (F.col("home") == F.col("block")).alias("own"), "tree", "key", "id").repartition("block").sortWithinPartitions("block", "place")

    def lists(members: list[np.ndarray | None]) -> pa.Array:
        return pa.array([None if m is None else np.sort(m) for m in members], pa.list_(pa.int64()))

    def whole(table: pa.Table) -> pa.RecordBatch:
        tree, ids, place = (table[c].to_numpy() for c in ("tree", "id", "place"))
        own = table["own"].to_numpy(zero_copy_only=False)
        keys = np.frombuffer(b"".join(table["key"].to_pylist()), np.uint8).reshape(len(ids), -1)
        groups, run, size = regions(tree, keys, own, place)
        region, members, asking = [None] * len(groups), [ids[g] for g, _ in groups], [None if a is None else ids[a] for _, a in groups]
        dense = np.flatnonzero(own & (size > CLOSED))
        if len(dense):
            for part in np.split(dense, np.flatnonzero(np.diff(run[dense])) + 1):
                name = int(tree[part[0]]).to_bytes(2, "big") + keys[part[0], : 4 * FIRST].tobytes()
                region.append(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "big", signed=True))
                members.append(ids[part]), asking.append(None)
        return pa.record_batch([pa.array(region, pa.int64()), lists(members), lists(asking)], ["region", "ids", "asking"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one block: BLOCK rows and those at its ends
        for b in batches:
            blocks = b["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and held[-1]["block"][0].as_py() != int(blocks[lo]):
                    yield whole(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield whole(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "region long, ids array<long>, asking array<long>")


def _pairs_of_groups(groups: DataFrame) -> DataFrame:
    """(a, b, near): pairs within arrays of (id, bits, asks) that are near enough: all (asks is null), or the NEAREST of those that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, near = [], [], []
            for members in batch["members"].to_pylist():
                ids = np.array([m["id"] for m in members], np.int64)
                bits = np.frombuffer(b"".join(m["bits"] for m in members), np.uint8).reshape(len(ids), _K)
                est = (bits[:, None, :] == bits[None, :, :]).sum(2)
                if members[0]["asks"] is None:
                    i, j = np.nonzero(np.triu(est >= NEAR * _K, 1))
                else:
                    np.fill_diagonal(est, -1)
                    ask, k = np.flatnonzero([m["asks"] for m in members]), min(NEAREST, len(ids) - 1)
                    i, j = np.repeat(ask, k), np.argpartition(-est[ask], k - 1, axis=1)[:, :k].ravel()
                    i, j = i[on := est[i, j] >= NEAR * _K], j[on]
                a.append(np.minimum(ids[i], ids[j]))
                b.append(np.maximum(ids[i], ids[j]))
                near.append(est[i, j].astype(np.int32))
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(near))], ["a", "b", "near"])

    return groups.select("members").mapInArrow(run, "a long, b long, near int")


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, near) proposed pairs of class ids, and (id, key) of the regions that are dense at the first depth."""
    found = materialize(_neighbours(classes), "neighbours")
    # equal groups of several orders are one; a group has CLOSED members at most
    groups = found.filter("region IS NULL").select("ids", "asking").distinct()
    asks = F.transform("ids", lambda x: F.struct(x.alias("id"), F.array_contains("asking", x).alias("asks")))
    named = groups.select(F.xxhash64("ids", "asking").alias("g"), F.inline(asks))
    # a class meets its signature once, not once for each group
    once = named.groupBy("id").agg(F.collect_list(F.struct("g", "asks")).alias("places")).join(classes.select("id", "bits"), "id")
    grouped = once.select("id", "bits", F.inline("places")).groupBy("g").agg(F.collect_list(F.struct("id", "bits", "asks")).alias("members"))
    pairs = _pairs_of_groups(grouped).groupBy("a", "b").agg(F.max("near").alias("near"))
    dense = found.filter("region IS NOT NULL").select(F.col("region").alias("key"), F.explode("ids").alias("id"))
    return materialize(pairs, "pairs"), dense


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, hashes binary) of the texts with the given ids, read again: only proposed classes' sets are ever stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["doc_id"], pa.array([shingles(t.as_py(), size).tobytes() for t in b["text"]], pa.binary())], ["id", "hashes"])

    wanted = docs.filter(id_filter(ids)).join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, hashes binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small = min(len(a), len(b))
    if 100 * small < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b["x"], b["y"], strict=True)]
            yield pa.record_batch([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = full.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    y = full.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of undirected edges (a, b); the component is its least id.

    Alternating large and small stars; each round is written to the shared folder, and only a count and
    a checksum of it reach the driver.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    check = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    before = tuple(e.agg(*check).first())  # one row
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = least.filter(F.col("n") > max(1.0, 2 * before[0] * HOT_SHARE)).select("u", "m")
        large = lookup(both, "u", least.select("u", "m"), hubs).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, e = e, materialize(small.filter("u <> v").distinct(), "stars")
        discard(last)
        now = tuple(e.agg(*check).first())
        if now == before:
            roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        before = now


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components; ids without a label are their own."""
    la = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    lb = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "near")


def _queries(dense: DataFrame, labels: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between residual classes of dense regions and all members of those regions.

    Residual are the classes outside their region's largest component. They meet the region in blocks of
    QUERIES classes on either side, and only confirmed links come out.
    """
    lab = labels.select("id", "component")
    member = dense.join(full.select("id"), "id").join(lab, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    member = materialize(member, "members")
    total = member.count()
    sizes = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most"))
    marked = lookup(member, "key", main, main.filter(F.col("total") > max(1.0, total * HOT_SHARE))).filter("total > most")
    placed = marked.join(full, "id").withColumn("parts", F.ceil(F.col("total") / QUERIES))
    spread = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), n)
    item = F.collect_list(F.struct("id", "component", "hashes"))
    held = placed.withColumn("part", spread(F.col("parts"))).groupBy("key", "part").agg(item.alias("held"))
    odd = placed.filter("component <> main").withColumn("block", spread(F.ceil((F.col("total") - F.col("most")) / QUERIES)))
    asked = odd.groupBy("key", "block", "parts").agg(item.alias("asked"))
    # each part of a region meets the queries under a key of its own
    asked = asked.select("key", "block", "asked", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b["asked"], b["held"], strict=True):
                left, right, found = x.as_py(), y.as_py(), set()
                sets_ = [np.frombuffer(m["hashes"], np.uint64) for m in left]
                sizes_ = np.array([len(v) for v in sets_])
                owner = np.repeat(np.arange(len(sets_)), sizes_)
                order = np.argsort(np.concatenate(sets_), kind="stable")
                words, owner = np.concatenate(sets_)[order], owner[order]
                for m in right:
                    h = np.frombuffer(m["hashes"], np.uint64)
                    lo, hi = np.searchsorted(words, h, "left"), np.searchsorted(words, h, "right")
                    n = hi - lo
                    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(left))
                    for i in np.flatnonzero(100 * both >= percent * (sizes_ + len(h) - both)).tolist():
                        if left[i]["component"] != m["component"]:
                            found.add((min(left[i]["id"], m["id"]), max(left[i]["id"], m["id"])))
                pairs = sorted(found)
                yield pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return asked.join(held, ["key", "part"]).select("asked", "held").mapInArrow(run, "a long, b long").distinct()


def _grown(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Components after more links: the old ones enter as stars."""
    stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(new.select("a", "b")))


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, component) of all classes that are linked with another."""
    pairs, dense = _candidates(classes)
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    full = materialize(_full_sets(docs, ends, size), "full")
    # first each class's nearest partners: they decide most components
    sides = pairs.select("a", "b", "near", F.explode(F.array("a", "b")).alias("side"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("near"), "a", "b"))
    first = sides.withColumn("r", rank).filter(F.col("r") <= NEAREST).select("a", "b").distinct()
    labels = components(materialize(_confirm(first, full, percent), "links"))
    rest = materialize(_between(pairs, labels).join(first, ["a", "b"], "left_anti"), "between")
    labels = _grown(labels, materialize(_confirm(rest, full, percent), "links"))
    more = materialize(_queries(dense, labels, full, percent), "links")
    return _grown(labels, more) if more.limit(1).count() else labels


def dedup(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets; the least id of a component is kept.
    """
    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    all_sets = materialize(sets(source, size), "sets")
    classes = all_sets.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    classes = materialize(classes, "classes")
    labels = links(source, classes.filter("id IS NOT NULL"), size, percent)
    named = materialize(classes.select("digest", "id", "n").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"), "n"), "named")
    hot = named.filter(F.col("n") > max(1.0, all_sets.count() * HOT_SHARE))
    return (
        lookup(all_sets.select("doc_id", "n_shingles", "digest"), "digest", named.drop("n"), hot.drop("n"))
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
