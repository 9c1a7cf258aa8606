"""A content-addressed store of token-id documents.

Each document's id stream is cut where a rolling hash of the last WINDOW ids says so; a chunk is stored once,
under the digest of its bytes, in pack files of plain little-endian ids. A recipe lists a document's chunks.
Recipes are in ascending order of the document id, which gives each its start in the stream of all ids, and
a Merkle tree over them gives each partition of recipes, and the store, a root. Packs, chunk places, recipes and
the manifest of roots lie in one folder, from which Store.open() reads a store again.

Chunks are deduplicated within a task before they are shuffled by digest, so a chunk that a third of the
documents share travels once for each task. Reading back visits each stored chunk once: CRCs of chunks are
combined into those of documents, so chunks aren't copied for each document that names them. Chunks that many
documents name are broadcast to the rows that name them, by their number, length and CRC alone.

Reading verifies: recipes must have the roots of the manifest, chunks their digests, and documents the number
of ids that their recipe states; a damaged, missing or surplus recipe or chunk is an error, never a wrong row.

Defined results: a null or empty text is a document of the end id alone; repeated ids are documents of their
own, one after the other; a null id sorts first; an empty table gives a store without packs; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_encoder
from .common import HOT_SHARE, id_text, lookup, materialize, shared_dir
from .flat_files import Rotating, open_fs

WINDOW, MASK_BITS, LEAST, MOST = 16, 9, 128, 4096
DIGEST = 16
#: A task forgets which chunks it has sent after so many; more copies are then sent, and dropped behind the shuffle.
REMEMBERED = 500_000
PACK_BYTES = 128 << 20
#: About so many recipes, picked by a hash, show which chunks are hot.
HOT_SAMPLE = 20_000
_BASE = 0x9E3779B97F4A7C15


def cuts(ids: np.ndarray, ends: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents that end at ends; each document's last chunk ends with it.

    A cut depends on the WINDOW ids before it and on the last cut, so equal passages get equal chunks soon
    after they begin. The least length is over WINDOW, so what precedes a document doesn't matter.
    """
    h, power, w = gear[ids], _BASE, 1
    while w < WINDOW:  # doubling: a sum over w ids becomes one over 2 w
        g = h.copy()
        g[w:] += h[:-w] * np.uint64(power)
        h, power, w = g, power * power % (1 << 64), 2 * w
    marks = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    out, start, k, marks_list = [], 0, 0, marks.tolist()
    n = len(marks_list)
    for end in ends.tolist():
        while k < n and marks_list[k] < end:
            m = marks_list[k]
            k += 1
            while m - start > MOST:
                start += MOST
                out.append(start)
            if m - start >= LEAST:
                out.append(m)
                start = m
        while end - start > MOST:
            start += MOST
            out.append(start)
        out.append(end)
        start = end
        while k < n and marks_list[k] <= end:
            k += 1
    return np.array(out, np.int64)


def gear_table(size: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, size, dtype=np.uint64)


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree of SHA-256; an odd node moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def leaf(doc_id: int | None, chunks: bytes) -> bytes:
    return hashlib.sha256(b"\0" + repr(doc_id).encode() + b"\0" + chunks).digest()


@dataclass
class Store:
    """recipes(part, pos, base, doc_id, n_tokens, chunks, lens), index(digest, pack, offset, n_bytes), roots(part, base, n_docs, n_ids, root)."""

    folder: str
    dtype: str
    recipes: DataFrame
    index: DataFrame
    roots: DataFrame
    root: bytes

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        """The store that write() left in a folder."""
        read = spark.read.schema
        places = read(_SCHEMAS["places"]).parquet(f"{folder}/places")
        manifest = read(_SCHEMAS["manifest"]).parquet(f"{folder}/manifest")
        top = manifest.filter("part = -1").first()
        return cls(
            folder,
            top["dtype"],
            read(_SCHEMAS["recipes"]).parquet(f"{folder}/recipes").filter("root IS NULL").drop("root"),
            places.filter("digest IS NOT NULL").select("digest", "pack", "offset", "n_bytes"),
            manifest.filter("part >= 0").drop("dtype"),
            bytes(top["root"]),
        )


_SCHEMAS = {
    "places": "doc_id long, n_tokens long, chunks binary, lens binary, digest binary, pack string, offset long, n_bytes long",
    "recipes": "part long, pos long, base long, doc_id long, n_tokens long, chunks binary, lens binary, root binary",
    "manifest": "part long, base long, n_docs long, n_ids long, root binary, dtype string",
}


def _chunked(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of two kinds from one pass over the texts: recipes, and chunks that the task hasn't sent yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder.word_encoder(tokenizer)
        gear, end, sent = gear_table(1 << (16 if enc.dtype == "<u2" else 20)), np.array([end_id], enc.dtype).tobytes(), set()
        width = len(end)
        for b in batches:
            streams = [enc.encode(t.as_py()) + end for t in b["text"]]
            if not streams:
                continue
            data = b"".join(streams)
            ends = np.cumsum([len(x) // width for x in streams])
            stops = cuts(np.frombuffer(data, enc.dtype), ends, gear).tolist()
            key, doc_id, n_tokens, chunks, lens, blob = [], [], [], [], [], []
            k = start = 0
            for d, stop in zip(b["doc_id"].to_pylist(), ends.tolist(), strict=True):
                names, sizes, first = [], [], start
                while start < stop:
                    piece = data[start * width : stops[k] * width]
                    name = hashlib.blake2b(piece, digest_size=DIGEST).digest()
                    names.append(name)
                    sizes.append(stops[k] - start)
                    if name not in sent:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(name)
                        key.append(name), doc_id.append(None), n_tokens.append(None), chunks.append(None), lens.append(None), blob.append(piece)
                    start, k = stops[k], k + 1
                recipe = b"".join(names)
                key.append(hashlib.blake2b(f"{d}".encode(), digest_size=DIGEST).digest())
                doc_id.append(d), n_tokens.append(stop - first), chunks.append(recipe), lens.append(np.array(sizes, "<u4").tobytes()), blob.append(None)
            yield pa.record_batch([pa.array(key, pa.binary()), pa.array(doc_id, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(chunks, pa.binary()), pa.array(lens, pa.binary()), pa.array(blob, pa.binary())], ["key", "doc_id", "n_tokens", "chunks", "lens", "blob"])

    return docs.mapInArrow(run, "key binary, doc_id long, n_tokens long, chunks binary, lens binary, blob binary")


def _packed(rows: DataFrame, folder: str) -> DataFrame:
    """Write each chunk once; rows are sorted by key. Recipes pass through, chunks come back as places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = Rotating(folder, "pack", PACK_BYTES), None
        for b in batches:
            names, packs, offsets, sizes = [], [], [], []
            whole = b.filter(b["blob"].is_null())
            for name, blob in zip(b["key"], b["blob"], strict=True):
                if blob.is_valid and (name := name.as_py()) != last:
                    last, data = name, blob.as_py()
                    pack, at = out.write(data)
                    names.append(name), packs.append(pack), offsets.append(at), sizes.append(len(data))
            n = len(names)
            if len(whole):
                yield pa.record_batch([whole["doc_id"], whole["n_tokens"], whole["chunks"], whole["lens"], pa.nulls(len(whole), pa.binary()), pa.nulls(len(whole), pa.string()), pa.nulls(len(whole), pa.int64()), pa.nulls(len(whole), pa.int64())], _PLACES)
            if n:
                yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(names, pa.binary()), pa.array(packs), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], _PLACES)
        out.close()

    return rows.mapInArrow(run, _SCHEMAS["places"])


_PLACES = ["doc_id", "n_tokens", "chunks", "lens", "digest", "pack", "offset", "n_bytes"]


def _numbered(recipes: DataFrame) -> DataFrame:
    """Recipes in ascending order of the id, with their place in the partition; a last row for each partition has its totals and its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, base, leaves = TaskContext.get().partitionId(), 0, 0, []
        for b in batches:
            n = np.array(b["n_tokens"].to_pylist(), np.int64)
            leaves += [leaf(d.as_py(), c.as_py()) for d, c in zip(b["doc_id"], b["chunks"], strict=True)]
            k = len(n)
            yield pa.record_batch([pa.array([part] * k, pa.int64()), pa.array(range(pos, pos + k), pa.int64()), pa.array(base + np.cumsum(n) - n, pa.int64()), b["doc_id"], b["n_tokens"], b["chunks"], b["lens"], pa.nulls(k, pa.binary())], _NUMBERED)
            pos, base = pos + k, base + int(n.sum())
        if pos:
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([pos], pa.int64()), pa.array([base], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([merkle(leaves)], pa.binary())], _NUMBERED)

    return recipes.mapInArrow(run, _SCHEMAS["recipes"])


_NUMBERED = ["part", "pos", "base", "doc_id", "n_tokens", "chunks", "lens", "root"]


def write(docs: DataFrame, end_id: int = 2, tokenizer: str = word_encoder.DEFAULT, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Write the store below a folder (a new one in the shared folder by default), in ascending order of the id."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/store"
    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = _chunked(source, tokenizer, end_id).repartition("key").sortWithinPartitions("key")
    _packed(rows, f"{folder}/packs").write.parquet(f"{folder}/places")
    recipes = spark.read.schema(_SCHEMAS["places"]).parquet(f"{folder}/places").filter("n_tokens IS NOT NULL").select("doc_id", "n_tokens", "chunks", "lens")
    _numbered(recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "chunks")).write.parquet(f"{folder}/recipes")
    ordered = spark.read.schema(_SCHEMAS["recipes"]).parquet(f"{folder}/recipes")
    totals = sorted(ordered.filter("root IS NOT NULL").select("part", "pos", "base", "root").collect())  # one row for each partition
    bases, at = [], 0
    for t in totals:
        bases.append((t.part, at, t.pos, t.base, t.root, None))
        at += t.base
    top = (-1, 0, sum(t.pos for t in totals), at, merkle([bytes(t.root) for t in totals]), word_encoder.word_encoder(tokenizer).dtype)
    spark.createDataFrame([top, *bases], _SCHEMAS["manifest"]).coalesce(1).write.parquet(f"{folder}/manifest")
    return Store.open(spark, folder)


def _read_chunks(index: DataFrame, store: Store, blobs: bool) -> DataFrame:
    """(digest, n, crc[, blob]) of each stored chunk, read from the packs; the digest is checked."""
    folder, dtype = f"{store.folder}/packs", store.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        name, file = None, None
        for b in batches:
            ns, crcs, data = [], [], []
            for digest, pack, at, size in zip(*(b[c].to_pylist() for c in ("digest", "pack", "offset", "n_bytes")), strict=True):
                if pack != name:
                    if file is not None:
                        file.close()
                    name, file = pack, fs.open_input_file(f"{path}/{pack}")
                blob = file.read_at(size, at)
                if hashlib.blake2b(blob, digest_size=DIGEST).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} in {pack} is damaged")
                wide = np.frombuffer(blob, dtype).astype("<u4").tobytes()
                ns.append(len(wide) // 4)
                crcs.append(zlib.crc32(wide))
                data.append(wide if blobs else None)
            yield pa.record_batch([b["digest"], pa.array(ns, pa.int64()), pa.array(crcs, pa.int64()), pa.array(data, pa.binary())], ["digest", "n", "crc", "blob"])
        if file is not None:
            file.close()

    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = index.repartitionByRange(tasks, "pack", "offset").sortWithinPartitions("pack", "offset")
    out = spread.mapInArrow(run, "digest binary, n long, crc long, blob binary")
    return out if blobs else out.drop("blob")


def _named(store: Store, recipes: DataFrame) -> DataFrame:
    """(start, doc_id, n_tokens, seq, digest, after): a row for each chunk that a recipe names; after: ids behind it in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for start, d, n, chunks, lens in zip(*(b[c].to_pylist() for c in ("start", "doc_id", "n_tokens", "chunks", "lens")), strict=True):
                sizes = np.frombuffer(lens, "<u4").astype(np.int64)
                after = (sizes.sum() - np.cumsum(sizes)).tolist()
                for k, left in enumerate(after):
                    for col, v in zip(cols, (start, d, n, k, chunks[k * DIGEST : (k + 1) * DIGEST], left), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["start", "doc_id", "n_tokens", "seq", "digest", "after"])

    bases = F.broadcast(store.roots.select("part", F.col("base").alias("offset")))  # a row for each partition of recipes
    placed = recipes.join(bases, "part").select((F.col("base") + F.col("offset")).alias("start"), "doc_id", "n_tokens", "chunks", "lens")
    return placed.mapInArrow(run, "start long, doc_id long, n_tokens long, seq long, digest binary, after long")


_POLY = 0xEDB88320


def _shift_tables() -> np.ndarray:
    """[k, j]: what bit j of a CRC becomes behind 2**k zero bytes."""
    one = np.array([_POLY, *(1 << j for j in range(31))], np.uint32)  # one zero bit

    def square(m: np.ndarray) -> np.ndarray:
        out = np.zeros(32, np.uint32)
        for j in range(32):
            out ^= np.where(m >> np.uint32(j) & np.uint32(1), m[j], 0).astype(np.uint32)
        return out

    m, tables = square(square(square(one))), []
    for _ in range(48):
        tables.append(m)
        m = square(m)
    return np.array(tables)


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRCs behind n_bytes more bytes: the XOR of the shifted CRCs of its parts is a document's CRC."""
    out, left = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for table in _shift_tables():
        if not left.any():
            break
        on = left & 1 > 0
        v, s = out[on], np.zeros(int(on.sum()), np.uint32)
        for j in range(32):
            s ^= np.where(v >> np.uint32(j) & np.uint32(1), table[j], 0).astype(np.uint32)
        out[on] = s
        left >>= 1
    return out


def _shifted(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = crc_shift(b["crc"].to_numpy(zero_copy_only=False), 4 * b["after"].to_numpy(zero_copy_only=False))
            yield pa.record_batch([b["start"], b["doc_id"], b["n_tokens"], b["n"], pa.array(crc.astype(np.int64))], ["start", "doc_id", "n_tokens", "n", "crc"])

    return df.select("start", "doc_id", "n_tokens", "n", "crc", "after").mapInArrow(run, "start long, doc_id long, n_tokens long, n long, crc long")


def _joined(store: Store, blobs: bool) -> DataFrame:
    """Each chunk that a recipe names, with what the packs hold of it; a chunk that they lack is an error.

    Which chunks are hot is read off about HOT_SAMPLE recipes; that decides how rows travel, not what comes out.
    """
    n = store.roots.agg(F.sum("n_docs")).first()[0] or 0
    named = _named(store, store.recipes)
    share = min(1.0, HOT_SAMPLE / max(n, 1))
    some = _named(store, store.recipes.filter(F.pmod(F.xxhash64("part", "pos"), F.lit(1_000_000)) < share * 1_000_000)).groupBy("digest").agg(F.count(F.lit(1)).alias("refs"))
    some = materialize(some, "refs")
    total = some.agg(F.sum("refs")).first()[0] or 0
    hot = some.filter(F.col("refs") > max(1.0, total * HOT_SHARE)).select("digest")
    hot_places = store.index.join(F.broadcast(hot), "digest", "left_semi")
    found = lookup(named, "digest", _read_chunks(store.index, store, blobs), _read_chunks(hot_places, store, blobs))
    lost = F.raise_error(F.concat(F.lit("chunk "), F.lower(F.hex("digest")), F.lit(" is missing")))
    return found.withColumn("n", F.when(F.col("n").isNull(), lost.cast("long")).otherwise(F.col("n")))


def _checked(given: str, seen: str) -> Column:
    """The number of ids that a recipe gives, which must be the number seen."""
    bad = F.raise_error(F.concat(F.lit("a document has "), F.col(seen), F.lit(" ids, not "), F.col(given)))
    return F.when(F.col(given) == F.col(seen), F.col(given)).otherwise(bad.cast("long")).alias("n_tokens")


def facts(store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the stored files, verified against the manifest."""
    verify_recipes(store)
    per_doc = _shifted(_joined(store, blobs=False)).groupBy("start", "doc_id").agg(F.first("n_tokens").alias("given"), F.sum("n").alias("seen"), F.bit_xor("crc").alias("ids_crc32"))
    return per_doc.select("doc_id", "start", _checked("given", "seen"), "ids_crc32")


def read(store: Store) -> DataFrame:
    """(doc_id, start, ids binary): whole documents, little-endian unsigned 32-bit integers, verified as facts() does."""
    verify_recipes(store)
    parts = _joined(store, blobs=True).groupBy("start", "doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "blob"))).alias("parts"))
    return parts.select("doc_id", "start", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.blob))").alias("ids"))


def verify_recipes(store: Store) -> None:
    """Raise unless the recipes have the Merkle roots of the manifest, and these the store's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves = None, []
        for b in batches:
            for p, d, chunks in zip(*(b[c].to_pylist() for c in ("part", "doc_id", "chunks")), strict=True):
                if p != part and leaves:
                    yield pa.record_batch([pa.array([part], pa.int64()), pa.array([merkle(leaves)], pa.binary())], ["part", "root"])
                    leaves = []
                part = p
                leaves.append(leaf(d, chunks))
        if leaves:
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([merkle(leaves)], pa.binary())], ["part", "root"])

    # all of a part meets in one task, which holds a hash for each of its documents as the writer did
    again = store.recipes.select("part", "pos", "doc_id", "chunks").repartition("part").sortWithinPartitions("part", "pos")
    seen = {r.part: bytes(r.root) for r in again.mapInArrow(run, "part long, root binary").collect()}
    held = {r.part: bytes(r.root) for r in store.roots.collect()}
    if seen != held or merkle([held[p] for p in sorted(held)]) != store.root:
        raise ValueError(f"the recipes in {store.folder} are damaged: their Merkle roots are not those of the manifest")


def verify(store: Store) -> bool:
    """True if every chunk has its digest and the recipes have the Merkle roots of the manifest; an error if not."""
    _read_chunks(store.index, store, blobs=False).agg(F.count("digest")).collect()
    verify_recipes(store)
    return True
