"""Token counts from flat files of ids that have no index: find end-of-document ids, then stitch the blocks.

A file is read in blocks by byte range. Within a block the separators are found by one vectorised comparison;
a block's row has the places of its separators, four bytes each. A prefix scan over the blocks of each file, which
sees their counts only, gives the number of separators and the last of them before the block. That is all that the
first document of a block needs; the worker then emits a block's documents in batches of bounded size.

Defined results: a document has the ids before its separator, perhaps none; ids after the last separator of a
file are an unterminated document (terminated = false), unless there are none; an empty file has no documents.
For write(): a null or empty text is a document without ids; null and repeated doc_ids pass through; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, materialize, shared_dir
from .flat_files import Rotating, open_fs

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The tokenizer's free id, which no text has.
END_ID = 50256
DTYPE = "<u2"
FILE_BYTES, BLOCK_BYTES = 256 << 20, 4 << 20
#: Rows of a batch that a task emits: what it holds of a block's documents at a time.
EMIT_ROWS = 1 << 15


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write(docs: DataFrame, folder: str, ranks_path: str = DEFAULT_RANKS, end_id: int = END_ID, dtype: str = DTYPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of each text, then end_id, to flat files; (file, doc_index, doc_id) says which document is where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = _encoding(ranks_path), Rotating(folder, "ids", FILE_BYTES)
        end, count, last = np.array([end_id], dtype).tobytes(), 0, ""
        for b in batches:
            files, places = [], []
            for t in b["text"]:
                name, _ = out.write(np.array(enc.encode_ordinary(t.as_py()), dtype).tobytes() + end)
                count = count + 1 if name == last else 0
                last = name
                files.append(name), places.append(count)
            yield pa.record_batch([pa.array(files, pa.string()), pa.array(places, pa.int64()), b["doc_id"]], ["file", "doc_index", "doc_id"])
        out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(id_text(docs, id_col, text_col).mapInArrow(run, f"file string, doc_index long, doc_id {kind}"), "manifest")


def blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(file, block, offset, n_bytes) of all files in a folder, and the number of its partitions; only names and sizes are listed."""
    from pyarrow.fs import FileSelector

    fs, path = open_fs(folder)
    found = [(f.base_name, f.size) for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.is_file]
    files = spark.createDataFrame(found, "file string, size long").filter("size > 0")
    numbered = files.select("file", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_bytes).cast("int"))).alias("block"))
    at = F.col("block").cast("long") * block_bytes
    tasks = max(1, min(100_000, sum(s for _, s in found) // (8 * block_bytes) + 1, len(found) * (1 + FILE_BYTES // block_bytes)))
    return numbered.select("file", "block", at.alias("offset"), F.least(F.lit(block_bytes), F.col("size") - at).alias("n_bytes")).repartition(tasks, "file", "block"), tasks


def scan(spark: SparkSession, folder: str, end_id: int = END_ID, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, doc_index, start, n_tokens, terminated) of every document in the files of a folder; start counts ids from the file's begin."""
    width = np.dtype(dtype).itemsize
    if block_bytes % width:
        raise ValueError("block_bytes must be a multiple of the ids' width")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for b in batches:
            for name, block, at, size in zip(*(b[c].to_pylist() for c in ("file", "block", "offset", "n_bytes")), strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    ids = np.frombuffer(f.read_at(size, at), dtype, count=size // width)
                stops = np.flatnonzero(ids == end_id)
                last = at // width + int(stops[-1]) if len(stops) else None
                row = [pa.array([name], pa.string()), pa.array([block], pa.int32()), pa.array([at // width], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(stops)], pa.int64()), pa.array([last], pa.int64())]
                yield pa.record_batch([*row, pa.array([stops.astype("<u4").tobytes()], pa.binary())], ["file", "block", "first", "n_ids", "n_stops", "last_stop", "stops"])

    listed, tasks = blocks(spark, folder, block_bytes)
    found = materialize(listed.mapInArrow(find, "file string, block int, first long, n_ids long, n_stops long, last_stop long, stops binary"), "stops")
    # the prefix scan: one short row for each block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select(
        "file",
        "block",
        F.coalesce(F.sum("n_stops").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last_stop").over(before), F.lit(-1)).alias("stop_before"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("is_last"),
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "doc_index", "start", "n_tokens", "terminated"]
        for b in batches:
            for name, first, n_ids, docs_before, stop_before, is_last, stops in zip(*(b[c].to_pylist() for c in ("file", "first", "n_ids", "docs_before", "stop_before", "is_last", "stops")), strict=True):
                at = first + np.frombuffer(stops, "<u4").astype(np.int64)
                begin = np.concatenate([[stop_before + 1], at + 1])
                # a file's last block may leave ids behind its last separator
                if is_last and first + n_ids > begin[-1]:
                    at = np.append(at, first + n_ids)
                done = len(stops) // 4
                for k in range(0, len(at), EMIT_ROWS):
                    stop, start = at[k : k + EMIT_ROWS], begin[: len(at)][k : k + EMIT_ROWS]
                    place = np.arange(k, k + len(stop))
                    yield pa.record_batch([pa.array([name] * len(stop), pa.string()), pa.array(docs_before + place), pa.array(start), pa.array(stop - start), pa.array(place < done)], names)

    # by number, so that many separators in few bytes still spread over tasks
    stitched = found.select("file", "block", "first", "n_ids", "stops").repartition(tasks, "file", "block").join(sums.repartition(tasks, "file", "block").hint("merge"), ["file", "block"])
    return stitched.mapInArrow(emit, "file string, doc_index long, start long, n_tokens long, terminated boolean")


def count_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_index, start, n_tokens): flat files are written from docs, and the counts come from the files alone."""
    folder = f"{shared_dir(docs.sparkSession)}/ids"
    manifest = write(docs, folder)
    return manifest.join(scan(docs.sparkSession, folder), ["file", "doc_index"]).select("doc_id", "doc_index", "start", "n_tokens")
