import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ontoloom.llm import byte_bpe, content_store, queries, separator_scan, word_encoder

ODD = ["", " ", "\x1c\x1d a", "  x  y\n\n z\t", "don't we'll  I'M", "naïve 12345 ﬁ ½", "<|endoftext|>", "abc <|endoftext|> def", "x<|EndOfText|>y", "<|startoftext|><|endoftext|>.", "a<|endoftext|", "a b　c", "x" * 3000, "日本語 テスト", "a\nb c", "a \nb", "👍🏽 ok", "a$$$ b### c!!", "ΑΣ İ ẞ"]


@pytest.fixture(scope="module")
def tk():
    c = byte_bpe.codec()
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("text", ODD)
def test_byte_bpe_is_tiktoken(tk, text):
    c = byte_bpe.codec()
    ids = c.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tk.encode_ordinary(text) and c.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_byte_bpe_on_any_text(text):
    c = byte_bpe.codec()
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert np.frombuffer(c.encode(text), "<u4").tolist() == t.encode_ordinary(text)


def test_caches_of_any_size_give_the_same(tk):
    c = byte_bpe.Codec()
    c.words, c.pieces, c.tokens = byte_bpe.Cache(2), byte_bpe.Cache(2), byte_bpe.Cache(2)
    text = "one two, three.\nfour two, one; five$$$ six two"
    assert np.frombuffer(c.encode(text), "<u4").tolist() == tk.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(2000)]
    h = byte_bpe.PerfectHash(keys, list(range(2000)))
    assert [h.get(k) for k in keys] == list(range(2000)) and len(h.keys) == 2000 and h.get(b"none") == -1
    assert byte_bpe.PerfectHash([], []).get(b"x") == -1


def test_op9(spark, docs, empty, tk):
    got = {r.doc_id: r for r in byte_bpe.digests(docs).collect()}
    for r in docs.collect():
        ids = np.array(tk.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert byte_bpe.digests(empty).count() == 0
    enc = byte_bpe.encode(docs)
    assert enc.filter("NOT round_trip").count() == 0
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode(enc).collect()} == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


@pytest.mark.parametrize("text", ODD)
def test_word_encoder_is_the_library(words, text):
    e = word_encoder.word_encoder()
    assert e.by_word and np.frombuffer(e.encode(text), e.dtype).tolist() == words.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_word_encoder_on_any_text(words, text):
    e = word_encoder.word_encoder()
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == words.encode(text, add_special_tokens=False).ids


def _expected(rows, words):
    out, start = {}, 0
    for d, t in sorted(rows):
        ids = np.array([*words.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out[d] = (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    return out


def test_op7(spark, docs, empty, words):
    store = content_store.write(docs)
    want = _expected([(r.doc_id, r.text) for r in docs.collect()], words)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in content_store.facts(store).collect()} == {d: v[:3] for d, v in want.items()}
    assert {r.doc_id: bytes(r.ids) for r in content_store.read(store).collect()} == {d: v[3] for d, v in want.items()}
    assert content_store.verify(store)
    assert store.index.count() == store.index.select("digest").distinct().count()
    assert content_store.facts(content_store.write(empty)).count() == 0
    again = content_store.facts(content_store.write(docs.filter("doc_id < 3").unionByName(docs.filter("doc_id < 3")))).collect()
    assert len(again) == 4 and len({r.start for r in again}) == 4


def _facts(store):
    return sorted(tuple(r) for r in content_store.facts(store).select("doc_id", "start", "n_tokens", "ids_crc32").collect())


def test_a_store_is_opened_again(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    store = content_store.write(docs, folder=folder)
    again = content_store.Store.open(spark, folder)
    assert again.root == store.root and again.dtype == store.dtype and _facts(again) == _facts(store) and content_store.verify(again)


def test_store_detects_damage(spark, docs, tmp_path):
    from ontoloom.llm.flat_files import open_fs

    store = content_store.write(docs)
    recipes = store.recipes
    for bad in (recipes.filter("doc_id <> 7"), recipes.withColumn("chunks", F.expr("if(doc_id = 7, concat(chunks, chunks), chunks)")), recipes.withColumn("doc_id", F.expr("if(doc_id = 7, 77, doc_id)"))):
        store.recipes = bad
        with pytest.raises(ValueError, match="damaged"):
            content_store.facts(store)
    store.recipes = recipes.withColumn("n_tokens", F.col("n_tokens") + 1)
    with pytest.raises(Exception, match="ids, not"):
        _facts(store)
    store.recipes, index = recipes, store.index
    store.index = index.filter(F.col("digest") != index.first()["digest"])
    with pytest.raises(Exception, match="is missing"):
        _facts(store)
    store.index = index
    fs, path = open_fs(store.folder)
    with fs.open_output_stream(f"{path}/packs/{index.first()['pack']}") as f:
        f.write(bytes(100_000))
    with pytest.raises(Exception, match="damaged"):
        content_store.verify(store)


def test_hot_chunks(spark, words):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 3 = 0 THEN 'the same words again' WHEN id % 7 = 0 THEN NULL ELSE concat('text ', id) END").alias("text"))
    want = _expected([(r.doc_id, r.text) for r in df.collect()], words)
    assert {r[0]: r[1:] for r in _facts(content_store.write(df))} == {d: v[:3] for d, v in want.items()}


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    gear = content_store.gear_table(1 << 16)
    a = rng.integers(0, 1 << 16, 20_000)
    one = content_store.cuts(a, np.array([len(a)]), gear)
    moved = np.concatenate([a[:50], [7, 7, 7], a[50:]])
    two = content_store.cuts(moved, np.array([len(moved)]), gear) - 3
    assert len(set(one.tolist()) & set(two.tolist())) > 0.8 * len(one)
    sizes = np.diff(np.concatenate([[0], one]))
    assert sizes.max() <= content_store.MOST and (sizes[:-1] >= content_store.LEAST).all()


def test_crcs_combine():
    rng = np.random.default_rng(2)
    parts = [rng.bytes(n) for n in (5, 0, 70_000, 1)]
    after = np.cumsum([0, *(len(p) for p in parts[::-1])])[:-1][::-1]
    got = np.bitwise_xor.reduce(content_store.crc_shift(np.array([zlib.crc32(p) for p in parts]), after))
    assert got == zlib.crc32(b"".join(parts))


def test_op6(spark, docs, empty, tk, sf):
    got = {r.doc_id: r.n_tokens for r in separator_scan.count_documents(docs).collect()}
    assert got == {r.doc_id: len(tk.encode_ordinary(r.text or "")) for r in docs.collect()}
    assert separator_scan.count_documents(empty).count() == 0
    assert queries.QUERIES["op6_token_counts"](spark, sf).count() == 200


@pytest.mark.parametrize("block", [2, 4, 6, 64])
def test_scan_stitches_blocks(spark, tmp_path, block):
    end = 50256
    rng = np.random.default_rng(block)
    files = {"a": [1, 2, end, end, 3, 4, 5, 6, 7, 8, 9, end, 1], "b": [], "c": [end], "d": [5], "e": [end if x < 2 else x for x in rng.integers(0, 9, 50).tolist()]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    want = []
    for name, ids in files.items():
        start = k = 0
        for i, x in enumerate(ids):
            if x == end:
                want.append((name, k, start, i - start, True))
                start, k = i + 1, k + 1
        if start < len(ids):
            want.append((name, k, start, len(ids) - start, False))
    assert sorted(tuple(r) for r in separator_scan.scan(spark, str(tmp_path), block_bytes=block).collect()) == want


def test_scan_of_very_short_documents(spark, tmp_path):
    """A million documents of one id, in blocks of 4 MB and in small ones, against a brute scan; memory stays bounded by the block."""
    n = 1_000_000
    ids = np.full(2 * n, 50256, "<u2")
    ids[::2] = 7
    (tmp_path / "short").write_bytes(ids.tobytes())
    (tmp_path / "only").write_bytes(np.full(50_000, 50256, "<u2").tobytes())
    for block in (4 << 20, 1 << 16):
        got = separator_scan.scan(spark, str(tmp_path), block_bytes=block)
        want = [("only", 50_000, 50_000 * 49_999 // 2, 50_000 * 49_999 // 2, 0, 0, 50_000), ("short", n, n * (n - 1) // 2, n * (n - 1), 1, 1, n)]
        sums = got.groupBy("file").agg(F.count("*"), F.sum("doc_index"), F.sum("start"), F.min("n_tokens"), F.max("n_tokens"), F.count_if("terminated"))
        assert sorted(tuple(r) for r in sums.collect()) == want
        assert got.filter("file = 'short' AND start <> 2 * doc_index").count() == 0
