import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from jobmosaic.llm import byte_bpe
from jobmosaic.llm.byte_bpe import Encoder, decode, decode_documents, encode_and_decode, encode_documents, merge_columns, merge_long, read_ranks, vocabulary
from jobmosaic.llm.token_counts import length_table, quantiles_of, suffix_sums, totals_at

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    return vocabulary(read_ranks(PATH), public_tokenizers.PATTERN)


def same(encoder, peer, texts):
    ids, counts = encoder.encode(texts)
    assert (encoder.lengths(texts) == counts).all()
    data, _ = decode(ids, counts, encoder.vocab)
    assert bytes(data) == "".join(texts).encode()
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == peer.encode_ordinary(text), repr(text)[:80]
        at += n


def test_every_code_point(vocab, peer):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    encoder = Encoder(vocab)
    for low in range(0, len(points), 60000):
        same(encoder, peer, [f"a {chr(c)}b  {chr(c)}{chr(c)}1 " for c in points[low : low + 60000]])


def test_random_and_long_texts(vocab, peer):
    rng = random.Random(7)
    letters = "aab'sdtlrevm  \n\t0129.,é中🎉 \x1c\x1f\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(1500)]
    texts += ["a" * n for n in (1, 2, 3, 31, 32, 33, 63, 64, 65, 66, 127, 129, 1000, 20001)] + [" " * 500, "\n" * 300 + "x", "abc" * 50000, ""]
    same(Encoder(vocab, kept=100), peer, texts)
    same(Encoder(vocab, kept_chars=100), peer, texts)


def test_columns_and_long_tree_agree(vocab):
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"aehinorst") for _ in range(rng.randrange(2, 65))) for _ in range(400)]
    ids, counts = merge_columns(pieces, 64, vocab)
    at = 0
    for piece, n in zip(pieces, counts, strict=True):
        assert ids[at : at + n].tolist() == merge_long(piece, vocab)
        at += n


def test_documents(spark, peer, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoded = encode_documents(docs, PATH, public_tokenizers.PATTERN)
    both = {r.doc_id: (r.token_ids, bytes(r.decoded)) for r in decode_documents(encoded, PATH, public_tokenizers.PATTERN).collect()}
    rows = docs.collect()
    assert len(both) == len(rows)
    for r in rows:
        assert both[r.doc_id] == (peer.encode_ordinary(r.text), r.text.encode())
    once = encode_and_decode(docs, PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: (r.token_ids, bytes(r.decoded)) for r in once.collect()} == both


def test_query_digests(spark, peer):
    from jobmosaic.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op7_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = peer.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    schema = "doc_id string, text string, id int, token_ids string, length long"
    rows = [(None, None, 1, None, None), ("a", "", 1, "x", 3), ("b", "hi hi", None, None, None), ("b", "hi hi", None, None, None), ("c", "x" * 300000, 1, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = decode_documents(encode_documents(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or "", bytes(r.decoded).decode()) for r in got) == sorted((r[0] or "", r[1] or "") for r in rows)
    empty = spark.createDataFrame([], schema)
    assert decode_documents(encode_documents(empty, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).count() == 0
    assert length_table(empty, PATH, public_tokenizers.PATTERN).count() == 0
    table = length_table(df, PATH, public_tokenizers.PATTERN)
    assert table.agg({"n_docs": "sum"}).first()[0] == 5 and table.filter("length = 0").first().n_docs == 2


def test_length_table_against_brute_force(spark, peer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lengths = [len(peer.encode_ordinary(r.text)) for r in docs.select("text").collect()]
    table = length_table(docs, PATH, public_tokenizers.PATTERN)
    got = {r.length: r for r in table.collect()}
    assert sorted(got) == sorted(set(lengths))
    for limit, r in got.items():
        upto = [x for x in lengths if x <= limit]
        assert (r.n_docs, r.docs_upto, r.tokens_upto, r.docs_cut) == (lengths.count(limit), len(upto), sum(upto), len(lengths) - len(upto))
        assert r.truncated_tokens == sum(min(x, limit) for x in lengths) and r.share_upto == len(upto) / len(lengths)
    limits = [0, 1, 77, 512, 2048, 10**6]
    for r in totals_at(table, limits).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in lengths) and r.docs_cut == sum(x > r.context_limit for x in lengths)
    for r in quantiles_of(table, [0.01, 0.5, 0.9, 1.0]).collect():
        assert r.length == min(x for x in lengths if sum(y <= x for y in lengths) / len(lengths) >= r.share)


def test_suffix_sums_do_not_depend_on_blocks(spark):
    histogram = spark.createDataFrame([(n * n % 97, n % 5 + 1) for n in range(40)], "length long, n_docs long").groupBy("length").agg({"n_docs": "sum"}).toDF("length", "n_docs")
    first = sorted(map(tuple, suffix_sums(histogram, 1).collect()))
    assert first == sorted(map(tuple, suffix_sums(histogram, 7).collect())) == sorted(map(tuple, suffix_sums(histogram, 1000).collect()))
