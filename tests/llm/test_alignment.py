import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jobmosaic.llm.alignment import Tokenizers, aligned_batches, cross_align, frequent_pairs, pair_counts, align_documents, read_model
from jobmosaic.llm.queries import op13_tokenizer_alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Rows of the result, by comparing the byte ranges of all tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    entries = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def ranges(ids, token):
        at, found = 0, []
        for i in ids:
            found.append((i, at, at := at + len(token(i))))
        return found

    of_a = lambda i: bytes(byte[c] for c in entries[i])
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    linked, told, seen = [], [], Counter()
    for _, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = b" " + (text or "").encode()
        if not text or b"".join(map(of_a, ids_a)) != raw or b"".join(map(of_b, ids_b)) != raw:
            linked.append(Counter())
            told.append((0, 0, 0, 0, ""))
            continue
        ra, rb = ranges(ids_a, of_a), ranges(ids_b, of_b)
        links, low = Counter(), 0
        for i, s, e in ra:
            while low < len(rb) and rb[low][2] <= s:
                low += 1
            k = low
            while k < len(rb) and rb[k][1] < e:
                links[i, rb[k][0]] += 1
                k += 1
        ends = sorted({e for *_, e in ra} & {e for *_, e in rb})
        names, start = [], 0
        for end in ends:
            names.append(",".join(str(i) for i, s, e in ra if start <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in rb if start <= s and e <= end) if len(ra) < 3000 else "")
            start = end
        linked.append(links)
        seen.update(links.keys())
        told.append((len(ra), len(rb), len(ends), sum(links.values()), hashlib.sha256(";".join(names).encode()).hexdigest() if len(ra) < 3000 else None))
    best = Counter()
    for (i, _), n in seen.items():
        best[i] = max(best[i], n)
    result = []
    for (doc, _), links, (na, nb, ng, nl, sha) in zip(rows, linked, told, strict=True):
        result.append((doc, na, nb, ng, nl, sum(t for p, t in links.items() if seen[p] == best[p[0]]), sum(t * seen[p] for p, t in links.items()), sha))
    return result


def check(got, rows):
    want = brute(rows)
    skip = {w[:7] for w in want if w[7] is None}  # groups of very long texts aren't told a second time
    told = Counter(tuple(r[c] for c in COLUMNS[:7]) + (None if tuple(r[c] for c in COLUMNS[:7]) in skip else r["groups_sha256"],) for r in got)
    assert told == Counter(want)


@pytest.fixture(scope="module")
def tools():
    return Tokenizers(read_model(A), read_model(B))


def test_identity_map(tools):
    assert tools.can_cut
    there = np.flatnonzero(tools.same >= 0)
    assert len(there) > 5000
    assert all(tools.bytes_a.tokens[i] == tools.bytes_b.tokens[tools.same[i]] for i in there.tolist())
    missing = {tools.bytes_a.tokens[i] for i in np.flatnonzero(tools.same < 0).tolist()} & set(tools.bytes_b.tokens[3:])
    assert not missing


CASES = [
    (7, "▁ a piece mark"),
    (1, "Hello world, it's a test of tokenization."),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "two  spaces   and\ttabs\r\nand lines"),
    (6, "ﬁne ligature"),  # B's own reading of it may differ
    (8, "日本語のテキスト и русский текст 🙂 <|endoftext|> <s> </s> <unk> <0x41>"),
    (9, "é é café ﬀ"),
    (10, "abababababab" * 9),
    (10, "abababababab" * 9),
    (11, "tokenization tokenization tokenizers"),
    (None, "no id here"),
    (12, "\x00\x01 zero"),
    (13, "x" * 3000),
]


def test_small_cases(spark):
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in CASES], "doc_id long, text string, row long, pairs string")
    for frequent in (1 << 17, 3, 0):  # with all, some and no pairs at hand
        check(cross_align(df, A, B, frequent=frequent).collect(), CASES)


def test_long_texts_are_cut_at_words_only(tools):
    rng = random.Random(1)
    words = ["alpha", "Beta's", "can't", "don’t", "ünder", "x1", "--", "a", "GPT", "wörter", "\n", "I", "日本", "  "]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 4000, 30, 2500)] + ["y" * 4000, "a ﬁ" + " word" * 900]
    own = pa.array(range(len(texts)), pa.int64())
    whole = pa.Table.from_batches(list(aligned_batches(tools, own, texts))).sort_by("own")
    parts = pa.Table.from_batches(list(aligned_batches(tools, own, texts, unit=700))).sort_by("own")
    assert len(tools.units(texts, 700)) > 20
    assert whole.to_pylist() == parts.to_pylist()


def test_counts_in_a_task_handed_over_early(spark, monkeypatch, tools):
    monkeypatch.setattr("jobmosaic.llm.alignment.KEPT_PAIRS", 1)
    aligned = align_documents(spark.createDataFrame(CASES, "doc_id long, text string"), A, B)
    counts = pair_counts(aligned, tools.size_a, tools.size_b, tools.same)
    rows = {r.pair: r.n for r in counts.collect()}
    pairs, n = frequent_pairs(counts, 40)
    assert 0 < len(pairs) <= 40 and (np.diff(pairs) > 0).all()
    assert [rows[p] for p in pairs.tolist()] == n.tolist() and min(n) > max((m for p, m in rows.items() if p not in set(pairs.tolist())), default=0)


def test_empty_table(spark):
    got = cross_align(spark.createDataFrame([], "doc_id int, text string"), A, B)
    assert got.columns == COLUMNS and dict(got.dtypes)["doc_id"] == "int" and got.collect() == []


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op13_tokenizer_alignment(spark, SF)
    assert got.columns == COLUMNS and all(t == "bigint" for n, t in got.dtypes if n != "groups_sha256")
    check(got.collect(), rows)
