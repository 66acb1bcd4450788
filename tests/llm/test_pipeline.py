import base64
import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from jobmosaic.llm.co_training import score_quality
from test_simhash import alike
from test_source_mix import brute_targets


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, sf), "test")
        out.append(now)
    assert all(x.columns == docs.columns for x in out[:-1])
    rows = [x.collect() for x in out]

    kept = {r.doc_id for r in score_quality(docs, labels).collect() if r.kept}
    assert {r.doc_id for r in rows[0]} == kept and len(rows[0]) == len(kept)

    least = {}
    for r in rows[0]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in rows[1]) == sorted(least.values())

    assert sorted(r.doc_id for r in rows[2]) == sorted(set(alike({r.doc_id: r.text for r in rows[1]}).values()))

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows[2]}
    source = {r.doc_id: r.source for r in rows[2]}
    times = Counter(r.doc_id for r in rows[3])
    totals, taken, largest = Counter(), Counter(), Counter()
    for d, n in size.items():
        totals[source[d]] += n
        taken[source[d]] += n * times[d]
        largest[source[d]] = max(largest[source[d]], n)
    want = brute_targets(dict(totals))
    assert set(times) <= set(size) and max(times.values()) <= 2
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in totals)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.VOCABULARY, "rb"))}
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in rows[2]}
    assert Counter(r.doc_id for r in rows[4]) == times
    for r in rows[4]:
        assert r.token_ids == peer.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_has_the_rows_of_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
