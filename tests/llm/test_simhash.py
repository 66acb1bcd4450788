import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from jobmosaic.llm import simhash
from jobmosaic.llm.simhash import BANDS, able_nodes, as_similar, as_similar_to, ask, band_keys, build_tree, checked_links, distinct_shingles, drop_near_copies, fingerprint, links_within, nearest, similar_components, simhash_components, tree_links, wide_fingerprint, wide_radius


def slow_shingles(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    return [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)] if parts else []


def slow_wide(text, words=5):
    """The 512 bits as a number, the first byte the most significant."""
    most = 2**64 - 1
    hashes = {xxhash.xxh64_intdigest(s.encode(), 42) for s in slow_shingles(text, words)}
    value = 0
    for lane in range(1, 9):
        mixed = []
        for h in hashes:
            x = (h + lane * 0x9E3779B97F4A7C15) & most
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
            x = (x ^ x >> 27) * 0x94D049BB133111EB & most
            mixed.append(x ^ x >> 31)
        for b in (8 * byte + bit for byte in range(8) for bit in range(7, -1, -1)):
            value = value << 1 | (2 * sum(x >> b & 1 for x in mixed) > len(mixed))
    return value


def slow_fingerprint(text, words=3):
    shingles = slow_shingles(text, words)
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def near(a, b, radius):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= radius


def components(ids, marks, radius, linked=near):
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(marks[i], marks[j], radius):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, d in enumerate(ids)}


def test_fingerprint():
    for text in [None, "", " \n", "One", "a b", "A b\tC d", "x\x1fy z w", "Größe   a b c", "a b c " * 40000]:
        assert fingerprint(text, 3) == slow_fingerprint(text)


def test_tree_spans_components():
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for s in seeds for _ in range(12)})
    links = tree_links(np.array(values, np.uint64)[:, None], 2)
    assert all(bin(values[a] ^ values[b]).count("1") <= 2 for a, b in links) and len(links) < len(values)
    want = components(range(len(values)), values, 2)
    got = list(range(len(values)))
    for _ in range(len(values)):
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
    assert dict(enumerate(got)) == want


def test_tree_is_keyed_by_distance_and_finds_all(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(512) for _ in range(4)]
    values = list({rng.choice(base) ^ sum(1 << rng.randrange(512) for _ in range(rng.randrange(90))) for _ in range(300)})
    marks = np.frombuffer(b"".join(v.to_bytes(64, "little") for v in values), np.uint64).reshape(len(values), 8)
    far = lambda a, b: bin(values[a] ^ values[b]).count("1")
    tree = build_tree(marks)
    assert sorted(tree.order.tolist()) == list(range(len(values)))
    for at, edges in enumerate(tree.edges):
        assert len({e for e, _ in edges}) == len(edges) and sum(tree.last[c] - c for _, c in edges) == tree.last[at] - at - 1
        assert all(far(tree.order[at], x) == e for e, c in edges for x in tree.order[c : tree.last[c]])
    radius = 60
    own = np.array([i % 7 for i in range(len(values))])
    got = {(int(q), n): int(d) for n, near, ds in ask(tree, own, radius) for q, d in zip(near, ds, strict=True)}
    assert got == {(a, b): far(a, b) for a in range(len(values)) for b in range(len(values)) if own[a] != own[b] and far(a, b) <= radius}
    who, to = nearest(marks, np.full(len(values), 10), own, radius, 0.8)
    least = {a: min(d for (q, _), d in got.items() if q == a) for a in {q for q, _ in got}}
    assert set(who.tolist()) == set(least) and all(own[a] != own[b] and far(a, b) == least[a] for a, b in zip(who.tolist(), to.tolist(), strict=True))
    assert len(nearest(marks, np.array([10 ** (i % 2) for i in range(len(values))]), np.arange(len(values)) % 2, radius, 0.8)[0]) == 0


def edited(rng, words, share):
    """Words with about that share of their shingles of five words changed."""
    words = list(words)
    for at in rng.sample(range(len(words)), round(len(words) * share / 5)):
        words[at] = f"e{rng.random()}"
    return words


def similarity(a, b):
    x, y = set(slow_shingles(a, 5)), set(slow_shingles(b, 5))
    return len(x & y) / len(x | y)


def test_wide_fingerprint():
    rng = random.Random(2)
    for text in [None, "", " \n", "One", "a b", "A b\tC d", "Größe   a b c d e f g h", "a b c " * 50, " ".join(str(rng.random()) for _ in range(600))]:
        assert int.from_bytes(wide_fingerprint(distinct_shingles(text, 5)), "big") == slow_wide(text)


def alike(texts, least=0.8):
    """Component of each text by all pairs of that similarity of the shingle sets; texts without words are all one."""
    sets = [set(slow_shingles(t, 5)) for t in texts.values()]
    linked = lambda a, b, _: len(a & b) >= least * len(a | b)
    return components(list(texts), sets, None, linked)


def named(spark, texts, **more):
    return {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **more).collect()}


def test_bands_find_pairs(spark):
    rng = random.Random(12)
    for least, share in ((0.8, 0.99), (0.9, 1.0)):
        hits = total = 0
        while total < 300:
            words = [str(rng.randrange(5000)) for _ in range(rng.randrange(150, 400))]
            a, b = " ".join(words), " ".join(edited(rng, words, rng.uniform(0.05, 0.12) if least == 0.8 else 0.05))
            if least <= similarity(a, b) < least + 0.02:
                x, y = (band_keys(distinct_shingles(t, 5)) for t in (a, b))
                total += 1
                hits += bool((x == y).any())
        assert len(x) == BANDS and hits >= share * total


def test_similar_texts_against_all_pairs(spark):
    """Precision and recall by similarity: pairs made at 0.7 to 1, groups whose ends are less similar, copies and odd ones."""
    rng = random.Random(4)
    texts, at = {9000: None, 9001: "", 9002: "word", 9003: "word", 9004: "Word", 9005: "two words", 9006: "word " * 30}, 0
    for k in range(120):
        words = [str(rng.randrange(5000)) for _ in range(rng.randrange(150, 400))]
        for n in range(2 + 6 * (k % 20 == 0)):
            texts[at] = " ".join(edited(rng, words, rng.uniform(0.01, 0.14)) if n else words)
            at += 1
    want, got = alike(texts), named(spark, texts)
    assert got == want and want[9001] == 9000 and want[9004] == want[9003] == 9002 and 50 < len(set(want.values())) < 0.8 * len(texts)


def test_near_copies_of_repeated_and_null_ids(spark):
    """A row goes by its id and text, not by its id; of rows without an id one stays, if no other does."""
    rng = random.Random(8)
    base, lone, other = (" ".join(str(rng.randrange(5000)) for _ in range(200)) for _ in range(3))
    rows = [(1, base), (5, base + " word"), (5, lone), (None, base + " more"), (None, other), (None, other + " x"), (7, None), (8, ""), (None, ""), (9, "short"), (9, "short")]
    kept = drop_near_copies(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, __gone string"))
    assert kept.columns == ["doc_id", "text", "__gone"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    one = [x for x in got if x[0] is None]
    assert len(one) == 1 and one[0][1] in (other, other + " x")
    assert [x for x in got if x[0] is not None] == [(1, base), (5, lone), (7, None), (9, "short"), (9, "short")]


def test_sets_met_at_once():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 300, n).astype("<u8")).tobytes() for n in (1, 5, 200, 210, 220, 250)]
    for a in sets:
        for share in (0.1, 0.5, 1.0):
            assert as_similar_to(a, sets, share).tolist() == [as_similar(a, b, share) for b in sets]


def test_texts_of_one_template_are_told_apart_without_pairs(spark, monkeypatch):
    """300 words of a template and 45 own ones (0.75 to each other), some with a near copy: no pair of two originals is compared twice over."""
    rng = random.Random(10)
    template = [str(rng.randrange(10**6)) for _ in range(300)]
    texts = {}
    for i in range(150):
        own = [f"w{i}x{k}" for k in range(45)]
        texts[2 * i] = " ".join(template + own)
        if i % 10 == 0:
            texts[2 * i + 1] = " ".join(template + own[:-1] + ["last"])
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_components(rows, shard=32).collect()}
    assert got == {i: i - i % 2 for i in texts}
    sets = spark.createDataFrame([(i, bytearray(distinct_shingles(t, 5).astype("<u8").tobytes())) for i, t in texts.items()], "node long, hashes binary")
    nodes = spark.createDataFrame([(i, i - i % 2, len(distinct_shingles(t, 5))) for i, t in texts.items()], "node long, root long, size long")
    assert {r.able: r.both for r in able_nodes(nodes, sets, 0.8).collect()} == {i: 296 for i in texts}
    apart = nodes.selectExpr("node", "node AS root", "size")
    assert {r.able: r.both for r in able_nodes(apart, sets, 0.8).collect()} == {i: 340 if i % 20 < 2 else 296 for i in texts}
    assert able_nodes(apart, sets, 0.9).count() == 2 * 15


def test_pairs_of_one_template_are_not_met(monkeypatch):
    met = []
    monkeypatch.setattr(simhash, "as_similar_to", lambda one, others, share: met.extend(others) or as_similar_to(one, others, share))
    sets = [np.sort(np.r_[np.arange(300), 1000 * i + 500 + np.arange(45)]).astype("<u8") for i in range(1, 40)] + [np.sort(np.r_[np.arange(300), 1500 + np.arange(44)]).astype("<u8")]
    marks = np.array([np.frombuffer(wide_fingerprint(s), np.uint64) for s in sets])
    sizes, root, both = np.array([len(s) for s in sets]), np.arange(40), np.array([344] + [300] * 38 + [344])
    raw = np.array([*[s.tobytes() for s in sets], None], object)[:-1]
    links = checked_links(marks, sizes, root, np.zeros((40, 14), np.int64), 0, both, raw, wide_radius(0.8), 0.8)
    assert sorted(map(sorted, links)) == [[0, 39]] and len(met) == 1


def test_given_texts_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, got = alike(dict(docs.select("doc_id", "text").collect())), {r.doc_id: r.component_id for r in similar_components(docs).collect()}
    assert got == want and len(set(want.values())) < len(want) - 50


def test_overfull_shards_lose_no_link(spark):
    """Families of variants of one text: near it, but under 0.8 to each other, or in chains; shards are cut into blocks of four."""
    rng = random.Random(7)
    texts = {}
    for family, (share, size) in enumerate([(0.05, 30), (0.09, 30), (0.12, 20)]):
        words = [str(rng.randrange(5000)) for _ in range(300)]
        for n in range(size):
            texts[1000 * family + n] = " ".join(edited(rng, words, share if n else 0))
    for n in range(12):
        texts[5000 + n] = " ".join(edited(rng, texts[4999 + n].split() if n else [str(rng.randrange(5000)) for _ in range(300)], 0.1))
    texts |= {9000 + k: " ".join(str(rng.random()) for _ in range(50)) for k in range(40)}
    want = alike(texts)
    assert 43 < len(set(want.values())) < 75 and want[5011] == 5000
    assert named(spark, texts, shard=8) == want


def test_large_shards_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    for radius in (1, 2, 3):
        values = {base}
        while len(values) < 300:
            v = rng.choice(sorted(values))
            for _ in range(rng.randrange(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
        rows = [(v - (1 << 64) if v >> 63 else v,) for v in values]
        links = links_within(spark.createDataFrame(rows, "fp long"), radius, shard=5).collect()
        ids = [r[0] for r in rows]
        want = components(ids, ids, radius)
        label = {i: i for i in ids}
        for _ in range(len(ids)):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        assert label == want


def test_components_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()
    rng = random.Random(1)
    rows = [(r.doc_id, r.text, "x") for r in docs]
    for k in range(60):
        words = rng.choice(docs).text.split(" ")
        words[rng.randrange(len(words))] = "zz"
        rows.append((1000 + k, " ".join(words), "y"))
    rows += [(2000, None, "n"), (2001, "", "n"), (2002, " \t", "n"), (2003, "word", "n"), (2004, "word", "n")]
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    marks = [slow_fingerprint(t) for _, t, _ in rows]
    want = components([r[0] for r in rows], marks, 2)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp for r in got} == dict(zip([r[0] for r in rows], marks, strict=True))
    assert want[2001] == want[2002] == 2000 and want[2004] == 2003


def test_edges(spark):
    schema = "doc_id long, text string, id string, fp int, key string"
    assert simhash_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", None, 1, "k"), (7, "a b c", "q", None, None), (7, "a b c", "q", 2, None), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash_components(df).collect())
    assert got == [(0, 7), (7, 7), (7, 7), (9, 9)]
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert kept.filter(F.col("doc_id") == 7).count() == 2 and kept.filter(F.col("doc_id") == 9).count() == 1
