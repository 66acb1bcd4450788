import random
import time

from pyspark.sql import functions as F

from jobmosaic.functions.rules import COMPANY_NOISE, plain
from jobmosaic.functions.text import company_identity, fingerprint, normalize
from jobmosaic.functions.joins import parts_of
from jobmosaic.operators.dedupe import containments, dedupe_full, distinct_names, first_of_term, merge_in_order, same_company_classes, same_company_pairs

SCHEMA = "ord long, source string, external_id string, title string, company string, description string, search_term string"


def prepared(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"norm_title": normalize("title"), "fingerprint": fingerprint("title", "company"), "identity": company_identity("company")})


def name_of(company):
    return frozenset(w for w in plain(company).split() if w not in COMPANY_NOISE and len(w) > 2)


def model(rows):
    """The three steps as one walk over a list."""
    by_key = {}
    for r in rows:
        r = dict(zip("ord source external_id title company description term".split(), r, strict=True)) | {"first": r[0]}
        key = (r["source"], r["external_id"])
        if key not in by_key:
            by_key[key] = r
        elif len(r["description"]) > len(by_key[key]["description"]):
            old = by_key[key]
            by_key[key] = r | {"first": old["first"], "term": old["term"] or r["term"]}
    by_print = {}
    for r in by_key.values():
        key = (plain(r["title"]), plain(r["company"])) if name_of(r["company"]) else r["ord"]
        if key not in by_print:
            by_print[key] = r
        elif len(r["description"]) > len(by_print[key]["description"]):
            by_print[key] = r | {"first": by_print[key]["first"]}
    groups = {}
    for r in by_print.values():
        kept = groups.setdefault(plain(r["title"]), [])
        for i, other in enumerate(kept):
            a, b = name_of(r["company"]), name_of(other["company"])
            if a and b and (a <= b or b <= a):
                if len(r["description"]) > len(other["description"]):
                    kept[i] = r
                break
        else:
            kept.append(r)
    return [(r["ord"], r["term"]) for kept in groups.values() for r in kept]


def test_against_model(spark):
    rng = random.Random(8)
    for _ in range(2):
        words = ["Alfa", "Beta", "Gama", "Delta", "LTDA", "XP", "do"]
        rows = []
        for i in range(300):
            company = rng.choice(["", "Confidencial", " ".join(rng.sample(words, rng.randrange(1, 5)))])
            rows.append((i * 3, rng.choice("pq"), str(rng.randrange(200)), rng.choice(["Dev Jr", "dev jr!", "QA Jr", "Suporte"]), company, "x" * rng.randrange(6), rng.choice(["", "t1", "t2"])))
        shuffled = rows[:]
        rng.shuffle(shuffled)
        got = dedupe_full(prepared(spark, shuffled).repartition(7)).orderBy("title_ord", "rep_ord").collect()
        assert [(r.ord, r.search_term) for r in got] == model(rows)


def walk(rows):
    """The greedy merge as a walk over a list of all representatives."""
    kept = []
    for ord_, first, identity, size in rows:
        name = frozenset(identity)
        for r in kept:
            if name <= r[2] or r[2] <= name:
                if size > r[3]:
                    r[0], r[2], r[3] = ord_, name, size
                break
        else:
            kept.append([ord_, first, name, size])
    return [(r[0], r[1]) for r in kept]


def test_merge_of_names_against_a_walk_over_all():
    rng = random.Random(11)
    for words, most in ((4, 4), (6, 3), (14, 12), (30, 2), (9, 9)):
        for _ in range(120):
            pool = [f"w{i}" for i in range(words)]
            rows = [(i, i, rng.sample(pool, rng.randint(1, most)), rng.randrange(6)) for i in range(rng.randrange(60))]
            assert merge_in_order(rows) == walk(rows)


def test_one_word_in_half_of_all_names():
    """30,000 names with one word in common, the bare word among them: each is looked up, not searched for."""
    rows = [(i, i, ["acme", f"x{i}", f"y{i % 7}"] if i % 3 else [f"z{i}", f"y{i % 7}"], 1) for i in range(60_000)] + [(60_000, 60_000, ["acme"], 1), (60_001, 60_001, ["acme", "q"], 1)]
    began = time.time()
    got = merge_in_order(rows)
    assert len(got) == 60_001 and got[-1] == (60_001, 60_001) and time.time() - began < 20


def merged(spark, *companies, title="Dev Jr", sizes=None):
    rows = [(i, "p", str(i), title, c, "x" * (sizes[i] if sizes else 1), "t") for i, c in enumerate(companies)]
    return [r.company for r in dedupe_full(prepared(spark, rows)).orderBy("rep_ord").collect()]


def test_companies_of_one_title(spark):
    assert merged(spark, "Minsait", "Minsait an Indra Company", sizes=[1, 5]) == ["Minsait an Indra Company"]
    assert merged(spark, "FEI", "Centro Universitário FEI") == ["FEI"]
    assert merged(spark, "Confidencial", "Confidencial", "") == ["Confidencial", "Confidencial", ""]
    assert merged(spark, "ACME", "ACME Soluções em Tecnologia LTDA") == ["ACME"]
    assert merged(spark, "Alfa", "Alfa Beta", "Alfa Gama") == ["Alfa"]
    assert merged(spark, "Alfa Beta", "Alfa Gama", "Alfa") == ["Alfa Beta", "Alfa Gama"]
    assert merged(spark) == []


def test_first_of_term_and_pairs(spark):
    rows = [(3, "p", "1", "a", "Alfa", "x", "t"), (1, "p", "1", "a", "Alfa Beta", "y", "t"), (2, "p", "1", "a", "Beta", "z", "u")]
    df = prepared(spark, rows)
    assert sorted(r.ord for r in first_of_term(df).collect()) == [1, 2]
    assert sorted((r.ord_a, r.ord_b) for r in same_company_pairs(df).select(F.col("ord_a"), F.col("ord_b")).collect()) == [(1, 2), (1, 3)]


def test_one_title_for_half_the_rows(spark):
    """A hot title is walked in parts of names that contain each other; a common word alone joins nothing."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        name = f"Grupo Casa{i // 3} Norte{i % 2}" if i % 3 else f"Casa{i // 3}"
        rows.append((i, "p", str(i), "Dev Jr" if i % 2 else f"Cargo {i} Jr", name, "x" * rng.randrange(9), "t"))
    df = prepared(spark, rows)
    got = dedupe_full(df).orderBy("title_ord", "rep_ord").collect()
    assert [(r.ord, r.search_term) for r in got] == model(rows)
    parts = parts_of(containments(distinct_names(df.filter("norm_title = 'dev jr'"))))
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] <= 3


def test_pairs_are_all_pairs(spark):
    rng = random.Random(5)
    words = ["Alfa", "Beta", "Gama", "Delta"]
    rows = [(i, "p", str(i), rng.choice(["a", "b"]), " ".join(rng.sample(words, rng.randrange(0, 4))), "x", "t") for i in range(60)]
    names = [(r[0], r[3], name_of(r[4])) for r in rows]
    want = sorted((a[0], b[0]) for a in names for b in names if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and (a[2] <= b[2] or b[2] <= a[2]))
    assert sorted((r.ord_a, r.ord_b) for r in same_company_pairs(prepared(spark, rows)).collect()) == want
    classes = {r.ord: (r.node, r.same, r.partners) for r in same_company_classes(prepared(spark, rows)).collect()}
    mine = lambda n: sorted(m[0] for m in names if m[1:] == n[1:])
    assert classes == {n[0]: (mine(n)[0], len(mine(n)), sum(n[0] in p for p in want)) for n in names if n[2]}
