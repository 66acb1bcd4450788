import random

from pyspark.sql import functions as F

from jobmosaic.functions.rules import Rules
from jobmosaic.operators.dedupe import dedupe_source_key, first_of_term
from jobmosaic.operators.levels import entry_level
from jobmosaic.plans.pipeline import clean
from jobmosaic.streaming.keys import by_source_key_stream, keep_source_keys, source_keys, survivor

SCHEMA = "ord long, source string, external_id string, title string, company string, url string, description string, location string, workplace_type string, published_date string, search_term string, seniority string"


def test_survivor():
    assert survivor([]) == survivor([("t", 1, 5, None)]) == (False, 0, 0, "", "")
    assert survivor([("b", 4, 9, "J"), ("", 2, 5, "E"), ("a", 3, 7, "J"), ("c", 1, 99, None)]) == (True, 4, 2, "a", "J")
    assert survivor([("a", 1, 5, "J"), ("b", 2, 5, "E")]) == (True, 1, 1, "a", "J")


def test_any_split_into_batches_gives_the_batch_result(spark, tmp_path):
    rng = random.Random(1)
    titles = ["Dev Júnior", "Dev Sênior", "Estágio em TI", "Analista"]
    rows = [(i, rng.choice("pq"), str(rng.randrange(25)), rng.choice(titles), "c", "", "x" * rng.randrange(8), "", "", "", rng.choice(["", "t1", "t2", None]), rng.choice(["", "", "Júnior"])) for i in range(200)]
    whole = spark.createDataFrame(rows, SCHEMA)
    want = dedupe_source_key(entry_level(first_of_term(clean(whole.fillna("", ["search_term"]))), Rules()))
    want = sorted((r.source, r.external_id, r.ord, r.first_ord, r.search_term, r.seniority) for r in want.collect())
    rng.shuffle(rows)
    for split, parts in enumerate(([rows[:90], rows[90:91], rows[91:]], [rows])):
        at = tmp_path / str(split)
        for n, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(at / "in" / str(n)))
            raw = spark.readStream.schema(whole.schema).option("recursiveFileLookup", True).parquet(str(at / "in"))
            keep_source_keys(raw, str(at / "changes"), str(at / "marks")).awaitTermination()
        assert len(list((at / "changes").glob("batch=*"))) == len(parts)
        got = source_keys(spark, str(at / "changes"))
        assert sorted((r.source, r.external_id, r.ord, r.first_ord, r.search_term, r.seniority) for r in got.collect()) == want


def test_state_stays_in_the_jvm_and_any_batch_can_be_asked_for(spark, tmp_path):
    raw = spark.createDataFrame([(2, "p", "1", "Dev Júnior", "c", "", "xx", "", "", "", "t", ""), (3, "p", "2", "Dev Sênior", "c", "", "x", "", "", "", "t", "")], SCHEMA)
    assert "Python" not in by_source_key_stream(raw)._jdf.queryExecution().toString()
    for batch, rows in enumerate((raw, raw.filter("ord = 2").withColumn("ord", F.lit(1).cast("long")))):
        by_source_key_stream(rows).write.parquet(str(tmp_path / f"batch={batch}"))
    assert [[r.ord for r in source_keys(spark, str(tmp_path), batch).collect()] for batch in (0, 1, None)] == [[2], [1], [1]]
