"""Tech gate, weighted area scores, classification and skills."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmosaic.functions.rules import Rules
from jobmosaic.functions.text import bound, has_phrase, mapping, phrase_hits


def with_hits(jobs: DataFrame, rules: Rules) -> DataFrame:
    """title_hits and body_hits: the gate's phrases and area keywords that stand in norm_title and norm_body, found once for gate and scores.

    They are columns of a one-row inline: a filter that reads them isn't moved below it, where it would fold and search each text again."""
    keywords = [k.phrase for k in rules.keywords]
    title = phrase_hits("norm_title", rules.gate_title + rules.gate_exclude + keywords)
    body = phrase_hits("norm_body", rules.gate_body + keywords)
    return jobs.select("*", F.inline(F.array(F.struct(title.alias("title_hits"), body.alias("body_hits")))))


def is_tech(rules: Rules) -> Column:
    """On title_hits and body_hits: excluded by title, let in by title, let in by a strong keyword of the title, then the same of the body."""
    title, body = F.col("title_hits"), F.col("body_hits")
    return ~has_phrase(title, rules.gate_exclude) & (has_phrase(title, rules.gate_title + rules.strong) | has_phrase(body, rules.gate_body + rules.strong))


def gate(norm_title: Column | str, norm_body: Column, rules: Rules) -> Column:
    """The same from the texts. The title decides most postings; norm_body, an expression, is worked out for the others alone."""
    by_body = F.size(phrase_hits(norm_body, rules.gate_body + rules.strong)) > 0
    decided = lambda title: F.when(has_phrase(title, rules.gate_exclude), F.lit(False)).when(has_phrase(title, rules.gate_title + rules.strong), F.lit(True)).otherwise(by_body)
    return bound(phrase_hits(norm_title, rules.gate_title + rules.gate_exclude + rules.strong), decided)


def _places(text: Column, phrase: Column) -> Column:
    """Offsets of a phrase that stands as whole words in a text with a space at either end; those that share a space too."""
    pieces = F.split(text, F.concat(F.lit(" "), phrase, F.lit("(?= )")))  # phrases are plain words: nothing in them to quote
    before = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.lit(0)), lambda ends, p: F.array_append(ends, F.element_at(ends, -1) + F.length(p)))
    return F.transform(F.slice(before, 2, F.size(pieces) - 1), lambda upto, n: upto + n * (F.length(phrase) + 1))


def _elsewhere(rank: Column, longest: int) -> Column:
    """A place before the text, of its own for each keyword of an area: free, and no place of the text is inside it."""
    return F.array((rank + 1) * -(longest + 1))


def _free(places: Column, size: Column, used: Column) -> Column:
    """The first place of which the span isn't inside a used one; null if there is none."""
    blocked = lambda p: F.exists(used, lambda s: (s["a"] <= p) & (p + size <= s["b"]))
    return F.try_element_at(F.filter(places, lambda p: ~blocked(p)), F.lit(1))


def _scored(area: Column, keywords: Column, boost: float) -> Column:
    """(area, score, title_score, matches) of an area's keywords, in their order. A keyword counts once: in the title (boosted) if
    it has a free place there, else in the body; a place inside the place of a keyword before it isn't free."""
    spans = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(spans.alias("t"), spans.alias("b"), F.lit(0.0).alias("score"), F.lit(0.0).alias("title"), F.array().cast("array<string>").alias("matches"))

    def put(used: Column, at: Column, k: Column) -> Column:
        return F.array_append(used, F.struct(at.alias("a"), (at + k["size"]).alias("b")))

    def step(acc: Column, k: Column) -> Column:
        gain = k["weight"] * boost
        in_title = lambda at: F.struct(put(acc["t"], at, k).alias("t"), acc["b"].alias("b"), (acc["score"] + gain).alias("score"), (acc["title"] + gain).alias("title"), F.array_append(acc["matches"], F.concat(k["keyword"], F.lit("(t)"))).alias("matches"))
        in_body = lambda at: F.struct(acc["t"].alias("t"), put(acc["b"], at, k).alias("b"), (acc["score"] + k["weight"]).alias("score"), acc["title"].alias("title"), F.array_append(acc["matches"], k["keyword"]).alias("matches"))
        body = lambda: bound(_free(k["body"], k["size"], acc["b"]), lambda at: F.when(at.isNotNull(), in_body(at)).otherwise(acc))
        return bound(_free(k["title"], k["size"], acc["t"]), lambda at: F.when(at.isNotNull(), in_title(at)).otherwise(body()))

    return F.aggregate(keywords, start, step, lambda acc: F.struct(area.alias("area"), acc["score"].alias("score"), acc["title"].alias("title_score"), acc["matches"].alias("matches")))


def score_areas(rules: Rules) -> Column:
    """Array of (area, score, title_score, matches): areas named in the title first, then by falling score, then by name.

    norm_title, norm_body and the hits are read. Only keywords that occur are looked at: their places are found, then a
    fold over them, longest first, carries the places used in each area. A place can only be inside that of a keyword
    that has this one as a part, so that only such keywords of one area and text, and their parts, are looked for."""
    told = json.dumps([{"rank": k.rank, "area": k.area, "phrase": k.phrase, "keyword": k.keyword, "weight": float(k.weight)} for k in rules.keywords])
    table = F.from_json(F.lit(told), "array<struct<rank:int,area:string,phrase:string,keyword:string,weight:double>>")
    title, body = (F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in ("norm_title", "norm_body"))
    none = F.array().cast("array<int>")
    longest = max((len(k.phrase) for k in rules.keywords), default=0)

    def known(hits: Column) -> Column:
        return F.array_sort(F.filter(table, lambda k: F.array_contains(hits, k["phrase"])))

    def placed(texts: Column, found: Column) -> Column:
        part = lambda o, k: F.contains(o["phrase"], k["phrase"]) | F.contains(k["phrase"], o["phrase"])
        meets = lambda hit, k: F.exists(found, lambda o: (o["area"] == k["area"]) & (o["rank"] != k["rank"]) & part(o, k) & F.array_contains(hit, o["phrase"]))
        there = lambda hit, text, k: F.when(~F.array_contains(hit, k["phrase"]), none).when(meets(hit, k), _places(text, k["phrase"])).otherwise(_elsewhere(k["rank"], longest))
        return F.transform(found, lambda k: F.struct(
            k["area"].alias("area"), k["keyword"].alias("keyword"), k["weight"].alias("weight"), F.length(k["phrase"]).alias("size"),
            there(F.col("title_hits"), texts["title"], k).alias("title"), there(F.col("body_hits"), texts["body"], k).alias("body"),
        ))

    def areas(found: Column) -> Column:
        own = F.array_distinct(F.transform(found, lambda k: k["area"]))
        return F.transform(own, lambda a: _scored(a, F.filter(found, lambda k: k["area"] == a), rules.title_boost))

    texts = F.struct(title.alias("title"), body.alias("body"))
    found = bound(bound(F.array_union("title_hits", "body_hits"), known), lambda found: bound(texts, lambda t: placed(t, found)))
    scores = bound(found, areas)
    named = lambda x: F.when(x["title_score"] > 0, 0).otherwise(1)
    before = lambda x, y: F.when(named(x) != named(y), named(x) - named(y)).when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1)).when(x["area"] < y["area"], -1).when(x["area"] > y["area"], 1).otherwise(0)
    return F.array_sort(F.filter(scores, lambda x: x["score"] > 0), before)


def with_scores(jobs: DataFrame, rules: Rules) -> DataFrame:
    """jobs with the column scores, which aren't worked out where nothing reads them."""
    return jobs.withColumn("scores", score_areas(rules))


def classify(jobs: DataFrame, rules: Rules) -> DataFrame:
    """area, area_score and area_matches from the column scores: the best area named in the title if there is one,
    else the best of all; below min_score it is the fallback, with score 0 and no matches."""
    scored = jobs.withColumn("__best", F.try_element_at("scores", F.lit(1)))  # a column of its own, so that it's worked out once
    best = F.col("__best")
    sure = F.coalesce(best["score"] >= rules.min_score, F.lit(False))
    return scored.withColumns({
        "area": F.when(sure, best["area"]).otherwise(F.lit(rules.fallback)),
        "area_score": F.when(sure, best["score"]).otherwise(F.lit(0.0)),
        "area_matches": F.when(sure, F.array_join(F.slice(best["matches"], 1, 12), ", ")).otherwise(F.lit("")),
    }).drop("__best")


def keyword_hits(jobs: DataFrame, rules: Rules) -> DataFrame:
    """(ord, area, keyword, in_title, in_body): which keywords of which areas occur, nested ones too."""
    spark = jobs.sparkSession
    table = spark.createDataFrame([(k.area, k.keyword, k.phrase) for k in rules.keywords], "area string, keyword string, phrase string")
    hit = jobs.select("ord", "title_hits", "body_hits", F.explode(F.array_union("title_hits", "body_hits")).alias("phrase"))
    return hit.join(F.broadcast(table), "phrase").select("ord", "area", "keyword", F.array_contains("title_hits", F.col("phrase")).alias("in_title"), F.array_contains("body_hits", F.col("phrase")).alias("in_body"))


def extract_skills(norm_tech: Column | str, rules: Rules) -> Column:
    """Sorted distinct skills of which an alias stands in the text (folded with # and + kept) as whole words."""
    aliases = rules.aliases
    table = mapping(aliases)
    return F.array_sort(F.array_distinct(F.transform(phrase_hits(norm_tech, list(aliases)), lambda p: F.try_element_at(table, p))))
