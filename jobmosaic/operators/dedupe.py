"""Duplicates of postings: by source key, by fingerprint, by company names of one title.

All steps compare keys, order and lengths alone (slim rows, made by keys_of); the postings themselves move once, when
the survivors are taken from them at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmosaic.functions.joins import join_spread, kept, parts_of


def first_of_term(jobs: DataFrame) -> DataFrame:
    """Of rows with one source, search term and external id, the first. Dealt by source and id alone, so that the step
    after it, by source key, needs no shuffle of its own."""
    order = Window.partitionBy("source", "external_id", "search_term").orderBy("ord")
    return jobs.repartition("source", "external_id").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def text_size(jobs: DataFrame) -> Column:
    """Length of the description; slim rows have it as a column."""
    return F.col("text_size") if "text_size" in jobs.columns else F.length(F.coalesce("description", F.lit(""))).alias("text_size")


def keys_of(jobs: DataFrame) -> DataFrame:
    """Slim rows: what the three steps read of cleaned postings."""
    return jobs.select("ord", "source", "external_id", "search_term", "norm_title", "fingerprint", "identity", text_size(jobs))


def _taken(jobs: DataFrame, survivors: DataFrame, *columns: str) -> DataFrame:
    """The postings that survive, with these columns of the survivors."""
    return jobs.drop(*columns).join(survivors.select("ord", *columns), "ord")


def by_source_key(slim: DataFrame) -> DataFrame:
    key = Window.partitionBy("source", "external_id")
    before = F.max("text_size").over(key.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    longest = key.orderBy(F.col("text_size").desc(), F.col("ord"))
    record = (F.col("__before").isNull() | (F.col("text_size") > F.col("__before"))) & (F.coalesce("search_term", F.lit("")) != "")
    marked = slim.withColumn("__before", before).withColumns({
        "__term": F.min(F.when(record, F.struct("ord", "search_term"))).over(key),
        "__n": F.row_number().over(longest),
        "first_ord": F.min("ord").over(key),
    })
    return marked.filter("__n = 1").withColumn("search_term", F.coalesce("__term.search_term", F.lit(""))).drop("__before", "__term", "__n")


def dedupe_source_key(jobs: DataFrame) -> DataFrame:
    """Of rows with one source and external id, the one with the longest description (the first of those), with first_ord.

    Its search term is the first that isn't empty among rows longer than all before them."""
    slim = jobs.select("ord", "source", "external_id", "search_term", text_size(jobs))
    return _taken(jobs, by_source_key(slim), "first_ord", "search_term")


def by_fingerprint(slim: DataFrame) -> DataFrame:
    key = F.when(F.size("identity") > 0, F.col("fingerprint")).otherwise(F.concat(F.lit("ord "), F.col("ord").cast("string")))
    group = Window.partitionBy("__key")
    longest = group.orderBy(F.col("text_size").desc(), F.col("first_ord"))
    marked = slim.withColumn("__key", key).withColumns({"__n": F.row_number().over(longest), "__first": F.min("first_ord").over(group)})
    return marked.filter("__n = 1").withColumn("first_ord", F.col("__first")).drop("__key", "__n", "__first")


def dedupe_fingerprint(jobs: DataFrame) -> DataFrame:
    """Of rows with one fingerprint and a company that can be told, the one with the longest description (the first of those).

    Rows whose company can't be told never merge: each gets a key of its own, so they stay spread out."""
    slim = jobs.select("ord", "first_ord", "fingerprint", "identity", text_size(jobs))
    return _taken(jobs, by_fingerprint(slim), "first_ord")


def containments(names: DataFrame) -> DataFrame:
    """(a, b): nodes of names (node, norm_title, identity; distinct) of one title where b's identity has all words of a's.

    Whatever has all words of a has a's rarest one, so a meets only the names with that word."""
    words = names.select("node", "norm_title", "identity", F.explode("identity").alias("word"))
    often = words.groupBy("norm_title", "word").agg(F.count(F.lit(1)).alias("often"))
    counted = words.join(often, ["norm_title", "word"])
    rarest = counted.groupBy("node").agg(F.min(F.struct("often", "word")).alias("rarest"), F.first("norm_title").alias("title"), F.first("identity").alias("inner"))
    rarest = rarest.filter("rarest.often > 1").select(F.col("node").alias("a"), "title", "inner", F.col("rarest.word").alias("rare"))
    met = counted.filter("often > 1").join(rarest, (F.col("norm_title") == F.col("title")) & (F.col("word") == F.col("rare")) & (F.col("node") != F.col("a")))
    return met.filter(F.size(F.array_except("inner", "identity")) == 0).select("a", F.col("node").alias("b"))


def distinct_names(jobs: DataFrame) -> DataFrame:
    """(norm_title, identity, node): companies that can be told, each once a title; node is the least ord."""
    return jobs.filter(F.size("identity") > 0).groupBy("norm_title", "identity").agg(F.min("ord").alias("node"))


def same_company_pairs(jobs: DataFrame) -> DataFrame:
    """(ord_a, ord_b, norm_title): earlier and later row with one title and compatible companies.

    Compatible: both identities have words, and one has all words of the other. All such pairs are the result, so
    it grows with the square of the postings of a company under one title; no other step needs it."""
    names = kept(distinct_names(jobs), "company-names")
    linked = containments(names).union(names.select(F.col("node").alias("a"), F.col("node").alias("b")))
    rows = jobs.select("ord", F.col("norm_title").alias("title"), F.col("identity").alias("own")).join(names, (F.col("title") == F.col("norm_title")) & (F.col("own") == F.col("identity"))).select("ord", "norm_title", "node")
    first, second = rows.select(F.col("ord").alias("x"), F.col("node").alias("a"), "norm_title"), rows.select(F.col("ord").alias("y"), F.col("node").alias("b"))
    pairs = first.join(linked, "a").join(second, "b").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"), "norm_title").distinct()


#: Names of more words are found by their words, not by the sets that they contain.
SUBSET_WORDS = 7


def same_company_classes(jobs: DataFrame) -> DataFrame:
    """(ord, node, same, partners), one row for each posting whose company can be told: node is the least ord of its title and
    company's words, same how many postings have both, partners how many others of the title have a compatible company.

    What same_company_pairs tells, as a result that grows with the rows: pairs are between names, and postings belong to names."""
    names = kept(jobs.filter(F.size("identity") > 0).groupBy("norm_title", "identity").agg(F.min("ord").alias("node"), F.count(F.lit(1)).alias("same")), "company-names")
    links = containments(names).select("a", "b")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    others = both.join(names.select(F.col("node").alias("b"), F.col("same").alias("n")), "b").groupBy("a").agg(F.sum("n").alias("others"))
    told = names.join(others, F.col("node") == F.col("a"), "left").select(
        F.to_json(F.struct("norm_title", "identity")).alias("name"), "node", "same", F.col("same").alias("size"), (F.col("same") - 1 + F.coalesce("others", F.lit(0))).alias("partners"),
    )
    rows = jobs.filter(F.size("identity") > 0).select("ord", F.to_json(F.struct("norm_title", "identity")).alias("name"))
    return join_spread(rows, told, "name", "size", F.col("ord")).select("ord", "node", "same", "partners")


class Merge:
    """The representatives of one part, as postings come in order of arrival: a posting joins the first representative with a
    compatible company, and takes its place if its description is longer; else it is a new representative.

    Whether a posting takes a place changes what the next one meets, so the walk has its order; what it keeps is a
    representative for each name that stays, and no postings. Each representative is listed under every set of words that its
    name contains, so that those that contain a name, and those that a name contains, are looked up and not searched,
    however many share a word."""

    def __init__(self) -> None:
        self.names: list[frozenset] = []
        self.sizes: list[int] = []
        self.winner: list[int] = []
        self.created: list[int] = []
        self.inside: dict[frozenset, list[int]] = {}  # heaps: representatives whose name has all these words
        self.exactly: dict[frozenset, list[int]] = {}
        self.long: dict[str, set[int]] = {}  # representatives with long names, by word
        self.all_long: set[int] = set()

    @staticmethod
    def _subsets(name: frozenset) -> Iterator[frozenset]:
        words = sorted(name)
        return (frozenset(c) for n in range(1, len(words) + 1) for c in combinations(words, n))

    def _least(self, heap: list[int] | None, fits: Callable[[int], bool]) -> int | None:
        while heap and not fits(heap[0]):  # a representative that has changed its name since
            heappop(heap)
        return heap[0] if heap else None

    def _first(self, name: frozenset) -> int | None:
        found = [self._least(self.inside.get(name), lambda i: name <= self.names[i] and i not in self.all_long)]
        if len(name) <= SUBSET_WORDS:
            found += [self._least(self.exactly.get(s), lambda i, s=s: self.names[i] == s) for s in self._subsets(name)]
        else:
            short = {i for heap in (self.inside.get(frozenset([w]), ()) for w in name) for i in heap}
            found += [i for i in short if self.names[i] <= name]
        near = set().union(*(self.long.get(w, ()) for w in name))
        found += [i for i in near if name <= self.names[i] or self.names[i] <= name]
        return min((i for i in found if i is not None), default=None)

    def _list(self, at: int, name: frozenset) -> None:
        self.all_long.discard(at)
        if len(name) > SUBSET_WORDS:
            self.all_long.add(at)
            for w in name:
                self.long.setdefault(w, set()).add(at)
            return
        for s in self._subsets(name):
            heappush(self.inside.setdefault(s, []), at)
        heappush(self.exactly.setdefault(name, []), at)

    def add(self, ord_: int, first_ord: int, identity: list[str], size: int) -> None:
        name = frozenset(identity)
        at = self._first(name)
        if at is None:
            at = len(self.names)
            self.names.append(name)
            self.sizes.append(size)
            self.winner.append(ord_)
            self.created.append(first_ord)
            self._list(at, name)
        elif size > self.sizes[at]:
            old = self.names[at]
            self.sizes[at], self.winner[at] = size, ord_
            if name != old:
                if len(old) > SUBSET_WORDS:
                    for w in old:
                        self.long[w].discard(at)
                self.names[at] = name
                self._list(at, name)

    def survivors(self) -> list[tuple[int, int]]:
        return list(zip(self.winner, self.created, strict=True))


def merge_in_order(rows: list[tuple]) -> list[tuple[int, int]]:
    """(ord, rep_ord) of the survivors of (ord, first_ord, identity, size) in order of arrival."""
    merge = Merge()
    for row in rows:
        merge.add(*row)
    return merge.survivors()


def _merge_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows lie part by part, in order of arrival, and are walked as they come; a part may go on in the next batch."""
    part, merge = None, Merge()
    for batch in batches:
        done: list[tuple[int, int]] = []
        for now, *row in zip(*(batch[c].tolist() for c in ("part", "ord", "first_ord", "identity", "text_size")), strict=True):
            if now != part:
                done += merge.survivors()
                part, merge = now, Merge()
            merge.add(*row)
        yield pd.DataFrame(done, columns=["ord", "rep_ord"], dtype="int64")
    yield pd.DataFrame(merge.survivors(), columns=["ord", "rep_ord"], dtype="int64")


def by_company(slim: DataFrame) -> DataFrame:
    """Only names that contain each other, straight or by way of others, can merge: each such part is walked on its own,
    however many postings its title has. A name of one posting that no other contains stays as it is."""
    parts = parts_of(containments(distinct_names(slim)))
    same = Window.partitionBy("norm_title", "identity")
    told = slim.filter(F.size("identity") > 0).withColumns({"__node": F.min("ord").over(same), "__same": F.count(F.lit(1)).over(same)})
    told = told.join(parts.withColumnRenamed("node", "__at"), F.col("__node") == F.col("__at"), "left")
    walked = told.filter(F.col("part").isNotNull() | (F.col("__same") > 1)).select(F.coalesce("part", "__node").alias("part"), "ord", "first_ord", "identity", "text_size")
    merged = walked.repartition("part").sortWithinPartitions("part", "first_ord").mapInPandas(_merge_parts, "ord long, rep_ord long")
    alone = told.filter(F.col("part").isNull() & (F.col("__same") == 1)).select("ord", F.col("first_ord").alias("rep_ord"))
    untold = slim.filter(F.size("identity") == 0).select("ord", F.col("first_ord").alias("rep_ord"))
    return slim.join(merged.union(alone).union(untold), "ord")


def dedupe_titles(jobs: DataFrame) -> DataFrame:
    """Greedy merge of compatible companies under one title, in order of first_ord; rep_ord orders the survivors of a title."""
    slim = jobs.select("ord", "first_ord", "norm_title", "identity", text_size(jobs))
    return _taken(jobs, by_company(kept(slim, "dedupe-keys")), "rep_ord")


def survivors_of(slim: DataFrame) -> DataFrame:
    """The slim rows that survive all three steps, with first_ord, rep_ord and title_ord; all but the last is a table of the shared folder."""
    left = kept(by_company(kept(by_fingerprint(by_source_key(slim)), "dedupe-keys")), "dedupe-merged")
    titles = left.groupBy("norm_title").agg(F.min("rep_ord").alias("title_ord"), F.count(F.lit(1)).alias("n"))
    return join_spread(left, titles, "norm_title", "n", F.col("ord"))


def dedupe_full(jobs: DataFrame) -> DataFrame:
    """All three steps. title_ord, then rep_ord, is the order of the survivors."""
    return _taken(jobs, survivors_of(keys_of(jobs)), "first_ord", "rep_ord", "title_ord", "search_term")
