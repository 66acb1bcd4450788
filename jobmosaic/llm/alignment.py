"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes. Places where both end a token cut a text into groups; each stretch between two ends
of either is a link of the token of A and the token of B that cover it. What is counted is in how many documents an
id pair is linked.

Most links join ids that stand for the same bytes. For these an array, made once from the vocabularies, tells the
B id of each A id, and one vector of the vocabulary's length holds their counts: nothing of them is shuffled. Only the
other pairs are: their counts are summed in each task first. When links are looked up, the vectors are sent along,
and so are the most frequent pairs, FREQUENT at most; the links of the rare pairs that are left meet their counts in a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmosaic.llm.shared import discard, stored

#: Characters that are tokenized at once. Longer texts are cut behind words.
UNIT_CHARS = 1 << 19
#: Pairs that a task counts before it hands them over.
KEPT_PAIRS = 1 << 20
#: Most frequent pairs that are sent to all tasks, at most. Any other pair holds less than one in so many of all links.
FREQUENT = 1 << 17
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by turn from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return gather(self.pool, self.start[ids], self.length[ids]).tobytes()


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start:start + length] of each, in a row."""
    ends = np.cumsum(length)
    return pool[np.repeat(start - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Tokenizers:
    """Both tokenizers from the bytes of their files: A of the tokenizers library (byte-level), B of sentencepiece."""

    def __init__(self, file_a: bytes, file_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(file_a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        alphabet = byte_alphabet()
        told = json.loads(file_a)
        entries = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        tokens_a = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            tokens_a[number] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        tokens_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = Bytes(tokens_a), Bytes(tokens_b)
        self.size_a, self.size_b = len(tokens_a), len(tokens_b)
        #: For each A id the B id that stands for the same bytes (-1: none). Bytes that are a piece of text go before single byte entries.
        of_bytes = {t: i for i, t in reversed(list(enumerate(tokens_b))) if not self.b.is_control(i) and not self.b.is_unknown(i)}
        of_bytes |= {t: i for i, t in reversed(list(enumerate(tokens_b))) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([of_bytes.get(t, -1) if t else -1 for t in tokens_a], np.int64)
        #: Whether no piece of B goes on behind a space inside it, so that a text can be cut before one.
        self.can_cut = not any(p.strip("▁") and "▁" in p.lstrip("▁") for p in pieces)
        digits = [str(i).encode() + b"," for i in range(max(self.size_a, self.size_b))]
        self.decimal = Bytes(digits)

    def units(self, texts: list[str], size: int = UNIT_CHARS) -> list[tuple[list[int], list[str], bool]]:
        """(text numbers, texts, whole): units of whole texts, and the parts of each text that is too long for one."""
        found, own, chars = [], [], 0
        for number, text in enumerate(texts):
            if len(text) > size and self.can_cut:
                if own:
                    found.append((own, [texts[i] for i in own], True))
                own, chars, low = [], 0, 0
                while low < len(text):
                    cut = _CUT.search(text, low + size)
                    high = cut.start() if cut else len(text)
                    found.append(([number], [text[low:high]], False))
                    low = high + 1
                continue
            if own and chars + len(text) > size:
                found.append((own, [texts[i] for i in own], True))
                own, chars = [], 0
            own.append(number)
            chars += len(text)
        return [*found, (own, [texts[i] for i in own], True)] if own else found

    def align(self, texts: list[str]) -> Aligned:
        return Aligned(self, texts)


class Aligned:
    """Counts of each text, its linked id pairs with how often they are linked (sorted keys: text, A id, B id in one number), and the
    groups as bytes, each behind a semicolon's end."""

    def __init__(self, tools: Tokenizers, texts: list[str]):
        ids_a = [e.ids for e in tools.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = tools.b.encode(texts, num_threads=1) if texts else []
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids))) for ids in (ids_a, ids_b))
        joined_a, joined_b = memoryview(tools.bytes_a.join(flat_a)), memoryview(tools.bytes_b.join(flat_b))
        many_a, many_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        upto_a, upto_b = (np.r_[0, np.cumsum(b.length[f])] for b, f in ((tools.bytes_a, flat_a), (tools.bytes_b, flat_b)))
        cut_a, cut_b = (u[np.r_[0, np.cumsum(m)]] for u, m in ((upto_a, many_a), (upto_b, many_b)))
        self.ok = np.zeros(len(texts), bool)
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            raw = b" " + text.encode()
            sizes[k] = len(raw)
            self.ok[k] = joined_a[cut_a[k] : cut_a[k + 1]] == raw and joined_b[cut_b[k] : cut_b[k + 1]] == raw
        flat_a, flat_b = flat_a[np.repeat(self.ok, many_a)], flat_b[np.repeat(self.ok, many_b)]
        self.n_a, self.n_b = np.where(self.ok, many_a, 0), np.where(self.ok, many_b, 0)
        text_end = np.cumsum(np.where(self.ok, sizes, 0))
        end_a, end_b = np.cumsum(tools.bytes_a.length[flat_a]), np.cumsum(tools.bytes_b.length[flat_b])
        ends_a, ends_b, ends_text = (_marks(ends, int(text_end[-1]) if len(texts) else 0) for ends in (end_a, end_b, text_end[self.ok]))
        common, either = np.flatnonzero(ends_a & ends_b), np.flatnonzero(ends_a | ends_b)
        # how many tokens (texts) end before a place is the number of the one that covers the bytes up to it
        before = lambda marks: np.cumsum(marks, dtype=np.int64) - marks
        text_of = np.flatnonzero(self.ok)[before(ends_text)[either]]
        self.n_groups = np.bincount(text_of[ends_b[either] & ends_a[either]], minlength=len(texts))
        self.n_links = np.bincount(text_of, minlength=len(texts))
        keys = (text_of * tools.size_a + flat_a[before(ends_a)[either]]) * tools.size_b + flat_b[before(ends_b)[either]]
        keys.sort()
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.times = keys[heads], np.diff(np.r_[heads, len(keys)])
        self.groups = self._told(tools, flat_a, flat_b, end_a, end_b, common)

    def _told(self, tools, flat_a, flat_b, end_a, end_b, common) -> list[memoryview]:
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        every = np.arange(len(common))
        order = np.zeros(len(flat_a) + len(flat_b), np.int64)
        place_a = np.arange(len(flat_a)) + np.searchsorted(group_b, every)[group_a]
        place_b = np.arange(len(flat_b)) + np.searchsorted(group_a, every, side="right")[group_b]
        order[place_a], order[place_b] = flat_a, flat_b
        told = gather(tools.decimal.pool, tools.decimal.start[order], tools.decimal.length[order])
        stops = np.cumsum(tools.decimal.length[order])
        told[stops[place_a[np.isin(end_a, common, assume_unique=True)]] - 1] = ord("|")
        told[stops[place_b[np.isin(end_b, common, assume_unique=True)]] - 1] = ord(";")
        cuts = np.r_[0, stops][np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        view = memoryview(told)
        return [view[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _marks(ends: np.ndarray, size: int) -> np.ndarray:
    """True at each end, of size + 1 places."""
    marks = np.zeros(size + 1, bool)
    marks[ends] = True
    return marks


@lru_cache(maxsize=1)
def _tools(file_a: bytes, file_b: bytes) -> Tokenizers:
    return Tokenizers(file_a, file_b)


def read_model(path: str) -> bytes:
    """A tokenizer's file, read once on the driver; its size is checked before it is sent along."""
    with open(path, "rb") as f:
        held = f.read(1 << 26)
    if len(held) == 1 << 26:
        raise ValueError(f"{path} isn't a file of under 64 MB")
    return held


_NAMES = ["own", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_times", "pairs", "pair_times"]


def _lists(values: np.ndarray, of: np.ndarray, count: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=count))], pa.int32()), pa.array(values, pa.int64()))


def _aligned_batch(tools: Tokenizers, own: pa.Array, counts: list[np.ndarray], digests: list[str], keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    of, pair = np.divmod(keys, tools.size_a * tools.size_b)
    same = tools.same[pair // tools.size_b] == pair % tools.size_b
    lists = [_lists(x[m], of[m], len(own)) for m, values in ((same, (pair // tools.size_b, times)), (~same, (pair, times))) for x in values]
    return pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), *lists], names=_NAMES)


def aligned_batches(tools: Tokenizers, own: pa.Array, texts: list[str], unit: int = UNIT_CHARS):
    """A row for each text: its counts, the digest of its groups, and its linked pairs: A ids whose B id stands for the same bytes, and others."""
    long: list = []  # number, counts, hash, keys, times of the long text whose parts are under way

    def told_long():
        number, ok, counts, digest, keys, times = long
        long.clear()
        if not ok:
            counts, keys, times = np.zeros(4, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known, back = np.unique(np.concatenate(keys), return_inverse=True)
        many = np.bincount(back, np.concatenate(times), len(known)).astype(np.int64)
        return _aligned_batch(tools, own.slice(number, 1), [c[None] for c in counts], [digest.hexdigest() if ok else ""], known, many)

    for numbers, parts, whole in tools.units(texts, unit):
        found = tools.align(parts)
        counts = [found.n_a, found.n_b, found.n_groups, found.n_links]
        if long and (whole or long[0] != numbers[0]):
            yield told_long()
        if whole:
            digests = [hashlib.sha256(g[:-1]).hexdigest() if ok else "" for g, ok in zip(found.groups, found.ok.tolist(), strict=True)]
            yield _aligned_batch(tools, own.take(pa.array(numbers, pa.int64())), counts, digests, found.keys, found.times)
        else:
            if not long:
                long.extend([numbers[0], True, np.zeros(4, np.int64), hashlib.sha256(), [], []])
            else:
                long[3].update(b";")
            long[1] = long[1] and bool(found.ok[0])
            long[2] = long[2] + np.concatenate(counts)
            long[3].update(found.groups[0][:-1])
            long[4].append(found.keys)
            long[5].append(found.times)
    if long:
        yield told_long()


def align_documents(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of the shared folder, one row for each row of docs: row (a number of its own), doc_id, n_a, n_b, n_groups,
    n_links, groups_sha256, same and same_times, pairs (A id * size of B + B id) and pair_times."""
    rows = docs.select(F.col(doc_id).alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["own"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((read_model(path_a), read_model(path_b)))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tools = _tools(*sent.value)
        for batch in batches:
            yield from aligned_batches(tools, batch.column(0), batch.column(1).to_pylist())

    arrays = "same array<long>, same_times array<long>, pairs array<long>, pair_times array<long>"
    found = rows.mapInArrow(run, f"own {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {arrays}")
    small = lambda c: F.col(c).cast("array<int>").alias(c)
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "own", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", small("same"), small("same_times"), "pairs", small("pair_times")), "aligned-documents")


def pair_counts(aligned: DataFrame, size_a: int, size_b: int, same: np.ndarray) -> DataFrame:
    """(pair, n): in how many documents each id pair is linked. Ids of the same bytes are counted in one vector a task."""
    sent = aligned.sparkSession.sparkContext.broadcast(same)

    def batch_of(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    def run(batches):
        vector = np.zeros(size_a, np.int64)
        held, many = [], 0
        for batch in batches:
            vector += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size_a)
            held.append(np.unique(batch.column(1).flatten().to_numpy(), return_counts=True))
            many += len(held[-1][0])
            if many > KEPT_PAIRS:
                yield batch_of(*_summed(held))
                held, many = [], 0
        if held:
            yield batch_of(*_summed(held))
        there = np.flatnonzero(vector)
        yield batch_of(there * size_b + sent.value[there], vector[there])

    return aligned.select("same", "pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    known, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return known, np.bincount(back, np.concatenate([n for _, n in held]), len(known)).astype(np.int64)


def frequent_pairs(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with the highest counts, in order, and their counts: as many whole powers of two of the count as stay within most pairs."""
    power = F.floor(F.log2("n"))
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1))).collect()), reverse=True)
    taken, least = 0, None
    for p, n in levels:
        if taken + n > most:
            break
        taken, least = taken + n, p
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.filter(power >= least).toArrow()
    pairs, n = rows.column("pair").to_numpy(), rows.column("n").to_numpy()
    by = np.argsort(pairs)
    return pairs[by], n[by]


def cross_align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    A has a space and the text, B the text (it adds the space itself). n_groups: stretches between places where tokens of both
    end; n_links: pairs of token occurrences that share bytes; count_sum: for each link, in how many documents its id pair is
    linked; n_best: links whose pair has the highest such count of all pairs of its A id. groups_sha256 is the digest of
    the ids by group, as a1,a2|b1;a3|b2,b3.

    A null or empty text, and one whose tokens' bytes aren't the space and the text, has zeros and an empty
    digest, and links nothing. Each row is a document, repeated or not. An empty table gives no rows.
    Other columns aren't looked at."""
    aligned = align_documents(docs, path_a, path_b, doc_id, text)
    tools = _tools(read_model(path_a), read_model(path_b))
    size_a, size_b = tools.size_a, tools.size_b
    counts = stored(pair_counts(aligned, size_a, size_b, tools.same), "pair-counts")
    best, vector = np.zeros(size_a, np.int64), np.zeros(size_a, np.int64)
    highest = counts.groupBy(F.expr(f"cast(pair div {size_b} as int)").alias("a")).agg(F.max("n").alias("n")).toArrow()  # a row for each A id at most
    best[highest.column("a").to_numpy()] = highest.column("n").to_numpy()
    of_same = counts.mapInArrow(lambda batches: _only_same(batches, tools.same, size_b), "pair long, n long").toArrow()  # the same
    vector[of_same.column("pair").to_numpy() // size_b] = of_same.column("n").to_numpy()
    told = stored(_looked_up(aligned, size_b, best, vector, *frequent_pairs(counts, frequent)), "aligned-counts")
    rare = told.select("row", F.inline(F.arrays_zip("rare", "rare_times", "rare_best"))).join(counts, F.col("rare") == F.col("pair"))
    rare = rare.groupBy("row").agg(F.sum(F.col("rare_times") * F.col("n")).alias("more"), F.sum(F.when(F.col("n") == F.col("rare_best"), F.col("rare_times")).otherwise(0)).alias("more_best"))
    both = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    discard(aligned)
    result = told.join(rare, "row", "left").select(F.col("own").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", both("n_best", "more_best"), both("count_sum", "more"), "groups_sha256")
    return result


def _only_same(batches, same: np.ndarray, size_b: int):
    for batch in batches:
        a, b = np.divmod(batch.column(0).to_numpy(), size_b)
        yield batch.filter(pa.array(same[a] == b))


def _looked_up(aligned: DataFrame, size_b: int, best: np.ndarray, vector: np.ndarray, known: np.ndarray, known_n: np.ndarray) -> DataFrame:
    """aligned with n_best and count_sum of the links whose counts are at hand, and the other pairs: rare, rare_times, and the highest count of their A ids."""
    sent = aligned.sparkSession.sparkContext.broadcast((best, vector, known, known_n))
    kept = ["row", "own", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = dict(aligned.dtypes)

    def run(batches):
        best, vector, known, known_n = sent.value
        for batch in batches:
            rows = batch.num_rows
            sums, tops = np.zeros(rows, np.int64), np.zeros(rows, np.int64)

            def add(of, a, times, n):
                np.add.at(sums, of, times * n)
                np.add.at(tops, of, times * (n == best[a]))

            same, same_times, pairs, pair_times = (batch.column(k) for k in range(len(kept), len(kept) + 4))
            of = np.repeat(np.arange(rows), same.value_lengths().to_numpy())
            a = same.flatten().to_numpy()
            add(of, a, same_times.flatten().to_numpy().astype(np.int64), vector[a])
            of = np.repeat(np.arange(rows), pairs.value_lengths().to_numpy())
            pair, times = pairs.flatten().to_numpy(), pair_times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            add(of[hit], pair[hit] // size_b, times[hit], known_n[at[hit]])
            left = [_lists(x[~hit], of[~hit], rows) for x in (pair, times, best[pair // size_b])]
            own = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(tops), pa.array(sums), *left], names=[*kept, "n_best", "count_sum", "rare", "rare_times", "rare_best"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_best long, count_sum long, rare array<long>, rare_times array<long>, rare_best array<long>"
    return aligned.select(*kept, "same", "same_times", "pairs", "pair_times").mapInArrow(run, schema)
