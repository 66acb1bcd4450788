"""Secret scan: rules, and a linear-chain conditional random field that adds what the rules miss.

A text is cut into tokens (runs of letters, digits and underscores, and single other characters); each line is
a chain of tokens. The field tags a token as secret begin, inside or outside (B, I, O) from its own shape and
word, the shapes and words beside it, and what is known of the whole file. It learns from what the rules find in
a bounded sample of documents, and the best tags of every line of every text are found by Viterbi's algorithm.
Feature values are worked out for many texts at once with array operations.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmosaic.llm.shared import stored

#: The rules, in the order in which kinds are listed: pattern, and the least length of its last group.
RULES = [
    ("assign", re.compile(r"""(?=[pstaPSTA])(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 12),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 18),
    ("hex", re.compile(r"([0-9a-f]{16,})"), 16),
]
KINDS = [k for k, _, _ in RULES] + ["crf"]
#: Documents that are learned from, at most; and windows of tokens taken from each.
TRAIN_DOCS = 2000
WINDOWS_A_DOC = 4
#: Tokens in a window.
WIDTH = 24
#: Windows of one training step, passes over all windows, and steps that a few windows get at least.
BATCH = 512
PASSES = 5
LEAST_STEPS = 60
#: Characters whose features are worked out at once.
SLICE_CHARS = 1 << 21
O, B, I = 0, 1, 2  # noqa: E741
_NEVER = -1e9
_ALLOWED = np.array([[0, 0, _NEVER], [0, 0, 0], [0, 0, 0]])
_START = np.array([0, 0, _NEVER])

WORD_CELLS = 1 << 12
SHAPES = 1024
FILE_CELLS = 64
FORMS = 128
#: Offsets of the feature groups in one weight table.
_GROUPS = [("shape", SHAPES), ("before shape", SHAPES), ("after shape", SHAPES), ("word", WORD_CELLS), ("before", WORD_CELLS), ("before that", WORD_CELLS), ("after", WORD_CELLS), ("form", FORMS), ("file", FILE_CELLS), ("hidden", 1)]
_OFFSET = dict(zip([n for n, _ in _GROUPS], np.cumsum([0, *[s for _, s in _GROUPS[:-1]]]).tolist(), strict=True))
SIZE = sum(s for _, s in _GROUPS)
#: Features of each token: one of each group but file, which has three, and hidden, which stands for one that training hides.
PER_TOKEN = len(_GROUPS) + 1
HIDDEN = SIZE - 1
#: Of a token's features, those that tell lengths and those that tell words; and how many windows don't show them in a pass.
_BY_LENGTH, _BY_WORD = [0, 1, 2], [3, 4, 5, 6]
HIDE = 1 / 2

_SPACE = [9, 10, 11, 12, 13, 32]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points under 128: kind bits (1 digit, 2 lower a-f, 4 other lower, 8 upper, 16 underscore, 32 space, 64 mark), lower case."""
    kind = np.full(128, 64, np.uint8)
    kind[48:58], kind[97:103], kind[103:123], kind[65:91], kind[95] = 1, 2, 4, 8, 16
    kind[_SPACE] = 32
    low = np.arange(128, dtype=np.uint32)
    low[65:91] += 32
    return kind, low


_KIND, _LOW = _tables()


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret part) of what the rules find, in code points, by start and kind."""
    found = []
    for number, (_, pattern, least) in enumerate(RULES):
        for m in pattern.finditer(text):
            if m.end(1) - m.start(1) >= least:
                found.append((m.start(), number, m.end(), m.start(1)))
    return sorted(found)


@dataclass
class Tokens:
    """Tokens of some texts in a row: place in the text, text, line, and feature numbers."""

    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    line: np.ndarray
    features: np.ndarray


def _neighbour(values: np.ndarray, line: np.ndarray, step: int, none: int) -> np.ndarray:
    """The value step tokens before (step > 0) or after, in the same line."""
    out = np.full_like(values, none)
    if step > 0:
        same = line[step:] == line[:-step]
        out[step:][same] = values[:-step][same]
    else:
        same = line[:step] == line[-step:]
        out[:step][same] = values[-step:][same]
    return out


def digit_share(text: str) -> float:
    """The share of ASCII digits, a feature of the whole file."""
    return sum(map(text.count, "0123456789")) / max(1, len(text))


def tokenise(texts: list[str], files: list[tuple[str | None, str | None]], shares: list[float] | None = None) -> Tokens:
    """files: source and language of each text; shares: digit shares of the files, where texts are parts of them."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = points < 128
    small = np.where(plain, points, 0)
    kind = np.where(plain, _KIND[small], 4)
    wordy = kind < 32
    begins = (kind == 64) | (wordy & ~np.r_[False, wordy[:-1]])
    start = np.flatnonzero(begins)
    none = np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1
    if not len(start):
        return Tokens(none, none, none, none, np.zeros((0, PER_TOKEN), np.int32))
    ends = np.flatnonzero(wordy & ~np.r_[wordy[1:], False]) + 1
    stop = start + 1
    stop[wordy[start]] = ends
    length = stop - start
    # sums over each token: spaces that follow a token belong to no sum, as their addends are zero
    count = lambda bit: np.add.reduceat((kind & bit) > 0, start, dtype=np.int32)
    digits, hexes, lower, upper, under = count(1), count(2), count(4), count(8), count(16)
    turns = np.add.reduceat(np.r_[False, (kind[1:] != kind[:-1])] & wordy & np.r_[False, wordy[:-1]], start, dtype=np.int32)
    low = np.where(plain, _LOW[small], points)
    token = np.cumsum(begins) - 1
    place = (np.arange(len(points)) - start[np.maximum(token, 0)]).astype(np.uint32)
    mixed = np.where(wordy | (kind == 64), (low + np.uint32(1)) * (place * np.uint32(0x9E3779B1) | np.uint32(1)), np.uint32(0)).astype(np.uint32)
    mixed ^= mixed >> np.uint32(15)
    mark = np.add.reduceat(mixed, start, dtype=np.uint32) * np.uint32(0x85EBCA77)
    word = (mark >> np.uint32(32 - 12)).astype(np.int32)
    letters = lower + hexes
    case = (digits > 0) * 1 + (letters > 0) * 2 + (upper > 0) * 4
    only_hex = (lower == 0) & (upper == 0) & (under == 0)
    size = np.searchsorted([2, 3, 5, 9, 13, 17, 25, 33, 41, 65], length, side="right")
    changes = np.minimum(turns // 2, 3)
    shape = (((size * 8 + case) * 2 + only_hex) * 4 + changes).astype(np.int32)
    is_mark = kind[start] == 64
    shape[is_mark] = SHAPES - 1 - points[start[is_mark]].astype(np.int32) % 100
    mixing = np.searchsorted([0.01, 0.2, 0.4], turns / np.maximum(1, length - 1), side="right")
    form = (((case * 2 + only_hex) * 4 + mixing) * 2 + (length > 5)).astype(np.int32)
    line = np.cumsum(points == 10)[start]
    of = np.searchsorted(first, start, side="right") - 1
    share = np.array(shares) if shares else np.add.reduceat(((kind & 1) > 0).astype(np.int64), first) / np.maximum(1, sizes)
    cell = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % (FILE_CELLS - 16)
    named = np.array([(cell(f"source={s}"), cell(f"lang={g}")) for s, g in files], np.int32).reshape(-1, 2)
    told = np.c_[named, FILE_CELLS - 16 + np.minimum(15, (share * 64).astype(np.int32))][of]
    columns = [
        shape + _OFFSET["shape"], _neighbour(shape, line, 1, 0) + _OFFSET["before shape"], _neighbour(shape, line, -1, 0) + _OFFSET["after shape"],
        word + _OFFSET["word"], _neighbour(word, line, 1, 0) + _OFFSET["before"], _neighbour(word, line, 2, 0) + _OFFSET["before that"], _neighbour(word, line, -1, 0) + _OFFSET["after"], form + _OFFSET["form"],
        *(told.T + _OFFSET["file"]),
    ]
    return Tokens(start - first[of], stop - first[of], of, line, np.stack(columns, 1).astype(np.int32))


@dataclass
class Field:
    """weights: SIZE x 3 scores of each feature value with each tag; moves: scores of a tag after a tag."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros((len(features), 3), np.float32)
        for column in features.T:
            total += self.weights[column]
        return total


def viterbi(emissions: np.ndarray, line: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of all chains (tokens with one line number stand together), many chains at a time.

    Chains stand in order of length, so that those still going at a step are the first ones."""
    if not len(line):
        return np.zeros(0, np.int8)
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    lengths = np.diff(np.r_[starts, len(line)])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0])
    going = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    moves = (moves + _ALLOWED).astype(np.float32)
    tags = np.zeros(len(line), np.int8)
    back = []
    score = emissions[starts] + _START.astype(np.float32)
    for step in range(1, longest):
        n = going[step]
        ways = score[:n, :, None] + moves
        back.append(ways.argmax(1).astype(np.int8))
        score[:n] = ways.max(1) + emissions[starts[:n] + step]
    now = score.argmax(1).astype(np.int8)
    for step in range(longest - 1, -1, -1):
        n = going[step]
        tags[starts[:n] + step] = now[:n]
        if step:
            now[:n] = np.take_along_axis(back[step - 1], now[:n, None].astype(np.int64), 1)[:, 0]
    return tags


def log_likelihood(weights: np.ndarray, moves: np.ndarray, features: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean over windows (N x WIDTH x PER_TOKEN features, padded) and its gradients, by forward and backward sums."""
    count, width, _ = features.shape
    inside = np.arange(width)[None, :] < lengths[:, None]
    emission = weights[features].sum(2)
    step = moves + _ALLOWED

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    forward = np.zeros((width, count, 3))
    forward[0] = emission[:, 0] + _START
    for t in range(1, width):
        on = inside[:, t]
        forward[t] = np.where(on[:, None], logsum(forward[t - 1][:, :, None] + step, 1) + emission[:, t], forward[t - 1])
    total = logsum(forward[-1], 1)
    backward = np.zeros((width, count, 3))
    for t in range(width - 2, -1, -1):
        on = inside[:, t + 1]
        backward[t] = np.where(on[:, None], logsum(step[None] + (emission[:, t + 1] + backward[t + 1])[:, None, :], 2), 0)
    chance = np.exp(forward + backward - total[None, :, None]) * inside.T[:, :, None]
    truth = np.zeros((count, width, 3))
    np.put_along_axis(truth, tags[:, :, None].astype(np.int64), 1.0, 2)
    truth *= inside[:, :, None]
    gap = truth - chance.transpose(1, 0, 2)
    slope = np.stack([np.bincount(features.reshape(-1), np.repeat(gap[:, :, k].reshape(-1), features.shape[2]), SIZE) for k in range(3)], 1)
    pairs = np.zeros((3, 3))
    gained = float((truth * emission).sum())
    for t in range(1, width):
        on = inside[:, t]
        both = np.exp(forward[t - 1][:, :, None] + step + (emission[:, t] + backward[t])[:, None, :] - total[:, None, None])[on]
        pairs -= both.sum(0)
        np.add.at(pairs, (tags[on, t - 1], tags[on, t]), 1)
        gained += float(moves[tags[on, t - 1], tags[on, t]].sum())
    return (gained - float(total.sum())) / count, slope / count, pairs / count


def fit(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray, passes: int = PASSES, ridge: float = 1e-4, rate: float = 0.5) -> Field:
    """Adaptive gradient ascent on the penalised likelihood, from zero, by BATCH windows at a time in a fixed random order.

    In each pass some windows hide what depends on lengths, some hide words: what the rules find is as long as they ask for
    and follows the names that they know, and the field is to know secrets by form and setting where those are others."""
    weights, moves = np.zeros((SIZE, 3)), np.zeros((3, 3))
    if not len(features):
        moves[:, B] = moves[:, I] = _NEVER  # nothing learned: everything is outside
        return Field(weights.astype(np.float32), moves)
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    draw = np.random.default_rng(0)
    parts = -(-len(features) // BATCH)
    for _ in range(passes * max(1, LEAST_STEPS // (passes * parts))):
        for at in np.array_split(draw.permutation(len(features)), parts):
            shown = features[at]
            for group in (_BY_LENGTH, _BY_WORD):
                shown[np.ix_(draw.random(len(at)) < HIDE, range(shown.shape[1]), group)] = HIDDEN
            _, slope, pairs = log_likelihood(weights, moves, shown, tags[at], lengths[at])
            slope[HIDDEN] = 0
            slope, pairs = slope - ridge * weights, pairs - ridge * moves
            seen_w += slope**2
            seen_m += pairs**2
            weights += rate * slope / np.sqrt(seen_w)
            moves += rate * pairs / np.sqrt(seen_m)
    return Field(weights.astype(np.float32), moves)


def rule_tags(tokens: Tokens, spans: list[list[tuple[int, int, int, int]]]) -> np.ndarray:
    """Tags of tokens that lie in the secret part of a rule's span."""
    tags = np.zeros(len(tokens.start), np.int8)
    edges = np.searchsorted(tokens.text, np.arange(len(spans) + 1))
    for number, found in enumerate(spans):
        low, high = edges[number], edges[number + 1]
        for _, _, end, secret in found:
            a, b = low + np.searchsorted(tokens.stop[low:high], secret, side="right"), low + np.searchsorted(tokens.start[low:high], end)
            if a < b:
                tags[a:b] = np.where(tags[a:b] == O, I, tags[a:b])
                tags[a] = B if tags[a] != B and (a == low or tags[a - 1] == O or tokens.line[a] != tokens.line[a - 1]) else tags[a]
    return tags


def doubtful(tokens: Tokens, tags: np.ndarray) -> np.ndarray:
    """Tokens of nine characters or more that mix digits and letters but that no rule found: they may be secrets, so they aren't taught as outside."""
    shape = tokens.features[:, 0] - _OFFSET["shape"]
    case = shape // 8 % 8
    return (shape < SHAPES - 100) & (shape // 64 >= 4) & (case & 1 > 0) & (case & 6 > 0) & (tags == O)


def windows(text: str, file: tuple[str | None, str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of up to WINDOWS_A_DOC stretches of a text, of one line and WIDTH tokens each: some about rule spans, the rest spread over the text."""
    tokens = tokenise([text], [file])
    if not len(tokens.start):
        return []
    tags = rule_tags(tokens, [base_spans(text)])
    doubt = doubtful(tokens, tags)
    hits = np.flatnonzero(tags == B)
    wanted = hits[np.linspace(0, len(hits) - 1, min(len(hits), WINDOWS_A_DOC - 1)).astype(int)] if len(hits) else hits
    spread = np.linspace(0, len(tags) - 1, WINDOWS_A_DOC - len(wanted) + 2).astype(int)[1:-1]
    out = []
    for at in np.unique(np.r_[wanted, spread]).tolist():
        own = np.searchsorted(tokens.line, [tokens.line[at], tokens.line[at] + 1])
        low = max(own[0], at - WIDTH // 2)
        while low > own[0] and tags[low] == I:
            low -= 1
        high = min(own[1], low + WIDTH)
        unsure = low + np.flatnonzero(doubt[low:high])
        low, high = max([low, *(unsure[unsure <= at] + 1)]), min([high, *unsure[unsure > at]])
        if low >= high:
            continue
        out.append((tokens.features[low:high], tags[low:high]))
    return out


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    there = {c.lower() for c in docs.columns}
    name = lambda c: (F.col(c) if c in there else F.lit(None)).cast("string").alias(c)
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), name("source"), name("lang"))


def train_field(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS) -> Field:
    """Learns from what the rules find in train_docs documents at most, up to half of them with a rule's find and the rest
    without, drawn by a hash of the id; all their windows come to the driver."""
    rows = _rows(docs, doc_id, text)
    id_kind = rows.schema["id"].dataType.simpleString()

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bool(base_spans(x.as_py())) for x in batch.column(1)], pa.bool_())], names=["id", "hit"])

    marked = stored(rows.filter(F.col("id").isNotNull()).select("id", "text").mapInArrow(mark, f"id {id_kind}, hit boolean").distinct(), "secret-hits")
    drawn = lambda found, most: found.select("id").orderBy(F.xxhash64("id", F.lit("field")), "id").limit(most)
    hits = stored(drawn(marked.filter("hit"), train_docs - train_docs // 2), "secret-drawn")
    ids = hits.union(drawn(marked.filter("NOT hit"), train_docs - hits.count()))
    chosen = rows.join(F.broadcast(ids.distinct().withColumnRenamed("id", "of")), F.col("id") == F.col("of")).select("id", "text", "source", "lang")

    def run(batches):
        for batch in batches:
            names = batch.column("id").cast(pa.string()).to_pylist()
            found = [(n, k, f.reshape(-1), t) for n, x, s, g in zip(names, batch.column("text"), batch.column("source"), batch.column("lang"), strict=True) for k, (f, t) in enumerate(windows(x.as_py(), (s.as_py(), g.as_py())))]
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(list(columns[2]), pa.list_(pa.int32())), pa.array([t.astype(np.int32) for t in columns[3]], pa.list_(pa.int32()))], names=["id", "part", "features", "tags"])

    found = chosen.mapInArrow(run, "id string, part int, features array<int>, tags array<int>").toPandas().sort_values(["id", "part"], kind="stable")
    count = len(found)
    features, tags, lengths = np.zeros((count, WIDTH, PER_TOKEN), np.int64), np.zeros((count, WIDTH), np.int64), np.zeros(count, np.int64)
    for i, (f, t) in enumerate(zip(found["features"], found["tags"], strict=True)):
        features[i, : len(t)], tags[i, : len(t)], lengths[i] = np.asarray(f).reshape(-1, PER_TOKEN), t, len(t)
    return fit(features, tags, lengths)


def line_parts(text: str, most: int) -> list[tuple[int, int]]:
    """Ranges of whole lines of up to most characters; a longer line is one range."""
    parts, low = [], 0
    while len(text) - low > most:
        high = text.rfind("\n", low, low + most) + 1 or text.find("\n", low + most) + 1 or len(text)
        parts.append((low, high))
        low = high
    return [*parts, (low, len(text))] if low < len(text) else parts


def added_in_parts(field: Field, text: str, file: tuple[str | None, str | None], most: int) -> list[tuple[int, int]]:
    """added_spans of one text, some lines at a time: a chain is one line, and what is told of the file is told to all parts."""
    share = [digit_share(text)]
    return [(low + a, low + b) for low, high in line_parts(text, most) for a, b in added_spans(field, [text[low:high]], [file], share)[0]]


def free_of(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of those taken."""
    taken = sorted(taken)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    before = [(a, b, bisect_left(starts, b)) for a, b in spans]
    return [(a, b) for a, b, n in before if not n or reach[n - 1] <= a]


def added_spans(field: Field, texts: list[str], files: list[tuple[str | None, str | None]], shares: list[float] | None = None) -> list[list[tuple[int, int]]]:
    """(start, end) of what the field tags in each text."""
    tokens = tokenise(texts, files, shares)
    tags = viterbi(field.emissions(tokens.features), tokens.line, field.moves)
    begin = np.flatnonzero(tags == B)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(begin):
        inside = tags == I
        ends = np.flatnonzero(~inside)
        # the last token of a span is the one before the next token that isn't inside
        after = np.r_[ends, len(tags)][np.searchsorted(ends, begin + 1)]
        for text, low, high in zip(tokens.text[begin].tolist(), tokens.start[begin].tolist(), tokens.stop[after - 1].tolist(), strict=True):
            out[text].append((low, high))
    return out


def _slices(texts: list[str]) -> list[tuple[int, int]]:
    cuts, size = [0], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            cuts.append(i)
            size = 0
        size += len(t)
    return list(zip(cuts, [*cuts[1:], len(texts)], strict=True)) if texts else []


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, spans), one row for each row of docs; spans: array of (kind, start, stop) by start, then kind.

    kind is assign, access or hex for what a rule finds, and crf for what the field adds: a span that touches
    none of the rules'. start and stop are code points, stop exclusive. A null text counts as empty. Repeated
    rows get the same spans. source and lang may be null or missing; other columns aren't looked at. Where the
    rules find nothing to learn from, nothing is added. An empty table gives no rows."""
    rows = _rows(docs, doc_id, text)
    kind = rows.schema["id"].dataType.simpleString()
    field = rows.sparkSession.sparkContext.broadcast(train_field(docs, doc_id, text, train_docs))  # SIZE x 3 numbers
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            files = list(zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), strict=True))
            for low, high in _slices(texts):
                out, some = [], texts[low:high]
                if max(map(len, some)) > SLICE_CHARS:
                    added = [added_in_parts(field.value, t, f, SLICE_CHARS) for t, f in zip(some, files[low:high], strict=True)]
                else:
                    added = added_spans(field.value, some, files[low:high])
                for t, more in zip(some, added, strict=True):
                    base = base_spans(t)
                    spans = [(a, k, b) for a, k, b, _ in base]
                    spans += [(a, 3, b) for a, b in free_of(more, [(x, y) for x, _, y, _ in base])]
                    out.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in sorted(spans)])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), pa.array(out, shape)], names=["id", "spans"])

    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,stop:int>>").withColumnRenamed("id", doc_id)
