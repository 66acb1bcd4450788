"""Quality classifier by co-training of two views: the text itself, and what the page's metadata say.

Each view has a logistic classifier. They start from labelled documents; over some rounds each one labels the
documents of an unlabelled pool that it is sure of, as training rows for the other. Rows held back from training
then calibrate each view and weigh the two against each other, and the combined score is given to all documents.
What is learned from is a bounded sample, drawn by a hash of the id; counts, scores and decisions cover all rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are learned from, and unlabelled ones in the pool, at most.
LABELLED_ROWS = 4000
POOL_ROWS = 4000
#: Labelled rows of which one in so many is held back for calibration.
HELD_BACK = 4
ROUNDS = 5
#: Documents of either class that a view may pass on in a round, and how sure it has to be.
PER_ROUND = 200
SURE = 0.95
#: A document with a lower probability of being good is rejected.
THRESHOLD = 0.5
META_CELLS = 64
#: Hash cells of words and pairs of neighbouring words in the text view.
WORD_CELLS = 256
_MARKS = b"|%$#&*!.,;:?<>{}[]()/\\=_~^@\"'-"


def word_cells(words: list[bytes]) -> np.ndarray:
    """Square roots of the shares of words and pairs of neighbouring words by hash cell."""
    marks = {w: zlib.crc32(w) for w in set(words)}
    one = np.fromiter(map(marks.__getitem__, words), np.uint32, len(words)) * np.uint32(0x9E3779B1)
    pairs = one[:-1] * np.uint32(0x85EBCA77) + (one[1:] ^ one[1:] >> np.uint32(15)) * np.uint32(0xC2B2AE3D)
    cells = np.concatenate([one, pairs]) >> np.uint32(32 - WORD_CELLS.bit_length() + 1)
    return np.sqrt(np.bincount(cells, minlength=WORD_CELLS) / max(1, len(cells)))


def text_features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, words and lines of the whole text, and its words and word pairs by hash cell; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    words = raw.split()
    many = max(1, len(words))
    kinds = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    stops = counts[[33, 46, 63]].sum()
    dense = [
        upper / size, lower / size, counts[48:58].sum() / size, counts[128:].sum() / size, counts[32] / size, counts[10] / size, counts[:32].sum() / size,
        upper / max(1, upper + lower), kinds / many, same / many, min(1.0, size / many / 20), stops / many, np.log1p(size) / 12, np.log1p(many) / 10,
        float(many < 5), float(many < 20), counts.max() / size,
    ]
    marks = counts[np.frombuffer(_MARKS, np.uint8)] / size
    return np.concatenate([dense, marks, np.sqrt(marks), word_cells(words), [1.0]])


def meta_features(row: dict) -> np.ndarray:
    """Hashed values of source, language and length class; nulls are values of their own. The text isn't used."""
    vector = np.zeros(META_CELLS + 2)
    chars = row["n_chars"]
    parts = [f"source={row['source']}", f"lang={row['lang']}", f"length={None if chars is None else int(np.log2(max(1, chars)) * 2)}"]
    for part in parts:
        vector[zlib.crc32(part.encode("utf-8", "surrogatepass")) % META_CELLS] += 1
    vector[-2] = 0.0 if chars is None else np.log1p(max(0, chars)) / 12
    vector[-1] = 1.0
    return vector


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    penalty = ridge * weight.sum() * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A classifier of standardised features (the last one is constant)."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> View:
        middle, spread = x.mean(0), x.std(0) + 1e-6
        middle[-1], spread[-1] = 0, 1
        return View(middle, spread, fit_logistic((x - middle) / spread, y, np.ones(len(y))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -20, 20) @ self.weights


@dataclass
class Model:
    views: tuple[View, View]
    #: of each view's logit: slope and shift that turn it into a calibrated one
    calibration: tuple[np.ndarray, np.ndarray]
    #: of the two calibrated logits and a constant
    mix: np.ndarray

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text score, metadata score, combined score) as probabilities of being good."""
        own = [np.stack([v.logit(x), np.ones(len(x))], 1) @ c for v, x, c in zip(self.views, views, self.calibration, strict=True)]
        both = np.stack([*own, np.ones(len(own[0]))], 1) @ self.mix
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*own, both))


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, back: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model | None:
    """back: rows that calibrate. None if the labels have one class only."""
    if len(y) == 0 or y[~back].min() == y[~back].max():
        return None
    rows = [[x[~back]] for x in labelled]
    marks = [[y[~back]], [y[~back]]]
    open_ = np.ones(len(pool[0]), bool)
    views = [View.fit(x[~back], y[~back]) for x in labelled]
    for _ in range(rounds):
        if not open_.any():
            break
        given = np.full((2, len(open_)), np.nan)
        for own in (0, 1):
            p = 1 / (1 + np.exp(-np.clip(views[own].logit(pool[own]), -30, 30)))
            for sure, label in ((p, 1.0), (1 - p, 0.0)):
                order = np.argsort(-sure, kind="stable")
                given[own, order[open_[order] & (sure[order] >= SURE)][:PER_ROUND]] = label
        open_ &= np.isnan(given).all(0)
        given[:, (given[0] != given[1]) & ~np.isnan(given).any(0)] = np.nan  # the views contradict each other: it teaches neither
        if np.isnan(given).all():
            break
        for own in (0, 1):
            order = np.flatnonzero(~np.isnan(given[own]))
            rows[1 - own].append(pool[1 - own][order])
            marks[1 - own].append(given[own, order])
        views = [View.fit(np.concatenate(r), np.concatenate(m)) for r, m in zip(rows, marks, strict=True)]
    check = back if back.any() and y[back].min() < y[back].max() else ~back
    ones = np.ones(int(check.sum()))
    logits = [v.logit(x[check]) for v, x in zip(views, labelled, strict=True)]
    calibration = [fit_logistic(np.stack([z, ones], 1), y[check], ones, ridge=1e-3) for z in logits]
    own = [np.stack([z, ones], 1) @ c for z, c in zip(logits, calibration, strict=True)]
    mix = fit_logistic(np.stack([*own, ones], 1), y[check], ones, ridge=1e-3)
    return Model(tuple(views), tuple(calibration), mix)


def _rows(docs: DataFrame, doc_id: str, *more: str) -> DataFrame:
    """The columns that the views read; one that docs lacks is null."""
    there = {c.lower() for c in docs.columns}
    column = lambda c, kind: F.col(c).cast(kind).alias(c) if c in there else F.lit(None).cast(kind).alias(c)
    return docs.select(F.col(doc_id).alias("id"), column("text", "string"), column("source", "string"), column("lang", "string"), column("n_chars", "double"), *more)


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = np.array([text_features(t.as_py()) for t in batch.column("text")])
    meta = [dict(zip(("source", "lang", "n_chars"), r, strict=True)) for r in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
    return texts, np.array([meta_features(m) for m in meta])


def train_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS) -> Model | None:
    """Learns from at most labelled_rows and pool_rows documents; these come to the driver as feature rows of fixed size.

    A document with several labels counts as bad if one of them is. Labels that are null, of ids that are null
    or not in docs teach nothing."""
    spread = F.xxhash64(F.col("id"), F.lit("co-training"))
    known = labels.filter(F.col("quality").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(F.col("quality").cast("double")).alias("quality"))
    known = known.orderBy(spread, "id").limit(labelled_rows)
    pool = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id")).orderBy(spread, "id").limit(pool_rows)
    chosen = known.unionByName(pool.withColumn("quality", F.lit(None).cast("double"))).groupBy("id").agg(F.max("quality").alias("quality"))
    chosen = chosen.withColumnRenamed("id", "of")
    sample = _rows(docs, doc_id).join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "text", "source", "lang", "n_chars", "quality", F.xxhash64("id", "text").alias("spread"))

    def run(batches):
        for batch in batches:
            if len(batch):
                texts, meta = _features(batch)
                yield pa.RecordBatch.from_arrays([batch.column("spread"), batch.column("quality"), pa.array(batch.column("id").cast(pa.string())), pa.array(list(texts), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))], names=["spread", "quality", "id", "texts", "meta"])

    # where ids repeat, rows beyond twice as many are left out, by a hash of id and text
    found = sample.mapInArrow(run, "spread long, quality double, id string, texts array<double>, meta array<double>").orderBy("spread", "id").limit(2 * (labelled_rows + pool_rows)).toPandas()
    if not len(found):
        return None
    found = found.sort_values(["id", "spread"], kind="stable")
    views = np.stack(found["texts"].to_numpy()), np.stack(found["meta"].to_numpy())
    y = found["quality"].to_numpy(float)
    have = ~np.isnan(y)
    back = np.array([zlib.crc32(f"back {i}".encode()) % HELD_BACK == 0 for i in found["id"][have]], bool)
    return co_train(tuple(v[have] for v in views), (y[have] > 0).astype(float), back, tuple(v[~have] for v in views))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", threshold: float = THRESHOLD, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept), one row for each row of docs.

    Scores are probabilities of good quality; kept: the combined score is the threshold or more. Without labels
    of both classes all scores are null and all documents stay. Nulls in text, source, lang or n_chars are
    values like others. Repeated rows get the same scores. Other columns aren't looked at. An empty table gives
    no rows."""
    rows = _rows(docs, doc_id)
    kind = rows.schema["id"].dataType.simpleString()
    model = rows.sparkSession.sparkContext.broadcast(train_model(docs, labels, doc_id, labelled_rows, pool_rows))

    def run(batches):
        for batch in batches:
            own = [np.full(len(batch), np.nan)] * 3
            if model.value and len(batch):
                own = model.value.scores(_features(batch))
            scores = [pa.array(s, pa.float64(), mask=np.isnan(s)) for s in own]
            kept = np.isnan(own[2]) | (own[2] >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *scores, pa.array(kept)], names=["id", "text_score", "meta_score", "score", "kept"])

    return rows.mapInArrow(run, f"id {kind}, text_score double, meta_score double, score double, kept boolean").withColumnRenamed("id", doc_id)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't rejected, with all their columns. Each row is judged where it stands: no join."""
    model = docs.sparkSession.sparkContext.broadcast(train_model(docs, labels, doc_id))
    there = {c.lower() for c in docs.columns}

    @F.arrow_udf("boolean")
    def good(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, source, lang, n_chars], names=["text", "source", "lang", "n_chars"])
        if not model.value or not len(batch):
            return pa.array([True] * len(batch), pa.bool_())
        return pa.array(model.value.scores(_features(batch))[2] >= threshold)

    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "double"}
    return docs.filter(good(*[(F.col(c) if c in there else F.lit(None)).cast(kind) for c, kind in kinds.items()]))
