"""Language ID by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; for each bit a linear n-gram classifier (log odds of the n-grams of the languages
with that bit set against those of the others) gives a signed margin. Loss-weighted decoding takes the codeword
with the least total logistic loss of its bits; the runner-up tells how sure that is. The classifiers follow
from n-gram sums by language over all training documents, a table whose size is fixed by the number of
languages and of hash cells.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmosaic.llm.shared import text_or_empty

#: Hash cells of n-grams.
CELLS = 1 << 14
#: More languages than that are refused: their sums come to the driver.
MOST_LANGUAGES = 500
#: A training document counts with so many n-grams at most, so that a few long ones don't decide.
DOC_WEIGHT = 2000
#: Codewords are exhaustive up to so many languages, random beyond.
EXHAUSTIVE = 6
#: Below this score the answer is flagged as ambiguous.
SURE = 0.6
#: Bytes hashed at once.
SLICE_BYTES = 1 << 22


def codewords(n: int) -> np.ndarray:
    """n rows of 1 and -1: all ways to split a few languages in two; else random ones, the best of some tries by least distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        return np.where(bits[None, :] >> np.arange(n)[:, None] & 1, 1, -1).astype(np.int8)
    length = 15 + 5 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for seed in range(20):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, length))
        split = np.abs(code.sum(0, dtype=int)) < n
        near = least_distance(code)
        if near > far and split.all() and len(np.unique(code, axis=0)) == n:
            best, far = code, near
    if best is None:
        raise ValueError("no codewords were found")
    return best


def least_distance(code: np.ndarray) -> int:
    """Places in which any two codewords differ, at least."""
    wide = code.astype(np.int32)
    apart = (code.shape[1] - wide @ wide.T) // 2
    np.fill_diagonal(apart, code.shape[1])
    return int(apart.min())


def cells(text: bytes) -> np.ndarray:
    """Hash cells of the two- and three-byte n-grams of a lower-case text between two spaces."""
    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    two = data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + data[2:] * np.uint32(0x27D4EB2F)
    return np.concatenate([two, three]) >> np.uint32(32 - 14)


def profile(text: str) -> np.ndarray:
    """Counts by hash cell over the whole text, in slices (which overlap by the last two bytes)."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    if len(raw) <= SLICE_BYTES:
        return np.bincount(cells(raw), minlength=CELLS)
    total = np.zeros(CELLS, np.int64)
    for low in range(0, len(raw), SLICE_BYTES):
        total += np.bincount(cells(raw[max(0, low - 2) : low + SLICE_BYTES]), minlength=CELLS)
    return total


def _letters(text: str):
    return text_or_empty(text).rlike(r"\p{L}")


def gram_sums(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, cell, n): sums over all training documents that have a letter; each is scaled to DOC_WEIGHT at most."""
    rows = train.filter(F.col(lang).isNotNull() & _letters(text)).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = profile(t.as_py())
                size = counts.sum()
                whole = counts if size <= DOC_WEIGHT else np.rint(counts * (DOC_WEIGHT / size)).astype(np.int64)
                if name not in sums and len(sums) >= MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                sums[name] = sums[name] + whole if name in sums else whole.astype(np.int64)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "cell", "n"])

    return rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def train_codes(train: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codewords, weights of each cell for each bit)."""
    sums = gram_sums(train, text, lang).toPandas()  # languages times CELLS rows at most
    names = sorted(sums["lang"].unique())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; {MOST_LANGUAGES} at most")
    code = codewords(len(names))
    if not names:
        return names, code, np.zeros((CELLS, 1), np.float32)
    counts = np.zeros((len(names), CELLS))
    counts[sums["lang"].map({n: i for i, n in enumerate(names)}), sums["cell"]] = sums["n"]
    shares = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * CELLS)
    weights = [np.log(shares[bit > 0].mean(0)) - np.log(shares[bit < 0].mean(0)) if (bit < 0).any() else np.zeros(CELLS) for bit in code.T]
    return names, code, np.stack(weights, 1).astype(np.float32)


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword, score) by the sum of logistic losses; score: its share of exp(-loss)."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]).sum(2)
    best = loss.argmin(1)
    return best, 1 / np.exp(loss[np.arange(len(loss)), best][:, None] - loss).sum(1)


def identify_languages(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous), one row for each row of docs.

    train: documents to learn from; those with a null language or without a letter teach nothing. lang_pred is
    `und` (score 0) where the text is null or has no letter, or nothing could be learned. Repeated rows get the
    same answer. Only the text tells the answer; other columns aren't looked at. An empty table gives no rows."""
    names, code, weights = train_codes(train, text, lang)
    rows = docs.select(F.col(doc_id).alias("id"), F.when(_letters(text), F.col(text).cast("string")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    model = rows.sparkSession.sparkContext.broadcast((names, code, weights))  # CELLS numbers for each bit

    def run(batches):
        names, code, weights = model.value
        for batch in batches:
            found, scores, unsure = ["und"] * len(batch), np.zeros(len(batch)), np.ones(len(batch), bool)
            if names:
                at, margins = [], []
                for i, t in enumerate(batch.column(1)):
                    if t.is_valid:
                        counts = profile(t.as_py())
                        at.append(i)
                        margins.append(counts.astype(np.float32) @ weights / np.sqrt(counts.sum()))
                if at:
                    best, score = decode(np.array(margins, float), code)
                    scores[at], unsure[at] = score, score < SURE
                    for i, b in zip(at, best.tolist(), strict=True):
                        found[i] = names[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores), pa.array(unsure)], names=["id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", doc_id)


def held_out(doc_id: str = "doc_id"):
    """True for documents that aren't learned from: crc32 of the id as text, mod 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
