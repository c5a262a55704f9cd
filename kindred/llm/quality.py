"""Quality classifier: naive Bayes support vectors over n-grams of words and of their shapes, fitted by dual coordinate descent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forgets, gram_hashes, hash_words, id_type, map_texts, mix, own_memos, space_words, steps

#: Hash buckets of the n-gram indicators; a model is this many numbers.
BUCKETS = 1 << 18

#: Labelled rows that a classifier is fitted on at most: those whose hashed ids are smallest.
SAMPLE_ROWS = 20_000

#: Longest n-gram.
GRAMS = 3

#: Shapes that a Python worker remembers.
MEMO_SHAPES = 200_000


#: ASCII capitals as A; small letters and all characters beyond ASCII as a; digits as 0; the rest as they are.
_KINDS = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class Shapes(dict):
    """Hash of a word's shape: the kinds of its characters, each run as one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_SHAPES:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_KINDS))
        found = self[word] = xxhash.xxh3_64_intdigest(shape)
        return found


SHAPES = Shapes()
forgets(SHAPES.clear)


def features(text: str) -> np.ndarray:
    """Buckets of the distinct n-grams of a whole text: of its words with A-Z lower-cased, and of their shapes, each
    marked if it repeats the word before."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.int32)
    shapes = np.fromiter(map(SHAPES.__getitem__, words), np.uint64, len(words))
    same = hash_words(words)
    again = np.concatenate(([False], same[1:] == same[:-1]))
    marked = mix(shapes + again.astype(np.uint64))
    plain = hash_words(space_words(text))
    grams = [gram_hashes(x, n) + np.uint64(n + k * GRAMS) for k, x in enumerate((marked, plain)) for n in range(1, GRAMS + 1)]
    return np.unique(mix(np.concatenate(grams)) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    """score = sigmoid(slope * (weights over the indicators, divided by the root of their number, + bias) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = (self.weights[found].sum() / np.sqrt(len(found)) if len(found) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """Fit on indicator rows.  With one class or none there is no margin, and every score is the smoothed share of label 1."""
    n, good = len(rows), int(labels.sum())
    if good in (0, n):
        share = (good + 1) / (n + 2)
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held = np.zeros(n, bool)
    held[order[: n // 5]] = True  # for the sigmoid
    if len(set(labels[~held])) < 2 or len(set(labels[held])) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    for i in train:
        (p if labels[i] else q)[rows[i]] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    y = np.where(labels == 1, 1.0, -1.0)
    # Dual coordinate descent of the hinge loss, the bias being a constant feature.
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(n)
    # Values are made as they are needed: those of all rows at once would outweigh the rows.
    values = lambda r: ratio[r] / np.sqrt(max(1, len(r)))
    square = np.array([(v := values(r)) @ v + 1 for r in rows])
    weight = cost * np.where(labels == 1, len(train) / (2 * labels[train].sum()), len(train) / (2 * (len(train) - labels[train].sum())))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train):
            value = values(rows[i])
            gradient = y[i] * (w[rows[i]] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), weight[i])
            if step := new - alpha[i]:
                w[rows[i]] += step * y[i] * value
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    weights = w * ratio
    margins = np.array([(weights[r].sum() / np.sqrt(len(r)) if len(r) else 0.0) + bias for r in rows])
    on = np.flatnonzero(held) if held.any() else train
    slope, shift = _sigmoid(margins[on], labels[on])
    return Model(weights, bias, slope, shift)


def _sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, with smoothed targets (Newton steps)."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g, h = np.array([((p - target) * margins).sum(), (p - target).sum()]), p * (1 - p)
        hess = np.array([[(h * margins**2).sum(), (h * margins).sum()], [(h * margins).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 0.0)), float(b)


def remainder(id_col: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def _rows():
    def run(docs) -> Iterator[dict]:
        for _, texts, batch in docs:
            yield {"label": batch.column("label"), "found": [features(t).tobytes() for t in texts]}

    return run


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit on the rows of one partition, in an order that depends on them alone; without rows there is a model as well."""
    own_memos(__name__)
    rows, labels = [], []
    for batch in batches:
        rows += [np.frombuffer(x, np.int32) for x in batch.column("found").to_pylist()]
        labels += batch.column("label").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), xxhash.xxh3_128_digest(rows[i]), labels[i]))
    model = fit([rows[i] for i in order], np.array([labels[i] for i in order], np.int64))
    yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, folds: int = 5,
) -> Model:
    """Fit on labelled documents whose id's remainder by ``folds`` is not 0, at most ``sample_rows`` of them.

    Labels other than 0 and 1, and ids with both, teach nothing.  Rows that repeat an id and its text teach once; where ids
    repeat with several texts, each text counts as a row.  Indicators are made where the rows lie; one task, in an executor, fits the
    model, and what it holds is bounded by ``sample_rows``."""
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(F.col(id_col), folds) != 0)).groupBy(F.col(id_col).alias("_id"))
    known = known.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("_other")).where("label = _other")
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id", "label"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, F.col("id") == F.col("_id"))
    texts = rows.groupBy(F.xxhash64("id").alias("at"), "id", F.xxhash64("text").alias("of")).agg(F.min("label").alias("label"))
    texts = F.broadcast(texts.orderBy("at", "id", "of").limit(sample_rows).select(F.col("id").alias("_id"), F.col("of").alias("_of"), "label"))
    rows = rows.drop("label", "_id").join(texts, (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_of")))
    rows = rows.groupBy("id", "_of").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    found = map_texts(rows, _rows(), "label int, found binary", "id", "text", {"label": F.col("label")})
    (row,) = found.repartition(1).mapInArrow(_fit, "weights binary, bias double, slope double, shift double").collect()
    return Model(np.frombuffer(row.weights), row.bias, row.slope, row.shift)


def _scores(shared):
    def run(docs) -> Iterator[dict]:
        for ids, texts, batch in docs:
            model = shared.value
            yield {"id": ids, "held_out": batch.column("held_out"), "score": [model.score(features(t)) for t in texts]}

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, folds: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    ``score`` is the estimated probability of label 1 from the text alone; null and empty texts get the score of a text
    without n-grams.  ``held_out`` rows (remainder 0; a null id is one) never teach.  Without labels of both classes all
    scores are the smoothed share of label 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample_rows, folds))
    out = map_texts(
        docs, _scores(shared), f"id {id_type(docs, id_col)}, held_out boolean, score double", id_col, text_col,
        {"held_out": remainder(F.col(id_col), folds) == 0},
    )
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3
) -> DataFrame:
    """``docs`` without those that score below ``threshold``; all columns stay, and no row moves to another task."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memos(__name__)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_col) if at is None else at
            for part in steps(batch, text_col):
                texts = pc.fill_null(part.column(at), "").to_pylist()
                yield part.filter(pa.array([shared.value.score(features(t)) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
