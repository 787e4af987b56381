"""Quality scores from random-indexing word vectors and a small calibrated network.

Every word has two terms: itself and its shape, in which runs of letters,
digits and signs shrink to one mark each. A term's index vector is a fixed sparse
random vector drawn from its hash; its word vector is the sum of the index
vectors around it in the fitted texts. A document is the mean of its words'
vectors, where a word that was not seen uses its shape and a run of more than
``LONGEST_WORD`` characters counts as many words, together with the share
of words that repeat the word before. A network of two layers turns that into a
score, and a temperature fitted on rows kept aside calibrates it.

Only fitting is on a bounded sample (``FIT_DOCS`` labelled rows of at most
``FIT_CHARS`` characters); scoring reads every whole text. The score depends on
the text alone. Of labelled rows that repeat a doc_id the fit takes one text.

Null texts count as empty; a text without words has the zero vector and a score
like any other. Repeated rows get the same score. An empty table gives no
scores; without any labels, or with labels of one kind, all scores are the same.
Other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.bpe import Bounded
from orderloom.llm.common import bounded_sample, from_text

FIT_DOCS = 2000
FIT_CHARS = 20_000
SIZE = 64
NONZERO = 6
HIDDEN = 32
WINDOW = 2
#: Words seen less often are known by their shape only.
LEAST_SEEN = 4
THRESHOLD = 0.3
CACHED_WORDS = 60_000
#: Longer runs without white space count as successive words of ``PIECE`` characters.
LONGEST_WORD, PIECE = 32, 8

_SHAPE = (
    (re.compile(r"[^\W\d_]+"), lambda hit: "X" if hit[0].isupper() else "Xx" if hit[0][0].isupper() else "x"),
    (re.compile(r"\d+"), lambda hit: "9"),
    (re.compile(r"([^\w\s])\1+"), lambda hit: hit[1] * 2),
)


def shape(word: str) -> str:
    """``EDTH!!`` gives ``X!!``, ``Thre***`` gives ``Xx**``."""
    for pattern, mark in _SHAPE:
        word = pattern.sub(mark, word)
    return word[:8]


def words_of(text: str) -> list[str]:
    """The words between white space, very long ones in pieces, so that all of an unspaced text counts."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    return [
        piece
        for word in words
        for piece in ((word,) if len(word) <= LONGEST_WORD else (word[i : i + PIECE] for i in range(0, len(word), PIECE)))
    ]


def index_vector(term: str) -> np.ndarray:
    """A sparse vector of +1 and -1 that depends on the term only."""
    draw = np.random.default_rng(zlib.crc32(term.encode()))
    vector = np.zeros(SIZE, dtype=np.float32)
    vector[draw.choice(SIZE, NONZERO, replace=False)] = draw.choice([-1.0, 1.0], NONZERO)
    return vector


class QualityModel:
    """Word vectors, two layers and a temperature."""

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.terms = {term: row for row, term in enumerate(vectors)}
        self.vectors = np.array([*vectors.values(), np.zeros(SIZE)], dtype=np.float32).reshape(-1, SIZE)
        self.layers: tuple[np.ndarray, ...] = ()
        self.temperature = 1.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def _row(self, word: str) -> int:
        row = self.terms.get(word)
        return row if row is not None else self.terms.get(f"\t{shape(word)}", len(self.vectors) - 1)

    def pooled(self, text: str) -> np.ndarray:
        """The mean word vector, at unit length, and the share of repeats."""
        if "rows" not in self.__dict__:
            self.rows = Bounded(self._row, CACHED_WORDS)
        words = words_of(text)
        if not words:
            return np.zeros(SIZE + 1, dtype=np.float32)
        rows = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
        mean = np.zeros(SIZE, dtype=np.float32)
        for at in range(0, len(rows), 4096):
            mean += self.vectors[rows[at : at + 4096]].sum(axis=0)
        norm = float(np.linalg.norm(mean))
        repeats = sum(map(str.__eq__, words, words[1:])) / len(words)
        return np.append(mean / norm if norm else mean, repeats).astype(np.float32)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        first, bias, second, last = self.layers
        return np.maximum(pooled @ first + bias, 0) @ second + last

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled.astype(float)) / self.temperature, -50, 50)))


def word_vectors(texts: Sequence[str]) -> dict[str, np.ndarray]:
    """Sums of the index vectors of the shapes and words around each term, at unit length."""
    seen = Counter(word for text in texts for word in words_of(text))
    shape_of = {word: f"\t{shape(word)}" for word in seen}
    known = sorted(word for word, n in seen.items() if n >= LEAST_SEEN)
    terms = [*sorted(set(shape_of.values())), *known]
    row_of = {term: row for row, term in enumerate(terms)}
    index = np.array([*map(index_vector, terms), np.zeros(SIZE)], dtype=np.float32)
    sums = np.zeros((len(terms) + 1, SIZE))
    for text in texts:
        words = words_of(text)
        shapes = np.array([row_of[shape_of[w]] for w in words], dtype=np.int64)
        own = np.array([row_of.get(w, len(terms)) for w in words], dtype=np.int64)
        total = np.cumsum(np.vstack([np.zeros((1, SIZE)), index[shapes] + index[own]]), axis=0)
        n = np.arange(len(words))
        context = total[np.minimum(n + WINDOW + 1, len(words))] - total[np.maximum(n - WINDOW, 0)]
        rows = np.concatenate([shapes, own])
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        if len(first):
            sums[rows[order][first]] += np.add.reduceat(np.vstack([context, context])[order], first, axis=0)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return dict(zip(terms, sums))


def fit(texts: Sequence[str], labels: Sequence[int], rounds: int = 400, seed: int = 7) -> QualityModel:
    """Train on four fifths of the rows and calibrate on the others."""
    model = QualityModel(word_vectors(texts))
    x = np.array([model.pooled(t) for t in texts], dtype=float).reshape(-1, SIZE + 1)
    y = np.array(labels, dtype=float)
    draw = np.random.default_rng(seed)
    layers = [
        draw.normal(0, (2 / (SIZE + 1)) ** 0.5, (SIZE + 1, HIDDEN)),
        np.zeros(HIDDEN),
        draw.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
        np.zeros(()),
    ]
    aside = np.arange(len(y)) % 5 == 4
    tx, ty = x[~aside], y[~aside]
    moment, spread = [0 * w for w in layers], [0 * w for w in layers]
    for step in range(1, rounds + 1 if len(ty) else 1):
        inner = np.maximum(tx @ layers[0] + layers[1], 0)
        error = (1 / (1 + np.exp(-np.clip(inner @ layers[2] + layers[3], -50, 50))) - ty) / len(ty)
        down = np.outer(error, layers[2]) * (inner > 0)
        slopes = [tx.T @ down, down.sum(axis=0), inner.T @ error, error.sum()]
        for i, slope in enumerate(slopes):
            slope = slope + 1e-4 * layers[i]
            moment[i] = 0.9 * moment[i] + 0.1 * slope
            spread[i] = 0.99 * spread[i] + 0.01 * slope**2
            layers[i] = layers[i] - 0.02 * moment[i] / (1 - 0.9**step) / (np.sqrt(spread[i] / (1 - 0.99**step)) + 1e-8)
    model.layers = tuple(layers)
    if aside.any():
        logits, kept = model.logits(x[aside]), y[aside]
        choices = np.geomspace(0.1, 10, 80)
        model.temperature = min(choices, key=lambda t: float(np.mean(np.logaddexp(0, (1 - 2 * kept) * logits / t))))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> QualityModel:
    """Fit on so many labelled documents, the first by a hash of their id; held-out rows are left out."""
    own = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    chosen = bounded_sample(own.distinct(), most, "doc_id", "quality")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(
        F.coalesce(F.length("text"), F.lit(0)) <= FIT_CHARS
    )
    # Of rows that repeat an identifier the smallest text stays, before anything reaches the driver.
    own = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = own.collect()  # bounded by both limits
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return fit([r.text for r in rows], [r.quality for r in rows])


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``row``, all columns of a document, and ``score``, the chance that its quality is 1."""

    def scores(texts: list[str | None]) -> list[float]:
        pooled = [model.pooled(t or "") for t in texts]
        return model.score(np.array(pooled).reshape(-1, SIZE + 1)).tolist()

    return from_text(docs, "score", T.DoubleType(), pa.float64(), lambda: scores)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit_on_labels(docs, labels)
    found = scored(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    aside = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", aside.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
