"""Quality scores by similarity-weighted voting of nearest labelled neighbours in a latent-semantic space.

A document's terms are its words, its pairs of words, the shapes of its words (letters by case, digits, signs) and how
much of it repeats itself. The labelled sample's TF-IDF matrix is reduced by its leading singular vectors, found by a
randomised SVD; the sample's vectors, of fixed size, go to every task, and each batch of documents is multiplied with all
of them in blocks, so neighbours are exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .shingles import STEP, mixed

#: Buckets of terms: of words, of pairs of words, and of shapes and repetition.
WORDS, PAIRS, SHAPES = 1 << 13, 1 << 13, 1 << 11
TERMS = WORDS + PAIRS + SHAPES
#: Weights of the three kinds of terms.
WEIGHTS = (1.0, 0.5, 2.0)
#: Documents scored at a time: what is held is so many rows of cosines to the sample.
ROWS = 256
#: Memoised words per Python worker, after which the memo starts afresh.
MEMO_WORDS = 200_000

_LETTERS, _DIGITS, _SAME = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"


def word_shape(word: str) -> str:
    """Runs of letters as X (capitals), Xx (a capital first) or x, runs of digits as 9, runs of a sign as the sign."""
    if word.isalpha() and word.islower():
        return "x"
    shape = _LETTERS.sub(lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "Xx" if m[0][0].isupper() else "x", word)
    return _SAME.sub(r"\1", _DIGITS.sub("9", shape))


def _shape_bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % SHAPES


class _Hashes(dict):
    """A word to a hash of its letters and the bucket of its shape, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        core = word.lower().strip(_EDGES)
        self[word] = out = (xxhash.xxh3_64_intdigest(core) >> 12) * SHAPES + _shape_bucket(word_shape(word))
        return out


_SEEN = _Hashes()
#: Tenths of a text's words or lines that are distinct.
_LEVELS = {kind: [_shape_bucket(f"{kind} {k}") for k in range(11)] for kind in ("words", "lines")}


def terms_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's terms, and the weighted logarithm of how often each occurs; none for a blank text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    both = np.fromiter(map(_SEEN.__getitem__, words), dtype=np.uint64, count=len(words))
    letters, shapes = both // np.uint64(SHAPES), both % np.uint64(SHAPES)
    pairs = mixed(letters[:-1] * STEP + letters[1:]) % np.uint64(PAIRS) + np.uint64(WORDS)
    lines = text.split("\n")
    levels = [_LEVELS["words"][10 * len(set(words)) // len(words)], _LEVELS["lines"][10 * len(set(lines)) // len(lines)]]
    level = np.repeat(np.array(levels, dtype=np.uint64), len(words))
    flat = np.concatenate([letters % np.uint64(WORDS), pairs, shapes + np.uint64(WORDS + PAIRS), level + np.uint64(WORDS + PAIRS)])
    terms, n = np.unique(flat.astype(np.int32), return_counts=True)
    kind = np.searchsorted([WORDS, WORDS + PAIRS], terms, side="right")
    return terms, (np.log1p(n) * np.array(WEIGHTS)[kind]).astype(np.float32)


def _product(rows: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray) -> np.ndarray:
    """The sparse rows times a dense matrix, some rows at a time."""
    out = np.zeros((len(rows), dense.shape[1]), dtype=np.float32)
    for at, (terms, values) in enumerate(rows):
        if len(terms):
            out[at] = values @ dense[terms]
    return out


def _transposed_product(rows: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray) -> np.ndarray:
    """The transpose of the sparse rows times a dense matrix of as many rows."""
    out = np.zeros((TERMS, dense.shape[1]), dtype=np.float32)
    for (terms, values), row in zip(rows, dense, strict=True):
        out[terms] += values[:, None] * row  # terms of a row are distinct
    return out


def right_singular_vectors(rows: list[tuple[np.ndarray, np.ndarray]], dims: int, extra: int = 16, powers: int = 2) -> np.ndarray:
    """The leading right singular vectors of the sparse rows, TERMS x dims at most, by a randomised range finder with powers."""
    q = np.random.default_rng(17).standard_normal((TERMS, dims + extra)).astype(np.float32)
    for _ in range(powers):
        q, _ = np.linalg.qr(_transposed_product(rows, _product(rows, q)))
    _, _, v = np.linalg.svd(_product(rows, q), full_matrices=False)
    return q @ v[:dims].T


@dataclass
class Model:
    """A basis (TERMS x dims, each row times its term's inverse document frequency), and the sample's unit vectors with their labels; prior is the score without neighbours."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = 15
    power: int = 8

    def embed(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = _product(rows, self.basis)
        size = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(size > 0, size, 1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Mean label of the nearest neighbours, weighted by cosine to a power; the prior where no cosine is positive. Of equal cosines the first of the sample count."""
        k = min(self.neighbours, len(self.labels))
        if not k:
            return np.full(len(rows), self.prior)
        cosine = (self.embed(rows) @ self.vectors.T).round(6)
        kth = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        above, level = cosine > kth, cosine == kth
        near = above | (level & (level.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(near, np.maximum(cosine, 0), 0).astype(float) ** self.power
        total = weight.sum(axis=1)
        return np.where(total > 0, np.clip(weight @ self.labels / np.where(total > 0, total, 1), 0, 1), self.prior)


def _counted(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            rows = [terms_of(t) for t in b.column(1).to_pylist()]
            both = [pa.array([x[k].tobytes() for x in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *both], names=["label", "terms", "values"])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, dims: int = 64, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model of at most ``sample`` labelled documents, those of the least hashed doc_ids.

    Labels other than 0 and 1 are left out; of a document's several labels the least counts, of rows that repeat a doc_id
    the least text. Without any labelled document the prior, 1, is every document's score. What reaches the driver is
    ``sample`` rows of at most TERMS terms each.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    rows = rows.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.min(label).cast("int").alias("label"))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "id")  # ``sample`` rows
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    found = texts.select("label", "text").mapInArrow(_counted, "label int, terms binary, values binary").toPandas()
    found = found.sort_values(["label", "terms", "values"])
    y = found["label"].to_numpy(dtype=float)
    if not len(y):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 1.0)
    sparse = [(np.frombuffer(t, np.int32), np.frombuffer(v, np.float32)) for t, v in zip(found["terms"], found["values"], strict=True)]
    in_docs = np.zeros(TERMS)
    for terms, _ in sparse:
        in_docs[terms] += 1
    idf = np.log((1 + len(y)) / (1 + in_docs)).astype(np.float32)  # 0 for what every document has
    unit = []
    for terms, values in sparse:
        weighted = values * idf[terms]
        unit.append((terms, weighted / max(float(np.linalg.norm(weighted)), 1e-9)))
    basis = right_singular_vectors(unit, dims) * idf[:, None]
    model = Model(basis.astype(np.float32), np.zeros(0), y, float(y.mean()))
    model.vectors = model.embed(sparse)
    return model


def _scored(batches, model):
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            terms = [terms_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(terms))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row. Null and empty texts get the model's prior; repeated rows score alike; an empty table gives no row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(lambda it: _scored(it, sent), "doc_id long, score double")


def _kept(batches, model, at: int, least: float):
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            b = whole.slice(first, ROWS)
            terms = [terms_of(t or "") for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(model.value.score(terms) >= least))


def keep_good(docs: DataFrame, model: Model, *, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs whose score is at least ``least``, with all their columns, whatever their names.

    Null and empty texts have the model's prior; repeated rows stay or go together; an empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda it: _kept(it, sent, at, least), docs.schema)
