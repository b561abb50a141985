"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

Documents are cut into overlapping passages. Their TF-IDF vectors, over the benchmark's words (no other word can bring a
passage nearer to an item), span a latent space that a randomised SVD finds in one distributed pass: every task adds up
its share of A'A O for a fixed random O, the shares are summed, and a Nystrom factorisation gives the right singular
vectors. Passages near an item by cosine are candidates. A candidate holds if its longest common subsequence with the
item covers enough of the item's words, and enough of the item's answer, its longest words, stands in the passage.

The space has DIMS dimensions whatever the benchmark, so it isn't what decides: each item is also posted under its rarest
words, as many as leave too few others for a leak, and every passage that holds one of them is a candidate as well.

Words become small integers once, in a written table; the later passes read those. Frequencies and the space cover every
document. What goes to every task is bounded by the benchmark: its vocabulary, and blocks of ITEMS item passages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join, text_or_empty, unique_name

#: Words of a passage, words from one passage to the next, and words that a check looks at before and behind one.
WINDOW, STRIDE, MARGIN = 64, 32, 16
#: Dimensions of the latent space, and further columns of the random matrix.
DIMS, EXTRA = 128, 16
#: Item passages that one pass searches for.
ITEMS = 20_000
#: Terms summed at a time.
TERM_BLOCK = 64
#: Words in more than this share of documents, and of SMOOTH further ones, weigh nothing; the others' inverse document
#: frequency to this power.
COMMON, SMOOTH, RARITY = 0.05, 50, 2
#: Memoised words per Python worker, after which the memo starts afresh.
MEMO_WORDS = 600_000

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"


def words_of(text: str) -> list[str]:
    """Words by white space, lower-cased, without signs at their ends; those of signs alone are empty."""
    return [w.strip(_EDGES) for w in text.lower().split()]


class _Ids(dict):
    """Raw word to its number in a vocabulary, 0 for words outside."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = out = self.vocabulary.get(word.lower().strip(_EDGES), 0)
        return out


def _numbered(batches, vocabulary):
    ids = _Ids(vocabulary.value)
    kind = np.uint16 if len(vocabulary.value) < 1 << 16 else np.uint32
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            rows = [np.array(list(map(ids.__getitem__, t.split())), dtype=kind).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["doc_id", "words"])


def _documents_with(frames, kind, size: int):
    total = np.zeros(size, dtype=np.int64)
    for frame in frames:
        for words in frame["words"]:
            total[np.unique(np.frombuffer(words, dtype=kind))] += 1
    at = np.flatnonzero(total[1:]) + 1
    yield pd.DataFrame({"term": at, "n": total[at]})


@dataclass
class Chunks:
    """The weighted terms of documents cut every STRIDE words; a passage is a chunk with the next one of its document.

    ``chunk`` and ``term`` name each occurrence that has weight, ``first`` and ``count`` each document's chunks.
    """

    chunk: np.ndarray
    term: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, documents: list[np.ndarray], weight: np.ndarray) -> Chunks:
        flat = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        count = np.maximum(1, -(-sizes // STRIDE))
        first = np.cumsum([0, *count])[:-1].astype(np.int64)
        at = np.flatnonzero(weight[flat])
        doc = np.repeat(np.arange(len(documents)), sizes)[at]
        place = at - (np.cumsum(sizes) - sizes)[doc]
        return cls(first[doc] + place // STRIDE, flat[at].astype(np.int64), first, count)

    def sums(self, basis: np.ndarray) -> np.ndarray:
        """Each chunk's sum of its terms' rows of basis: the k-th occurrence of all chunks at a time."""
        total = int(self.count.sum())
        n = np.bincount(self.chunk, minlength=total)
        order = np.argsort(-n, kind="stable")  # chunks with most terms first
        starts = (np.cumsum(n) - n)[order]
        n = n[order]
        out = np.zeros((total, basis.shape[1]), dtype=np.float32)
        for k in range(int(n[0]) if total else 0):
            m = int(np.searchsorted(-n, -k, side="left"))  # chunks with more than k terms
            out[:m] += basis[self.term[starts[:m] + k]]
        back = np.empty_like(out)
        back[order] = out
        return back

    def passages(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each passage's vector, document and first word; a document of one chunk has one passage."""
        last = self.first + self.count - 1
        more = np.ones(len(sums), dtype=bool)
        more[last[self.count > 1]] = False
        owner = np.repeat(np.arange(len(self.first)), self.count)
        at = np.flatnonzero(more)
        z = sums[at].copy()
        pair = self.count[owner[at]] > 1
        z[pair] += sums[at[pair] + 1]
        return z, owner[at], (at - self.first[owner[at]]) * STRIDE

    def both(self, z: np.ndarray) -> np.ndarray:
        """For each chunk the sum of the vectors of the passages that it is in."""
        last = self.first + self.count - 1
        more = np.ones(int(self.count.sum()), dtype=bool)
        more[last[self.count > 1]] = False
        out = np.zeros((len(more), z.shape[1]), dtype=z.dtype)
        out[more] = z
        up = np.flatnonzero(more)
        pair = np.repeat(self.count, self.count)[up] > 1
        out[up[pair] + 1] += z[pair]
        return out


def _documents(words, kind):
    return [np.frombuffer(w, dtype=kind) for w in words]


def _sketched(frames, kind, weight, omega):
    """This task's share of A'A O, by blocks of terms. ``omega`` is O with each row times its term's weight, as A's columns are."""
    total = np.zeros(omega.value.shape)
    for frame in frames:
        for at in range(0, len(frame), 512):
            chunks = Chunks.of(_documents(frame["words"].iloc[at : at + 512], kind), weight.value)
            z, _, _ = chunks.passages(chunks.sums(omega.value))
            y = np.asfortranarray(chunks.both(z))
            for j in range(total.shape[1]):
                total[:, j] += np.bincount(chunks.term, weights=y[chunks.chunk, j], minlength=len(total))
    total *= weight.value[:, None]
    for block in range(0, len(total), TERM_BLOCK):
        if (part := total[block : block + TERM_BLOCK]).any():
            yield pd.DataFrame({"block": [block], "part": [part.tobytes()]})


def _summed(frames):
    """Sums the parts of each block that come in; a task holds one sum per block of its own."""
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for block, part in zip(frame["block"], frame["part"], strict=True):
            x = np.frombuffer(part)
            sums[block] = sums[block] + x if block in sums else x
    for block, x in sums.items():
        yield pd.DataFrame({"block": [block], "part": [x.tobytes()]})


def nystrom(b: np.ndarray, omega: np.ndarray, dims: int) -> np.ndarray:
    """The leading right singular vectors of A, from b = A'A omega; zeros where A is zero."""
    core = omega.T @ b
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    sound = values > max(values.max(initial=0), 0) * 1e-8
    if not sound.any():
        return np.zeros((len(b), 1))
    half = b @ (vectors[:, sound] / np.sqrt(values[sound]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, : min(dims, int((s > s[0] * 1e-6).sum()))]


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := places.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Item:
    """A passage of a benchmark item: its words' numbers, the answer, the longest quarter of them, and the fewest distinct ones a leak has.

    A leak holds one of the words ``posted``; None if anything is one.
    """

    item_id: int
    words: list[int]
    distinct: set[int]
    answer: set[int]
    least: int
    posted: list[int] | None


def needed(n: int, share: float) -> int:
    """The least count whose share of n is enough."""
    h = max(0, int(share * n) - 1)
    while h / n < share:
        h += 1
    return h


def posting(choices: list[tuple[set[int], int]], in_docs) -> list[int] | None:
    """The words to post an item under, for choices of (words, how many of them a leak has): the rarest of one choice.

    A leak lacks at most len(words) - least of them, so that it holds one of any len(words) - least + 1.
    """
    lists = [sorted(words, key=lambda w: (in_docs[w], w))[: max(0, len(words) - least + 1)] for words, least in choices if least > 0]
    return min(lists, key=lambda words: sum(in_docs[w] for w in words), default=None)


class Postings:
    """The items of a block by the words that they are posted under."""

    def __init__(self, items: list[Item], size: int):
        pairs = np.array([(w, k) for k, item in enumerate(items) for w in item.posted or ()], dtype=np.int64).reshape(-1, 2)
        self.items = pairs[np.argsort(pairs[:, 0], kind="stable"), 1]
        self.count = np.bincount(pairs[:, 0], minlength=size)
        self.first = np.cumsum(self.count) - self.count

    def met(self, documents: list[np.ndarray], chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """Passages and items, by passage: those whose passage, with its margins, holds a word that the item is posted under."""
        flat = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        at = np.flatnonzero(self.count[flat])
        doc = np.repeat(np.arange(len(documents)), sizes)[at]
        place, word = at - (np.cumsum(sizes) - sizes)[doc], flat[at].astype(np.int64)
        n = np.maximum(1, chunks.count - 1)  # passages of a document
        base = (np.cumsum(n) - n)[doc]
        low = np.maximum(0, (place - WINDOW - MARGIN) // STRIDE + 1)
        high = np.minimum(n[doc] - 1, (place + MARGIN) // STRIDE)
        size = len(self.count)
        spans = range(int((high - low).max(initial=-1)) + 1)
        held = np.unique(np.concatenate([np.zeros(0, np.int64), *((base + low + k)[low + k <= high] * size + word[low + k <= high] for k in spans)]))
        passage, word = held // size, held % size
        n = self.count[word]
        which = np.repeat(self.first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(passage, n), self.items[which]


def _found(batches, kind, weight, basis, vectors, items, cosine: float, share: float, answer: float):
    weight, basis, vectors, items = weight.value, basis.value, vectors.value, items.value
    postings = Postings(items, len(weight))
    anywhere = [k for k, item in enumerate(items) if item.posted is None]
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            docs = _documents(batch.column(1).to_pylist(), kind)
            chunks = Chunks.of(docs, weight)
            z, owner, first = chunks.passages(chunks.sums(basis))
            size = np.linalg.norm(z, axis=1, keepdims=True)
            z /= np.where(size > 0, size, 1)
            passage, posted = postings.met(docs, chunks)
            best: dict[tuple[int, int], tuple] = {}
            for lo in range(0, len(z), 8192):
                near = z[lo : lo + 8192] @ vectors.T
                last = -1
                asked = near >= cosine
                asked[:, anywhere] = True
                part = slice(*np.searchsorted(passage, [lo, lo + 8192]))
                asked[passage[part] - lo, posted[part]] = True
                for p, i in zip(*(x.tolist() for x in np.nonzero(asked)), strict=True):
                    if p != last:
                        last, doc, start = p, int(owner[lo + p]), int(first[lo + p])
                        seen = docs[doc][max(0, start - MARGIN) : start + WINDOW + MARGIN].tolist()
                        bag = set(seen)
                    item = items[i]
                    # a common subsequence covers its length less the item's repetitions in distinct words
                    if len(item.distinct & bag) < item.least:
                        continue
                    common = lcs_length(item.words, seen) / len(item.words)
                    told = len(item.answer & bag) / len(item.answer)
                    if common >= share and told >= answer:
                        key = (doc, item.item_id)
                        best[key] = max(best.get(key, (0.0,)), (common, told, float(near[p, i]), -start))
            out = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([k[0] for k, _ in out], pa.int64())),
                    pa.array([k[1] for k, _ in out], pa.int64()),
                    *(pa.array([v[x] for _, v in out], pa.float64()) for x in range(3)),
                    pa.array([-v[3] for _, v in out], pa.int64()),
                ],
                names=["doc_id", "item_id", "lcs_share", "answer_share", "cosine", "start_word"],
            )


def _leaks_of_block(rows: DataFrame, items: DataFrame, cosine: float, share: float, answer: float) -> DataFrame:
    """``find_leaks`` of one block of items (i, t) in documents (doc_id, text)."""
    spark = rows.sparkSession
    keep = Scratch(spark, "decontam")
    schema = "doc_id long, item_id long, lcs_share double, answer_share double, cosine double, start_word long"
    listed = sorted({(r.i, tuple(w for w in words_of(r.t) if w)) for r in items.toLocalIterator()})
    listed = [x for x in listed if x[1]]
    if not listed:
        return spark.createDataFrame([], schema)
    vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, words in listed for w in words}))}
    size = len(vocabulary) + 1
    kind = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32
    send = spark.sparkContext.broadcast
    sent_vocabulary = send(vocabulary)
    numbered = keep.write(rows.mapInArrow(lambda it: _numbered(it, sent_vocabulary), "doc_id long, words binary"))
    n_docs = numbered.count()
    seen = numbered.select("words").mapInPandas(lambda it: _documents_with(it, kind, size), "term int, n long")
    in_docs = np.zeros(size)
    for r in seen.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # a row per word of the benchmark at most
        in_docs[r.term] = r.n
    weight = np.log((1 + n_docs) / (1 + in_docs)).clip(0) ** RARITY
    weight[in_docs > COMMON * (n_docs + SMOOTH)] = 0
    weight[0] = 0

    parts = []
    for i, words in listed:
        numbers = np.array([vocabulary[w] for w in words])
        n = -(-len(numbers) // WINDOW)
        parts += [(i, numbers[len(numbers) * k // n : len(numbers) * (k + 1) // n]) for k in range(n)]
    searched, spelled = [], list(vocabulary)
    for i, numbers in parts:
        distinct = np.unique(numbers).tolist()
        telling = sorted(distinct, key=lambda n: (-len(spelled[n - 1]), n))  # leaks would make rare words frequent
        told = set(telling[: -(-len(telling) // 4)])
        least = needed(len(numbers), share) - (len(numbers) - len(distinct))
        if share > 0:  # a common subsequence has a word
            least = max(1, least)
        posted = posting([(told, needed(len(told), answer)), (set(distinct), least)], in_docs)
        searched.append(Item(i, numbers.tolist(), set(distinct), told, least, posted))
    omega = np.random.default_rng(11).standard_normal((size, DIMS + EXTRA)).astype(np.float32)
    sent_weight, sent_omega = send(weight), send((omega * weight[:, None]).astype(np.float32))
    shares = numbered.select("words").mapInPandas(lambda it: _sketched(it, kind, sent_weight, sent_omega), "block int, part binary")
    sums = shares.repartition("block").mapInPandas(_summed, "block int, part binary")
    b = np.zeros((size, omega.shape[1]))
    for r in sums.toLocalIterator():  # a row per TERM_BLOCK words of the benchmark
        part = np.frombuffer(r.part).reshape(-1, omega.shape[1])
        b[r.block : r.block + len(part)] = part
    basis = (nystrom(b, omega.astype(float), DIMS) * weight[:, None]).astype(np.float32)
    sent_basis = send(basis)
    out = None
    for at in range(0, len(searched), ITEMS):
        block = searched[at : at + ITEMS]
        z = np.stack([basis[x.words].sum(axis=0) for x in block])
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        sent_vectors, sent_items = send(z / np.where(norm > 0, norm, 1)), send(block)
        one = numbered.mapInArrow(
            lambda it, v=sent_vectors, x=sent_items: _found(it, kind, sent_weight, sent_basis, v, x, cosine, share, answer), schema
        )
        out = one if out is None else out.unionByName(one)
    if len(parts) > len(listed):
        best = F.max(F.struct("lcs_share", "answer_share", "cosine", "start_word")).alias("b")
        out = out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    cosine: float = 0.4,
    share: float = 0.6,
    answer: float = 0.5,
    block_items: int = 50_000,
) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, cosine, start_word: the best passage of each document for each item it leaks.

    Items longer than WINDOW words are searched for in passages of up to WINDOW words; an item counts as leaked if one
    of them is. Items of no words (null, empty, signs alone) are never found, nor are rows of a null item_id; items of
    equal words are found alike. A null or empty document leaks nothing; repeated documents leak alike; of null doc_id
    the rows are found with a null. An empty table on either side gives no row. Other columns are not read.

    The benchmark is searched for in blocks of about ``block_items`` items, each with a vocabulary and a space of its
    own, so what the driver and each task hold is bounded by a block; a block is three passes over the documents'
    words. The blocks change the column cosine only: every passage that passes the checks is a candidate in any space.
    """
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), text_or_empty(item_text).alias("t")).distinct()
    blocks = max(1, -(-items.count() // block_items))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    found = [_leaks_of_block(rows, items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k), cosine, share, answer) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of docs whose text leaks no item, with all their columns, whatever their names.

    A row is told by its text, so null and repeated doc_ids need no rule: equal texts go or stay together. Null and empty
    texts stay; an empty table gives no row; an empty benchmark drops none.
    """
    key = unique_name("leak_key", docs.columns)
    marked = docs.withColumn(key, F.xxhash64(text_or_empty(text)))
    leaks = find_leaks(marked.select(F.col(key), F.col(text)), benchmark, doc_id=key, text=text, **options).select(F.col("doc_id").alias(key)).distinct()
    return salted_join(marked, leaks, [key], F.spark_partition_id(), "left_anti").select(docs.columns)
