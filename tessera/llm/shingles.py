"""Word shingles as 64-bit hashes, and MinHash signatures of their sets; numpy over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multiplier that tells the words of a shingle apart by place.
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, A to Z lower-cased (what bytes.lower and bytes.split do)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order; of the whole sequence where there are fewer words; none without words."""
    size = min(n, len(words))
    if not size:
        return words
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = out * STEP + words[k : len(words) - size + 1 + k]
    return mixed(out + np.uint64(size))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    return np.unique(grams(word_hashes(text), n))


def multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the k hash functions of a signature; fixed by k, alike on every machine."""
    rng = np.random.default_rng(20_240_229 + k)
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """The k minima of each set that isn't empty, 32 bits each; an empty set gets zeros."""
    out = np.zeros((len(sets), k), dtype=np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    mult, flip = multipliers(k)
    at = 0
    while at < len(full):
        part, size = [], 0
        while at < len(full) and (not part or size < 30_000):
            part.append(full[at])
            size += len(sets[full[at]])
            at += 1
        flat = np.concatenate([sets[i] for i in part])
        starts = np.cumsum([0, *(len(sets[i]) for i in part[:-1])])
        for j in range(k):
            out[part, j] = np.minimum.reduceat(((flat ^ flip[j]) * mult[j]) >> np.uint64(32), starts).astype(np.uint32).view(np.int32)
    return out


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind) if flat.dtype != np.uint64 else flat.view(kind)))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text as bytes, text_key) to doc_id, n_shingles, set_key, sig, text_key."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
            sigs = signatures(sets, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, k, dtype=np.int32)), pa.array(sigs.ravel())),
                    batch.column(2),
                ],
                names=["doc_id", "n_shingles", "set_key", "sig", "text_key"],
            )


def full_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(text as bytes) to set_key, shingles."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            sets = [shingle_set(t, n) for t in whole.slice(at, 512).column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), _lists(sets, np.int64)], names=["set_key", "shingles"])
