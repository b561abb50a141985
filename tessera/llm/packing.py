"""Packing of tokenised documents into windows by Karmarkar-Karp differencing.

Documents are tokenised, cut into pieces, and each bounded run of pieces is
partitioned into near-equal windows: the two partial partitions with the widest
spreads are merged again and again, the fullest windows of one with the emptiest
of the other, until one partition is left. If a window then exceeds the capacity,
the run is partitioned again into one window more.

Each input partition is streamed once and packs its own documents, so nothing is
shuffled, no task holds more than one run, and a lost task repeats alone with the
same numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Memoised words per Python worker, after which the memo starts afresh.
MEMO_WORDS = 500_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def partition_sizes(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of sizes in so many windows of near-equal sums (multiway differencing).

    A partial partition is a vector of window sums less its least one, ascending, with the members of each window as
    nested pairs. Ties break by age, so equal input gives equal output.
    """
    if not sizes:
        return [[] for _ in range(windows)]
    if windows == 1:
        return [list(range(len(sizes)))]
    heap = []
    for age, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        sums = np.zeros(windows, dtype=np.int64)
        sums[-1] = sizes[i]
        members = np.full(windows, None, dtype=object)
        members[-1] = i
        heap.append((-sizes[i], age, sums, members))
    heapq.heapify(heap)
    age = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        members = np.empty(windows, dtype=object)
        members[:] = [y if x is None else x if y is None else (x, y) for x, y in zip(in_a, in_b[::-1], strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), age, sums, members[order]))
        age += 1
    out = []
    for tree in heap[0][3]:
        flat, todo = [], [] if tree is None else [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                flat.append(x)
        out.append(sorted(flat))
    return out


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity; their number starts at the least possible and rises while one is exceeded."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = partition_sizes(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        windows += 1


class WordIds:
    """Token ids of a text as little-endian 32-bit bytes, memoised by word.

    The tokenizer must treat words apart (white space never joins or changes its tokens) and lower-case, as the
    word-level BPE does: its patterns hold no white space, and neither composition nor lower-casing reaches over it.
    Separators U+001C to U+001F, which Python alone takes as white space, send a text to the tokenizer whole. A word of
    Latin letters with marks behind it is two pre-tokens, so letters are learnt once for all cases and marks; many are
    sent joined by spaces and told apart by the ids that end a word.
    """

    #: Marks that may follow a word's letters without meeting a pattern of the vocabulary.
    MARKS = ".,;:!?#$%&*)|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_letters(self, new: list[str]) -> None:
        """Memoises lower-case words of Latin letters, each one pre-token."""
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(part) and stops[-1] == 4 * len(ids):
                flat, start = ids.tobytes(), 0
                for word, stop in zip(part, stops.tolist(), strict=True):
                    self.letters[word] = flat[start:stop]
                    start = stop
            else:
                self.letters.update((word, self.whole(word)) for word in part)

    def learn(self, texts: list[list[str]]) -> None:
        """Memoises the words of these texts that are not yet known."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if len(self.letters) > MEMO_WORDS:
            self.letters.clear()
        words, cores, tails = [], [], []
        for word in set().union(*texts).difference(self.memo):
            core = word.rstrip(self.MARKS)
            low = core.lower()
            if core.isalpha() and (core.isascii() or max(core) < "\u0250" and len(low) == len(core)):
                words.append(word)
                cores.append(low)
                tails.append(word[len(core) :])
            else:
                self.memo[word] = self.whole(word)
        for marks in set(tails).difference(self.letters):
            self.letters[marks] = self.whole(marks)
        self._learn_letters(list(set(cores).difference(self.letters)))
        of = self.letters.__getitem__
        self.memo.update(zip(words, map(bytes.__add__, map(of, cores), map(of, tails)), strict=True))

    def many(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 128):
            part = texts[at : at + 128]
            split = [[] if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in part]
            self.learn(split)
            for words, text in zip(split, part, strict=True):
                yield b"".join(map(self.memo.__getitem__, words)) if words else self.whole(text)


def _pack(batches, path: str, capacity: int, max_piece: int, run_windows: int, fill: float, end_id: int):
    words = WordIds(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    serial = TaskContext.get().partitionId() << 36
    goal = int(run_windows * capacity * fill)
    whole: list[list[tuple]] = []  # windows of one piece: doc_id, start, ids, doc_tokens
    run: list[tuple] = []
    full = 0

    def rows_of(windows: list[list[tuple]]) -> pa.RecordBatch:
        nonlocal serial
        rows = []
        for window in windows:
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // 4, ids, total, serial, offset))
                offset += len(ids) // 4
            serial += 1
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def packed() -> list[list[tuple]]:
        return [[run[i] for i in members] for members in pack_sizes([len(p[2]) // 4 for p in run], capacity)]

    for batch in (table.slice(at, 1024) for table in batches for at in range(0, table.num_rows, 1024)):
        texts = batch.column(1).to_pylist()
        for doc, ids in zip(batch.column(0).to_pylist(), words.many(texts), strict=True):
            ids += end
            total = len(ids) // 4
            at = total // capacity * capacity
            whole += [[(doc, x, ids[4 * x : 4 * (x + capacity)], total)] for x in range(0, at, capacity)]
            parts = -(-(total - at) // max_piece)
            for to in [at + (total - at) * (k + 1) // parts for k in range(parts)]:
                while full + to - at >= goal:  # the run ends here, if need be within the piece
                    stop = at + goal - full
                    run.append((doc, at, ids[4 * at : 4 * stop], total))
                    yield rows_of(whole + packed())
                    at, whole, run, full = stop, [], [], 0
                if to > at:
                    run.append((doc, at, ids[4 * at : 4 * to], total))
                    full += to - at
                    at = to
    if whole or run:
        yield rows_of(whole + (packed() if run else []))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    max_piece: int = 1024,
    run_windows: int = 48,
    fill: float = 0.99,
    end_id: int = 2,
) -> DataFrame:
    """Pieces of every document in windows of at most ``capacity`` tokens.

    One row per piece: doc_id, start (tokens of the document before it), length, ids (little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id, offset (its place in the window, gapless from 0). A document's tokens are those
    of its text, then ``end_id``; null and empty texts have that one token, repeated rows are packed each on its own,
    a null doc_id stays null, and an empty table gives no row. A text longer than the capacity fills whole windows; what
    remains is cut into equal pieces of at most ``max_piece``. Pieces are packed in runs of ``fill`` times the capacity
    of ``run_windows`` windows; the document at the end of a run is cut there. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, tokenizer_path, capacity, max_piece, run_windows, fill, end_id), SCHEMA)
