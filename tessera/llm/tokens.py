"""Token counts by byte-pair merging with a heap over a linked list of symbols."""

from __future__ import annotations

import heapq
import json
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The published split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Memoised words per Python worker, after which the memo starts afresh.
MEMO_WORDS = 800_000
#: Bytes written as themselves by byte-level vocabularies (fixed values); the rest take code points from 256 on.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    rest = [b for b in range(256) if b not in PLAIN_BYTES]
    return {b: chr(b) for b in PLAIN_BYTES} | {b: chr(256 + k) for k, b in enumerate(rest)}


def count_after_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens of one pre-token: initial symbols minus merges.

    Adjacent pairs wait in a heap by rank, then position; the symbols form a linked list. A popped pair whose symbols
    have changed since it was pushed is stale and skipped.
    """
    n = len(symbols)
    if n < 2:
        return n
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        merges += 1
        symbols[i], symbols[j] = a + b, ""
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbols[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], a + b))
    return n - merges


@cache
def stand_ins(path: str) -> dict[int, str]:
    """Code points that the vocabulary's library puts into another class than the pattern's engine, which knows another
    version of Unicode: each with a character of the library's class (letter, number, white space or other).

    Runs of characters of one class are one pre-token of the library; those that aren't are halved until it is told which
    characters differ.
    """
    import regex
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    edges = {r"\p{L}": "a", r"\p{N}": "9", r"[^\s\p{L}\p{N}]": "!", r"\s": "\n"}

    def strange(run: str, edge: str):
        if len(cut(edge + run + edge)) > 1:
            if len(run) == 1:
                yield run
            else:
                for half in (run[: len(run) // 2], run[len(run) // 2 :]):
                    yield from strange(half, edge)

    found = {}
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    for at in range(0, len(every), 4096):
        chunk = "".join(map(chr, every[at : at + 4096]))
        for kind, edge in edges.items():
            if run := "".join(regex.findall(kind, chunk)):
                for c in strange(run, edge):
                    found[ord(c)] = next((e for e in "a9!" if len(cut(e + c + e)) == 1), "\n")
    return found


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) > MEMO_WORDS:
            self.clear()
        self[key] = out = self.make(key)
        return out


class Counter:
    """Counts tokens as the vocabulary file's library does; no identifiers are made.

    Texts with one of the code points of ``odd`` (see ``stand_ins``) are cut where their stand-ins are.
    """

    def __init__(self, path: str, odd: dict[int, str]):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.letters = byte_letters()
        pattern = regex.compile(PATTERN)
        self.find, self.places = pattern.findall, pattern.finditer
        self.odd, self.odd_letters = odd, frozenset(map(chr, odd))
        self.far = re.compile(f"[{re.escape(chr(min(odd)))}-\U0010ffff]").search if odd else None
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.odd_space = re.compile(r"[^\S \n]").search
        self.pre = _Memo(self._pre)
        self.bare = _Memo(self._piece)
        self.spaced = _Memo(lambda word: self._piece(" " + word))

    def _pre(self, pre_token: str) -> int:
        return count_after_merges([self.letters[b] for b in pre_token.encode()], self.ranks)

    def _piece(self, text: str) -> int:
        return sum(self.pre[x] if len(x) < 200 else self._pre(x) for x in self.find(text))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if self.far is not None and self.far(text) and not self.odd_letters.isdisjoint(text):
            return sum(self._pre(text[slice(*m.span())]) for m in self.places(text.translate(self.odd)))
        if self.odd_space(text):
            return self._piece(text)
        total = -1
        for line in text.split("\n"):
            words = line.split(" ")
            if "" in words:  # white space that meets other white space or an end
                return self._piece(text)
            total += 1 + self.bare[words[0]] + sum(map(self.spaced.__getitem__, words[1:]))
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


_COUNTERS: dict[str, Counter] = {}


def _count(batches, path: str, odd):
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, odd.value)
    count = _COUNTERS[path].count
    for batch in batches:
        n = pa.array(map(count, batch.column(2).to_pylist()), type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text.

    ``vocabulary_path`` names a byte-level BPE file on every machine. A special string of it inside a text is one token.
    Null and empty texts have none; every row is counted on its own, repeated ones too; an empty table gives no row.
    One pass without a shuffle: memory is bounded by the memo of words and the longest text.
    """
    whole = text_or_empty(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    odd = docs.sparkSession.sparkContext.broadcast(stand_ins(vocabulary_path))  # of code points: the same for every table
    return rows.mapInArrow(lambda it: _count(it, vocabulary_path, odd), "doc_id long, n_bytes long, n_tokens long")
