import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tessera.llm import packing, tokens

ODD = [
    "", " ", "\n\n", "a  b", " lead", "trail ", "it's we'll", "x\ty\r\nz", "née Ünï", "日本語 のテキスト", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c",
    "a\x1cb \x85c\u00a0d\u2028e\u3000f", "12345 67", "!!! ??", "e\u0301 \u0301x", "\u1680a", "😀 😀😀", "A" * 3000, "ab" * 500 + " " + "é" * 300, "İstanbul ΣΑΣ",
]
SCHEMA = "doc_id long, text string, ids string, extra int"


def rows():
    rng = random.Random(4)
    made = ["".join(rng.choice("abcé \n\t.,'s12€日\u0301") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return [(i, t, "x", i) for i, t in enumerate([*ODD, *made])] + [(None, "null id", None, None), (7777, None, None, 1), (3, ODD[3], "x", 3)]


def test_counts_equal_the_library(spark):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    data = rows()
    got = tokens.count_tokens(spark.createDataFrame(data, SCHEMA), path("byte_bpe_50k.json")).collect()
    want = sorted((-1 if d is None else d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, *_ in data)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_every_code_point_counts_as_in_the_library():
    file = path("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    counter = tokens.Counter(file, tokens.stand_ins(file))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}'s 9{c}" for c in every]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        wrong = [x for x, e in zip(part, t.encode_batch(part, add_special_tokens=False), strict=True) if counter.count(x) != len(e.ids)]
        assert not wrong
    rng = random.Random(7)
    odd = sorted(counter.odd_letters)
    for _ in range(3000):
        x = "".join(rng.choice([rng.choice(odd), rng.choice(odd), "a", " ", "9", "'s", "!", "\n", "é"]) for _ in range(rng.randint(1, 25)))
        assert counter.count(x) == len(t.encode(x, add_special_tokens=False).ids)


def test_long_texts(spark):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["ab" * 60_000, "word " * 100_000, "日本" * 20_000, " " * 50_000, "\n" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tokens.count_tokens(empty, path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(empty, path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pack_round_trip(spark, capacity):
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    data = [r for r in rows() if r[0] is not None][:-1]
    pieces = packing.pack(spark.createDataFrame(data, SCHEMA), path("word_bpe_49k.json"), capacity=capacity, max_piece=max(8, capacity // 4)).collect()
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    for doc, text, *_ in data:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[doc], key=lambda p: p.start)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        assert b"".join(bytes(p.ids) for p in parts) == np.array(ids, "<u4").tobytes()
        assert {p.doc_tokens for p in parts} == {len(ids)}
    for window in by_window.values():
        at = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity


def test_windows_are_full_and_equal():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1024) for _ in range(700)]
    found = packing.pack_sizes(sizes, 4096)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(700))
    assert len(found) <= -(-sum(sizes) // 4096) + 1 and max(sums) <= 4096 and max(sums) - min(sums) < 100
    assert packing.pack_sizes([], 10) == []
    assert sorted(map(tuple, packing.pack_sizes([6, 6, 6], 10))) == [(0,), (1,), (2,)]  # two windows would do for the sum alone


def test_checksum_column(spark):
    from pyspark.sql import functions as F

    p = packing.pack(spark.createDataFrame([(1, "hello there")], "doc_id long, text string"), path("word_bpe_49k.json"))
    r = p.select("ids", F.crc32("ids").alias("c")).first()
    assert r.c == zlib.crc32(bytes(r.ids))


def test_pack_odd_rows(spark):
    """Null ids, repeated rows and texts of many windows, at the capacity in use."""
    file = path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta,", "Gamma!", "x1", "naïve"]) for _ in range(30_000))
    data = [(None, "no id", None, None), (None, "no id", None, None), (1, long, None, 1), (1, long, None, 1), (2, None, None, None), (3, "", None, None)]
    pieces = packing.pack(spark.createDataFrame(data, SCHEMA), file).collect()
    size = len(t.encode(long, add_special_tokens=False).ids) + 1
    assert size > 5 * 4096
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    assert [sum(p.length for p in by[k]) for k in (None, 1, 2, 3)] == [2 * (len(t.encode("no id", add_special_tokens=False).ids) + 1), 2 * size, 1, 1]
    ids = [*t.encode(long, add_special_tokens=False).ids, 2]
    covered = np.zeros(size, int)
    for p in by[1]:
        assert bytes(p.ids) == np.array(ids[p.start : p.start + p.length], "<u4").tobytes() and p.doc_tokens == size
        covered[p.start : p.start + p.length] += 1
    assert (covered == 2).all()
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert max(fill.values()) <= 4096
