"""Repeated passages by sparse suffix arrays.

Of all word positions only those are kept whose GRAM-word gram has the least hash in some window of WINDOW grams
(minimisers): equal passages of MIN_WORDS words keep a position at the same place of both. Each kept position stands for
the suffix that starts there. Suffixes whose first gram occurs once are dropped; the others are sorted by what follows
(and, a second time, by what precedes, read backwards), compared with their neighbours, and the match is extended to the
right and left by up to CONTEXT words each; longer passages hold several kept positions, whose matches are joined.

Neighbours decide all matches of a gram that at most NEAR + 1 classes have. Of a gram of more, a passage's best partner may
lie further off in both orders; there each suffix is also entered under each of the MIN_WORDS-word passages around its
gram, and those that another document has are matches. So nothing that repeats is missed.

Suffixes with equal contexts on both sides are one class, so thousands of copies are sorted as one row, and a sort key
with many rows is split by range: neighbours on both sides of a cut meet in a second pass over the partitions' ends.
Words are compared by 32-bit hashes, grams by 64 bits, so a passage of equal hashes but other words is practically
excluded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, salted_join, text_or_empty
from .shingles import STEP, mixed, word_hashes

#: A repeated passage has MIN_WORDS words or more: GRAM + WINDOW - 1.
GRAM, WINDOW = 26, 25
MIN_WORDS = GRAM + WINDOW - 1
#: Words compared on either side of a gram.
CONTEXT = MIN_WORDS - GRAM
#: Sorted rows that each row is compared with.
NEAR = 3


def gram_hashes(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of all n-word grams, by doubling: a gram of 2k words from two of k words."""
    power, scale, size = {1: h}, {1: np.array([STEP])}, 1
    while 2 * size <= n:
        part = power[size]
        power[2 * size] = part[: len(part) - size] * scale[size] + part[size:]
        scale[2 * size] = scale[size] * scale[size]
        size *= 2
    out, done, total = None, 0, len(h) - n + 1
    for size in sorted(power, reverse=True):
        if n - done >= size:
            part = power[size][done : done + total]
            out = part if out is None else out * scale[size] + part
            done += size
    return mixed(out)


def kept_positions(grams: np.ndarray) -> np.ndarray:
    """Positions of the least gram hash of each window of WINDOW grams, the first of equal ones."""
    at = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= WINDOW:
        at = np.minimum(at[: len(at) - size], at[size:])
        size *= 2
    rest = WINDOW - size
    if rest:
        at = np.minimum(at[: len(at) - rest], at[rest:])
    return np.unique((at & np.uint64(0xFFFFFFFF)).astype(np.int64))


def contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position the CONTEXT words before it, nearest first, and the CONTEXT words behind its gram; 0 beyond the text."""
    small = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    pad = np.concatenate([np.zeros(CONTEXT, np.uint32), small, np.zeros(CONTEXT, np.uint32)])
    before = pad[at[:, None] + CONTEXT - 1 - np.arange(CONTEXT)]
    behind = pad[at[:, None] + CONTEXT + GRAM + np.arange(CONTEXT)]
    return np.concatenate([before, behind], axis=1)


_MIX = np.random.default_rng(5).integers(0, 1 << 63, 2 * CONTEXT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def class_hash(grams: np.ndarray, around: np.ndarray) -> np.ndarray:
    """64 bits of a gram with both its contexts."""
    return mixed(grams + (around.astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64))


def _positions(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            doc, text_key, pos, gram, full = [], [], [], [], []
            for d, key, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = word_hashes(t)
                if len(h) >= MIN_WORDS:
                    g = gram_hashes(h)
                    p = kept_positions(g)
                    doc += [d] * len(p)
                    text_key += [key] * len(p)
                    pos.append(p)
                    gram.append(g[p])
                    full.append(class_hash(g[p], contexts(h, p)))
            if pos:
                flat = [np.concatenate(x) for x in (pos, gram, full)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(text_key, pa.int64()), pa.array(flat[0].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in flat[1:])],
                    names=["doc_id", "text_key", "pos", "gram", "class"],
                )


def _contexts(frames):
    """gram, class, both contexts in an order that sorts, for the asked positions of each text."""
    for frame in frames:
        out = []
        for text, at in zip(frame["text"], frame["at"], strict=True):
            h = word_hashes(text)
            p = np.asarray(at, dtype=np.int64)
            g = gram_hashes(h)[p]
            around = contexts(h, p)
            full = class_hash(g, around).view(np.int64)
            wide = around.astype(">u4")
            for k in range(len(p)):
                left, right = wide[k, :CONTEXT].tobytes(), wide[k, CONTEXT:].tobytes()
                out.append((int(g[k].view(np.int64)), int(full[k]), right, left, int((around[k, :CONTEXT] > 0).sum()), int((around[k, CONTEXT:] > 0).sum())))
        yield pd.DataFrame(out, columns=["gram", "class", "after", "before", "n_before", "n_after"])


_PLACE = np.random.default_rng(7).integers(0, 1 << 63, CONTEXT + 1, dtype=np.uint64)


def _passages(frames):
    """(class, left, passage, low, high): the hash of each passage of MIN_WORDS words around a gram, left words of it before."""
    for f in frames:
        if not len(f):
            continue
        before, after = (np.frombuffer(b"".join(f[c]), dtype=">u4").reshape(len(f), CONTEXT).astype(np.uint64) for c in ("before", "after"))
        gram = f["gram"].to_numpy().view(np.uint64)
        sums = [np.concatenate([np.zeros((len(f), 1), np.uint64), np.cumsum(x * m, axis=1, dtype=np.uint64)], axis=1) for x, m in ((before, _MIX[:CONTEXT]), (after, _MIX[CONTEXT:]))]
        left = np.arange(CONTEXT + 1)
        whole = mixed(gram[:, None] + sums[0] + sums[1][:, ::-1] + _PLACE)
        row, at = np.nonzero((left <= f["n_before"].to_numpy()[:, None]) & (CONTEXT - left <= f["n_after"].to_numpy()[:, None]))
        got = f[["class", "low", "high"]].iloc[row]
        yield got.assign(left=at.astype(np.int32), passage=whole[row, at].view(np.int64))[["class", "left", "passage", "low", "high"]]


def _run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that rows of two context matrices share from the start on."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def _neighbours(frames, ends_only: bool = False):
    """Matches of each sorted row with the NEAR rows behind it, both ways; and the partition's ends, as rows of kind 1.

    A partition's stream is taken frame by frame with an overlap of NEAR rows.
    """
    columns = ["kind", "gram", "class", "after", "before", "low", "high", "left", "right", "other"]
    tail, first = None, True

    def ends(rows):
        return rows.assign(kind=1, left=0, right=0, other=0)[columns]

    for frame in frames:
        if not len(frame):
            continue
        if first and not ends_only:
            yield ends(frame.iloc[:NEAR])
        first = False
        rows = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
        rows = rows.reset_index(drop=True)
        after = np.frombuffer(b"".join(rows["after"]), dtype=">u4").reshape(len(rows), CONTEXT)
        before = np.frombuffer(b"".join(rows["before"]), dtype=">u4").reshape(len(rows), CONTEXT)
        gram, low, high = (rows[c].to_numpy() for c in ("gram", "low", "high"))
        fresh = 0 if tail is None else len(tail)
        for step in range(1, NEAR + 1):
            i = np.arange(max(0, fresh - step), len(rows) - step)
            i = i[(gram[i] == gram[i + step]) & ~((low[i] == high[i + step]) & (high[i] == low[i + step]))]
            right_, left_ = _run(after[i], after[i + step]), _run(before[i], before[i + step])
            good = right_ + left_ >= MIN_WORDS - GRAM
            i, right_, left_ = i[good], right_[good], left_[good]
            for me, you in ((i, i + step), (i + step, i)):
                single = low[me] == high[me]  # a class of several documents is matched whole already
                me, you, left, right = me[single], you[single], left_[single], right_[single]
                if len(me):
                    got = rows.iloc[me].copy()
                    other = np.where(low[you] == low[me], high[you], low[you])
                    yield got.assign(kind=0, left=left, right=right, other=other, after=b"", before=b"")[columns]
        tail = rows.iloc[-NEAR:]
    if tail is not None and not ends_only:
        yield ends(tail)


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words, other_doc: passages of MIN_WORDS words or more that recur in another document.

    Words are those of white space (`[^\\x20\\x09-\\x0D]+`), A to Z lower-cased, counted from 0; end_word is exclusive. A
    passage is a run of overlapping matches; other_doc is the least document met that shares a part of it. Passages
    that recur in their own document alone are not told; one that another document has is told wherever it stands. Null, empty and shorter texts have none, nor does an empty
    table; repeated rows are told once, as rows of one doc_id are one document; rows with a null doc_id take no part.
    """
    keep = Scratch(docs.sparkSession, "suffix")
    body = text_or_empty(text)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.cast("binary").alias("text"))
    every = keep.write(rows.mapInArrow(_positions, "doc_id long, text_key long, pos int, gram long, class long"))
    span = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    # written, so that the join's two sides are shuffled on their own and a frequent gram's rows can be split
    repeated = keep.write(every.groupBy("gram").agg(*span).where("low < high").select("gram"))
    kept = keep.write(salted_join(every, repeated, ["gram"], F.struct("doc_id", "pos"), salts=4))
    keep.drop(every, repeated)
    # one row per class: the suffixes that agree in both contexts
    one = F.min(F.struct("doc_id", "text_key", "pos")).alias("at")
    classes = keep.write(kept.groupBy("class").agg(*span, one))
    asked = classes.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(F.collect_list("at.pos").alias("at"))
    texts = rows.join(asked, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("text", "at")
    sides = texts.mapInPandas(_contexts, "gram long, class long, after binary, before binary, n_before int, n_after int")
    rowed = keep.write(sides.dropDuplicates(["class"]).join(classes.select("class", "low", "high"), "class"))
    schema = "kind int, gram long, class long, after binary, before binary, low long, high long, left int, right int, other long"
    found = None
    for order in (["gram", "after", "before", "class"], ["gram", "before", "after", "class"]):
        parts = rowed.sparkSession.conf.get("spark.sql.shuffle.partitions")
        dealt = rowed.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
        met = keep.write(dealt.mapInPandas(_neighbours, schema))
        edges = met.where("kind = 1").select("gram", "class", "after", "before", "low", "high").dropDuplicates(["class"])
        across = edges.coalesce(1).sortWithinPartitions(*order).mapInPandas(lambda it: _neighbours(it, True), schema)
        both = met.where("kind = 0").unionByName(across.where("kind = 0")).select("class", "left", "right", "other")
        found = both if found is None else found.unionByName(both)
    crowded = keep.write(rowed.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > NEAR + 1).select("gram"))
    around = keep.write(salted_join(rowed, crowded, ["gram"], F.col("class"), salts=4).mapInPandas(_passages, "class long, left int, passage long, low long, high long"))
    both = around.groupBy("passage").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
    met = salted_join(around, keep.write(both), ["passage"], F.col("class"), salts=4)
    partner = F.when(F.col("low") < F.col("high"), None).when(F.col("least") == F.col("low"), F.col("most")).otherwise(F.col("least"))
    found = found.unionByName(met.select("class", "left", (CONTEXT - F.col("left")).alias("right"), partner.alias("other")))
    whole = rowed.where("low < high").where(F.col("n_before") + F.col("n_after") >= MIN_WORDS - GRAM)
    whole = whole.select("class", F.col("n_before").alias("left"), F.col("n_after").alias("right"), F.lit(None).cast("long").alias("other"))
    spans = found.unionByName(whole).groupBy("class", "left", "right").agg(F.min("other").alias("other"))
    spans = keep.write(spans.join(classes.select("class", "low", "high"), "class"))
    keep.drop(classes, rowed)
    # the least other document: of a class of several one of its ends, else the one that was met
    other = F.when(F.col("low") == F.col("high"), F.col("other")).when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    met = kept.select("doc_id", "text_key", "pos", "class").join(spans, "class")
    met = met.select("doc_id", "text_key", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + GRAM + F.col("right")).alias("hi"), other.alias("other"))
    met = met.groupBy("doc_id", "text_key", "lo", "hi").agg(F.min("other").alias("other"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("new", F.when(F.col("lo") < reach, 0).otherwise(1))
    met = met.withColumn("passage", F.sum("new").over(order))
    out = met.groupBy("doc_id", "text_key", "passage").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"), F.min("other").alias("other_doc"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc")
