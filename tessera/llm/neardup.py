"""Near-duplicate documents by a signature-coordinate inverted join.

A document's shingle set gets a MinHash signature of K values. Documents are posted under coordinate-value pairs; two
sets of similarity 0.8 share about 0.8 K of them. Collisions are counted by prefix and skip merging:

* prefix: with pairs in ascending order of their frequency over all documents, two documents that share T pairs must
  meet within the first K - T + 1 of both, so only these are posted, and of these only pairs that occur twice at all;
* skip: the long lists beyond the prefix are never merged. Whether a candidate reaches T is told from both signatures,
  and candidates already known to be in one component are skipped.

Candidates of T collisions or more are confirmed on the full sets. Documents with equal sets are one class throughout.

No list is expanded into all its pairs at first: a round links each member with one pivot per list, the next with a
few pivots of those lists that still hold several components. Lists of more than LONG members beside their main
component after that, as of pages of one template, are dealt anew by the rarest shingles of their members, again by prefix: two sets as alike as asked share one
of them, while members that share the template alone meet nowhere. What is left is compared whole, in blocks of bounded
size: one pass names the members that have candidates there, the next holds their full sets and returns links alone. So
every pair of T collisions is confirmed, refuted or inside one component.

Bounds: a pair at similarity 0.8 reaches T = 16 of K = 32 collisions, and 0.62 of the 96 finer bytes, but for a few in a
hundred thousand. Memory per task is one Arrow batch or two blocks of BLOCK sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join, text_or_empty, unique_name
from .components import contract
from .shingles import full_sets, signed

#: Coordinates that are posted; collisions that make a candidate; further coordinates kept as one byte each.
K, T, FINE = 32, 16, 96
#: Least share of equal bytes among the FINE.
FINE_SHARE = 0.62
#: Signatures of a block in the last round, pivot classes of the second, and members beside the main component of a
#: list that is dealt anew.
BLOCK, PIVOTS, LONG = 256, 4, 1024


#: What names a pair of blocks.
GROUP = ["coordinate", "token", "bi", "bj"]


def _signed(batches, n: int):
    for b in signed(batches, n, K + FINE):
        sig = np.frombuffer(b.column(3).values.buffers()[1], dtype=np.int32)[: b.num_rows * (K + FINE)].reshape(-1, K + FINE)
        coarse = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * K + 1, K, dtype=np.int32)), pa.array(sig[:, :K].ravel()))
        fine = pa.array([x.tobytes() for x in (sig[:, K:] & 255).astype(np.uint8)], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], coarse, fine, b.column(4)], names=["doc_id", "n_shingles", "set_key", "sig", "fine", "text_key"])


def _wanted(batches):
    """The first text of each key that a row without text, sorted before it, asks for."""
    asked = None
    for b in batches:
        out = []
        for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if not t.is_valid:
                asked = k
            elif k == asked:
                out.append(t.as_py())
                asked = None
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["text"])


def _alike(frames):
    """The pairs (a, b) whose signatures agree often enough."""
    for f in frames:
        if len(f):
            same = np.stack(f["sig_a"].to_numpy()) == np.stack(f["sig_b"].to_numpy())
            fine = _bytes(f["fine_a"]) == _bytes(f["fine_b"])
            f = f[(same.sum(axis=1) >= T) & (fine.mean(axis=1) >= FINE_SHARE)]
        yield f[["a", "b"]]


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


def _groups(frames, by: list[str]):
    """The rows of each group of a sorted stream, whole."""
    key, parts = None, []
    for frame in frames:
        for k, part in frame.groupby(by, sort=False):
            if k != key and parts:
                yield pd.concat(parts) if len(parts) > 1 else parts[0]
                parts = []
            key = k
            parts.append(part)
    if parts:
        yield pd.concat(parts) if len(parts) > 1 else parts[0]


def _fitting(f: pd.DataFrame, percent: int):
    """Rows of the two sides of a block pair, and which of their pairs are candidates that belong to this list.

    A pair across components belongs to the list of the first coordinate that both post and share; in a list of a shingle
    (coordinate -1) each pair does.
    """
    left, right = f[f["side"] != 2], f[f["side"] != 1]
    if not len(left) or not len(right):
        return None
    (la, sa, fa, na, ma), (lb, sb, fb, nb, mb) = (
        (x["label"].to_numpy(), np.stack(x["sig"].to_numpy()), _bytes(x["fine"]), x["n"].to_numpy(), x["mask"].to_numpy()) for x in (left, right)
    )
    own = int(f["coordinate"].iloc[0])
    same = np.zeros((len(left), len(right)), dtype=np.int16)
    first = np.ones(same.shape, dtype=bool)
    for j in range(K):
        equal = sa[:, j][:, None] == sb[:, j][None, :]
        same += equal
        if j < own:
            first &= ~(equal & ((ma >> j & 1) > 0)[:, None] & ((mb >> j & 1) > 0)[None, :])
    fits = first & (same >= T) & (la[:, None] != lb[None, :])
    fits &= 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
    i, j = np.nonzero(fits)
    for x in range(0, len(i), 65536):
        bad = (fa[i[x : x + 65536]] == fb[j[x : x + 65536]]).mean(axis=1) < FINE_SHARE
        fits[i[x : x + 65536][bad], j[x : x + 65536][bad]] = False
    return left, right, fits


def _needed(frames, percent: int):
    """The members of each block pair that have a candidate there."""
    for f in _groups(frames, GROUP):
        if (met := _fitting(f, percent)) is not None:
            left, right, fits = met
            need = set(left["node"].to_numpy()[fits.any(axis=1)]) | set(right["node"].to_numpy()[fits.any(axis=0)])
            yield f.loc[f["node"].isin(need), [*GROUP, "side", "node", "label"]]


def _linked(frames, percent: int):
    """Links among the candidates of each block pair, confirmed on the full sets; pairs that these links already join are skipped."""
    for f in _groups(frames, GROUP):
        if (met := _fitting(f, percent)) is None:
            continue
        left, right, fits = met
        up: dict = {}

        def root(x):
            while x in up:
                x = up[x]
            return x

        a, la, sa = (left[c].to_numpy() for c in ("node", "label", "shingles"))
        b, lb, sb = (right[c].to_numpy() for c in ("node", "label", "shingles"))
        out = []
        for i in np.flatnonzero(fits.any(axis=1)):
            js = np.flatnonzero(fits[i])
            here = root(la[i])
            js = js[[root(lb[j]) != here for j in js]]
            if not len(js):
                continue
            sizes = np.array([len(sb[j]) for j in js])
            flat = np.concatenate([sb[j] for j in js])
            mine = np.sort(sa[i])  # 64-bit hashes come signed
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *sizes[:-1]]))
            for j in js[100 * both >= percent * (len(mine) + sizes - both)]:
                if (x := root(la[i])) != (y := root(lb[j])):
                    up[x] = y
                    out.append((a[i], b[j]))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


class Finder:
    """The classes of equal sets of a table, and the components of their links.

    A class stands for its rows by the least of (null doc_id last, doc_id, hash of the text).
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, n: int, percent: int):
        self.percent, self.n = percent, n
        self.keep = Scratch(docs.sparkSession, "neardup")
        body = text_or_empty(text)
        self.rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.cast("binary").alias("text"), F.xxhash64(body).alias("text_key"))
        self.signed = self.keep.write(
            self.rows.mapInArrow(lambda it: _signed(it, n), "doc_id long, n_shingles long, set_key binary, sig array<int>, fine binary, text_key long")
        )
        full = self.signed.where("n_shingles > 0")
        at = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
        first = full.groupBy("set_key").agg(
            F.min(at).alias("at"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("fine").alias("fine")
        )
        self.classes = self.keep.write(first.withColumn("node", F.monotonically_increasing_id()))

    def postings(self) -> DataFrame:
        """(token, node): the prefix of each class, where another class has the token too."""
        token = F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
        pairs = self.classes.select("node", F.explode(token).alias("token"))
        # written, so that the join's two sides are shuffled on their own and a frequent token's rows can be split
        often = self.keep.write(pairs.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"))
        shared = pairs.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("shared"))
        prefix = F.slice("shared", F.lit(1), F.size("shared") - T + 1)
        return shared.where(F.size("shared") >= T).select("node", F.explode(prefix).alias("p")).select(F.col("p.token").alias("token"), "node")

    def full_sets(self) -> DataFrame:
        """(node, shingles) of the posted classes, from one text of each: wanted keys and texts meet in one sorted stream."""
        n = self.n
        key = ["unnamed", "doc_id", "text_key", "salt"]
        # a text without doc_id may have any number of rows: they are dealt over some places
        salts = F.when(F.col("unnamed"), F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(0)))
        wanted = self.posted.select("at.*").distinct().withColumn("salt", F.explode(salts))
        rows = self.rows.withColumns({"unnamed": F.col("doc_id").isNull(), "salt": F.when(F.col("doc_id").isNull(), F.pmod(F.spark_partition_id(), F.lit(16))).otherwise(0)})
        both = wanted.withColumn("text", F.lit(None).cast("binary")).unionByName(rows.select(*key, "text"))
        met = both.repartition(*key).sortWithinPartitions(*key, F.col("text").isNotNull())
        keyed = met.select(F.xxhash64(*key).alias("k"), "text")
        found = keyed.mapInArrow(lambda it: full_sets(_wanted(it), n), "set_key binary, shingles array<long>")
        return found.join(self.posted.select("node", "set_key"), "set_key").select("node", "shingles").dropDuplicates(["node"])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of candidates whose full sets are as alike as asked."""
        sets = [self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b")]
        met = pairs.join(sets[0], "a").join(sets[1], "b")
        both = F.size(F.array_intersect("sa", "sb"))
        either = F.size("sa") + F.size("sb") - both
        return met.where(100 * both >= self.percent * either).select("a", "b")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that collide often enough and whose sizes allow the similarity."""
        ends = [self.posted.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("sig", "fine", "n"))) for x in ("a", "b")]
        met = pairs.join(ends[0], "a").join(ends[1], "b")
        met = met.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        return met.select("a", "b", "sig_a", "sig_b", "fine_a", "fine_b").mapInPandas(_alike, "a long, b long")

    def by_pivot(self, lists: DataFrame, pivots: int) -> DataFrame:
        """Distinct pairs of different components, each member of a list (token, node, label) with one pivot of it."""
        kind = F.pmod("token", F.lit(pivots))
        pick = F.struct((F.xxhash64("node", kind) if pivots > 1 else F.col("node")).alias("by"), "node", "label")
        pivot = lists.groupBy("token").agg(F.min(pick).alias("p")).select("token", F.col("p.node").alias("pivot"), F.col("p.label").alias("pivot_label"))
        pivot = self.keep.write(pivot)
        met = lists.join(pivot, "token").where("label <> pivot_label")
        return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    def several(self, met: DataFrame) -> DataFrame:
        """(token, node, label, main, most, size) of the lists of a written table that hold several components; main is the one of most members."""
        counts = met.groupBy("token", "label").agg(F.count("*").alias("c"))
        some = counts.groupBy("token").agg(F.max_by("label", "c").alias("main"), F.max("c").alias("most"), F.sum("c").alias("size"), F.count("*").alias("labels"))
        return met.join(self.keep.write(some.where("labels > 1").drop("labels")), "token")

    def by_shingle(self, lists: DataFrame) -> DataFrame:
        """Lists by shingle in place of long ones: each member under the rarest shingles of its set, as many as leave too few others.

        Of a set of n shingles a partner holds percent * n / 100 at least, so among its rarest n less that, and one, is a
        shared one, in any order that all sets follow. Shingles that one member alone has come first and are posted nowhere.
        """
        members = self.keep.write(lists.select("node", "label").distinct())
        each = members.join(self.sets, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
        often = self.keep.write(each.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"))
        met = salted_join(each, often, ["token"], F.col("node"))
        shared = met.groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "token"))).alias("shared"))
        n_posted = (F.size("shared") - F.ceil(F.col("n") * self.percent / 100) + 1).cast("int")
        prefix = F.slice("shared", F.lit(1), F.greatest(n_posted, F.lit(0)))
        return self.several(self.keep.write(shared.select("node", "label", F.explode(prefix).alias("p")).select("p.token", "node", "label")))

    def in_blocks(self, lists: DataFrame) -> DataFrame:
        """Links (a, b) between different components that join all which any link joins, from whole lists in blocks.

        ``lists`` has (coordinate, token, node, label, main, most, size). Members of the main component aren't compared
        with each other, so a list of one large component and a few others is a row per member and block of the others.
        Work goes with the pairs compared, not with the bytes, so the number of tasks is fixed and not left to their size.
        """
        signs = ("sig", "fine", "n", "mask")
        met = lists.join(self.posted.select("node", *signs), "node")
        rest, main = (F.ceil(c / BLOCK).cast("int") for c in (F.col("size") - F.col("most"), F.col("most")))
        met = met.withColumns({"rest": rest, "blocks": rest + main, "is_main": F.col("label") == F.col("main")})
        number = F.xxhash64("node")
        own = F.when(F.col("is_main"), F.col("rest") + F.pmod(number, F.col("blocks") - F.col("rest"))).otherwise(F.pmod(number, F.col("rest")))
        last = F.when(F.col("is_main"), F.col("rest")).otherwise(F.col("blocks")) - 1
        met = met.withColumns({"own": own.cast("int"), "other": F.explode(F.sequence(F.lit(0), last))})
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        met = met.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other"), "side": side})
        spark, percent = lists.sparkSession, self.percent
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

        def dealt(rows: DataFrame) -> DataFrame:
            return rows.repartition(tasks, *GROUP).sortWithinPartitions(*GROUP)

        compared = dealt(met.select(*GROUP, "side", "node", "label", *signs))
        needed = self.keep.write(compared.mapInPandas(lambda it: _needed(it, percent), "coordinate int, token long, bi int, bj int, side int, node long, label long"))
        full = needed.join(self.posted.select("node", *signs), "node").join(self.sets, "node")
        return dealt(full).mapInPandas(lambda it: _linked(it, percent), "a long, b long")

    def components(self) -> DataFrame:
        """(node, label) of the posted classes; every other class stands alone."""
        keep = self.keep
        postings = keep.write(self.postings())
        bit = F.expr("shiftleft(1L, cast(shiftright(token, 32) as int))")
        nodes = postings.groupBy("node").agg(F.bit_or(bit).alias("mask"))
        self.posted = keep.write(self.classes.join(nodes, "node").select("node", "set_key", "at", "sig", "fine", "n", "mask"))
        self.sets = keep.write(self.full_sets())
        labels = keep.write(self.posted.select("node", F.col("node").alias("label")))
        for pivots in (1, PIVOTS, 0):
            met = keep.write(postings.join(labels, "node"))
            lists = keep.write(self.several(met))
            if pivots:
                pairs = keep.write(self.alike(self.by_pivot(lists, pivots)))
                links = keep.write(self.confirmed(pairs))
                keep.drop(pairs)
            else:
                others = F.col("size") - F.col("most")
                short = lists.where(others <= LONG).withColumn("coordinate", F.shiftright("token", 32).cast("int"))
                anew = self.by_shingle(lists.where(others > LONG)).withColumn("coordinate", F.lit(-1))
                links = keep.write(self.in_blocks(short.unionByName(anew)))
            after = contract(labels, links, keep)
            keep.drop(met, lists, links)
            labels = after
        keep.drop(postings, self.posted, self.sets)
        return labels

    def named(self) -> DataFrame:
        """(set_key, at): the row that stands for the component of each class."""
        classed = self.classes.select("node", "set_key", "at").join(self.components(), "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = classed.groupBy("label").agg(F.min("at").alias("least"))
        return self.keep.write(classed.join(least, "label").select("set_key", F.col("least").alias("at")))


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    A document's set holds its distinct n-word shingles (words `[^\\x20\\x09-\\x0D]+`, A to Z lower-cased); with fewer
    words the whole sequence is one; a null, empty or blank text has none and is linked with nothing. Two documents are
    linked if 100 * intersection >= percent * union. component_id is the least doc_id that links reach, kept whether it
    is the document's own. Repeated rows share a component; a row with null doc_id is compared like any other, its own
    id names no component unless the component has no other, and its kept is null or false. An empty table gives no row.
    """
    find = Finder(docs, doc_id, text, n, percent)
    named = find.named().select("set_key", F.col("at.doc_id").alias("component_id"))
    out = find.signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key"))
    out = out.join(named, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without all but one of each component: that of the least doc_id (null ones last), then hash of the text.

    Null, empty and blank texts are in no component and stay. Rows that repeat both doc_id and text count as one row; of
    a doc_id with several texts each text is a row of its own. An empty table gives no row. Columns are those of docs.
    """
    find = Finder(docs, doc_id, text, n, percent)
    key = ["unnamed", "doc_id", "text_key"]
    blank = find.signed.where("n_shingles = 0").select(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    alone = find.named().select("at.*").distinct().unionByName(blank.distinct())
    names = [unique_name(f"kept_{k}", docs.columns) for k in key]
    alone = alone.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).toDF(*names)
    values = [F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.xxhash64(text_or_empty(text))]
    marked = docs.withColumns(dict(zip(names, values, strict=True)))
    return marked.join(alone, names, "left_semi").dropDuplicates(names).select(docs.columns)
