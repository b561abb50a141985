"""Connected components of an edge table."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that one task takes at once.
SMALL = 100_000


def checkpoint_dir(table: DataFrame) -> None:
    """Sees to a folder for checkpoints: the session's, or a local one where none is set."""
    import tempfile

    sc = table.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-"))


class Written:
    """Tables written as Parquet to the checkpoint folder, to cut lineage and the planner's estimates of size.

    What ``checkpoint`` gives keeps the estimate of its plan, and a join's is the product of its sides': over rounds of
    joins the estimate's digits double with each, until planning takes all the time. A file's size is its own. Tables that
    are not dropped go when the driver ends, as the result may read them until then.
    """

    def __init__(self, table: DataFrame):
        checkpoint_dir(table)
        self.spark = table.sparkSession
        self.root, self.n = f"{self.spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex[:12]}", 0

    def _path(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(sc._jsc.hadoopConfiguration())

    def write(self, table: DataFrame) -> DataFrame:
        """The rows of table, reread."""
        path = f"{self.root}/{self.n}"
        table.write.parquet(path)
        if not self.n:
            root, system = self._path(self.root)
            system.deleteOnExit(root)
        self.n += 1
        out = self.spark.read.schema(table.schema).parquet(path)
        out.written_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of ``write`` that nothing reads any more."""
        for t in tables:
            path, system = self._path(t.written_path)
            system.delete(path, True)


def _ends(frames):
    """i, up: the least node of the component of each node of edges (i, j) that has a smaller one."""
    up: dict = {}

    def end(x):
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    for f in frames:
        for i, j in zip(f["i"].tolist(), f["j"].tolist(), strict=True):
            a, b = end(i), end(j)
            if a != b:
                up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"i": list(up), "up": [end(x) for x in up]})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component. edges (i, j) go either way; nodes without any stand alone.

    Edges are contracted round by round: each node takes its least neighbour if smaller, chains of these are followed to
    their ends by doubling, then edges move to the ends; rounds are about the logarithm of a component's size. A node that
    took another leaves the edges, so the rounds' tables shrink, and are followed back from the last to the first. Once at
    most SMALL edges are left, one task does the rest.
    """
    keep = Written(nodes)
    met = edges.where("i <> j").select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"))
    left, rounds = keep.write(met.distinct()), []
    while (n := left.count()) > SMALL:
        up = keep.write(left.groupBy("i").agg(F.min("j").alias("up")))
        while True:
            above = up.select(F.col("i").alias("up"), F.col("up").alias("above"))
            jumped = keep.write(up.select("i", "up").join(above, "up", "left").select("i", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")))
            keep.drop(up)
            up = jumped
            if up.where("moved").isEmpty():
                break
        rounds.append(up)
        moved = left.join(up.select("i", F.col("up").alias("ui")), "i").where("ui <> j")
        moved = moved.join(up.select(F.col("i").alias("j"), F.col("up").alias("uj")), "j", "left").select("ui", F.coalesce("uj", "j").alias("uj")).where("ui <> uj")
        after = keep.write(moved.select(F.greatest("ui", "uj").alias("i"), F.least("ui", "uj").alias("j")).distinct())
        keep.drop(left)
        left = after
    if n:
        kind = dict(left.dtypes)["i"]
        rounds.append(keep.write(left.coalesce(1).mapInPandas(_ends, f"i {kind}, up {kind}")))
    found = None
    for up in reversed(rounds):
        labelled = up.select("i", F.col("up").alias("label"))
        if found is not None:
            ends = found.select(F.col("i").alias("label"), F.col("label").alias("end"))
            labelled = keep.write(labelled.join(ends, "label", "left").select("i", F.coalesce("end", "label").alias("label")))
            keep.drop(up)
        found = labelled if found is None else found.unionByName(labelled)
    if found is None:
        return nodes.select("node", F.col("node").alias("label"))
    labels = nodes.select("node").join(found.withColumnRenamed("i", "node"), "node", "left")
    return labels.select("node", F.coalesce("label", "node").alias("label"))


def touching(points: DataFrame, axes: list[str], same: list[str], node: str = "node") -> DataFrame:
    """(i, j): points whose integer coordinates differ by one on one axis and agree on all else; equi-joins on shifted coordinates."""
    out = None
    key = [*same, *axes]
    for axis in axes:
        a = points.select(F.col(node).alias("i"), *key)
        b = points.select(F.col(node).alias("j"), *((F.col(c) - 1).alias(c) if c == axis else F.col(c) for c in key))
        met = a.join(b, key).select("i", "j")
        out = met if out is None else out.unionByName(met)
    return out


def grid_neighbours(points: DataFrame, axes: list[str], node: str = "node") -> DataFrame:
    """``touching`` points of one grid."""
    return touching(points, axes, [], node)
